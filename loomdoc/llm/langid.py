"""Language identification by words first, with a backoff to character n-grams.

Known words score by their log frequency in each language. A word that no language knows
is read piece by piece: at each position the longest known n-gram counts, from
``ORDER`` characters down to one. The language with the highest mean wins; the score is
its share of the softmax over the languages.

A frequency is (n + 1/2) / sum; so an item's log frequency in a language is that of an item
never seen there plus log(2 n + 1), and only the languages that have the item are kept with
it. All words and n-grams of the sample are known: the sample's rows are the only bound.

Defined cases: null text and text without a letter (Unicode category L) get ``und`` with
score 0; rows whose lang is null teach nothing; with nothing to learn from, every text gets
``und`` with score 0; of equal languages the first by code point wins; repeated rows get
equal predictions; other columns are neither read nor changed. Languages are names, few
enough for the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm.common import bound_batches, fold, settle, share, table, tidy

#: At most about so many documents are learned from, but about LEAST_EACH of each language; n-grams have up to ORDER characters.
MOST_ROWS, LEAST_EACH, ORDER = 20_000, 20, 4
#: Bytes of the words' rows that a worker keeps: few words of many languages, many of few.
CACHE_BYTES = 64 << 20
MOD, HELD = 4, 2
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str) -> Counter:
    """The runs of letters of a text, in lower case. Python's word characters also hold numbers such as fractions, which are no letters."""
    found = Counter(_WORD.findall(text.lower()))
    for w in [w for w in found if not w.isalpha()]:
        n = found.pop(w)
        for part in _LETTERS.findall(w):
            found[part] += n
    return found


def grams(word: str) -> Iterator[str]:
    """All n-grams of a word between its edges, up to ORDER characters."""
    w = f" {word} "
    for n in range(1, ORDER + 1):
        for i in range(len(w) - n + 1):
            yield w[i : i + n]


@dataclass(frozen=True)
class Items:
    """What each known item adds in the languages that have it (rows of one sparse matrix), and the log frequency in each language of an item it lacks."""

    rows: dict[str, int]
    starts: np.ndarray
    at: np.ndarray
    add: np.ndarray
    lacking: np.ndarray

    def sums(self, owners: list[int], items: list[int], weights: list[float], n: int) -> np.ndarray:
        """n rows: for each owner the weighted sum of what its items add in each language."""
        i, langs = np.array(items, int), len(self.lacking)
        sizes = self.starts[i + 1] - self.starts[i]
        flat = np.repeat(self.starts[i] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        places = np.repeat(np.array(owners, int) * langs, sizes) + self.at[flat]
        return np.bincount(places, self.add[flat] * np.repeat(np.array(weights, float), sizes), n * langs).reshape(n, langs)


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    words: Items
    grams: Items

    def pieces(self, word: str) -> tuple[list[int], int]:
        """The longest known n-grams that read the word from left to right, and how many steps that takes; a character that none starts at is a step alone."""
        w, i, n, found = f" {word} ", 0, 0, []
        known = self.grams.rows
        while i < len(w):
            for k in range(min(ORDER, len(w) - i), 0, -1):
                if (g := known.get(w[i : i + k])) is not None:
                    found.append(g)
                    break
            else:
                k = 1
            n, i = n + 1, i + k
        return found, n

    def logs(self, words: list[str]) -> np.ndarray:
        """The log frequency of each word in each language: its own, or the mean of its pieces'."""
        own, parts = ([], []), ([], [], [])
        for r, w in enumerate(words):
            if (i := self.words.rows.get(w)) is not None:
                own[0].append(r)
                own[1].append(i)
            else:
                found, n = self.pieces(w)
                parts[0].extend([r] * len(found))
                parts[1].extend(found)
                parts[2].extend([1 / n] * len(found))
        whole = np.zeros((len(words), 1), bool)
        whole[own[0]] = True
        out = np.where(whole, self.words.lacking, self.grams.lacking)
        return out + self.words.sums(*own, [1.0] * len(own[0]), len(words)) + self.grams.sums(*parts, len(words))

    def predictor(self):
        most = max(256, CACHE_BYTES // (8 * max(1, len(self.langs))))
        known: dict[str, int] = {}
        rows = np.zeros((256, len(self.langs)))

        def places(words: list[str]) -> np.ndarray:
            """Where the rows of so many words as fit are; a full cache starts anew."""
            nonlocal rows
            if len(known) + len(words) > most:
                known.clear()
            if new := [w for w in words if w not in known]:
                first = len(known)
                known.update(zip(new, range(first, first + len(new)), strict=True))
                while len(known) > len(rows):
                    rows = np.concatenate([rows, np.zeros_like(rows)])
                rows[first : len(known)] = self.logs(new)
            return np.array([known[w] for w in words], int)

        def predict(text: str | None) -> tuple[str, float]:
            counts = words_of(text) if text and self.langs else Counter()
            if not counts:
                return UNKNOWN, 0.0
            words, n, total = list(counts), np.fromiter(counts.values(), float, len(counts)), sum(counts.values())
            mean = sum(n[i : i + most] @ rows[at] for i in range(0, len(words), most) if len(at := places(words[i : i + most]))) / total
            best = int(np.argmax(mean))
            z = np.exp((mean - mean[best]) * min(total, 50))
            return self.langs[best], float(1 / z.sum())

        return predict


def fit(docs: DataFrame, most: int = MOST_ROWS) -> LanguageModel:
    """Learn from text and lang of documents outside the held-out fold: about ``most`` of them, an equal share of each language as far as it has so many, the same in each run."""
    bound_batches(docs.sparkSession)
    with tidy(docs.sparkSession):
        return _fitted(docs, most)


def _fitted(docs: DataFrame, most: int) -> LanguageModel:
    spark = docs.sparkSession
    lang, open_ = F.col("lang").cast("string"), F.col("lang").isNotNull() & (fold(F.col("doc_id"), MOD) != HELD)
    sizes = [(r.lang, r["count"]) for r in docs.where(open_).groupBy(lang.alias("lang")).count().collect()]
    each, left = float(most), most
    for i, (_, c) in enumerate(sorted(sizes, key=lambda x: x[1])):  # small languages whole; what they leave of their share goes to the others
        each = left / (len(sizes) - i)
        if c > each:
            break
        left -= c
    else:
        each = float(most)
    names = sorted(x for x, _ in sizes)
    place = {x: i for i, x in enumerate(names)}
    parts = F.broadcast(spark.createDataFrame([(x, place[x], min(1.0, max(each, LEAST_EACH) / c)) for x, c in sizes], "lang string, at int, part double"))
    mine = docs.where(open_).select("doc_id", lang.alias("lang"), F.col("text").cast("string").alias("text")).join(parts, "lang")
    mine = mine.where((F.col("part") >= 1) | (share(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) < F.col("part")))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words: dict[int, Counter] = {}
            for text, own in zip(b["text"], b["at"], strict=True):
                words.setdefault(own, Counter()).update(words_of(text) if isinstance(text, str) else ())
            out = []
            for own, found in words.items():
                pieces: Counter = Counter()
                for w, c in found.items():
                    for g in grams(w):
                        pieces[g] += c
                out += [(own, 0, w, c) for w, c in found.items()] + [(own, 1, g, c) for g, c in pieces.items()]
            yield pd.DataFrame(out, columns=["at", "kind", "item", "n"])

    counts = mine.select("text", "at").mapInPandas(counted, "at int, kind int, item string, n long").groupBy("at", "kind", "item").agg(F.sum("n").alias("n"))
    rows = settle(counts.groupBy("kind", "item").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("of")), "langid")  # an entry for each language that has the item
    used = [r[0] for r in rows.select(F.explode("of.at").alias("at")).distinct().orderBy("at").collect()]
    new = np.zeros(len(names), np.int32)
    new[used] = np.arange(len(used))
    return LanguageModel(tuple(names[i] for i in used), *(_items(rows.where(F.col("kind") == kind), new, len(used)) for kind in (0, 1)))


def _items(rows: DataFrame, new: np.ndarray, langs: int) -> Items:
    """One of the model's tables, straight from Arrow's arrays: the driver holds no Python object but the items' names."""
    got = rows.select("item", F.col("of.at").alias("at"), F.col("of.n").alias("n")).toArrow()
    if not got.num_rows:
        return Items({}, np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0), np.zeros(langs))
    item, at, n = (c.combine_chunks() for c in got.columns)
    item, at, n = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (item, at, n))
    own, count = new[at.flatten().to_numpy(zero_copy_only=False)], n.flatten().to_numpy(zero_copy_only=False).astype(float)
    starts = np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False))])
    lacking = np.log(0.5 / (np.bincount(own, count, langs) + 0.5 * (len(item) + 1)))
    return Items({x.as_py(): i for i, x in enumerate(item)}, starts.astype(np.int64), own, np.log(2 * count + 1), lacking)


def predict(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """struct<lang_pred, score> of each text."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = shared.value.predictor()
        for t in texts:
            yield pd.DataFrame([of(v if isinstance(v, str) else None) for v in t], columns=["lang_pred", "score"])

    return predicted(text.cast("string"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    return docs.select("doc_id", (fold(docs["doc_id"], MOD) == HELD).alias("held_out"), predict(spark, model, docs["text"]).alias("_p")).select(
        "doc_id", "held_out", F.col("_p.lang_pred").alias("lang_pred"), F.col("_p.score").alias("score")
    )
