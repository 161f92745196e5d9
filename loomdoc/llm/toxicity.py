"""Toxicity by a counterfactually regularised linear classifier.

A text is the set of the hashed features of its words: the word, its beginnings and its
inner character n-grams. A logistic model with non-negative, sparse weights learns which
of them mark toxic documents. Labelled sentences that name a group are repeated with the
group term swapped for the others of its kind, and the squared change of the score is
penalised, so that group terms as such carry no weight. All labelled sentences of the
sample are swapped; each distinct change of features counts once.

Defined cases: null text counts as empty text and gets the model's base score; with no
label, or labels of one kind only, every score is a constant just below 0.5, so that
nothing is called toxic; repeated rows score alike; other columns are neither read nor
changed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm.common import bound_batches, fold, labelled, settle, table, tidy

#: At most about so many labelled rows are learned from, and so many features are kept.
MOST_ROWS, MOST_FEATURES = 12_000, 8_192
#: Words kept with their features by a worker, before it starts anew.
MOST_CACHED = 500_000
ACCEPT, MOD, HELD = 0.5, 5, 0
#: The penalties on weights and on changes by swaps, against a loss in which either class weighs one half.
L1, SWAP = 4e-3, 10.0

#: Terms of groups; those of one line are swapped for each other.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("immigrants", "refugees", "natives", "foreigners", "citizens"),
    ("deaf", "blind", "disabled", "autistic", "paralyzed"),
    ("old", "young", "elderly", "teenage"),
    ("femmes", "hommes", "chrétiens", "musulmans", "juifs", "immigrés"),
    ("mujeres", "hombres", "cristianos", "musulmanes", "judíos", "inmigrantes"),
    ("frauen", "männer", "christen", "muslime", "juden", "einwanderer"),
)

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+")
_GROUP = {t: g for g in IDENTITY_TERMS for t in g}
_TERM = re.compile(r"\b(" + "|".join(map(re.escape, _GROUP)) + r")\b")


def word_features(word: str) -> list[int]:
    """Hashes of a word: itself, its beginnings and its inner 4- and 5-grams."""
    own = [f"={word}"]
    own += [f"^{word[:n]}" for n in range(3, min(7, len(word)) + 1)]
    own += [word[i : i + n] for n in (4, 5) for i in range(1, len(word) - n + 1)]
    return [xxhash.xxh32_intdigest(x) for x in own]


class Features(dict):
    """The features of each word, made when first asked for; only those in ``among``, as positions, if given."""

    def __init__(self, among: dict[int, int] | None = None):
        self.among = among

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > MOST_CACHED:
            self.clear()
        found = set(word_features(word))
        self[word] = out = tuple(found) if self.among is None else tuple(self.among[x] for x in found if x in self.among)
        return out

    def of(self, text: str) -> set[int]:
        out: set[int] = set()
        for w in set(_WORD.findall(text.lower())):
            if own := self[w]:
                out.update(own)
        return out


def swaps(text: str) -> Iterator[tuple[str, str]]:
    """Each sentence that names a group, with each swap of one of its terms."""
    text = text.lower()
    if not _TERM.search(text):
        return
    for s in _SENTENCE.findall(text):
        for m in _TERM.finditer(s):
            for other in _GROUP[m[0]]:
                if other != m[0]:
                    yield s, f"{s[: m.start()]}{other}{s[m.end() :]}"


@dataclass(frozen=True)
class ToxicityModel:
    """weights: by the hash of a feature; base: the logit of a text with none of them."""

    weights: dict[int, float] = field(default_factory=dict)
    base: float = -1e-9

    def scorer(self):
        """Scores of a batch of texts."""
        known = Features({h: i for i, h in enumerate(self.weights)})
        by = np.array([*self.weights.values(), 0.0])

        def score(texts: list[str | None]) -> np.ndarray:
            found = [sorted(known.of(t)) if t else () for t in texts]
            row = np.repeat(np.arange(len(found)), [len(x) for x in found])
            z = self.base + np.bincount(row, by[[i for x in found for i in x] or np.zeros(0, int)], len(found))
            return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

        return score


def fit_sparse(rows: list[list[int]], y: np.ndarray, deltas: list[tuple[list[int], list[int]]], n: int, l1: float = L1, swap: float = SWAP, steps: int = 800) -> tuple[np.ndarray, float]:
    """Non-negative weights and a base that minimise class-balanced logistic loss + l1 |w| + swap mean((w delta)^2), by accelerated proximal steps."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols = np.array([c for r in rows for c in r], int)
    d_at = np.array([i for i, (a, b) in enumerate(deltas) for _ in [*a, *b]], int)
    d_cols = np.array([c for a, b in deltas for c in [*a, *b]], int)
    d_sign = np.array([s for a, b in deltas for s in [-1.0] * len(a) + [1.0] * len(b)])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    # Lipschitz bounds by rows and columns: |X|^2 <= (most in a row) * (weighted most in a column)
    longest = max([len(r) for r in rows] or [1]) + 1
    bound = 0.25 * max(np.bincount(cols, weight[at], n).max(initial=0), weight.sum()) * longest
    if deltas:
        bound += 2 * swap * max(np.bincount(d_at, minlength=1).max(), 1) * max(np.bincount(d_cols, minlength=1).max(initial=0), 1) / len(deltas)
    rate = 8 / max(bound, 1e-9)
    w, base = np.zeros(n), 0.0

    def loss(w: np.ndarray, base: float) -> tuple[float, np.ndarray, float]:
        z = np.bincount(at, w[cols], len(rows)) + base
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        e = weight * (p - y)
        value, g = float((weight * np.logaddexp(0, np.where(y == 1, -z, z))).sum()), np.bincount(cols, e[at], n)
        if deltas:
            change = np.bincount(d_at, d_sign * w[d_cols], len(deltas))
            value += swap * float(np.mean(change**2))
            g = g + 2 * swap / len(deltas) * np.bincount(d_cols, d_sign * change[d_at], n)
        return value, g, float(e.sum())

    last_w, last_b, t = w, base, 1.0
    for _ in range(steps):
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w + (t - 1) / t_next * (w - last_w), base + (t - 1) / t_next * (base - last_b)
        value, g, gb = loss(v, vb)
        while True:
            new_w, new_b = np.maximum(0, v - rate * (g + l1)), vb - rate * gb
            dw, db = new_w - v, new_b - vb
            if rate < 1e-7 or loss(new_w, new_b)[0] <= value + g @ dw + gb * db + (dw @ dw + db * db) / (2 * rate) + 1e-12:
                break
            rate /= 2
        last_w, last_b, w, base, t = w, base, new_w, new_b, t_next
        if np.abs(w - last_w).max(initial=0) < 1e-6 and abs(base - last_b) < 1e-6:
            break
    return w, base


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_ROWS, swap: float = SWAP) -> ToxicityModel:
    """Learn from the labelled documents outside the held-out fold; ``swap`` weighs the counterfactual penalty."""
    bound_batches(docs.sparkSession)
    with tidy(docs.sparkSession):
        return _fitted(labelled(docs, labels, label, MOD, HELD, most), swap)


def _fitted(rows: DataFrame, swap: float) -> ToxicityModel:
    spark = rows.sparkSession

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Features()
        for b in batches:
            seen, n = (Counter(), Counter()), [0, 0]
            for text, y in zip(b["text"], b["label"], strict=True):
                n[y] += 1
                seen[y].update(known.of(text))
            yield pd.DataFrame({"h": [*seen[0].keys() | seen[1].keys(), -1]}).assign(
                neg=lambda d, s=seen, n=n: [n[0] if h < 0 else s[0][h] for h in d.h], pos=lambda d, s=seen, n=n: [n[1] if h < 0 else s[1][h] for h in d.h]
            )

    counts = settle(rows.mapInPandas(counted, "h long, neg long, pos long").groupBy("h").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")), "counts")
    total = F.broadcast(counts.where("h < 0").select(F.col("neg").alias("n0"), F.col("pos").alias("n1")))  # one row
    a, b = (F.col("pos") + 0.5) / (F.col("n1") + 1), (F.col("neg") + 0.5) / (F.col("n0") + 1)
    best = (
        counts.where("h >= 0 and pos >= 2")
        .join(total)
        .where("n0 > 0 and n1 > 0")
        .select("h", ((a - b) / F.sqrt(F.col("pos") + F.col("neg") + 1) * F.sqrt(F.col("n0") + F.col("n1"))).alias("z"))
        .where("z > 0")
        .orderBy(F.desc("z"), "h")
        .limit(MOST_FEATURES)
    )
    chosen = [r.h for r in best.collect()]
    if not chosen:
        return ToxicityModel()
    among = spark.sparkContext.broadcast({h: i for i, h in enumerate(sorted(chosen))})

    def chosen_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Features(among.value)
        for b in batches:
            out = []
            for text, y in zip(b["text"], b["label"], strict=True):
                out.append((y, sorted(known.of(text)), None))
                for s, other in swaps(text):
                    x, z = known.of(s), known.of(other)
                    if x != z:
                        out.append((-1, sorted(x - z), sorted(z - x)))
            yield pd.DataFrame(out, columns=["label", "a", "b"])

    made = settle(rows.mapInPandas(chosen_of, "label int, a array<int>, b array<int>"), "made")
    train = sorted((r.label, list(r.a)) for r in made.where("label >= 0").collect())  # a row for each of the sample
    deltas = sorted((list(r.a), list(r.b)) for r in made.where("label < 0").select("a", "b").distinct().collect())
    known = Features(among.value)
    for group in IDENTITY_TERMS:  # the bare terms too, so that those which no labelled sentence holds weigh the same
        deltas += [(sorted(x - z), sorted(z - x)) for s, o in zip(group, group[1:], strict=False) if (x := known.of(s)) != (z := known.of(o))]
    y = np.array([y for y, _ in train], float)
    w, base = fit_sparse([x for _, x in train], y, deltas, len(chosen), swap=swap)
    # The penalty that chooses features also holds their weights down; those chosen are fitted again with little of it.
    kept = {int(i): j for j, i in enumerate(np.flatnonzero(w > 0))}
    if kept:
        only = lambda x: [kept[i] for i in x if i in kept]
        again, base = fit_sparse([only(x) for _, x in train], y, [(only(a), only(b)) for a, b in deltas], len(kept), l1=L1 / 20, swap=swap)
        w = np.zeros(len(chosen))
        w[list(kept)] = again
    return ToxicityModel({h: float(w[i]) for h, i in among.value.items() if w[i] > 0}, base)


def score(spark: SparkSession, model: ToxicityModel, text: Column) -> Column:
    """The score of each text as a column."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = shared.value.scorer()
        for t in texts:
            yield pd.Series(of([v if isinstance(v, str) else None for v in t]), dtype=float)

    return scored(text.cast("string"))


def drop_toxic(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The documents whose score stays below ``accept``, with all their columns."""
    return docs.where(score(docs.sparkSession, fit(docs, labels), docs["text"]) < accept)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return docs.select(
        "doc_id", (fold(docs["doc_id"], MOD) == HELD).alias("held_out"), score(spark, model, docs["text"]).alias("score")
    ).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
