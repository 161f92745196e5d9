"""Quality classifier by Bradley-Terry ranking.

Documents are described by figures of their whole text, of which one is lexical: the mean
of how much oftener its words occur in good labelled documents than in poor ones (a
labelled document leaves itself out of these counts). Each preference pair (a good document
over a poor one, all pairs of all labelled documents) is an observation of a Bradley-Terry model:
the logistic loss of the difference of their features teaches one utility for all documents.
The utility at the quantile of the training scores that equals the share of poor documents
is the threshold; a monotone curve maps it to ``accept`` (0.3) and utilities to 0..1.

Counts, model, threshold and curve come from all labelled documents outside the held-out
fold. Their features stay in the cluster: each step of the fit is a pass whose sums are all
that the driver gets. The pairs, whose number is the product of both kinds, are summed
through interpolation in the utility (see ``_moments``), to about 1e-12 of a term.

Defined cases: null text counts as empty text and gets a score like any other; with no
label, or labels of one kind only, every score is 0.5; repeated rows score alike; other
columns, whatever their names, are neither read nor changed.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from functools import cache, cached_property, partial
from itertools import chain
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm.common import bound_batches, fold, labelled, settle, table, tidy

#: A word is known that so many labelled documents hold.
LEAST_DOCS = 20
#: Documents of either kind that are added to a word's, so that few say little.
PRIOR = 5.0
#: Pairs of nodes that are looked at together, rows of features that are, and texts whose words are, to look them up or to count them.
TILE, BLOCK, TEXTS, COUNTED = 1 << 22, 8_192, 256, 512
#: Utilities are interpolated in cells so wide, by so many Chebyshev nodes: the poles of the logistic function are at pi from the real line, so the error falls as 6.4 ** -NODES.
WIDTH, NODES = 2.0, 16
#: Tasks of a pass over the features at most, as each sends its sums to the driver.
PASS_TASKS = 32
SLOPES = np.geomspace(0.05, 20, 60)
ACCEPT, MOD, HELD = 0.3, 5, 0

_UPPER, _LOWER, _DIGIT, _SPACE, _PLAIN, _ODD, _MARK = range(7)


@cache
def _classes() -> np.ndarray:
    """The class of each code point of the basic plane; what lies beyond counts as odd."""
    kinds = np.full(65_536 + 1, _ODD, np.uint8)
    for c in range(65_536):
        kind = unicodedata.category(chr(c))
        if kind in ("Lu", "Lt"):
            kinds[c] = _UPPER
        elif kind[0] == "L":
            kinds[c] = _LOWER
        elif kind[0] == "M":
            kinds[c] = _MARK
        elif kind[0] == "N":
            kinds[c] = _DIGIT
        elif kind[0] == "Z" or chr(c) in "\t\n\r\v\f":
            kinds[c] = _SPACE
    for c in ".,;:'\"-()?’“”«»¿¡":
        kinds[ord(c)] = _PLAIN
    return kinds


FEATURES = 14
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


@dataclass(frozen=True, eq=False)
class Words(Mapping):
    """How many poor and good documents hold each word; columns by code points, as there may be millions."""

    words: pa.Array = field(default_factory=lambda: pa.array([], pa.string()))
    poor: np.ndarray = field(default_factory=lambda: np.zeros(0))
    good: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def of(cls, rows: pa.Table) -> Words:
        rows = rows.take(pc.sort_indices(rows["word"]))
        words = rows["word"].cast(pa.string()).combine_chunks()
        return cls(words, rows["poor"].to_numpy().astype(float), rows["good"].to_numpy().astype(float))

    def __len__(self) -> int:
        return len(self.words)

    def __iter__(self) -> Iterator[str]:
        return (w.as_py() for w in self.words)

    def __getitem__(self, word: str) -> tuple[int, int]:
        i = bisect_left(range(len(self)), word, key=lambda i: self.words[i].as_py())
        if i == len(self) or self.words[i].as_py() != word:
            raise KeyError(word)
        return int(self.poor[i]), int(self.good[i])

    def ratios(self, sizes: tuple[int, int], own: int | None = None) -> np.ndarray:
        """The log ratios of the shares of good and of poor documents that hold each word; own: the label of a document that leaves itself out."""
        p, g = own == 0, own == 1
        return np.log((self.good - g + PRIOR) / (sizes[1] - g + 2 * PRIOR) * (sizes[0] - p + 2 * PRIOR) / (self.poor - p + PRIOR))

    def lexical(self, texts: list[str | None], ratios: np.ndarray, kinds: np.ndarray | None = None) -> np.ndarray:
        """Of each text the mean ratio of its known words, whatever their order; ratios: a row for each kind of text."""
        own = [words_of(t) for t in texts]
        doc = np.repeat(np.arange(len(own)), [len(w) for w in own])
        at = pc.index_in(pa.array(chain.from_iterable(own), pa.string()), value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False)
        doc, at = np.divmod(np.sort(doc[at >= 0] * len(self) + at[at >= 0]), max(1, len(self)))
        total = np.bincount(doc, ratios[0 if kinds is None else kinds[doc], at], len(own))
        return total / (np.bincount(doc, minlength=len(own)) + 20)

    def described(self, texts: list[str | None], ratios: np.ndarray, kinds: np.ndarray | None = None) -> np.ndarray:
        """The features of each text."""
        out = np.zeros((len(texts), FEATURES))
        for i in range(0, len(texts), TEXTS):
            some = texts[i : i + TEXTS]
            out[i : i + TEXTS] = [features(t) for t in some]
            out[i : i + TEXTS, -1] = self.lexical(some, ratios, None if kinds is None else kinds[i : i + TEXTS])
        return out


def features(text: str | None, evidence: float = 0.0) -> list[float]:
    """Figures of a whole text, the last of them lexical; shares are shrunk so that a word or two of a short text weigh little."""
    text = text or ""
    words = text.split()
    n, lines = len(words), text.split("\n")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    up, low, digit, space, plain, odd, mark = np.bincount(_classes()[np.minimum(codes, 65_536)], minlength=7).tolist()
    letters, chars = up + low, max(1, len(text) - space)
    again = sum(map(eq, words, words[1:]))
    skip = sum(map(eq, words, words[2:]))
    distinct = len(set(words))
    bare = [x for x in lines if x and not x.isspace()]
    return [
        up / (letters + 20),
        digit / (chars + 20),
        plain / (chars + 20),
        min(1.0, odd / (chars + 20) * 5),
        odd / (chars + 20),
        mark / (chars + 20),
        again / (n + 20),
        min(1.0, again / (n + 20) * 5),
        skip / (n + 20),
        np.log1p(distinct) / np.log1p(n + 20),
        min(20.0, letters / (n + 5)),
        1 - len(set(bare)) / (len(bare) + 2),
        float(np.log1p(n)),
        evidence,
    ]


@dataclass(frozen=True)
class QualityModel:
    """score = sigmoid(slope * (utility - threshold) + logit(accept))"""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float
    accept: float = ACCEPT
    #: word: poor and good labelled documents that hold it; sizes: all of them
    known: Words = field(default_factory=Words)
    sizes: tuple[int, int] = (0, 0)

    @cached_property
    def ratios(self) -> np.ndarray:
        return self.known.ratios(self.sizes)[None]

    def described(self, texts: list[str | None]) -> np.ndarray:
        return self.known.described(texts, self.ratios)

    def utility(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.slope:
            return np.full(len(x), 0.5)
        z = self.slope * (self.utility(x) - self.threshold) + np.log(self.accept / (1 - self.accept))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def bradley_terry(better: np.ndarray, worse: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """For given pairs: weights w that minimise the mean of log(1 + exp(-w (better - worse))) + ridge |w|^2 / 2, by Newton's method."""
    d = better - worse
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        gradient = ridge * w - d.T @ p / len(d)
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


#: What a pass makes of a block of rows (features and labels): arrays by keys.
Part = Callable[[np.ndarray, np.ndarray], Iterable[tuple[int, np.ndarray]]]
#: A pass over all rows: these arrays, added up by key.
Sums = Callable[[Part], dict[int, np.ndarray]]


def _added(parts: Iterable[tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    out: dict[int, np.ndarray] = {}
    for key, value in parts:
        out[key] = out[key] + value if key in out else value
    return out


def _by_blocks(part: Part, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for i in range(0, len(x), BLOCK):
        yield from part(x[i : i + BLOCK], y[i : i + BLOCK])


def sums_here(x: np.ndarray, y: np.ndarray) -> Sums:
    """Passes over rows in memory."""
    return lambda part: _added(_by_blocks(part, x, y))


def sums_of(figures: DataFrame) -> Sums:
    """Passes over the rows (x, label) of a table."""
    figures = figures.coalesce(PASS_TASKS)
    schema = pa.schema([("task", pa.int32()), ("key", pa.int64()), ("value", pa.binary())])

    def sums(part: Part) -> dict[int, np.ndarray]:
        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = ((b.column("x").flatten().to_numpy().reshape(-1, FEATURES), b.column("label").to_numpy()) for b in batches)
            found = _added(chain.from_iterable(_by_blocks(part, x, y) for x, y in blocks))
            task = TaskContext.get().partitionId()
            for key, value in found.items():
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(([task], [key], [value.tobytes()]), schema, strict=True)], schema=schema)

        rows = figures.mapInArrow(summed, "task int, key long, value binary").collect()
        return _added((r.key, np.frombuffer(r.value)) for r in sorted(rows, key=lambda r: (r.task, r.key)))

    return sums


def _utilities(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """z @ w, each row by itself, so that it is the same number in any block."""
    return (z * w).sum(1)


@cache
def _nodes() -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a cell, as fractions of its width, and what makes Lagrange polynomials at them of Chebyshev polynomials."""
    at = np.cos((np.arange(NODES) + 0.5) * np.pi / NODES)
    to = np.cos(np.arange(NODES)[:, None] * np.arccos(at)[None]) * 2 / NODES
    to[0] /= 2
    return (at + 1) / 2, to


def _moments(x: np.ndarray, y: np.ndarray, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Moments of the features by kind, cell of the utility and node: sums of 1, z and z z' weighted by the nodes' Lagrange polynomials.

    A sum over pairs of f(u - v) times figures of either row is then a sum over pairs of
    nodes, as f at any u is interpolated from f at the nodes of its cell.
    """
    z = (x - mean) / scale
    u = _utilities(z, w) / WIDTH
    cell = np.floor(u)
    near = np.cos(np.arccos(np.clip(2 * (u - cell) - 1, -1, 1))[:, None] * np.arange(NODES)) @ _nodes()[1]
    i, j = np.triu_indices(z.shape[1])
    figures = np.hstack([np.ones((len(z), 1)), z, z[:, i] * z[:, j]])
    key = cell.astype(np.int64) * 2 + y
    for k in np.unique(key):
        own = np.flatnonzero(key == k)
        yield int(k), (near[own].T @ figures[own]).ravel()


def _of_kind(found: dict[int, np.ndarray], y: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the nodes of a kind, and the moments there."""
    keys = sorted(k for k in found if k & 1 == y)
    at = np.concatenate([((k >> 1) + _nodes()[0]) * WIDTH for k in keys])
    return at, np.concatenate([found[k].reshape(NODES, -1) for k in keys])


def bradley_terry_sums(sums: Sums, sizes: tuple[int, int], mean: np.ndarray, scale: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights w that minimise the mean of log(1 + exp(-w (b - c))) over all pairs of a good row b and a poor row c, + ridge |w|^2 / 2, by Newton's method, a pass a step."""
    d = len(mean)
    w, n = np.zeros(d), float(sizes[0]) * sizes[1]
    i, j = np.triu_indices(d)
    for _ in range(steps):
        found = sums(partial(_moments, mean=mean, scale=scale, w=w))
        (low, worse), (high, better) = _of_kind(found, 0), _of_kind(found, 1)
        gradient, second, cross = np.zeros(d), np.zeros(len(i)), np.zeros((d, d))
        step = max(1, TILE // len(low))
        for k in range(0, len(high), step):
            b = better[k : k + step]
            p = 1 / (1 + np.exp(np.clip(high[k : k + step, None] - low[None], -500, 500)))
            by = p @ worse[:, : d + 1]
            gradient += b[:, 0] @ by[:, 1:] - by[:, 0] @ b[:, 1 : d + 1]
            by = (p * (1 - p)) @ worse
            second += by[:, 0] @ b[:, d + 1 :] + b[:, 0] @ by[:, d + 1 :]
            cross += b[:, 1 : d + 1].T @ by[:, 1 : d + 1]
        curve = np.zeros((d, d))
        curve[i, j] = curve[j, i] = second
        change = np.linalg.solve((curve - cross - cross.T) / n + ridge * np.eye(d), gradient / n + ridge * w)
        w = w - change
        if np.abs(change).max() < 1e-7:
            break
    return w


def bradley_terry_all(better: np.ndarray, worse: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """The same weights for rows in memory, as they are."""
    d = better.shape[1]
    rows = np.vstack([worse, better]), np.repeat([0, 1], [len(worse), len(better)])
    return bradley_terry_sums(sums_here(*rows), (len(worse), len(better)), np.zeros(d), np.ones(d), ridge, steps)


def _moved(x: np.ndarray, y: np.ndarray, mean: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """By kind: the rows' number, sums from the mean and sums of their squares."""
    for k in (0, 1):
        own = x[y == k] - mean
        yield k, np.concatenate([[len(own)], own.sum(0), (own**2).sum(0)])


def _ordered(u: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values."""
    bits = u.view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _bins(x: np.ndarray, y: np.ndarray, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, shift: int, begins: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """The rows by the next 16 bits of their utilities' order, for each beginning of it."""
    keys = _ordered(_utilities((x - mean) / scale, w))
    for k, begin in enumerate(begins):
        own = keys if shift == 48 else keys[keys >> np.uint64(shift + 16) == np.uint64(begin)]
        yield k, np.bincount((own >> np.uint64(shift) & np.uint64(0xFFFF)).astype(int), minlength=1 << 16).astype(float)


def ranked(sums: Sums, ranks: Iterable[int], mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> list[float]:
    """The utilities of these ranks, from 0, among those of all rows, in four passes that count."""
    found = [(0, rank) for rank in ranks]
    for shift in (48, 32, 16, 0):
        begins = sorted({begin for begin, _ in found})
        ends = {k: np.cumsum(v) for k, v in sums(partial(_bins, mean=mean, scale=scale, w=w, shift=shift, begins=begins)).items()}
        for i, (begin, rest) in enumerate(found):
            end = ends[begins.index(begin)]
            at = int(np.searchsorted(end, rest, side="right"))
            found[i] = (begin << 16 | at, rest - int(end[at - 1] if at else 0))
    keys = np.array([key for key, _ in found], np.uint64)
    return np.where(keys >> np.uint64(63), keys ^ np.uint64(1 << 63), ~keys).view(float).tolist()


def _losses(x: np.ndarray, y: np.ndarray, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, threshold: float, off: float) -> Iterator[tuple[int, np.ndarray]]:
    """The logistic loss by slope."""
    u = _utilities((x - mean) / scale, w) - threshold
    yield 0, np.logaddexp(0, np.where(y == 1, -1, 1)[:, None] * (u[:, None] * SLOPES + off)).sum(0)


def fit_features(sums: Sums, n: int = FEATURES, accept: float = ACCEPT, reject: float | None = None) -> QualityModel:
    """Fit to all rows that the passes see, of n features. reject: the quantile of the training scores below which documents go; the share of label 0 if None."""
    by = sums(partial(_moved, mean=np.zeros(n)))
    bad, good = (int(by[k][0]) if k in by else 0 for k in (0, 1))
    if not good or not bad:
        return QualityModel(np.zeros(n), np.ones(n), np.zeros(n), 0.0, 0.0, accept)
    rows = bad + good
    mean = (by[0] + by[1])[1 : n + 1] / rows
    by = sums(partial(_moved, mean=mean))
    scale = np.sqrt((by[0] + by[1])[n + 1 :] / rows) + 1e-6
    at = {"mean": mean, "scale": scale, "w": bradley_terry_sums(sums, (bad, good), mean, scale)}
    cut = int(round((bad / rows if reject is None else reject) * rows))
    threshold = sum(ranked(sums, (min(rows - 1, max(0, cut - 1)), min(rows - 1, cut)), **at)) / 2
    off = float(np.log(accept / (1 - accept)))
    loss = sums(partial(_losses, **at, threshold=threshold, off=off))[0] / rows + 1e-4 * SLOPES
    return QualityModel(mean, scale, at["w"], threshold, float(SLOPES[int(np.argmin(loss))]), accept)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", accept: float = ACCEPT, reject: float | None = None) -> QualityModel:
    """Learn from all labelled documents outside the held-out fold."""
    bound_batches(docs.sparkSession)
    with tidy(docs.sparkSession):
        return _fitted(labelled(docs, labels, label, MOD, HELD), accept, reject)


def _fitted(rows: DataFrame, accept: float, reject: float | None) -> QualityModel:
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (b[i : i + COUNTED] for b in batches for i in range(0, len(b), COUNTED)):
            seen = (Counter(), Counter())
            for text, y in zip(b["text"], b["label"], strict=True):
                seen[y].update(words_of(text))
            words = sorted(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"word": words, "poor": [seen[0][w] for w in words], "good": [seen[1][w] for w in words]})

    held = rows.groupBy("label").count().collect()
    sizes = (sum(r["count"] for r in held if r.label == 0), sum(r["count"] for r in held if r.label == 1))
    counts = rows.mapInPandas(counted, "word string, poor long, good long").groupBy("word").agg(F.sum("poor").alias("poor"), F.sum("good").alias("good"))
    known = Words.of(settle(counts.where(F.col("poor") + F.col("good") >= LEAST_DOCS), "words").toArrow())  # a few dozen bytes a word
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def figures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        without = np.array([shared.value.ratios(sizes, y) for y in (0, 1)])
        for b in batches:
            x = shared.value.described(list(b["text"]), without, b["label"].to_numpy())
            yield pd.DataFrame({"x": list(x), "label": b["label"]})

    found = settle(rows.mapInPandas(figures, "x array<double>, label int"), "figures")
    return replace(fit_features(sums_of(found), FEATURES, accept, reject), known=known, sizes=sizes)


def score(spark: SparkSession, model: QualityModel, text: Column) -> Column:
    """The score of each text as a column."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(shared.value.score(shared.value.described([v if isinstance(v, str) else None for v in t])))

    return scored(text.cast("string"))


def keep_good(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    model = fit(docs, labels, **fitting)
    return docs.where(score(docs.sparkSession, model, docs["text"]) >= model.accept)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return docs.select(
        "doc_id", (fold(docs["doc_id"], MOD) == HELD).alias("held_out"), score(spark, model, docs["text"]).alias("score")
    ).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
