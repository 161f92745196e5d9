"""Exact vector search: filters first, then the k best scores, ties by id.

One pass over the vectors: each task scores its batches by numpy and reports its k best keys
for each query, and only those are merged. Other columns of the winners, if asked for, are
looked up by key afterwards; which of several rows of a key won is told by a hash of its
vector, so that no score is ever computed twice and compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, isfinite
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdoc.functions.values import is_number
from loomdoc.functions.vectors import METRICS, sparse_score
from loomdoc.operators.filters import predicate
from loomdoc.sources.scratch import scratch

MOST_NUMBERS, MOST_SPACES, MOST_DIMENSIONS = 1_000_000, 64, 1_000_000_000
#: Query vectors that are broadcast at once.
BLOCK = 1_024


class VectorError(ValueError):
    """A vector, a space or a query that is not valid."""


def checked_dense(v: Any) -> list[float]:
    if not isinstance(v, (list, tuple)) or not 0 < len(v) <= MOST_NUMBERS or not all(is_number(x) and isfinite(x) for x in v):
        raise VectorError("a dense vector is a list of finite numbers")
    return [float(x) for x in v]


def checked_sparse(v: Any) -> tuple[list[int], list[float]]:
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    if not isinstance(v, dict) or not whole(v.get("dimensions")) or not 0 < v["dimensions"] <= MOST_DIMENSIONS:
        raise VectorError("a sparse vector has dimensions, indices and values")
    i, x = v.get("indices"), v.get("values")
    if not isinstance(i, list) or not isinstance(x, list) or len(i) != len(x) or not all(map(whole, i)) or any(b <= a for a, b in zip(i, i[1:], strict=False)) or i and not (0 <= i[0] and i[-1] < v["dimensions"]):
        raise VectorError("indices are distinct, rising and below the dimensions, one for each value")
    if not all(is_number(y) and isfinite(y) for y in x):
        raise VectorError("values are finite numbers")
    return i, [float(y) for y in x]


@dataclass(frozen=True)
class Space:
    """A declared vector space of a collection."""

    dimensions: int
    kind: str = "dense"
    metric: str = "cosine"
    required: bool = False

    def violated(self, c: Column) -> Column:
        """Is a value of this space missing or of the wrong shape?"""
        missing = F.lit(True) if self.required else F.lit(False)
        if self.kind == "dense":
            bad = (F.size(c) != self.dimensions) | F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        else:
            bad = (c["dimensions"] != self.dimensions) | (F.size(c["indices"]) != F.size(c["values"])) | F.exists(c["indices"], lambda i: (i < 0) | (i >= self.dimensions)) | (F.array_sort(F.array_distinct(c["indices"])) != c["indices"])
        return F.when(c.isNull(), missing).otherwise(F.coalesce(bad, F.lit(True)))


def split_by_schema(df: DataFrame, spaces: dict[str, Space]) -> tuple[DataFrame, DataFrame]:
    """(rows that fit the declared spaces, rows that do not)."""
    if not 0 < len(spaces) <= MOST_SPACES:
        raise VectorError(f"a schema has 1 to {MOST_SPACES} spaces")
    bad = F.lit(False)
    for name, space in spaces.items():
        bad = bad | space.violated(F.col(name) if name in df.columns else F.col("vectors").getItem(name))
    return df.where(~bad), df.where(bad)


def space_column(df: DataFrame, name: str | None, default: str) -> Column:
    """A named space out of the map ``vectors``, or a column of its own."""
    if name is None or name in df.columns:
        return F.col(name or default)
    if "vectors" in df.columns and isinstance(df.schema["vectors"].dataType, T.MapType):
        return F.try_element_at("vectors", F.lit(name))
    raise VectorError(f"no space {name!r}")


def search(
    df: DataFrame, vector: list[float], k: int = 10, metric: str = "cosine", query: Any = None, modality: str | None = None, name: str | None = None, key: str = "id", column: str = "vector", payload: bool = True,
) -> DataFrame:
    """The k nearest rows with their score; key and score alone without ``payload``. Rows that lack the vector, have another length or no finite score take no part; of repeated ids the best row counts."""
    v = checked_dense(vector)
    if k <= 0:
        raise VectorError("k is at least 1")
    if metric not in METRICS:
        raise VectorError(f"unknown metric {metric!r}")
    df = df.where(predicate(query, df.schema))
    if modality is not None:
        df = df.where(F.col("modality") == modality)
    c = space_column(df, name, column)
    near = _ranked(df, c, {len(v): (np.zeros(1, int), np.array([v], float))}, metric, k, key)
    winners = near.orderBy(F.desc("score"), "id").limit(k)
    if not payload:
        return winners.select(F.col("id").alias(key), "score")
    won = F.broadcast(winners.select("id", "score", "mark"))  # k rows
    rows = df.join(won, (df[key] == won["id"]) & (_mark(c) == won["mark"])).dropDuplicates([key])
    return rows.select(*(df[x] for x in df.columns if x != "score"), won["score"]).orderBy(F.desc("score"), F.asc(key)).limit(k)


def _mark(c: Column) -> Column:
    return F.xxhash64(c.cast("array<double>"))


def _ranked(df: DataFrame, c: Column, block: dict[int, tuple[np.ndarray, np.ndarray]], metric: str, k: int, key: str, by_query: bool = False) -> DataFrame:
    """q, id, score and mark of the tasks' best rows for a block of queries, one for each query and id. by_query: dealt by query, which ranking them wants too."""
    rows = df.where(c.isNotNull()).select(F.col(key).alias("id"), c.cast("array<double>").alias("v"), _mark(c).alias("mark"))
    kinds = f"q int, id {df.schema[key].dataType.simpleString()}, score double, mark long"
    best = rows.mapInPandas(_best(block, metric, k), kinds)  # k rows of each query and task at most
    best = best.repartition("q") if by_query else best
    return best.groupBy("q", "id").agg(F.max(F.struct("score", "mark")).alias("b")).select("q", "id", "b.score", "b.mark")


def search_sparse(df: DataFrame, vector: dict, k: int = 10, metric: str = "dot", query: Any = None, name: str | None = None, key: str = "id", column: str = "vector") -> DataFrame:
    """As ``search``, over sparse vectors struct<dimensions, indices, values> of the query's dimensions."""
    i, x = checked_sparse(vector)
    df = df.where(predicate(query, df.schema))
    c = space_column(df, name, column)
    near = sparse_score(metric, c["indices"].cast("array<int>"), c["values"].cast("array<double>"), F.lit(i).cast("array<int>"), F.lit(x).cast("array<double>"))
    return top(df.withColumn("score", F.when(c["dimensions"] == vector["dimensions"], near)), k, key)


def top(scored: DataFrame, k: int, key: str) -> DataFrame:
    """The k best rows of a table with scores, one for each key, ties by key. The rows themselves are reduced, not looked up."""
    columns = [F.col(f"`{c}`") for c in scored.columns]
    best = scored.where(F.col("score").isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), "score").alias("_row"))
    return best.orderBy(F.desc("_row.score"), F.asc(key)).limit(k).select("_row.*")


def _scores(metric: str, v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Scores of all rows of v by all rows of q; not finite where a row has a component that is not. Sums that overflow are formed again from scaled vectors; a score beyond all doubles is an error."""
    kind = METRICS[metric]
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        dot = v @ q.T
        if kind == "l2":
            out = -np.stack([np.sqrt(((v - x) ** 2).sum(1)) for x in q], 1)
        elif kind == "dot":
            out = dot
        else:
            sizes = np.sqrt((v * v).sum(1))[:, None] * np.sqrt((q * q).sum(1))[None]
            out = np.where(sizes < 1e-12, 0.0, dot / np.maximum(sizes, 1e-300))
            out[~(np.isfinite(dot) & np.isfinite(sizes))] = np.nan
        for i, j in np.argwhere(~np.isfinite(out) & np.isfinite(v).all(1)[:, None]):
            out[i, j] = _scaled(kind, v[i], q[j])
    return out


def _scaled(kind: str, a: np.ndarray, b: np.ndarray) -> float:
    """The score of two vectors whose sums leave the doubles, by parts of 1 at most."""
    pa, pb = max(np.abs(a).max(), 1e-300), max(np.abs(b).max(), 1e-300)
    if kind == "l2":
        p = max(pa, pb)
        size = np.linalg.norm(a / p - b / p)
        score = -float(size) * p
    elif kind == "dot":
        score = float((a / pa) @ (b / pb)) * pa * pb
    else:
        x, y = a / pa, b / pb
        return float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y)))
    if not isfinite(score):
        raise VectorError("vector_score_out_of_range")
    return score


def _best(block: dict[int, tuple[np.ndarray, np.ndarray]], metric: str, k: int, meets: dict[int, set[int]] | None = None):
    """A task's k best ids of each query: (place of the query, id, score, mark). meets: the queries (by place) that rows of a cell are held against; all of them without it."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def cut() -> pd.DataFrame:
            rows = pd.concat(held).sort_values(["q", "score", "id"], ascending=[True, False, True], kind="stable").drop_duplicates(["q", "id"])
            return rows.groupby("q", sort=False).head(k)

        for b in batches:
            sizes = b["v"].map(lambda x: -1 if x is None else len(x)).to_numpy()
            for n, (places, q) in block.items():
                here = np.flatnonzero(sizes == n)
                cells = b["cell"].to_numpy()[here] if meets is not None else np.zeros(len(here), int)
                for cell in np.unique(cells):
                    asked = np.array([i for i, p in enumerate(places) if meets is None or p in meets.get(int(cell), ())], int)
                    rows = here[cells == cell]
                    if not len(asked) or not len(rows):
                        continue
                    s = _scores(metric, np.stack(b["v"].iloc[rows].to_numpy()).astype(float), q[asked])
                    ids, marks, good = b["id"].to_numpy()[rows], b["mark"].to_numpy()[rows], np.isfinite(s)
                    if len(rows) > k and len(set(ids)) == len(ids):  # the k best of each query, and what ties with the last
                        x = np.where(good, s, -np.inf)
                        good &= x >= np.partition(x, len(rows) - k, axis=0)[len(rows) - k]
                    i, j = np.nonzero(good)
                    held.append(pd.DataFrame({"q": places[asked][j], "id": ids[i], "score": s[i, j], "mark": marks[i]}))
            if sum(map(len, held)) > 100_000 + 2 * k * sum(len(p) for p, _ in block.values()):
                held = [cut()]
        if held:
            yield cut()

    return best


def search_many(df: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", key: str = "id", column: str = "vector", query_key: str = "query_id", block: int = BLOCK) -> DataFrame:
    """query_id, rank, id, score of the k nearest rows for each query vector (query_id, vector).

    Queries come in blocks of a counted size. Tasks score a batch of rows by a whole block at
    once and report k rows of each query. One block is answered lazily; several are answered
    one after the other and written below the shared folder, so that neither the driver nor
    the plan ever holds more than one.
    """
    if metric not in METRICS:
        raise VectorError(f"unknown metric {metric!r}")
    return in_blocks(df.sparkSession, queries, query_key, block, lambda held: _ranked(df, F.col(column), held, metric, k, key, by_query=True), k)


def in_blocks(spark: SparkSession, queries: DataFrame, query_key: str, block: int, answer, k: int) -> DataFrame:
    """query_id, rank, id, score over all blocks of queries; answer(vectors by length) gives (q, id, score) of one."""
    asked = queries.where(F.col("vector").isNotNull()).select(F.col(query_key).alias("query_id"), F.col("vector").cast("array<double>").alias("q"))
    first, path, kind, out = asked.limit(block + 1).collect(), None, queries.schema[query_key].dataType, None
    parts = 1 if len(first) <= block else ceil(asked.count() / block)
    for p in range(parts):
        mine = asked.where(F.pmod(F.hash("query_id"), F.lit(parts)) == p).collect() if parts > 1 else first  # about ``block``
        by: dict[int, list[int]] = {}
        for i, r in enumerate(mine):
            by.setdefault(len(r.q), []).append(i)
        held = {n: (np.array(at), np.array([mine[i].q for i in at], float)) for n, at in by.items() if n}
        names = spark.createDataFrame([(i, r.query_id) for i, r in enumerate(mine)], T.StructType([T.StructField("q", T.IntegerType()), T.StructField("query_id", kind)]))
        w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        best = answer(held).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).join(F.broadcast(names), "q").select("query_id", "rank", "id", "score")
        if parts == 1:
            return best
        path = path or scratch(spark, "searches")
        best.write.mode("append").parquet(path)
        out = best.schema
    return spark.read.schema(out).parquet(path)
