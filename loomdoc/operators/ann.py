"""Approximate vector search: an inverted file of k-means cells with exact re-ranking.

The centres are fitted on a bounded sample; every row is assigned to a cell and written by
cell, so that a probe reads only its cells. How many cells are probed is found at build
time: rows held back from the fit are searched exactly, and so many cells are read as hold
``AIM`` of their true neighbours. The index records the metric, the source's version, the
probes and the recall measured with them.

A path holds generations of cells: an update writes the cells it touches as a new one, and the
index names the generation of each cell, so that searches that have begun, failed updates
and the former rows of emptied cells are no concern.

Each length of vectors has centres, probes and recall of its own. Empty vectors and such with
a value that is null or not finite have no score in exact search either, and are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from math import ceil, sqrt
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdoc.functions.vectors import METRICS
from loomdoc.operators.vector_search import BLOCK, VectorError, _best, _mark, checked_dense, in_blocks, search, search_many

MOST_SAMPLE, MOST_CELLS = 20_000, 4_096
#: Rows of each length in the sample, even of rare ones; parts that shares of rows are cut into.
LEAST_SAMPLE, SHARES = 64, 1 << 53
#: Recall demanded of the default search, aimed at on the held-back rows, how many of them at most, and neighbours of each.
LEAST_RECALL, AIM, MOST_HELD, NEIGHBOURS = 0.9, 0.95, 200, 10
STATES = ("ABSENT", "QUEUED", "BUILDING", "READY", "STALE", "FAILED")


@dataclass
class Index:
    """A built index: its options, centres and where its rows lie."""

    name: str
    path: str
    column: str = "vector"
    metric: str = "cosine"
    key: str = "id"
    state: str = "READY"
    source_version: int = 0
    centres: list[list[float]] = field(default_factory=list)
    probes: dict[int, int] = field(default_factory=dict)
    recall: dict[int, float] = field(default_factory=dict)
    generation: int = 0
    #: cell: its generation, if it is not the first
    newer: dict[int, int] = field(default_factory=dict)

    def manifest(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def of(manifest: str) -> Index:
        held = json.loads(manifest)
        return Index(**held | {k: {int(n): v for n, v in held[k].items()} for k in ("probes", "recall", "newer")})

    def rows(self, spark: SparkSession) -> DataFrame:
        """The rows of all cells; a filter on _cell prunes folders."""
        rows = spark.read.parquet(self.path)
        if not self.newer:
            return rows.where("_generation = 0").drop("_generation")
        at = F.create_map(*(F.lit(x) for pair in self.newer.items() for x in pair))
        return rows.where(F.col("_generation") == F.coalesce(F.try_element_at(at, F.col("_cell")), F.lit(0))).drop("_generation")

    def write(self, rows: DataFrame, generation: int) -> None:
        rows.withColumn("_generation", F.lit(generation)).write.mode("overwrite" if not generation else "append").partitionBy("_generation", "_cell").parquet(self.path)


def lloyd(points: np.ndarray, k: int, rounds: int = 12, seed: int = 20) -> np.ndarray:
    """k centres of a sample, the same ones in each run."""
    deal = np.random.default_rng(seed)
    centres = points[deal.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        cell = ((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None]).argmin(1)
        for c in np.unique(cell):
            centres[c] = points[cell == c].mean(0)
    return centres


def _ready(points: np.ndarray, metric: str) -> np.ndarray:
    return points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-30) if METRICS[metric] == "cosine" else points


def build(df: DataFrame, path: str, name: str = "default", column: str = "vector", metric: str = "cosine", key: str = "id", cells: int | None = None, version: int = 0) -> Index:
    """Fit the centres, assign every row and write the rows by cell."""
    if metric not in METRICS:
        raise VectorError(f"unknown metric {metric!r}")
    spark = df.sparkSession
    vectors = df.where(_scored(F.col(column)))
    sizes = {r[0]: r[1] for r in vectors.groupBy(F.size(column)).count().collect()}  # lengths, a few
    if not sizes:
        raise VectorError("nothing to index")
    n = sum(sizes.values())
    limits = F.create_map(*(F.lit(x) for m, c in sizes.items() for x in (m, int(min(1.0, max(LEAST_SAMPLE / c, MOST_SAMPLE / n)) * SHARES))))
    sample: dict[int, list] = {}
    for r in vectors.where(F.pmod(F.xxhash64(key), F.lit(SHARES)) < F.element_at(limits, F.size(column))).select(F.col(column).cast("array<double>").alias("v")).orderBy("v").collect():
        sample.setdefault(len(r.v), []).append(r.v)
    index, held = Index(name, path, column, metric, key, source_version=version), []
    for m in sorted(sizes):
        raw = np.array(sample.get(m) or [[0.0] * m])
        order = np.random.default_rng(21).permutation(len(raw))
        apart, fitted = np.split(order, [min(MOST_HELD, len(raw) // 10)])
        k = max(1, round(cells * sizes[m] / n)) if cells else max(1, ceil(sqrt(sizes[m])) // 2)
        centres = lloyd(_ready(raw[fitted], metric), min(MOST_CELLS, k))
        index.centres += centres.tolist()
        index.probes[m] = len(centres)
        held += list(raw[apart])
    index.write(assign(vectors, index), 0)
    _measure(spark, index, held)
    return index


def _scored(c: Column) -> Column:
    """Can a vector have a score?"""
    bad = F.exists(c.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & ~bad


def _cells(index: Index, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and centres of the cells of one length."""
    ids = np.array([i for i, c in enumerate(index.centres) if len(c) == length], int)
    return ids, np.array([index.centres[i] for i in ids], float).reshape(len(ids), length)


def _by_length(v: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors) of a batch, without null and empty ones."""
    sizes = np.array([0 if x is None else len(x) for x in v], int)
    for m in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == m)
        yield int(m), rows, np.array(v.iloc[rows].tolist(), float).reshape(len(rows), m)


def _nearest(index: Index, q: np.ndarray) -> np.ndarray:
    """The cells of each query, all of one length, the nearest first."""
    ids, centres = _cells(index, q.shape[1])
    q = _ready(q, index.metric)
    away = (centres**2).sum(1)[None] - 2 * q @ centres.T if METRICS[index.metric] != "dot" else -(q @ centres.T)
    return ids[np.argsort(away, 1, kind="stable")]


def _measure(spark: SparkSession, index: Index, held: list[np.ndarray]) -> None:
    """Set the probes that reach AIM on held-back rows, and the recall they reach. A held-back row's first neighbour, itself, does not count. With nothing to measure on, all cells are probed."""
    if not held:
        return
    rows = index.rows(spark)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(held)], "query_id int, vector array<double>")
    true = search_many(rows, asked, NEIGHBOURS + 1, index.metric, index.key, index.column).where("rank > 1").select("query_id", "id")
    places = [{c: i + 1 for i, c in enumerate(_nearest(index, v[None])[0].tolist())} for v in held]
    needed: dict[int, list[int]] = {}
    # MOST_HELD times NEIGHBOURS of each length; a repeated key may lie in cells of another length too.
    for r in rows.select(F.col(index.key).alias("id"), "_cell").join(F.broadcast(true), "id").collect():
        if r["_cell"] in places[r.query_id]:
            needed.setdefault(len(held[r.query_id]), []).append(places[r.query_id][r["_cell"]])
    for m, at in needed.items():
        index.probes[m] = sorted(at)[ceil(AIM * len(at)) - 1]
        index.recall[m] = sum(x <= index.probes[m] for x in at) / len(at)


def assign(df: DataFrame, index: Index) -> DataFrame:
    """The rows with the cell of their vector; null if the index has none of its length."""

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), dtype="Int32")
        for m, rows, raw in _by_length(v):
            ids, centres = _cells(index, m)
            if len(ids):
                out.iloc[rows] = ids[((centres**2).sum(1)[None] - 2 * _ready(raw, index.metric) @ centres.T).argmin(1)]
        return out

    return df.withColumn("_cell", cell(F.col(index.column).cast("array<double>")))


def search_index(spark: SparkSession, index: Index, vector: list[float], k: int = 10, probes: int | None = None, query: Any = None, version: int | None = None) -> DataFrame:
    """The k best rows of the nearest cells, by their exact scores. A stale index raises."""
    if index.state != "READY" or version is not None and version != index.source_version:
        raise VectorError(f"index {index.name} is {'STALE' if index.state == 'READY' else index.state}")
    v = checked_dense(vector)
    nearest = _nearest(index, np.array([v]))[0][: probes or index.probes.get(len(v), 1)]
    rows = index.rows(spark).where(F.col("_cell").isin(*map(int, nearest))).drop("_cell")
    return search(rows, v, k, index.metric, query, key=index.key, column=index.column)


def search_index_many(spark: SparkSession, index: Index, queries: DataFrame, k: int = 10, probes: int | None = None, query_key: str = "query_id", block: int = BLOCK) -> DataFrame:
    """query_id, rank, id, score for many queries (query_id, vector).

    Queries are taken in blocks, which go to the rows: each task holds the rows of a cell
    against the queries that probe it. No vector is shuffled and no cell is a key, however
    many rows it has.
    """

    def answer(held: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        meets: dict[int, set[int]] = {}
        for n, (places, q) in held.items():
            for place, cells in zip(places, _nearest(index, q)[:, : probes or index.probes.get(n, 1)], strict=True):
                for c in cells.tolist():
                    meets.setdefault(c, set()).add(int(place))
        rows = index.rows(spark).where(F.col("_cell").isin(*meets) if meets else F.lit(False))
        c = F.col(index.column)
        rows = rows.select(F.col(index.key).alias("id"), c.cast("array<double>").alias("v"), _mark(c).alias("mark"), F.col("_cell").alias("cell"))
        near = rows.mapInPandas(_best(held, index.metric, k, meets), f"q int, id {rows.schema['id'].dataType.simpleString()}, score double, mark long")
        return near.repartition("q").groupBy("q", "id").agg(F.max("score").alias("score"))

    return in_blocks(spark, queries, query_key, block, answer, k)


def route(df: DataFrame, vector: list[float], index: Index | None, mode: str = "auto", fallback: bool = True, probes: int | None = None, **how) -> tuple[DataFrame, dict]:
    """Exact or approximate search, and a report of what was done. Filters, a modality, and a space, key or metric that the index is not about make it exact; an index's metric, key and column hold unless others are named."""
    if mode not in ("auto", "exact", "ann"):
        raise VectorError(f"unknown mode {mode!r}")
    if index is not None:
        how = {"metric": index.metric, "key": index.key, "column": index.column} | how
    usable = index is not None and index.state == "READY" and how.get("query") is None and how.get("modality") is None
    usable = usable and (how["metric"], how["key"], how.get("name") or how["column"]) == (index.metric, index.key, index.column)
    if mode == "exact" or not usable:
        if mode == "ann" and not fallback:
            raise VectorError("no index is ready for this search")
        return search(df, vector, **how), {"requested_mode": mode, "executed_mode": "exact", "fallback": mode == "ann"}
    return search_index(df.sparkSession, index, vector, how.get("k", 10), probes), {"requested_mode": mode, "executed_mode": "ann", "fallback": False, "index": index.name}


def upsert_index(spark: SparkSession, index: Index, rows: DataFrame, version: int | None = None, gone: DataFrame | None = None) -> None:
    """Put new versions of rows into the index and take the keys of ``gone`` out: the cells of before and after are written as a new generation. Of equal new keys that with the greatest vector counts. The caller stores the manifest."""
    fit = rows.where(_scored(F.col(index.column))).groupBy(index.key).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), F.col(index.column)).alias("_row")).select("_row.*")
    for m in sorted({r[0] for r in fit.select(F.size(index.column)).distinct().collect()} - {len(c) for c in index.centres}):  # new lengths: one cell each
        index.centres.append([0.0] * m)
        index.probes[m] = 1
    keys = (rows.select(index.key) if gone is None else rows.select(index.key).unionByName(gone.select(index.key))).distinct()
    held, fresh = index.rows(spark), assign(fit, index)
    touched = sorted(r[0] for r in held.join(keys, index.key, "left_semi").select("_cell").union(fresh.select("_cell")).distinct().collect())  # cells, a bounded number
    if touched:
        index.write(held.where(F.col("_cell").isin(*touched)).join(keys, index.key, "left_anti").unionByName(fresh.select(*held.columns)), index.generation + 1)
        index.generation += 1
        index.newer |= dict.fromkeys(touched, index.generation)
    index.source_version = index.source_version if version is None else version


def recall(df: DataFrame, index: Index, queries: list[list[float]], k: int = 10, probes: int | None = None) -> float:
    """The share of the exact k best that the index finds."""
    hit = 0
    for v in queries:
        exact = {r[0] for r in search(df, v, k, index.metric, key=index.key, column=index.column, payload=False).select(index.key).collect()}
        hit += len(exact & {r[0] for r in search_index(df.sparkSession, index, v, k, probes).select(index.key).collect()})
    return hit / max(1, k * len(queries))
