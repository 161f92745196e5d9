"""A packed exact index: vectors as bytes of doubles with their norms, searched without any approximation.

Building costs one pass; a search reads keys, bytes and norms alone, and a task turns the
bytes of a whole batch into one matrix, without a list for each row. Norms are not computed
again. Rows that cannot have a score are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.functions.vectors import METRICS
from loomdoc.operators.vector_search import VectorError, _scores, checked_dense, space_column


@dataclass(frozen=True)
class FlatIndex:
    path: str
    column: str = "vector"
    key: str = "id"
    source_version: int = 0

    def manifest(self) -> str:
        return json.dumps(asdict(self))


def build_flat(df: DataFrame, path: str, column: str = "vector", key: str = "id", version: int = 0) -> FlatIndex:
    """Write key, size, bytes and norm of each finite vector."""

    @F.pandas_udf("bytes binary, norm double")
    def packed(v: pd.Series) -> pd.DataFrame:
        rows = [None if x is None else np.asarray(x, "<f8") for x in v]
        good = [x if x is not None and len(x) and np.isfinite(x).all() else None for x in rows]
        return pd.DataFrame({"bytes": [None if x is None else x.tobytes() for x in good], "norm": [None if x is None else float(np.linalg.norm(x)) for x in good]})

    c = space_column(df, column, column)
    rows = df.select(F.col(key).alias("id"), packed(c.cast("array<double>")).alias("p")).select("id", (F.length("p.bytes") / 8).cast("int").alias("size"), "p.*")
    rows.where("bytes is not null").write.mode("overwrite").parquet(path)
    return FlatIndex(path, column, key, version)


def search_flat(spark: SparkSession, index: FlatIndex, vector: list[float], k: int = 10, metric: str = "cosine") -> DataFrame:
    """key and score of the k nearest rows, ties by key; of repeated keys the best counts."""
    q = np.array([checked_dense(vector)], float)
    if k <= 0 or metric not in METRICS:
        raise VectorError("k is at least 1 and the metric one of " + ", ".join(METRICS))
    rows = spark.read.parquet(index.path).where(F.col("size") == q.shape[1])
    kind, size = rows.schema["id"].dataType.simpleString(), float(np.linalg.norm(q[0]))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pd.DataFrame({"id": [], "score": []})
        for b in batches:
            if not b.num_rows:
                continue
            m = np.frombuffer(b"".join(b.column("bytes").to_pylist()), "<f8").reshape(b.num_rows, q.shape[1])
            if METRICS[metric] == "cosine":
                with np.errstate(over="ignore", invalid="ignore"):
                    sizes, dot = b.column("norm").to_numpy(zero_copy_only=False) * size, m @ q[0]
                    s = np.where(sizes < 1e-12, 0.0, dot / np.maximum(sizes, 1e-300))
                odd = np.flatnonzero(~(np.isfinite(sizes) & np.isfinite(dot)))
                s[odd] = _scores(metric, m[odd], q)[:, 0] if len(odd) else s[odd]
            else:
                s = _scores(metric, m, q)[:, 0]
            now = pd.DataFrame({"id": b.column("id").to_pandas(), "score": s})
            both = pd.concat([held, now]) if len(held) else now
            held = both.sort_values(["score", "id"], ascending=[False, True], kind="stable").drop_duplicates("id").head(k)
        if len(held):
            yield pa.RecordBatch.from_pandas(held, schema=None, preserve_index=False)

    near = rows.select("id", "bytes", "norm").mapInArrow(best, f"id {kind}, score double")
    top = near.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return top.withColumnRenamed("id", index.key)
