"""Change logs: the latest version of each document, visibility, time travel and compaction.

A log is a table of document versions. What is invisible to a reader is left out before the
latest version is chosen, tombstones are taken out after it, and filters apply last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The first of these that a row has decides its version.
VERSION_FIELDS = ("_mvcc_version", "version", "deleted_txn", "created_txn", "_timestamp")


def version(df: DataFrame, fields: tuple[str, ...] = VERSION_FIELDS) -> Column:
    """The version of a row as a long; null if it has none. Text counts by the whole number it starts with."""
    found = []
    for name in fields:
        if name in df.columns:
            text = isinstance(df.schema[name].dataType, T.StringType)
            found.append(F.regexp_extract(F.col(name), r"^\s*([+-]?\d+)", 1).try_cast("long") if text else F.col(name).cast("long"))
    return F.coalesce(*found) if found else F.lit(None).cast("long")


def visible(df: DataFrame, applied: int | None = None, floor: int | None = None) -> DataFrame:
    """Rows that a reader may see: committed, not pending, no newer than what is applied and no older than the floor."""
    tests = []
    if "_visibility_state" in df.columns:
        tests.append(F.coalesce(F.upper("_visibility_state"), F.lit("")) != "PENDING")
    if "_committed" in df.columns:
        tests.append(F.coalesce(F.col("_committed"), F.lit(True)))
    if applied is not None:
        tests.append(F.coalesce(version(df) <= applied, F.lit(True)))
    if floor is not None:
        tests.append(F.coalesce(version(df) >= floor, F.lit(True)))
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def as_of(df: DataFrame, txn: int) -> DataFrame:
    """Rows created at or before a transaction and not deleted by then."""
    deleted = F.coalesce(F.col("deleted_txn"), F.lit(0)) if "deleted_txn" in df.columns else F.lit(0)
    return df.where((F.col("created_txn") <= txn) & ((deleted == 0) | (deleted > txn)))


def latest(df: DataFrame, key: str = "id", seq: str | None = None, deleted: str | None = "_deleted", by: Column | None = None) -> DataFrame:
    """The newest version of each key, without tombstones.

    Versioned rows are newer than unversioned ones; of equal versions the later in ``seq``
    wins, or without it the later as the log lies. max_by keeps one row per key on each side of the shuffle, so that a key with many
    versions stays small.
    """
    order = F.struct(F.coalesce(by if by is not None else version(df), F.lit(-(1 << 63))).alias("v"), F.col(seq or "_place").alias("s"))
    placed = df if seq else df.withColumn("_place", F.monotonically_increasing_id())
    newest = placed.groupBy(key).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), order).alias("_row")).select("_row.*")
    if deleted and deleted in df.columns:
        newest = newest.where(~F.coalesce(F.col(deleted), F.lit(False)))
    return newest


def merge(logs: list[DataFrame], key: str = "id", **how) -> DataFrame:
    """The newest versions over several layers, later layers winning ties."""
    parts = [d.withColumn("_layer", F.lit(i)) for i, d in enumerate(logs)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return latest(both, key, seq="_layer", **how).drop("_layer")


def compact(df: DataFrame, key: str = "id", whole: bool = True, **how) -> DataFrame:
    """One row per key; tombstones go only if the rows cover the whole collection."""
    return latest(df, key, **how) if whole else latest(df, key, deleted=None, **{k: v for k, v in how.items() if k != "deleted"})


def own(df: DataFrame, user: str, column: str = "tenant_id") -> DataFrame:
    """Rows of one tenant, and those of none."""
    return df.where(F.col(column).isNull() | (F.col(column) == user)) if column in df.columns else df
