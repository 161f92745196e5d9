"""Secondary indexes as posting lists, their validation, and digests of tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def postings(df: DataFrame, field: str, key: str = "id") -> DataFrame:
    """(value, id) of each row that has the field: one row per entry, so that a common value is no long list."""
    return df.where(F.col(field).isNotNull()).select(F.col(field).cast("string").alias("value"), F.col(key).alias("id")).distinct()


def posting_sizes(df: DataFrame, field: str, key: str = "id") -> DataFrame:
    return postings(df, field, key).groupBy("value").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def lookup(df: DataFrame, index: DataFrame, field: str, value: str, key: str = "id") -> DataFrame:
    """Rows by an index, re-verified against the live rows."""
    hits = index.where(F.col("value") == value).select(F.col("id").alias("_id"))
    return df.where(F.col(field).cast("string") == value).join(hits, df[key] == F.col("_id"), "left_semi")


#: Folders of values; entries in a file of one; ids that are told to the scan itself.
BUCKETS, FILE_ENTRIES, MOST_IDS = 64, 5_000_000, 10_000


def write_postings(df: DataFrame, path: str, field: str, key: str = "id", buckets: int = BUCKETS) -> int:
    """Write the entries in folders by a hash of the value and files sorted by value, so that a lookup reads little. A common value is dealt over several files. Returns the number of folders."""
    rows = postings(df, field, key).withColumn("_bucket", _bucket(F.col("value"), buckets))
    files = max(1, df.count() // (buckets * FILE_ENTRIES) + 1)
    dealt = rows.repartition(buckets * files, "_bucket", F.pmod(F.xxhash64("id"), F.lit(files)))
    dealt.sortWithinPartitions("_bucket", "value", "id").write.mode("overwrite").partitionBy("_bucket").parquet(path)
    return buckets


def _bucket(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def entries(index: DataFrame, texts: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The entries of some values, from their folders alone."""
    at = index.sparkSession.range(1).select(*(_bucket(F.lit(t), buckets).alias(f"b{i}") for i, t in enumerate(texts))).first()
    return index.where(F.col("_bucket").isin(*sorted(set(at))) & F.col("value").isin(*texts)).select("id")


def narrowed(df: DataFrame, index: DataFrame, value: Any, key: str = "id", buckets: int = BUCKETS) -> DataFrame:
    """The rows that an index has under a value: a superset of those that a filter with this equality passes, as the filter is applied to them again.

    Few ids go to the scan as a list, which prunes row groups and files by their bounds; more
    are joined. A number is asked for in every way that Spark's types write it (1, 1.0, 1.00).
    """
    found = entries(index, sorted(_texts(index.sparkSession, value)), buckets).distinct()
    ids = found.limit(MOST_IDS + 1).collect()
    if len(ids) <= MOST_IDS:
        return df.where(F.col(key).isin([r.id for r in ids])) if ids else df.where(F.lit(False))
    return df.join(found.withColumnRenamed("id", "_id"), F.col(key) == F.col("_id"), "left_semi")


def _texts(spark: SparkSession, value: Any) -> set[str]:
    if isinstance(value, (str, bool)):
        return {str(value).lower() if isinstance(value, bool) else value}
    kinds = ("bigint", "float", "double", *(f"decimal(38,{n})" for n in range(19)))
    row = spark.range(1).select(*(F.lit(value).try_cast(k).cast("string").alias(f"c{i}") for i, k in enumerate(kinds))).first()
    return {x for x in row if x is not None}


def validate(df: DataFrame, index: DataFrame, field: str, key: str = "id") -> DataFrame:
    """Counts of entries: missing (live, not indexed), stale (the row now has another value), extra (no such row), and valid."""
    live = df.select(F.col(key).alias("id"), F.col(field).cast("string").alias("now"))
    both = live.join(index.select("id", "value").distinct(), "id", "full")
    known = both.join(live.select("id", F.lit(True).alias("known")), "id", "left")
    indexed = live.join(index.select("id", F.col("value").alias("now")).distinct(), ["id", "now"], "left_anti").where("now is not null")
    return known.agg(
        F.count(F.when(F.col("value") == F.col("now"), 1)).alias("valid"),
        F.count(F.when(F.col("value").isNotNull() & F.col("known") & ~(F.col("value").eqNullSafe(F.col("now"))), 1)).alias("stale"),
        F.count(F.when(F.col("value").isNotNull() & F.col("known").isNull(), 1)).alias("extra"),
    ).join(F.broadcast(indexed.agg(F.count("*").alias("missing"))))  # one row each


@dataclass(frozen=True)
class IndexOptions:
    """A declared index: not unique, over one top-level field."""

    field: str
    name: str | None = None

    def __post_init__(self) -> None:
        if not self.field or "." in self.field or self.field.startswith("$"):
            raise ValueError("an index is over one top-level field")


def digest(df: DataFrame, key: str = "id", most: int | None = None) -> DataFrame:
    """One row: status, documents, and a SHA-256 that equal tables share, whatever their order or layout.

    Each row is hashed by itself; the hashes are added up in five lanes of 48 bits as
    decimals, so that no task holds the table. Rows without a key make it INVALID_ROW; more
    than ``most`` rows TRUNCATED.
    """
    plain = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"})
    h = F.sha2(plain, 256)
    lanes = [F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("long") for i in range(5)]  # 48 bits each
    sums = df.select(F.col(key).isNull().alias("bad"), *(x.cast(T.DecimalType(20, 0)).alias(f"l{i}") for i, x in enumerate(lanes)))
    sums = sums.agg(F.count("*").alias("documents"), F.sum(F.col("bad").cast("int")).alias("bad"), *(F.coalesce(F.sum(f"l{i}"), F.lit(0)).cast("string").alias(f"l{i}") for i in range(5)))
    status = F.when(F.coalesce("bad", F.lit(0)) > 0, "INVALID_ROW").when((F.col("documents") > most) if most is not None else F.lit(False), "TRUNCATED").otherwise("OK")
    text = F.concat_ws(":", F.col("documents").cast("string"), *(f"l{i}" for i in range(5)))
    return sums.select(status.alias("status"), "documents", F.when(status == "OK", F.sha2(text, 256)).alias("digest"))


def expire(df: DataFrame, now_ms: int, column: str = "expires_at") -> DataFrame:
    """Rows whose time has not come."""
    return df.where(F.col(column).isNull() | (F.col(column) > now_ms))


def limited(df: DataFrame, most: int, most_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Opt-in result cap: (the first ``most`` rows, as far as their JSON has ``most_bytes``; one row {partial, partial_reason})."""
    seen = df.limit(most + 1).withColumn("_size", F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))
    first = Window.orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)  # most + 1 rows at most
    seen = seen.withColumn("_place", F.monotonically_increasing_id()).withColumns({"_n": F.row_number().over(Window.orderBy("_place")), "_sum": F.sum("_size").over(first)})
    fits = (F.col("_n") <= most) & (F.col("_sum") <= most_bytes if most_bytes is not None else F.lit(True))
    over = seen.agg(F.coalesce(F.max(F.col("_n")) > most, F.lit(False)).alias("_rows"), F.coalesce(F.bool_or(~fits), F.lit(False)).alias("partial"))
    reason = F.when(F.col("partial") & ~F.col("_rows"), "result_bytes").when(F.col("_rows"), "document_limit")
    return seen.where(fits).select(*(F.col(f"`{c}`") for c in df.columns)), over.select("partial", reason.alias("partial_reason"))
