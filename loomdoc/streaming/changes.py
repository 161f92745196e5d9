"""Change logs as streams: latest versions, expiry and incremental upkeep of indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loomdoc.operators.versions import latest


class GapError(RuntimeError):
    """Changes are missing; what was derived must be built anew."""


def changes(spark: SparkSession, path: str, schema: T.StructType, per_batch: int = 1000) -> DataFrame:
    """The files of a change log as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def upkeep(stream: DataFrame, target: str, checkpoint: str, key: str = "id", by: str = "version", shards: int = 16, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Keep the latest version of each key below ``target``, in folders by key shard.

    Each batch is reduced to its newest versions, and only the shards that it touches are
    written again, tombstones included, so that later old versions stay hidden. A batch that
    runs twice leaves the same rows. ``then`` gets the changed rows, for derived indexes.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        new = latest(rows, key, by=F.col(by), deleted=None).withColumn("_shard", F.pmod(F.hash(key), F.lit(shards)))
        new = new.persist()
        try:
            touched = [r[0] for r in new.select("_shard").distinct().collect()]  # at most ``shards``
            if not touched:
                return
            merged = new
            if _exists(spark, target):
                old = spark.read.schema(new.schema).parquet(target).where(F.col("_shard").isin(touched))
                merged = latest(old.unionByName(new), key, by=F.col(by), deleted=None)
            staged = f"{target}__staged"
            merged.write.mode("overwrite").parquet(staged)
            spark.read.schema(new.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_shard").parquet(target)
            if then is not None:
                then(new.drop("_shard"), number)
        finally:
            new.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def current(spark: SparkSession, target: str) -> DataFrame:
    """The live rows that ``upkeep`` keeps."""
    rows = spark.read.parquet(target).drop("_shard")
    return rows.where(~F.coalesce("_deleted", F.lit(False))) if "_deleted" in rows.columns else rows


def journal(log: DataFrame, cursor: int, most: int = 128, seq: str = "seq", key: str = "id") -> tuple[str, DataFrame, int]:
    """(Covered, More or Gap; the distinct changed ids after the cursor; the next cursor) of a bounded journal of changes."""
    ends = log.agg(F.min(seq).alias("lo"), F.max(seq).alias("hi")).first()
    if ends.lo is None or ends.hi <= cursor:
        return "Covered", log.select(key).limit(0), cursor
    if ends.lo > cursor + 1:
        return "Gap", log.select(key).limit(0), cursor
    after = min(ends.hi, cursor + most)
    rows = log.where((F.col(seq) > cursor) & (F.col(seq) <= after)).select(key).distinct()
    return ("Covered" if after == ends.hi else "More"), rows, after


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and value; rows later than ``late`` are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
