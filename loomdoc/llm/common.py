"""What the training-data operators share: tables, folds, hot keys and shared storage."""

from __future__ import annotations

import atexit
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most keys that can count as hot: each holds over this part of the rows, so that there are no more of them.
MOST_HOT, LEAST_HOT = 10_000, 1_000
#: Ids that are broadcast at most; where there are more, both sides go through a shuffle.
MOST_SENT = 200_000
#: Bytes of an Arrow batch at most: a worker holds a batch several times over, as texts, words and hashes.
BATCH_BYTES = 8 << 20

_made = threading.local()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by their bytes. Only ever lowered, and no bound on rows: tables of short rows, also other queries', go on in batches as large as before."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(name))  # other units, and no bound at all, are more
    if now is None or not 0 < int(now[1]) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where the cluster names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomdoc-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the program ends."""
    path = f"{shared_dir(spark)}/loomdoc-{tag}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    if open_ := getattr(_made, "stack", None):
        open_[-1].append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; the folder's owner clears what is left
        pass


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them again."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


@contextmanager
def tidy(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is settled inside is removed on leaving, but for the frames that are given to ``keep``; a tidy around this one sees to those."""
    stack = _made.__dict__.setdefault("stack", [])
    stack.append([])
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._settled_at)
        return df

    try:
        yield keep
    finally:
        for path in stack.pop():
            if path not in kept:
                drop_path(spark, path)
            elif stack:
                stack[-1].append(path)


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> DataFrame | None:
    """(key, _parts) of the keys of which each holds over a MOST_HOT-th of ``total`` rows; there are MOST_HOT of them at most. None if there is none."""
    limit = max(LEAST_HOT, total // MOST_HOT)
    if total <= limit:
        return None
    hot = settle(counts.where(F.col(n) > limit).select(key, F.ceil(F.col(n) / limit).cast("int").alias("_parts")), "hot")
    return None if hot.isEmpty() else hot


def join_spread(many: DataFrame, one: DataFrame, key: str, by: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """many joined with one (a row for each key) by key. Rows of a hot key are dealt by a hash of ``by`` over its parts, each of which gets a copy of the one row."""
    if hot is None:
        return many.join(one, key, how)
    hot = F.broadcast(hot)
    dealt = many.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copied = one.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copied, [key, "_part"], how).drop("_part")


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % mod


def share(key: Column) -> Column:
    """A hash of the key, as a fraction from 0 to 1."""
    return (F.xxhash64(key, F.lit(20)) % (1 << 52) / float(1 << 52) + 1) / 2


def labelled(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, most: int | None = None) -> DataFrame:
    """(text, label 0 or 1) of the labelled rows outside the held-out fold, written once so that documents are read once.

    All of them, or, given ``most``, a sample of about so many ids, the same ones in each run.
    Several labels of one document are averaged; null ids, labels and texts teach nothing.
    """
    by = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("_y"))
        .where("_id is not null and _y is not null")
        .groupBy("_id")
        .agg((F.avg("_y") >= 0.5).cast("int").alias("label"))
        .where(fold(F.col("_id"), mod) != held)
    )
    n = by.count()
    if most is not None and n > most:
        n, by = most, by.where(share(F.col("_id")) < most / n)
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return settle(texts.join(F.broadcast(by) if n <= MOST_SENT else by, "_id").select("text", "label"), "labelled")
