"""Media as a manifest table and a table of base64 chunks."""

from __future__ import annotations

import base64
import hashlib


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 256 << 10
#: States of an upload, and the moves between them.
MOVES = {"uploading": ("verifying", "failed", "aborted"), "verifying": ("ready", "failed", "uploading"), "ready": (), "failed": (), "aborted": ()}


def moved(state: str, to: str) -> str:
    if to not in MOVES.get(state, ()):
        raise ValueError(f"an upload cannot go from {state} to {to}")
    return to


def chunked(files: DataFrame, size: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(manifests, chunks) of rows media_id, content: as Spark's binaryFile source reads them, with an id."""
    n = F.ceil(F.length("content") / size).cast("int")
    manifests = files.select("media_id", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), n.alias("chunks"), F.lit("uploading").alias("state"))
    parts = files.select("media_id", "content", F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).alias("index"))
    parts = parts.select("media_id", "index", F.substring(F.col("content"), F.col("index") * size + 1, F.lit(size)).alias("part")).where("length(part) > 0")
    return manifests, parts.select("media_id", "index", F.base64("part").alias("data"), F.sha2("part", 256).alias("sha256"))


def accepted(chunks: DataFrame) -> DataFrame:
    """One row of each chunk: the same chunk sent again is a duplicate, a different one under the same number a conflict."""
    return chunks.groupBy("media_id", "index").agg(F.min("data").alias("data"), (F.count("*") > 1).alias("duplicate"), (F.min("sha256") != F.max("sha256")).alias("conflict"))


def verified(manifests: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each manifest with its state after all its chunks were looked at, and the reason.

    The chunks of one medium are put together in one task, in their order: a medium is one
    value. Missing chunks leave the upload open; conflicts and wrong sizes or hashes fail.
    """
    want = manifests.select("media_id", "size", F.col("sha256").alias("want"), "chunks")
    held = accepted(chunks).join(want, "media_id").groupBy("media_id", "size", "want", "chunks").applyInPandas(_checked, "media_id string, state string, reason string")
    return manifests.drop("state").join(held, "media_id", "left").withColumns(
        {
            "state": F.coalesce("state", F.when(F.col("chunks") == 0, "ready").otherwise("uploading")),
            "reason": F.when(F.col("state").isNull() & (F.col("chunks") > 0), "media_chunks_missing").otherwise(F.col("reason")),
        }
    )


def _checked(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    media, size, want, n = key
    if rows["conflict"].any():
        state, reason = "failed", "media_chunk_conflict"
    elif set(rows["index"]) != set(range(int(n))):
        state, reason = "uploading", "media_chunks_missing"
    else:
        body = hashlib.sha256()
        length = 0
        for data in rows.sort_values("index")["data"]:
            part = base64.b64decode(data)
            body.update(part)
            length += len(part)
        good = length == size and body.hexdigest() == want
        state, reason = ("ready", None) if good else ("failed", "media_checksum_mismatch")
    return pd.DataFrame({"media_id": [media], "state": [state], "reason": [reason]})


def content(manifests: DataFrame, chunks: DataFrame) -> DataFrame:
    """media_id and content of the ready media."""
    ready = manifests.where("state = 'ready'").select("media_id")

    def joined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"media_id": [key[0]], "content": [b"".join(map(base64.b64decode, rows.sort_values("index")["data"]))]})

    return accepted(chunks).join(ready, "media_id", "left_semi").groupBy("media_id").applyInPandas(joined, "media_id string, content binary")


def orphans(manifests: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks whose manifest is gone, failed or aborted."""
    live = manifests.where("state not in ('failed', 'aborted')")
    return chunks.join(live.select("media_id"), "media_id", "left_anti")


def aborted(manifests: DataFrame, ids: DataFrame) -> DataFrame:
    """The manifests, with the uploads under way of these media_ids given up. What is done, failed or aborted already stays as it is."""
    hit = ids.select("media_id", F.lit(True).alias("_hit")).distinct()
    open_ = F.col("state").isin(*(s for s, to in MOVES.items() if "aborted" in to))
    return manifests.join(hit, "media_id", "left").withColumn("state", F.when(F.col("_hit") & open_, "aborted").otherwise(F.col("state"))).select(*manifests.columns)


def deleted(manifests: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without these media_ids."""
    gone = ids.select("media_id").distinct()
    return manifests.join(gone, "media_id", "left_anti"), chunks.join(gone, "media_id", "left_anti")


def cleaned(manifests: DataFrame, chunks: DataFrame, before_ms: int, at: str = "updated_at_ms") -> tuple[DataFrame, DataFrame]:
    """Both tables without uploads that were given up, failed or not touched since a time, and without chunks that have no manifest."""
    over = (F.col("state") != "ready") & (F.coalesce(F.col(at), F.lit(0)) < before_ms)
    left = manifests.where(~over)
    return left, chunks.join(left.select("media_id"), "media_id", "left_semi")


def reconciled(manifests: DataFrame, chunks: DataFrame) -> DataFrame:
    """The manifests, those called ready but short of chunks as failed, with the reason; nothing is decoded."""
    held = accepted(chunks).groupBy("media_id").agg(F.count("*").alias("_held"))
    short = (F.col("state") == "ready") & (F.coalesce("_held", F.lit(0)) != F.col("chunks"))
    both = manifests.drop("reason").join(held, "media_id", "left")
    reason = F.when(short, "media_chunks_missing")
    if "reason" in manifests.columns:
        both = both.join(manifests.select("media_id", F.col("reason").alias("_said")), "media_id")
        reason = reason.otherwise(F.col("_said"))
    return both.withColumns({"reason": reason, "state": F.when(short, "failed").otherwise(F.col("state"))}).drop("_held", "_said")


def summary(manifests: DataFrame) -> DataFrame:
    return manifests.groupBy("state").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def listed(manifests: DataFrame, limit: int, offset: int = 0, owner: str | None = None) -> DataFrame:
    """A page of manifests; what the owner may not see goes before the offset counts."""
    seen = manifests.where(F.col("owner") == owner) if owner is not None else manifests
    return seen.orderBy("media_id").offset(offset).limit(limit)


def inline(files: DataFrame) -> DataFrame:
    """Small media as ordinary documents."""
    return files.select(F.col("media_id").alias("id"), F.lit("media").alias("kind"), F.base64("content").alias("data"), F.length("content").cast("long").alias("size"))


__all__ = ["aborted", "accepted", "chunked", "cleaned", "content", "deleted", "inline", "listed", "moved", "orphans", "reconciled", "summary", "verified"]
