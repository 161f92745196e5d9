"""Writes as DataFrames of new versions: inserts, updates, deletes and bulks."""

from __future__ import annotations

import json
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdoc.operators.filters import find_one, predicate
from loomdoc.sources.scratch import scratch

ABSENT = object()


class WriteError(ValueError):
    """An update or document that cannot be written."""


def literal(v: Any, kind: T.DataType | None = None) -> Column:
    if isinstance(v, (dict, list)):
        if kind is None:
            raise WriteError("a nested value needs a column of known type")
        return F.from_json(F.lit(json.dumps(v)), kind)
    return F.lit(v).cast(kind) if kind is not None else F.lit(v)


def with_id(df: DataFrame, key: str = "id") -> DataFrame:
    """A key for rows whose key is missing, null or empty: 24 hex digits."""
    fresh = F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 24)
    if key not in df.columns:
        return df.withColumn(key, fresh)
    return df.withColumn(key, F.when(F.col(key).isNull() | (F.col(key).cast("string") == ""), fresh).otherwise(F.col(key).cast("string")))


def stamp(df: DataFrame, at: int, user: str | None = None) -> DataFrame:
    """Version, transaction and tenant of new versions."""
    df = df.withColumns({"_mvcc_version": F.lit(at).cast("long"), "created_txn": F.lit(at).cast("long"), "deleted_txn": F.lit(0).cast("long"), "_deleted": F.lit(False)})
    return df.withColumn("tenant_id", F.lit(user)) if user is not None else df


def changed(update: dict, schema: T.StructType, hit: Column) -> dict[str, Column]:
    """The columns that an update sets on rows where ``hit`` holds. A plain document sets its fields; dotted names are literal."""
    plain = {k: v for k, v in update.items() if not k.startswith("$")}
    sets, gone, grow = {**plain, **update.get("$set", {})} if plain and len(plain) == len(update) else dict(update.get("$set", {})), update.get("$unset", []), update.get("$inc", {})
    if not isinstance(gone, list):
        raise WriteError("$unset takes a list of names")
    kinds = {f.name: f.dataType for f in schema}
    now: dict[str, Column] = {n: F.col(f"`{n}`") for n in kinds}
    out: dict[str, Column] = {}

    def put(name: str, c: Column) -> None:
        out[name] = F.when(hit, c).otherwise(now.get(name, F.lit(None)))
        now[name] = out[name]

    for name, v in sets.items():
        put(name, literal(v, kinds.get(name)))
    for name in gone:
        if name in now:
            put(name, F.lit(None).cast(kinds[name]) if name in kinds else F.lit(None))
    for name, by in grow.items():  # missing and non-numeric values count as 0; fractions are cut off
        kind = kinds.get(name)
        base = F.coalesce(now[name].cast("double").cast("long"), F.lit(0)) if name in now and (kind is None or isinstance(kind, T.NumericType)) else F.lit(0)
        value = base + F.lit(int(by)).cast("long")
        put(name, value.cast(kind) if isinstance(kind, T.NumericType) else value)
    return out


def update_many(df: DataFrame, query: Any, update: dict) -> DataFrame:
    """The table with all matching rows updated, in one pass."""
    return df.withColumns(changed(update, df.schema, predicate(query, df.schema)))


def update_one(df: DataFrame, query: Any, update: dict, key: str = "id") -> DataFrame:
    """The table with the matching row of the smallest key updated; nothing is inserted if there is none."""
    first = find_one(df, query, key).select(F.col(key).alias("_hit"))
    marked = df.join(F.broadcast(first), df[key] == F.col("_hit"), "left")  # one row
    return marked.withColumns(changed(update, df.schema, F.col("_hit").isNotNull())).drop("_hit")


def delete_many(df: DataFrame, query: Any) -> DataFrame:
    return df.where(~predicate(query, df.schema))


def delete_one(df: DataFrame, query: Any, key: str = "id") -> DataFrame:
    first = find_one(df, query, key).select(F.col(key).alias("_hit"))
    return df.join(F.broadcast(first), df[key] == F.col("_hit"), "left_anti")  # one row


def tombstones(df: DataFrame, query: Any, at: int) -> DataFrame:
    """Versions that hide the matching rows from now on."""
    hit = df.where(predicate(query, df.schema))
    return hit.withColumns({"_deleted": F.lit(True), "deleted_txn": F.lit(at).cast("long"), "_mvcc_version": F.lit(at).cast("long")})


def newest(rows: DataFrame, key: str = "id", seq: str | None = None) -> DataFrame:
    """One row of each key: the last by ``seq``, or as the rows lie. Rows without a key all stay."""
    if rows.isStreaming:
        raise WriteError("a stream has no last row")
    named = rows.where(F.col(key).isNotNull()).withColumn("_at", F.col(seq) if seq else F.monotonically_increasing_id())
    last = named.groupBy(key).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), "_at").alias("_row")).select("_row.*")
    return last.unionByName(rows.where(F.col(key).isNull()))


def upsert(df: DataFrame, rows: DataFrame, key: str = "id", seq: str | None = None) -> DataFrame:
    """The table with rows inserted; a row with a known key replaces the old one, of equal new keys the last wins (by ``seq``, or as the rows lie). Rows without a key are added."""
    new = newest(rows, key, seq)
    return df.join(rows.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_once(df: DataFrame, rows: DataFrame, key: str = "id", seq: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Idempotent insert by key and content: (new rows, conflicts with another content under the same key). Of new rows with one key the first counts; the same again is a duplicate, another content a conflict."""
    columns = [F.col(f"`{c}`") for c in rows.columns]
    hashed = lambda d: d.withColumn("_h", F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(rows.columns))), {"ignoreNullFields": "false"}), 256))
    placed = hashed(rows).withColumn("_at", F.col(seq) if seq else F.monotonically_increasing_id())
    named, bare = placed.where(F.col(key).isNotNull()), rows.where(F.col(key).isNull())
    firsts = named.groupBy(key).agg(F.min_by(F.struct("_h", F.struct(*columns).alias("_row")), "_at").alias("_first")).select(F.col(key).alias("_k"), "_first")
    known = hashed(df.select(*rows.columns)).select(F.col(key).alias("_k"), F.col("_h").alias("_old"))
    held = firsts.join(known, "_k", "left")
    new = held.where("_old is null").select("_first._row.*").unionByName(bare)
    right = held.select("_k", F.coalesce("_old", "_first._h").alias("_right"))
    clash = named.join(right, F.col(f"`{key}`") == F.col("_k")).where("_h != _right").select(*columns)
    return new, clash


#: Steps of a bulk between two writes of the table, so that the plan stays small.
MOST_STEPS = 50


def bulk(df: DataFrame, operations: list[dict], key: str = "id") -> tuple[DataFrame, list[dict]]:
    """Ordered operations; one that fails is reported as {index, error} and the others go on.

    Inserts that follow each other are one step, and so are deletes by key; after MOST_STEPS
    steps the table is written to the shared folder and read again.
    """
    spark, errors, steps = df.sparkSession, [], 0
    waiting: list = []  # documents to insert, or keys to delete
    mode = ""

    def done(now: DataFrame) -> DataFrame:
        nonlocal steps
        steps += 1
        if steps % MOST_STEPS:
            return now
        path = scratch(spark, "bulk")
        now.write.parquet(path)
        return spark.read.schema(now.schema).parquet(path)

    def flush() -> None:
        nonlocal df, waiting, mode
        if waiting and mode == "insert":
            rows = spark.createDataFrame([(i, *r) for i, r in enumerate(waiting)], T.StructType([T.StructField("_at", T.LongType()), *df.schema.fields]))
            last = rows.groupBy(key).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), "_at").alias("_row")).select("_row.*")
            df = done(df.join(rows.select(key).distinct(), key, "left_anti").unionByName(last))
        elif waiting:
            df = done(df.join(F.broadcast(spark.createDataFrame([(k,) for k in waiting], T.StructType([df.schema[key]]))), key, "left_anti"))
        waiting, mode = [], ""

    def wait(kind: str, items: list) -> None:
        nonlocal waiting, mode
        if mode != kind:
            flush()
        mode, waiting = kind, [*waiting, *items]

    def row(document: Any) -> tuple:
        if not isinstance(document, dict):
            raise WriteError("a document is an object")
        if document.get(key) is None:
            raise WriteError(f"a document lacks {key!r}")
        made = tuple(document.get(f.name) for f in df.schema.fields)
        spark.createDataFrame([made], df.schema)  # its types are looked at now, so that the error is its own
        return made

    for i, op in enumerate(operations):
        try:
            ((name, body),) = op.items()
            by_key = isinstance(q := body.get("filter"), dict) and list(q) == [key] and isinstance(q[key], (str, int)) and not isinstance(q[key], bool)
            if name == "insertOne":
                wait("insert", [row(body["document"])])
            elif name == "insertMany":
                wait("insert", [row(d) for d in body["documents"] if isinstance(d, dict)])
            elif name in ("deleteOne", "deleteMany") and by_key and isinstance(q[key], str) == isinstance(df.schema[key].dataType, T.StringType):
                wait("delete", [q[key]])
            elif name in ("updateOne", "updateMany", "deleteOne", "deleteMany"):
                flush()
                if name == "updateMany" or name == "updateOne" and by_key:  # keys are unique, so that no first one is looked for
                    df = done(update_many(df, q, body["update"]))
                elif name == "updateOne":
                    df = done(update_one(df, q, body["update"], key))
                else:
                    df = done(delete_one(df, q, key) if name == "deleteOne" else delete_many(df, q))
            else:
                raise WriteError(f"unknown operation {name}")
        except (ValueError, KeyError, TypeError, AttributeError, PySparkException) as e:
            errors.append({"index": i, "error": str(e)})
    flush()
    return df, errors
