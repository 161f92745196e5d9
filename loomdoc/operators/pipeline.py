"""Aggregation pipelines: $match, $project, $sort, $skip, $limit and $count over a lazy DataFrame."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdoc.functions.values import Row
from loomdoc.operators.filters import predicate, script_predicate


class PipelineError(ValueError):
    """A stage that is unknown or malformed."""


def _whole(v: Any) -> bool:
    return isinstance(v, int) and not isinstance(v, bool)


def checked(pipeline: list) -> list[tuple[str, Any]]:
    """The stages as (operator, body); raises on what is not supported."""
    if not isinstance(pipeline, list):
        raise PipelineError("a pipeline is a list of stages")
    stages = []
    for i, stage in enumerate(pipeline):
        if not isinstance(stage, dict) or len(stage) != 1:
            raise PipelineError("a stage has exactly one operator")
        ((op, body),) = stage.items()
        good = {
            "$match": lambda b: isinstance(b, dict),
            "$project": lambda b: isinstance(b, dict) and bool(b) and all(v is True or _whole(v) and v == 1 for v in b.values()),
            "$sort": lambda b: isinstance(b, dict) and bool(b) and all(_whole(v) and v in (1, -1) for v in b.values()),
            "$skip": lambda b: _whole(b) and b >= 0,
            "$limit": lambda b: _whole(b) and b > 0,
            "$count": lambda b: isinstance(b, str) and bool(b) and i == len(pipeline) - 1,
        }
        if op not in good:
            raise PipelineError(f"unsupported stage {op}")
        if not good[op](body):
            raise PipelineError(f"malformed {op}")
        stages.append((op, body))
    return stages


def sort_keys(spec: dict, schema: T.StructType, tie: str | None) -> list[Column]:
    """Keys in alphabetical order. Values of one type sort as such; null sorts after them, as its text does after numbers and strings."""
    keys = []
    for name in sorted(spec):
        if name in schema.fieldNames():
            kind = schema[name].dataType
            c = F.col(f"`{name}`")
            if isinstance(kind, T.BooleanType):  # false < null < true, by their texts
                c = F.coalesce(c.cast("string"), F.lit("null"))
            elif isinstance(kind, (T.StructType, T.MapType)):
                c = F.to_json(c)
            keys.append(c.asc_nulls_last() if spec[name] == 1 else c.desc_nulls_first())
    if tie and tie in schema.fieldNames() and tie not in spec:
        keys.append(F.col(f"`{tie}`").asc_nulls_last())
    return keys


def aggregate(df: DataFrame, pipeline: list, tie: str | None = None) -> DataFrame:
    """The pipeline's documents. ``tie`` names the key that keeps rows of equal sort keys in a fixed order."""
    for op, body in checked(pipeline):
        df = _stage(df, op, body, tie)
    return df


def aggregate_counted(df: DataFrame, pipeline: list, tie: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents, and one row for each stage: position (from 0), stage, input_count, output_count.

    The counts are those of the whole stages, whatever Spark reads to answer a limit: rows are
    counted at the start and after each $match, the rest follows from these numbers.
    """
    counted, places, stages = [], [], checked(pipeline)
    known: list[Column] = []

    def measure(d: DataFrame) -> Column:
        counted.append(d.agg(F.count(F.lit(1)).alias(f"n{len(counted)}")))
        return F.col(f"n{len(counted) - 1}")

    known.append(measure(df))
    for i, (op, body) in enumerate(stages):
        df, n = _stage(df, op, body, tie), known[-1]
        if op == "$match":
            n = measure(df)
        elif op == "$skip":
            n = F.greatest(n - body, F.lit(0))
        elif op == "$limit":
            n = F.least(n, F.lit(body))
        elif op == "$count":
            n = F.lit(1)
        places.append(F.struct(F.lit(i).alias("position"), F.lit(op).alias("stage"), known[-1].cast("long").alias("input_count"), n.cast("long").alias("output_count")))
        known.append(n)
    row = reduce(lambda a, b: a.join(F.broadcast(b)), counted)  # one row each
    kind = "array<struct<position: int, stage: string, input_count: bigint, output_count: bigint>>"
    return df, row.select(F.explode(F.array(*places).cast(kind)).alias("s")).select("s.*")


def _stage(df: DataFrame, op: str, body: Any, tie: str | None) -> DataFrame:
    match op:
        case "$match":
            return df.where(predicate(body, df.schema))
        case "$project":
            names = [n for n in sorted(body) if n in df.schema.fieldNames()]  # by literal name, without an implied key
            return df.select(*(F.col(f"`{n}`") for n in names))
        case "$sort":
            return df.orderBy(*sort_keys(body, df.schema, tie))
        case "$skip":
            return df.offset(body)
        case "$limit":
            return df.limit(body)
        case "$count":
            return df.agg(F.count(F.lit(1)).alias(body))
    raise PipelineError(f"unsupported stage {op}")


def variant_sort_key(column: Column) -> list[Column]:
    """Keys that order the values of a VARIANT column as one key: numbers among themselves by value, strings by their text, and all else, and values of different types, by their JSON text."""
    tag = F.coalesce(F.schema_of_variant(column), F.lit("VOID"))
    number = reduce(lambda a, b: a | b, [tag.startswith(x) for x in ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "INT", "SMALLINT", "TINYINT")])
    text = F.when(column.isNull() | (tag == "VOID"), F.lit("null")).otherwise(F.to_json(column))
    # Texts of JSON start with a quote, a sign or digit, [, f, n, t or {: numbers stand together there.
    group = F.when(tag.startswith("STRING"), 0).when(number, 1).otherwise(2)
    value = F.when(number, F.try_variant_get(column, "$", "double"))
    return [group, value, F.when(tag.startswith("STRING"), F.try_variant_get(column, "$", "string")).otherwise(F.when(~number, text))]


def sort_documents(df: DataFrame, spec: dict, column: str, tie: str | None = None) -> DataFrame:
    """$sort over VARIANT documents: fields of mixed types, a missing field counts as null."""
    keys = []
    for name in sorted(spec):
        if "'" in name or "\\" in name:
            raise PipelineError(f"cannot sort by {name!r}")
        for c in variant_sort_key(F.try_variant_get(F.col(column), f"$['{name}']", "variant")):
            keys.append(c.asc_nulls_first() if spec[name] == 1 else c.desc_nulls_last())
    return df.orderBy(*keys, *([F.col(tie).asc_nulls_last()] if tie else []))


def script_aggregate(df: DataFrame, pipeline: list, most: int = 5000, key: str = "id") -> DataFrame:
    """The pipeline by the helper library's rules: the first ``most`` documents by key, looser filters, dotted and excluding projections with the key implied, nulls first, clamped limits."""
    df = df.orderBy(F.col(key).asc_nulls_last()).limit(most)
    for stage in pipeline:
        ((op, body),) = stage.items()
        if op == "$match":
            df = df.where(script_predicate(body, Row(df.schema)))
        elif op == "$project":
            df = _script_project(df, body, key)
        elif op == "$sort":
            keys = []
            for name, way in body.items():
                value = Row(df.schema).path(name)
                if value is not None:
                    keys.append(value.column.desc_nulls_last() if way < 0 else value.column.asc_nulls_first())
            df = df.orderBy(*keys) if keys else df
        elif op == "$limit":
            df = df.limit(max(1, min(most, int(body))))
        elif op == "$skip":
            df = df.offset(max(0, int(body)))
        elif op == "$count":
            df = df.agg(F.count(F.lit(1)).alias(str(body or "count")))
        else:
            raise PipelineError(f"unsupported stage {op}")
    return df


def _script_project(df: DataFrame, body: dict, key: str) -> DataFrame:
    if any(v in (1, True) for v in body.values()):
        found = [(n, v) for n, on in body.items() if on in (1, True) and (v := Row(df.schema).path(n)) is not None]
        columns = [v.column.alias(n) for n, v in found]
        if key in df.columns and body.get(key) != 0 and key not in body:
            columns.append(F.col(key))
        return df.select(*columns)
    return df.drop(*(n for n, v in body.items() if v in (0, False)))
