"""Mixing sources to target weights by hash-random order, prefix sums and an exact cut.

Every row gets a hash-random key. Within a source the keys are split into equal ranges; the
ranges' sums are summed along the ranges, and in the one range where the budget ends, sizes
are summed in key order, rows alike in key, id and size being one entry with their number.
So no task holds a source, and what comes out is one cut for each source. A source whose
target is a times its size takes each document floor(a) times in whole epochs, then all
before the cut; the cut falls within one document at most, so that budgets are met to the
word. Documents are only held against the cut of their source: texts are never shuffled.

Targets: sources by code point, null last, weigh ``weights`` in turn and share the total;
a target stops at ``cap`` times its source's size, and the excess is shared by weight until
none is above. With caps sorted by cap / weight, the common level of the others follows
from running sums.

Defined cases: null text and text without a word have size 0 and take 0; a null source is a
source of its own, and last; null ids count as empty text in the key; rows with equal ids
follow each other by size, and each counts; those alike in id and size, if the cut falls
among them, are numbered as they lie in the table; an empty table gives an empty mix. Columns of
the input are kept by ``mix``; where a new name is taken, the new column gets a trailing
underscore.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm.common import hot_keys, join_spread, settle, table, tidy

WEIGHTS, CAP, SHARE, SEED = (5, 2, 1), 3, 1.0, "mix"
WORD = r"[^\x20\x09-\x0D]+"
#: Sources whose cuts (about 100 bytes each) are broadcast; more go through a join.
MOST_SOURCES = 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def keyed(docs: DataFrame, ranges: int, seed: str, **more: Column) -> DataFrame:
    """(id, source and its name as one value, size, key, range) of each row; the ranges cut the keys' space evenly."""
    key = F.md5(F.concat(F.lit(seed + "/"), F.coalesce(docs["doc_id"].cast("string"), F.lit(""))).cast("binary"))
    part = F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / float(1 << 32) * ranges)
    source = docs["source"].cast("string")
    rows = docs.select(
        docs["doc_id"].alias("_id"), source.isNull().alias("_none"), F.coalesce(source, F.lit("")).alias("_source"), F.coalesce(F.concat(F.lit("+"), source), F.lit("")).alias("_from"), size_of(docs["text"]).alias("_size"), key.alias("_key"), part.alias("_range"), *(c.alias(k) for k, c in more.items())
    )
    return rows


def budgets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, share: float = SHARE) -> DataFrame:
    """For each source and range: the words of the range and before it, and the source's size, target and budget."""
    turn = " ".join(f"when {i} then {w}" for i, w in enumerate(weights))
    return rows.sparkSession.sql(
        f"""
        with ranges as (select _none, _source, _from, _range, sum(_size) as words from {{mixed}} group by all),
        sources as (select _none, _source, sum(words) as source_size from ranges group by all),
        weighed as (
            select *, case pmod(row_number() over (order by _none, _source) - 1, {len(weights)}) {turn} end as weight,
                   {share}D * sum(source_size) over () as total
            from sources),
        stepped as (
            select *, {cap} * source_size / cast(weight as double) as ratio,
                   (total - coalesce(sum({cap} * source_size) over (order by {cap} * source_size / cast(weight as double), _none, _source rows between unbounded preceding and 1 preceding), 0))
                   / sum(weight) over (order by {cap} * source_size / cast(weight as double), _none, _source rows between current row and unbounded following) as level
            from weighed),
        levelled as (select *, min(case when level <= ratio then ratio end) over () as first_free from stepped),
        targets as (
            select _none, _source, source_size, least(cast({cap} * source_size as double),
                   coalesce(max(case when ratio = first_free then level end) over (), {cap * 1.0}D * total) * weight) as target
            from levelled)
        select r._from, r._range, r.words, t.source_size, t.target, cast(floor(t.target + 0.5D) as bigint) as budget,
               sum(r.words) over (partition by r._none, r._source order by r._range) - r.words as before
        from ranges r join targets t on r._none = t._none and r._source = t._source
        """,
        mixed=rows,
    )


def cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """For each source: its size and target, whole epochs, and the cut: a row's key, id and size, how many rows are alike in these, and how many words of them are taken."""
    plan = settle(plan, "plan")
    sources = plan.groupBy("_from").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("budget").alias("budget"))
    sources = settle(sources.selectExpr("_from", "source_size", "target", "if(source_size > 0, budget div source_size, 0L) as epochs", "if(source_size > 0, budget % source_size, 0L) as rest"), "sources")
    ends = plan.where("source_size > 0 and budget % source_size >= before and budget % source_size < before + words").selectExpr("_from", "_range", "budget % source_size - before as rest")
    few = sources.count() <= MOST_SOURCES
    here = rows.join(F.broadcast(ends) if few else ends, ["_from", "_range"]).groupBy("_from", "rest", "_key", "_id", "_size").agg(F.count("*").alias("n"))
    summed = here.selectExpr("*", "sum(n * _size) over (partition by _from order by _key, _id, _size rows between unbounded preceding and current row) - n * _size as _before")
    cut = summed.where("rest >= _before and rest < _before + n * _size").selectExpr("_from", "struct(_key, _id, _size) as cut", "n as alike", "rest - _before as left")
    return settle(sources.join(cut, "_from", "left").drop("rest"), "cuts")


def taken(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """rows with source_size, target and taken."""
    here = F.struct("_key", "_id", "_size")
    if (n := cut.count()) <= MOST_SOURCES:
        joined = rows.join(F.broadcast(cut), "_from")
    else:
        sizes = rows.groupBy("_from").count()
        joined = join_spread(rows, cut, "_from", "_key", hot_keys(sizes, "_from", "count", rows.count()))
    at = F.coalesce(here == F.col("cut"), F.lit(False))
    part = F.when(at, F.least("_size", "left")).when(here < F.col("cut"), F.col("_size")).otherwise(0)
    done = lambda d, part: d.withColumn("taken", F.col("epochs") * F.col("_size") + part)
    if not n or cut.where("alike > 1").isEmpty():
        return done(joined, part)
    # The cut falls among rows that are alike: written with a place, they are numbered within their task's rows, of which the counts are summed up.
    several = at & (F.col("alike") > 1)
    tied = settle(joined.where(several).withColumns({"_task": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "tied")
    tasks = tied.groupBy("_from", "_task").agg(F.count("*").alias("_n"))
    tasks = tasks.selectExpr("_from", "_task", "sum(_n) over (partition by _from order by _task) - _n as _earlier")
    numbered = tied.selectExpr("*", "row_number() over (partition by _from, _task order by _place) - 1 as _i").join(F.broadcast(tasks), ["_from", "_task"])  # sources with ties times tasks
    rest = F.col("left") - (F.col("_earlier") + F.col("_i")) * F.col("_size")
    return done(joined.where(~several), part).unionByName(done(numbered, F.greatest(F.lit(0), F.least(F.col("_size"), rest))).select(*joined.columns, "taken"))


def ranges_for(n: int) -> int:
    """About the square root of the rows: both the rows of a range and the ranges of a source stay few."""
    return max(1, ceil(sqrt(n)))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, share: float = SHARE, seed: str = SEED) -> DataFrame:
    """All columns of the documents that the mix takes, with size, source_size, target and taken."""
    with tidy(docs.sparkSession) as keep:
        ranges = ranges_for(docs.count())
        rows = settle(keyed(docs, ranges, seed), "mix")
        cut = keep(cuts(rows, budgets(rows, weights, cap, share)))
    done = taken(keyed(docs, ranges, seed, _row=F.struct(*(docs[c] for c in docs.columns))), cut).where("taken > 0")
    used, new = set(docs.columns), []
    for name, column in (("size", "_size"), ("source_size", "source_size"), ("target", "target"), ("taken", "taken")):
        while name in used:
            name += "_"
        new.append(F.col(column).alias(name))
    return done.select(*(F.col("_row")[c].alias(c) for c in docs.columns), *new)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = settle(keyed(docs, ranges_for(docs.count()), SEED), "mix")
    done = taken(rows, cuts(rows, budgets(rows)))
    return done.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", "taken")


ORACLE = r"""
with rows as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
           md5('mix/' || coalesce(doc_id::varchar, '')) as k
    from documents),
sources as (select source is null as none, source, sum(size)::bigint as source_size from rows group by all),
weighed as (
    select *, [5, 2, 1][((row_number() over (order by none, source) - 1) % 3 + 1)::int] as weight, sum(source_size) over ()::double as total
    from sources),
stepped as (
    select *, 3 * source_size / weight::double as ratio,
           (total - coalesce(sum(3 * source_size) over (order by 3 * source_size / weight::double, none, source rows between unbounded preceding and 1 preceding), 0)::double)
           / (sum(weight) over (order by 3 * source_size / weight::double, none, source rows between current row and unbounded following))::double as level
    from weighed),
levelled as (select *, min(case when level <= ratio then ratio end) over () as first_free from stepped),
targets as (
    select none, source, source_size, least((3 * source_size)::double, max(case when ratio = first_free then level end) over () * weight) as target
    from levelled),
run as (
    select r.*, t.source_size, t.target, floor(t.target + 0.5)::bigint as budget,
           (sum(r.size) over (partition by r.source order by k, doc_id, size rows between unbounded preceding and current row) - r.size)::bigint as before
    from rows r join targets t on r.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (case when source_size = 0 then 0 else budget // source_size * size + greatest(0, least(size, budget % source_size - before)) end)::bigint as taken
from run
"""
