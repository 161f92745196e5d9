"""Exact top-k search by distributed histogram selection.

For a block of queries every candidate is scored. Each query keeps an interval that holds
its k-th best score; the tasks count their scores in the interval's bins, the counts are
added up, and the bin of the k-th score becomes the next interval, until few enough scores
are left at or above its lower end, or its bins are single scores. A last pass keeps the
scores from there on and breaks ties by the smaller id. A task reports only what can
matter: bins from its own k-th best score up, and its k best rows.

Queries are taken in blocks of about ``BLOCK``, fewer if they are long; one block at a time
is broadcast. All candidates are read for each block and pass, so a block is as large as a
worker can hold beside its counts (16 k queries with 256 bins: 34 MB) and its queries
(``BLOCK_BYTES``); nothing is kept that grows with queries times candidates.

Defined cases: vectors that are null, empty or hold null or non-finite components take no
part, nor do null ids; a query meets vectors of its own length only and never rows with its
own id; repeated candidate rows count each, repeated query rows give one answer each; fewer
than k candidates give fewer rows; an empty table gives no rows; other columns are not read.
Scores that a 64-bit integer cannot hold raise OverflowError.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdoc.llm.common import scratch, table

BLOCK, BINS, K, EVERY, SCALE = 16_384, 256, 5, 50, 256
#: Bytes of a block's queries.
BLOCK_BYTES = 64 << 20
#: Scores at or above a bound that are few enough to end the refining (each task still keeps k of them at most).
FEW = 64
#: Queries times candidates that are scored at once.
TILE = 1 << 21


def quantised(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix of whole numbers) of the valid vectors, for each length."""
    ids, vectors = batch.column(0), batch.column(1)
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    valid = np.logical_and(~np.asarray(ids.is_null()), ~np.asarray(vectors.is_null()))
    sizes = np.where(valid, np.asarray(vectors.value_lengths().fill_null(0)), 0)
    flat = vectors.flatten()
    numbers = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(np.where(np.asarray(vectors.is_null()), 0, np.asarray(vectors.value_lengths().fill_null(0))))])[:-1]
    keys = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for n in np.unique(sizes):
        if n:
            at = np.flatnonzero(sizes == n)
            m = numbers[starts[at][:, None] + np.arange(n)]
            good = np.isfinite(m).all(1)
            yield keys[at[good]], np.floor(m[good] * SCALE)


def products(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact integer inner products, vectors by queries."""
    most = np.abs(vectors).max(initial=0) * np.abs(queries).max(initial=0) * vectors.shape[1]
    if most < 1 << 53:
        return (vectors @ queries.T).astype(np.int64)
    if most < 1 << 63:
        return vectors.astype(np.int64) @ queries.astype(np.int64).T
    raise OverflowError("an inner product may exceed 64 bits")


Block = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by length: query numbers, ids, matrix


def _scores(block: Block, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query numbers, candidate ids, scores candidates x queries; the own row is the least integer), tile by tile."""
    for batch in batches:
        for ids, m in quantised(batch):
            if len(ids) and m.shape[1] in block:
                numbers, own, q = block[m.shape[1]]
                step = max(1, TILE // len(ids))
                for i in range(0, len(own), step):
                    s = products(m, q[i : i + step])
                    s[ids[:, None] == own[None, i : i + step]] = np.iinfo(np.int64).min
                    yield numbers[i : i + step], ids, s


def _counter(shared, lows: np.ndarray, widths: np.ndarray, k: int) -> Callable:
    """A task's counts (q, bin, n): of the BINS bins of each query's interval, and what lies above as bin BINS; no bins below the task's own k-th score."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(lows), BINS + 1), np.int64)
        for numbers, _, s in _scores(shared.value, batches):
            low, width = lows[numbers], widths[numbers]
            inside = s >= low[None]
            row = np.broadcast_to(numbers[None], s.shape)[inside]
            bins = np.minimum((s[inside] - low[np.searchsorted(numbers, row)]) // width[np.searchsorted(numbers, row)], BINS)
            counts += np.bincount(row * (BINS + 1) + bins, minlength=counts.size).reshape(counts.shape)
        above = np.cumsum(counts[:, ::-1], 1)[:, ::-1] - counts
        q, b = np.nonzero((counts > 0) & (above < k))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts[q, b])], ["q", "bin", "n"])

    return count


def _taker(shared, least: np.ndarray, k: int) -> Callable:
    """A task's k best rows of each query with scores of at least ``least``."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, v, s = (np.zeros(0, np.int64) for _ in range(3))
        for numbers, ids, scores in _scores(shared.value, batches):
            c, j = np.nonzero(scores >= least[numbers][None])
            q, v, s = np.concatenate([q, numbers[j]]), np.concatenate([v, ids[c]]), np.concatenate([s, scores[c, j]])
            if len(q) > 4 * k * len(least) + 100_000:
                q, v, s = _best(q, v, s, k)
        q, v, s = _best(q, v, s, k)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(v), pa.array(s)], ["q", "vec_id", "score"])

    return take


def _best(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    place = np.arange(len(q)) - np.searchsorted(q, q, "left")
    keep = place < k
    return q[keep], v[keep], s[keep]


def _peaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        most = [(float(np.sqrt((m * m).sum(1)).max(initial=0)), m.shape[1]) for _, m in quantised(batch)]
        yield pa.RecordBatch.from_arrays([pa.array([max((x for x, _ in most), default=0.0)], pa.float64()), pa.array([max((n for _, n in most), default=1)], pa.int32())], ["norm", "size"])


def search(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of ``vectors`` for each of ``queries`` (both vec_id, embedding)."""
    spark = vectors.sparkSession
    numbers = lambda d: d.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    vectors, queries = numbers(vectors), numbers(queries).where("vec_id is not null and embedding is not null")
    longest, size = vectors.mapInArrow(_peaks, "norm double, size int").agg(F.coalesce(F.max("norm"), F.lit(0.0)), F.coalesce(F.max("size"), F.lit(1))).first()
    parts = max(1, ceil(queries.count() / min(block, max(1, BLOCK_BYTES // (8 * size)))))
    path = scratch(spark, "topk")
    for part in range(parts):
        mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part) if parts > 1 else queries
        got = mine.toArrow().to_batches()
        by: dict[int, list] = {}
        for b in got:
            for ids, m in quantised(b):
                by.setdefault(m.shape[1], []).append((ids, m))
        held: Block = {}
        n, names, norms = 0, [], []
        for size, parts_of in sorted(by.items()):
            ids, m = np.concatenate([x for x, _ in parts_of]), np.concatenate([x for _, x in parts_of])
            order = np.argsort(ids, kind="stable")
            ids, m = ids[order], m[order]
            held[size] = (np.arange(n, n + len(ids)), ids, m)
            n, names, norms = n + len(ids), [*names, ids], [*norms, np.sqrt((m * m).sum(1))]
        if not n:
            continue
        shared = spark.sparkContext.broadcast(held)
        reach = np.ceil(np.concatenate(norms) * longest) + 1
        if reach.max() >= 1 << 62:
            raise OverflowError("an inner product may exceed 64 bits")
        lows = -reach.astype(np.int64)
        widths = np.maximum(1, -(-(2 * reach.astype(np.int64) + 1) // BINS))
        busy = np.ones(n, bool)
        while busy.any():
            counts = vectors.mapInArrow(_counter(shared, np.where(busy, lows, np.iinfo(np.int64).max), widths, k), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
            # Bins from the top: the first at which k scores are reached, and how many that makes.
            ranked = counts.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("bin", "n")), asc=False).alias("bins"))
            found = ranked.selectExpr(
                "q",
                f"aggregate(bins, named_struct('bin', -1, 'n', 0L), (a, x) -> if(a.n >= {k}, a, named_struct('bin', x.bin, 'n', a.n + x.n))) as at",
            ).selectExpr("q", "at.bin as bin", "at.n as n")
            left = np.zeros(n, bool)
            for r in found.collect():  # one row for each query of the block
                if r.n < k:
                    continue  # fewer than k candidates: all of them
                if r.bin < BINS:
                    lows[r.q] += r.bin * widths[r.q]
                    left[r.q] = r.n > FEW and widths[r.q] > 1
                    widths[r.q] = max(1, -(-widths[r.q] // BINS)) if left[r.q] else widths[r.q]
                # else: k scores lie above the interval, which then starts at the bound found before
            busy = left
        best = vectors.mapInArrow(_taker(shared, lows, k), "q int, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
        of = np.concatenate(names)
        table_of = spark.createDataFrame(pa.table({"q": pa.array(np.arange(n, dtype=np.int32)), "query_id": pa.array(of)}))
        top = best.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(table_of), "q")  # a block of queries
        top.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score").write.mode("append").parquet(path)
    schema = "query_id long, rank int, vec_id long, score long"
    return spark.read.schema(schema).parquet(path) if n_written(spark, path) else spark.createDataFrame([], schema)


def n_written(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


ORACLE = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id != c.vec_id where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id::bigint as query_id, rank::int as rank, vec_id::bigint as vec_id, score from ranked where rank <= 5
"""
