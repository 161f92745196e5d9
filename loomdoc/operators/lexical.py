"""BM25 ranking over a text column, with or without an inverted index, and reciprocal rank fusion.

The index holds one row for each term and document (postings, with the term's count and the
document's length), in folders by a hash of the term and files sorted by term; a frequent
term's postings are dealt over several files. A query reads the postings of its own terms,
at most 64, and never the texts.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from math import ceil, isfinite, log
from typing import Any
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdoc.functions.text import MOST_BYTES, MOST_TOKENS, TOKEN, ascii_lower, lowered, query_tokens
from loomdoc.operators.filters import predicate
from loomdoc.operators.vector_search import search
from loomdoc.sources.scratch import scratch

MOST_K, RRF_CONSTANT = 1_000, 60.0
#: Folders of terms at most; postings in a folder, if there are so many folders, and in a file of one.
BUCKETS, BUCKET_POSTINGS, FILE_POSTINGS = 1_024, 250_000, 5_000_000
_LENGTHS = -1  # the folder of the documents' own rows


class RankError(ValueError):
    """Rank lists or parameters that cannot be fused or ranked."""


@dataclass(frozen=True)
class LexicalIndex:
    """A built index: where it lies, what it covers, and the totals that scores need."""

    path: str
    key: str
    column: str
    docs: int
    mean: float
    kind: str
    folders: tuple[int, ...]
    buckets: int
    source_version: int = 0

    def manifest(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def of(manifest: str) -> LexicalIndex:
        held = json.loads(manifest)
        return LexicalIndex(**held | {"folders": tuple(held["folders"])})

    def of_terms(self, spark: SparkSession, table: str, terms: list[str]) -> DataFrame:
        """Rows of the terms, from their folders alone: no other is even listed."""
        asked = sorted({crc32(t.encode()) % self.buckets for t in terms} & set(self.folders))
        schema = f"id {self.kind}, row long, term string, tf long, n long" if table == "postings" else "term string, docs long"
        if not asked:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*(f"{self.path}/{table}/_bucket={b}" for b in asked)).where(F.col("term").isin(*terms))


def build_lexical(df: DataFrame, path: str, key: str = "id", column: str = "text", buckets: int | None = None, version: int = 0, strict: bool = False) -> LexicalIndex:
    """Index every row whose text is a string, also empty ones. Tokens are counted where the text is read; only postings are shuffled. strict: a text beyond MOST_BYTES or MOST_TOKENS is an error."""
    spark, word = df.sparkSession, re.compile(TOKEN)
    kind = df.schema[key].dataType.simpleString()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, rows, terms, tf, sizes = [], [], [], [], []
            for at, row, text in zip(b["id"], b["row"], b["text"], strict=True):
                found = Counter(word.findall(lowered(text)))
                n = found.total()
                if strict and (n > MOST_TOKENS or len(text.encode()) > MOST_BYTES):
                    raise RankError(f"document {at!r} is too long for the index")
                ids += [at] * (len(found) + 1)
                rows += [row] * (len(found) + 1)
                sizes += [n] * (len(found) + 1)
                terms += [None, *found]
                tf += [0, *found.values()]
            yield pd.DataFrame({"id": pd.Series(ids, dtype=b["id"].dtype), "row": rows, "term": terms, "tf": tf, "n": sizes})

    texts = df.where(F.col(column).isNotNull()).select(F.col(key).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(column).cast("string").alias("text"))
    made = texts.mapInPandas(counted, f"id {kind}, row long, term string, tf long, n long")
    staged = scratch(spark, "postings")
    made.write.parquet(staged)
    made = spark.read.schema(made.schema).parquet(staged)
    n = made.count()
    buckets = buckets or min(BUCKETS, max(1, ceil(n / BUCKET_POSTINGS)))
    files = max(1, ceil(n / (buckets * FILE_POSTINGS)))  # of each folder, so that a term of all documents is no single task
    made = made.withColumn("_bucket", F.when(F.col("term").isNull(), _LENGTHS).otherwise(F.pmod(F.crc32("term"), F.lit(buckets))).cast("int"))
    dealt = made.repartition((buckets + 1) * files, "_bucket", F.pmod(F.xxhash64("row"), F.lit(files)))
    dealt.sortWithinPartitions("_bucket", "term").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/postings")
    held = spark.read.parquet(f"{path}/postings")
    terms = held.where(F.col("_bucket") != _LENGTHS).groupBy("_bucket", "term").agg(F.count("*").alias("docs"))
    terms.repartition(buckets, "_bucket").sortWithinPartitions("_bucket", "term").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/terms")
    total = held.where(F.col("_bucket") == _LENGTHS).agg(F.count("*").alias("docs"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean")).first()
    folders = tuple(sorted(r[0] for r in held.where(F.col("_bucket") != _LENGTHS).select("_bucket").distinct().collect()))
    return LexicalIndex(path, key, column, total.docs, total.mean, kind, folders, buckets, version)


def _weight(tf: Column, n: Column, mean: float | Column, k1: float, b: float) -> Column:
    mean = mean if isinstance(mean, Column) else F.lit(float(mean))
    length = F.when(mean > 0, n / mean).otherwise(0.0)
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length))


def bm25_indexed(spark: SparkSession, index: LexicalIndex, text: str, k: int = 10, df: DataFrame | None = None, query: Any = None, every_term: bool = False, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """As ``bm25``, from an index. A filter is looked up in the documents' other columns (df); it changes no statistics."""
    terms = query_tokens(text)
    if not terms:
        return spark.createDataFrame([], f"id {index.kind}, score double")
    found = {r.term: r.docs for r in index.of_terms(spark, "terms", terms).collect()}  # 64 at most
    rows = index.of_terms(spark, "postings", terms)
    part = _weight(F.col("tf").cast("double"), F.col("n"), index.mean, k1, b)
    sums = rows.groupBy("row", "id").agg(F.count("*").alias("hits"), *(F.sum(F.when(F.col("term") == t, part)).alias(f"s{i}") for i, t in enumerate(terms)))
    total = F.lit(0.0)
    for i, t in enumerate(terms):  # in the query's order, so that equal documents have equal scores
        n = found.get(t, 0)
        total = total + F.lit(log(1 + (index.docs - n + 0.5) / (n + 0.5))) * F.coalesce(f"s{i}", F.lit(0.0))
    near = sums.where(F.col("hits") >= (len(terms) if every_term else 1)).select("id", total.alias("score"))
    if query:
        if df is None:
            raise RankError("a filter needs the documents")
        near = near.join(df.where(predicate(query, df.schema)).select(F.col(index.key).alias("id")), "id", "left_semi")
    return near.orderBy(F.desc("score"), "id").limit(k)


def _occurrences(term: str) -> Column:
    return F.size("w") - F.size(F.array_remove("w", term))  # compiled, unlike a filter with a lambda


def bm25(df: DataFrame, text: str, k: int = 10, query: Any = None, every_term: bool = False, k1: float = 1.2, b: float = 0.75, key: str = "id", column: str = "text") -> DataFrame:
    """id and score of the k best documents, without an index.

    The statistics cover every document whose text is a string, also empty ones; the filter
    only decides which documents are returned. One pass over the texts counts their tokens
    and the query's within each row; these narrow rows are written once, and statistics and
    scores come from them.
    """
    spark, terms = df.sparkSession, query_tokens(text)
    if not terms:
        return df.select(F.col(key).alias("id"), F.lit(0.0).alias("score")).limit(0)
    keep = predicate(query, df.schema)
    # Java's (?i) folds ASCII letters alone, as the tokenizer does; only what was found is lower-cased.
    edge = r"[A-Za-z0-9\x{80}-\x{10FFFF}]"
    pattern = f"(?i)(?<!{edge})(?:" + "|".join(f"\\Q{t}\\E" for t in terms) + f")(?!{edge})"
    hits = F.split(ascii_lower(F.array_join(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0)), " ")), " ")
    held = df.where(F.col(column).isNotNull()).select(F.col(key).alias("id"), keep.alias("keep"), F.regexp_count(F.col(column), F.lit(f"{edge}+")).alias("n"), F.explode(F.array(hits)).alias("w"))
    counts = held.select("id", "keep", "n", *(_occurrences(x).alias(f"tf{i}") for i, x in enumerate(terms)))
    path = scratch(spark, "counts")
    counts.write.parquet(path)
    counts = spark.read.schema(counts.schema).parquet(path)
    stats = counts.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *(F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(terms))))
    joined = counts.where("keep").join(F.broadcast(stats))  # one row
    total, hits = F.lit(0.0), F.lit(0)
    for i in range(len(terms)):
        tf, df_ = F.col(f"tf{i}").cast("double"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("docs") - df_ + 0.5) / (df_ + 0.5))
        total = total + F.when(tf > 0, idf * _weight(tf, F.col("n"), F.col("mean"), k1, b)).otherwise(0.0)
        hits = hits + (tf > 0).cast("int")
    return joined.where(hits >= (len(terms) if every_term else 1)).select("id", total.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def fuse(left: DataFrame, right: DataFrame, k: int = 10, left_weight: float = 1.0, right_weight: float = 1.0, constant: float = RRF_CONSTANT) -> DataFrame:
    """Reciprocal rank fusion of two lists (id, score): weight / (constant + rank), added over the lists. A list of weight 0 takes no part; an id that occurs twice in a list, and a score that is not finite, are errors when the rows are made."""
    if min(left_weight, right_weight) < 0 or left_weight + right_weight <= 0 or not all(map(isfinite, (left_weight, right_weight, constant))) or constant <= 0:
        raise RankError("weights are at least 0 and not both 0, and the constant is above 0")
    parts = []
    for ranked, weight in ((left, left_weight), (right, right_weight)):
        if weight > 0:  # the lists are top lists of at most MOST_K rows, so one task may rank them
            at, again = F.row_number().over(Window.orderBy(F.desc("score"), "id")), F.count("*").over(Window.partitionBy("id"))
            score = F.col("score").cast("double")
            odd = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
            part = F.when(again > 1, F.raise_error(F.lit("an id occurs twice in a rank list")).cast("double")).when(odd, F.raise_error(F.lit("a score is not finite")).cast("double"))
            parts.append(ranked.select("id", part.otherwise(F.lit(float(weight)) / (F.lit(float(constant)) + at)).alias("part")))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.groupBy("id").agg(F.sum("part").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def hybrid(
    df: DataFrame, vector: list[float], text: str, k: int = 10, candidates: int | None = None, query: Any = None, metric: str = "cosine", every_term: bool = False,
    vector_weight: float = 1.0, lexical_weight: float = 1.0, constant: float = RRF_CONSTANT, key: str = "id", column: str = "vector", text_column: str = "text", index: LexicalIndex | None = None,
) -> DataFrame:
    """id and fused score: the best of exact vector search and of BM25 over the same rows, the latter from an index if one is given."""
    if not 0 < k <= MOST_K:
        raise RankError(f"k is 1 to {MOST_K}")
    n = max(k, min(100, MOST_K)) if candidates is None else candidates
    if not k <= n <= MOST_K:
        raise RankError(f"candidates are k to {MOST_K}")
    near = search(df, vector, n, metric, query, key=key, column=column, payload=False).select(F.col(key).alias("id"), "score")
    if index is not None:
        words = bm25_indexed(df.sparkSession, index, text, n, df, query, every_term)
    else:
        words = bm25(df, text, n, query, every_term, key=key, column=text_column)
    return fuse(near, words, k, vector_weight, lexical_weight, constant)
