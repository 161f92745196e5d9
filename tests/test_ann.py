"""Approximate search at its defaults, over other rows than those it was measured on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdoc.operators import ann, vector_search


@pytest.mark.parametrize("rows", [500, 1900])
@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_recall_of_the_default_search(spark, tmp_path, rows, metric):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).orderBy("id").limit(rows + 100).cache()
    held, asked = df.orderBy("id").limit(rows), df.orderBy(F.desc("id")).limit(100).withColumnRenamed("id", "query_id")
    index = ann.build(held, f"{tmp_path}/cells", metric=metric)
    exact = {(r.query_id, r.id) for r in vector_search.search_many(held, asked, 10, metric).collect()}
    found = {(r.query_id, r.id) for r in ann.search_index_many(spark, index, asked, 10).collect()}
    assert len(exact & found) / len(exact) >= ann.LEAST_RECALL and index.recall[64] >= ann.LEAST_RECALL and f'"probes": {{"64": {index.probes[64]}}}' in index.manifest()
    one = asked.first()
    routed, how = ann.route(held, list(map(float, one.vector)), index)
    assert how["executed_mode"] == "ann" and {r.id for r in routed.collect()} == {i for q, i in found if q == one.query_id}


def test_routes_keep_modality_metric_and_probes(spark, tmp_path):
    deal = np.random.default_rng(4)
    df = spark.createDataFrame([(i, deal.normal(size=4).tolist(), "image" if i % 2 else "text") for i in range(200)], "id long, vector array<double>, modality string")
    index = ann.build(df, f"{tmp_path}/cells", cells=10)
    v = [1.0, 0.5, 0.0, 0.0]
    rows, how = ann.route(df, v, index, modality="text")
    assert how["executed_mode"] == "exact" and {r.modality for r in rows.collect()} == {"text"}
    rows, how = ann.route(df, v, index, metric="l2")
    assert how["executed_mode"] == "exact" and rows.first().score <= 0
    few, all_ = (ann.route(df, v, index, probes=p, k=200)[0].count() for p in (1, 10))
    assert few < all_ == 200


def test_vectors_of_several_lengths(spark, tmp_path):
    deal = np.random.default_rng(8)
    rows = [(i, deal.normal(size=4 if i % 3 else 6).tolist()) for i in range(300)] + [(900, []), (901, None), (902, [float("nan"), 1.0]), (903, [1.0, 2.0, 3.0]), (904, [None, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    index = ann.build(df, f"{tmp_path}/cells")
    assert {r.id for r in index.rows(spark).collect()} == {*range(300), 903} and set(index.probes) == {3, 4, 6}
    asked = spark.createDataFrame([(0, rows[0][1]), (1, rows[1][1]), (2, [1.0, 2.0, 3.0]), (3, []), (4, None), (5, [1.0] * 9)], "query_id long, vector array<double>")
    exact, found = (sorted(map(tuple, x.select("query_id", "rank", "id").collect())) for x in (vector_search.search_many(df, asked, 10), ann.search_index_many(spark, index, asked, 10, probes=99)))
    assert exact == found and {x[0] for x in found} == {0, 1, 2}
    ann.upsert_index(spark, index, spark.createDataFrame([(950, [1.0] * 9)], "id long, vector array<double>"))
    assert [r.id for r in ann.search_index(spark, index, [1.0] * 9, 3).collect()] == [950]
