"""Every query of the catalogue against its SQL, over the smallest tables."""

import pytest
from oracle import same

from loomdoc.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, name):
    got, want = same(spark, "/root/testdata/sf0.001", catalogue.QUERIES[name], catalogue.ORACLES[name])
    assert got == want


def test_names():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES) and catalogue.FLAGSHIP in catalogue.QUERIES.values()


def test_recall_of_the_approximate_query(spark):
    from pyspark.sql import functions as F

    from loomdoc.operators.vector_search import search_many

    at = "/root/testdata/sf0.001"
    rows = catalogue.table(spark, at, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = {(r.query_id, r.id) for r in search_many(rows, asked, 10, "cosine", "vec_id", "embedding").collect()}
    found = {(r.query_id, r.id) for r in catalogue.QUERIES["ann_topk"](spark, at).collect()}
    assert len(exact & found) / len(exact) >= 0.9
