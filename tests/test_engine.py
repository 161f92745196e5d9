import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loomdoc.functions.text import query_tokens, tokens
from loomdoc.functions.vectors import score, sparse_score
from loomdoc.operators import ann, flat, indexes, lexical, vector_search, versions, writes

LOG = "id string, _mvcc_version long, value int, _deleted boolean, _visibility_state string, seq int"


def test_versions(spark):
    rows = [("a", 2, 20), ("a", 4, 40), ("a", 1, 10), ("b", 1, 10), ("b", 3, None), ("c", 1, 10), ("c", 2, 20), ("d", 5, 50), ("d", 5, 51), ("e", None, 7)]
    log = spark.createDataFrame([(i, v, x, True if (i, v) == ("b", 3) else None, "PENDING" if (i, v) == ("c", 2) else None, n) for n, (i, v, x) in enumerate(rows)], LOG)
    now = lambda d: {r.id: r.value for r in versions.latest(d, seq="seq").collect()}
    assert now(log) == {"a": 40, "c": 20, "d": 51, "e": 7}
    assert now(versions.visible(log)) == {"a": 40, "c": 10, "d": 51, "e": 7}
    assert now(versions.visible(log, applied=3)) == {"a": 20, "c": 10, "e": 7}
    assert versions.latest(log, deleted=None).count() == 5 and versions.compact(log, whole=False).count() == 5
    layers = [log.where("id = 'd' and value = 51"), log.where("id = 'd' and value = 50")]
    assert [r.value for r in versions.merge(layers).collect()] == [50]
    text = spark.createDataFrame([("x", "12abc"), ("x", "9")], "id string, version string")
    assert versions.latest(text).first().version == "12abc"
    assert versions.own(spark.createDataFrame([("u",), (None,), ("v",)], "tenant_id string"), "u").count() == 2


def test_updates(spark):
    df = spark.createDataFrame([(1, 2.9, "a", None), (2, None, "b", [1]), (3, 5.0, None, [2])], "id long, n double, s string, t array<int>")
    out = {r.id: r for r in writes.update_many(df, {"id": {"$lte": 2}}, {"$set": {"s": "z", "t": [7], "new.field": 1}, "$inc": {"n": 3}, "$unset": ["s"]}).collect()}
    assert (out[1].n, out[2].n, out[3].n) == (5.0, 3.0, 5.0) and out[1].s is None and out[1].t == [7] and out[1]["new.field"] == 1 and out[3].s is None
    assert [r.s for r in writes.update_one(df, {}, {"s": "one"}, "id").orderBy("id").collect()] == ["one", "b", None]
    assert writes.update_one(df, {"id": 99}, {"s": "q"}, "id").where("s = 'q'").count() == 0
    assert writes.delete_one(df, {}, "id").count() == 2 and writes.delete_many(df, {"n": {"$exists": True}}).count() == 1
    with pytest.raises(writes.WriteError):
        writes.update_many(df, {}, {"$unset": {"s": 1}})
    rows, errors = writes.bulk(df.select("id", "s"), [{"insertOne": {"document": {"id": 9, "s": "n"}}}, {"odd": {}}, {"deleteMany": {"filter": {"id": 1}}}, {"updateOne": {"filter": {}}}], "id")
    assert sorted(r.id for r in rows.collect()) == [2, 3, 9] and [e["index"] for e in errors] == [1, 3]
    new, conflicts = writes.insert_once(df.select("id", "s"), spark.createDataFrame([(1, "a"), (2, "other"), (5, "n")], "id long, s string"), "id")
    assert [r.id for r in new.collect()] == [5] and [r.id for r in conflicts.collect()] == [2]
    twice = spark.createDataFrame([(5, "one"), (5, "two"), (5, "one"), (None, "x"), (None, "y")], "id long, s string").coalesce(1)
    assert sorted(((r.id, r.s) for r in writes.upsert(df.select("id", "s"), twice, "id").collect()), key=str) == sorted([(1, "a"), (2, "b"), (3, None), (5, "one"), (None, "x"), (None, "y")], key=str)
    new, conflicts = writes.insert_once(df.select("id", "s"), twice, "id")
    assert sorted(((r.id, r.s) for r in new.collect()), key=str) == [(5, "one"), (None, "x"), (None, "y")] and [(r.id, r.s) for r in conflicts.collect()] == [(5, "two")]
    many = [{"insertOne": {"document": {"id": 100 + i % 7, "s": f"v{i}"}}} for i in range(120)] + [{"deleteOne": {"filter": {"id": 100}}}, {"deleteMany": {"filter": {"id": 101}}}]
    many += [x for i in range(60) for x in ({"updateOne": {"filter": {"id": 103}, "update": {"$set": {"s": f"u{i}"}}}}, {"insertOne": {"document": {"id": 200, "s": "z"}}})]
    rows, errors = writes.bulk(df.select("id", "s"), many, "id")
    assert not errors and {r.id: r.s for r in rows.collect()} == {1: "a", 2: "b", 3: None, 102: "v114", 103: "u59", 104: "v116", 105: "v117", 106: "v118", 200: "z"}
    named = writes.with_id(spark.createDataFrame([("",), (None,), ("k",)], "id string")).collect()
    assert len(named[0].id) == len(named[1].id) == 24 and named[2].id == "k"


def test_vector_scores(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1e300, 1e300], [1e300, 0.0]), ([1.0], [1.0, 2.0]), ([math.nan, 1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = df.select(*(score(m, F.col("a"), F.col("b")).alias(m) for m in ("cosine", "l2", "dot"))).collect()
    assert got[0].cosine == pytest.approx(0.8) and got[0].l2 == pytest.approx(-math.sqrt(2)) and got[0].dot == 4
    assert got[1].cosine == 0 and got[2].cosine == pytest.approx(math.sqrt(0.5)) and got[2].dot is None and got[3].cosine is None and got[4].dot is None
    s = spark.createDataFrame([([0, 3], [2.0, -1.0], [0, 3], [1.0, 3.0])], "i array<int>, x array<double>, j array<int>, y array<double>")
    one = s.select(*(sparse_score(m, F.col("i"), F.col("x"), F.col("j"), F.col("y")).alias(m) for m in ("dot", "l2", "cosine"))).first()
    assert one.dot == -1 and one.l2 == pytest.approx(-math.sqrt(17)) and one.cosine == pytest.approx(-1 / math.sqrt(50))


def test_sparse_matches_dense(spark):
    deal = random.Random(1701)
    rows = []
    for _ in range(100):
        a, b = ([deal.uniform(-1, 1) if deal.random() < 0.3 else 0.0 for _ in range(32)] for _ in range(2))
        rows.append((a, b, [i for i, v in enumerate(a) if v], [v for v in a if v], [i for i, v in enumerate(b) if v], [v for v in b if v]))
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, i array<int>, x array<double>, j array<int>, y array<double>")
    for m in ("dot", "l2", "cosine"):
        worst = df.select(F.max(F.abs(score(m, F.col("a"), F.col("b")) - sparse_score(m, F.col("i"), F.col("x"), F.col("j"), F.col("y"))))).first()[0]
        assert worst < 1e-10


def test_search_rules(spark):
    rows = [("unit", [1.0, 0.0], "keep", "text"), ("big", [9.0, 0.0], "keep", "image"), ("far", [0.0, 1.0], "drop", "text"), ("flat", [1.0, 1.0, 1.0], "keep", "text"), ("none", None, "keep", "text"), ("big", [1.0, 0.0], "keep", "image")]
    df = spark.createDataFrame(rows, "id string, vector array<double>, tag string, modality string")
    ids = lambda **how: [(r.id, round(r.score, 6)) for r in vector_search.search(df, [1.0, 0.0], **how).collect()]
    assert ids(k=2) == [("big", 1.0), ("unit", 1.0)] and ids(k=9, metric="dot") == [("big", 9.0), ("unit", 1.0), ("far", 0.0)]
    assert ids(query={"tag": "keep"}, modality="text") == [("unit", 1.0)] and ids(k=1, metric="l2")[0][1] == 0
    large = spark.createDataFrame([("a", [1e200, 1e200]), ("b", [1.0, 0.0])], "id string, vector array<double>")
    assert [r.score for r in vector_search.search(large, [1e100, 0.0], metric="dot").collect()] == [1e300, 1e100]
    assert vector_search.search(large, [1.0, 1.0]).first().id == "a" and vector_search.search(large, [0.0, 0.0], metric="l2").collect()[1].score == pytest.approx(-math.sqrt(2) * 1e200)
    with pytest.raises(Exception, match="vector_score_out_of_range"):
        vector_search.search(large, [1e200, 0.0], metric="dot").collect()
    for bad in ({"k": 0}, {"metric": "odd"}, {"name": "nowhere"}):
        with pytest.raises(vector_search.VectorError):
            vector_search.search(df, [1.0, 0.0], **bad)
    for v in ([], [math.inf], ["a"], [True], "x"):
        with pytest.raises(vector_search.VectorError):
            vector_search.checked_dense(v)
    for v in ({"dimensions": 0, "indices": [], "values": []}, {"dimensions": 4, "indices": [2, 1], "values": [1, 1]}, {"dimensions": 4, "indices": [4], "values": [1]}, {"dimensions": 4, "indices": [1], "values": []}, {"dimensions": 4, "indices": [1.0], "values": [1]}, {"dimensions": 4, "indices": [1], "values": [math.nan]}):
        with pytest.raises(vector_search.VectorError):
            vector_search.checked_sparse(v)
    sparse = spark.createDataFrame([("a", (4, [3], [2.0])), ("b", (4, [1], [1.0])), ("c", (5, [3], [9.0]))], "id string, vector struct<dimensions int, indices array<int>, values array<double>>")
    assert [(r.id, r.score) for r in vector_search.search_sparse(sparse, {"dimensions": 4, "indices": [3], "values": [1.0]}).collect()] == [("a", 2.0), ("b", 0.0)]


def test_batches_equal_single_searches(spark):
    deal = random.Random(20261029)
    df = spark.createDataFrame([(i, [deal.uniform(-1, 1), deal.uniform(-1, 1)]) for i in range(350)], "id long, vector array<double>")
    asked = spark.createDataFrame([(q, [deal.uniform(-1, 1), deal.uniform(-1, 1)]) for q in range(7)], "query_id long, vector array<double>")
    many = sorted((r.query_id, r["rank"], r.id) for r in vector_search.search_many(df, asked, 3, block=3).collect())
    one = [(q.query_id, n + 1, r.id) for q in asked.collect() for n, r in enumerate(vector_search.search(df, list(q.vector), 3).collect())]
    assert many == sorted(one)


def test_packed_index_is_exact(spark, tmp_path):
    deal = random.Random(12)
    rows = [(i, [deal.uniform(-1, 1) for _ in range(5)]) for i in range(300)] + [(5, [1.0] * 5), (900, [1.0, 2.0]), (901, None), (902, [math.nan] * 5), (903, []), (904, [0.0] * 5), (905, [1e300] * 5)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    index = flat.build_flat(df, f"{tmp_path}/flat")
    for metric in ("cosine", "l2", "dot"):
        near, want = flat.search_flat(spark, index, [0.5, 1.0, 0.0, -0.25, 2.0], 9, metric), vector_search.search(df, [0.5, 1.0, 0.0, -0.25, 2.0], 9, metric, payload=False)
        assert [(r.id, pytest.approx(r.score)) for r in want.collect()] == [(r.id, r.score) for r in near.collect()]
    assert flat.search_flat(spark, index, [1.0, 2.0]).first().id == 900 and flat.search_flat(spark, index, [1.0]).count() == 0
    with pytest.raises(vector_search.VectorError):
        flat.search_flat(spark, index, [1.0], 0)


def test_approximate_search(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index = ann.build(df, f"{tmp_path}/cells", cells=10)
    asked = [list(map(float, r.vector)) for r in df.where("id % 100 = 0").collect()]
    assert ann.recall(df, index, asked, 10, probes=7) >= 0.9
    assert index.rows(spark).count() == df.count()
    moved = spark.createDataFrame([(3, asked[0]), (9999, asked[0])], "id long, vector array<float>")
    ann.upsert_index(spark, index, moved)
    top = [r.id for r in ann.search_index(spark, index, asked[0], 3).collect()]
    assert top == [0, 3, 9999] and index.rows(spark).count() == df.count() + 1
    assert ann.route(df, asked[0], index, "auto", k=2)[1]["executed_mode"] == "ann" and ann.route(df, asked[0], index, "auto", k=2, query={"id": {"$gt": 5}})[1]["executed_mode"] == "exact"
    with pytest.raises(vector_search.VectorError):
        ann.search_index(spark, index, asked[0], version=9)
    with pytest.raises(vector_search.VectorError):
        ann.route(df, asked[0], None, "ann", fallback=False)


CORPUS = [("a", "alpha alpha beta", 1), ("b", "alpha gamma", 2), ("c", "beta delta delta delta", 1), ("d", "", 2), ("e", None, 1)]


def exhaustive(terms, docs, k1=1.2, b=0.75):
    held = {i: (t or "").split() for i, t, _ in docs if t is not None}
    mean = sum(map(len, held.values())) / len(held)
    out = {}
    for i, words in held.items():
        s = 0.0
        for t in terms:
            f, df = words.count(t), sum(t in w for w in held.values())
            if f:
                s += math.log(1 + (len(held) - df + 0.5) / (df + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(words) / mean))
        if s or any(t in words for t in terms):
            out[i] = s
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def test_bm25(spark):
    df = spark.createDataFrame(CORPUS, "id string, text string, kind int")
    got = [(r.id, r.score) for r in lexical.bm25(df, "Alpha, beta ALPHA").collect()]
    want = exhaustive(["alpha", "beta"], CORPUS)
    assert [i for i, _ in got] == [i for i, _ in want] and all(abs(x - y) < 1e-12 for (_, x), (_, y) in zip(got, want))
    assert [r.id for r in lexical.bm25(df, "alpha beta", every_term=True).collect()] == ["a"] and lexical.bm25(df, "alpha nowhere", every_term=True).count() == 0
    kept = {r.id: r.score for r in lexical.bm25(df, "alpha beta", query={"kind": 1}).collect()}
    assert kept == pytest.approx({i: s for i, s in want if i in "ac"}) and lexical.bm25(df, "...").count() == 0
    assert query_tokens("Alpha,beta ALPHA! 123 été") == ["alpha", "beta", "123", "été"]
    assert spark.createDataFrame([("Alpha,beta ALPHA! 123 Été",)], "t string").select(tokens(F.col("t"))).first()[0] == ["alpha", "beta", "alpha", "123", "Été"]
    for bad in ("x" * 4097, " ".join(f"t{i}" for i in range(65))):
        with pytest.raises(ValueError):
            query_tokens(bad)


def test_an_index_scores_as_a_scan(spark, tmp_path):
    deal = random.Random(6)
    words = ["alpha", "beta", "Gamma", "delta,", "été", "x1"]
    rows = [(i, " ".join(deal.choice(words) for _ in range(deal.randrange(12))), i % 3) for i in range(200)] + [(200, None, 1), (201, "", 1), (202, "alpha " * 3000, 2)]
    df = spark.createDataFrame(rows, "id long, text string, kind int")
    index = lexical.build_lexical(df, f"{tmp_path}/words", buckets=4)
    assert (index.docs, lexical.LexicalIndex.of(index.manifest())) == (202, index)
    for text, how in (("alpha GAMMA", {}), ("été nowhere beta", {}), ("alpha delta x1", {"every_term": True}), ("beta", {"query": {"kind": 1}}), ("nowhere", {}), ("...", {})):
        scan, held = lexical.bm25(df, text, 20, **how), lexical.bm25_indexed(spark, index, text, 20, df, **how)
        assert [(r.id, pytest.approx(r.score, abs=1e-12)) for r in scan.collect()] == [(r.id, r.score) for r in held.collect()]
    plan = index.of_terms(spark, "postings", ["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,alpha)" in plan and {f.split("_bucket=")[1].split("/")[0] for f in index.of_terms(spark, "postings", ["alpha"]).inputFiles()} == {str(zlib.crc32(b"alpha") % 4)}
    with pytest.raises(Exception, match="too long"):
        lexical.build_lexical(df.withColumn("text", F.repeat(F.lit("word "), 70_000)).limit(1), f"{tmp_path}/long", strict=True)


def test_fusion_refuses_what_is_no_rank_list(spark):
    good = spark.createDataFrame([("a", 2.0)], "id string, score double")
    for rows in ([("a", 1.0), ("a", 0.5)], [("a", math.inf)], [("a", math.nan)], [("a", None)]):
        with pytest.raises(Exception, match="rank list|not finite"):
            lexical.fuse(good, spark.createDataFrame(rows, "id string, score double")).collect()


def test_winners_are_found_once(spark):
    """One scan of the table and no shuffle of all keys where keys and scores are asked for."""
    df = spark.range(1000).select("id", F.array(F.rand(3), F.rand(4)).alias("vector")).cache()
    plan = vector_search.search(df, [1.0, 0.5], 5, payload=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1
    full, bare = vector_search.search(df, [1.0, 0.5], 5), vector_search.search(df, [1.0, 0.5], 5, payload=False)
    assert [(r.id, r.score) for r in full.collect()] == [(r.id, r.score) for r in bare.collect()] and full.columns == ["id", "vector", "score"]


def test_fusion(spark):
    left = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "id string, score double")
    right = spark.createDataFrame([("b", 9.0), ("c", 8.0)], "id string, score double")
    got = [(r.id, r.score) for r in lexical.fuse(left, right).collect()]
    assert [i for i, _ in got] == ["b", "a", "c"] and got[0][1] == pytest.approx(1 / 61 + 1 / 62)
    assert [r.id for r in lexical.fuse(left, right, left_weight=0).collect()] == ["b", "c"]
    for bad in ({"left_weight": -1}, {"left_weight": 0, "right_weight": 0}, {"constant": 0}, {"constant": math.nan}):
        with pytest.raises(lexical.RankError):
            lexical.fuse(left, right, **bad)
    df = spark.createDataFrame([("a", [1.0, 0.0], "alpha", "news"), ("b", [0.9, 0.0], "beta", "old"), ("c", None, "alpha alpha", "old")], "id string, vector array<double>, text string, kind string")
    assert [r.id for r in lexical.hybrid(df, [1.0, 0.0], "alpha", 3, 4, metric="dot").collect()][0] == "a"
    assert [r.id for r in lexical.hybrid(df, [1.0, 0.0], "alpha", 3, query={"kind": "old"}, metric="dot").collect()] == ["b", "c"]


def test_indexes(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "x")], "id long, f string")
    held = indexes.postings(df, "f")
    assert [r.id for r in indexes.lookup(df, held, "f", "x").orderBy("id").collect()] == [1, 4]
    odd = held.where("id <> 4").union(spark.createDataFrame([("z", 2), ("x", 77), ("q", 3)], "value string, id long"))
    assert indexes.validate(df, odd, "f").first().asDict() == {"valid": 2, "stale": 2, "extra": 1, "missing": 1}
    one, two = indexes.digest(df).first(), indexes.digest(df.repartition(3).orderBy(F.desc("id"))).first()
    assert one == two and one.status == "OK" and indexes.digest(df.where("id < 4")).first().digest != one.digest
    assert indexes.digest(df, most=2).first().status == "TRUNCATED" and indexes.digest(df, key="f").first().status == "INVALID_ROW"
    rows, partial = indexes.limited(df, 3)
    assert rows.count() == 3 and partial.first().partial and indexes.limited(df, 9)[1].first().asDict() == {"partial": False, "partial_reason": None}
    rows, partial = indexes.limited(df, 9, 40)
    assert 0 < rows.count() < 4 and partial.first().partial_reason == "result_bytes" and indexes.limited(df.limit(0), 3)[1].first().partial is False
    with pytest.raises(ValueError):
        indexes.IndexOptions("a.b")
