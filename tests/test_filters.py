import json
import random

import pytest
from pyspark.sql import functions as F
from pyeval import matches

from loomdoc.operators import english, filters, pipeline

DOCS = [
    {"id": "a", "n": 1, "s": "Alpha", "b": True, "x": None, "tags": ["p", "q"], "o": {"city": "Rome", "k": 1}, "items": [{"v": 1}, {"v": 9, "w": "z"}]},
    {"id": "b", "n": 2.5, "s": "beta", "b": False, "tags": [], "o": {"city": "Oslo"}, "items": [{"v": 5}]},
    {"id": "c", "n": -3, "s": "", "tags": [1, 2.0, "p"], "o": {}, "items": [5, 7]},
    {"id": "d", "n": 10, "s": "10", "x": 4, "tags": ["q", "p"], "o": {"city": None, "deep": {"er": [1]}}},
    {"id": "e", "n": "10", "s": "été", "b": "true", "x": [1, [2]], "tags": "p"},
    {"id": "f"},
    {"id": "g", "n": 9007199254740993, "x": {"a": 1, "b": [True, None]}, "o": [{"city": "Rome"}]},
    {"id": "h", "n": 1.0, "s": "ALPHA beta", "x": 1000.0, "tags": [None, {"a": 1}]},
]
QUERIES = [
    {}, None, {"n": 1}, {"n": 1.0}, {"n": "10"}, {"s": "10"}, {"x": None}, {"b": True}, {"b": "true"}, {"tags": ["p", "q"]}, {"tags": "p"}, {"x": {"a": 1, "b": [True, None]}}, {"x": {"b": [True, None], "a": 1.0}}, {"x": [1, [2]]},
    {"n": {"$ne": 1}}, {"x": {"$ne": None}}, {"zz": {"$ne": 1}}, {"$not": {"zz": {"$ne": 1}}}, {"n": {"$gt": 2}}, {"n": {"$gte": 2.5, "$lt": 11}}, {"s": {"$gt": "b"}}, {"b": {"$gt": 5}}, {"n": {"$lt": "2"}}, {"x": {"$lte": "z"}},
    {"n": {"$in": [1, "10"]}}, {"tags": {"$in": ["q", 2]}}, {"tags": {"$nin": ["q", 2]}}, {"zz": {"$nin": [1]}}, {"n": {"$in": 1}}, {"$not": {"n": {"$in": 1}}}, {"n": {"$in": []}}, {"n": {"$nin": []}}, {"x": {"$in": [None]}},
    {"tags": {"$all": ["p"]}}, {"tags": {"$all": ["p", "q"]}}, {"tags": {"$all": []}}, {"s": {"$all": []}}, {"tags": {"$size": 2}}, {"tags": {"$size": 2.9}}, {"tags": {"$size": "2"}}, {"tags": {"$size": 0}},
    {"items": {"$elemMatch": {"v": {"$gt": 4}}}}, {"items": {"$elemMatch": {"v": 9, "w": "z"}}}, {"items": {"$elemMatch": {"$gt": 4}}}, {"items": {"$elemMatch": {"$not": {"v": 1}}}}, {"o.deep": {"$elemMatch": {"er": 1}}},
    {"x": {"$exists": True}}, {"x": {"$exists": False}}, {"x": {"$exists": 0}}, {"o.city": {"$exists": True}}, {"o.city": "Rome"}, {"o.deep.er": [1]}, {"o.city": None}, {"o.city": {"$ne": "Rome"}},
    *({"x": {"$type": t}} for t in ("null", "int", "double", "string", "object", "array", "bool", "unknown", 10, 16, 1, 3, 99)), {"n": {"$type": "double"}}, {"n": {"$type": 16}},
    {"s": {"$regex": "^a"}}, {"s": {"$regex": "^a", "$options": "i"}}, {"s": {"$regex": "a$", "$ne": "beta"}}, {"n": {"$regex": "1"}}, {"s": {"$text": {"$search": "ALPHA"}}}, {"s": {"$text": {"$search": "ÉTÉ"}}}, {"s": {"$text": {}}},
    {"$and": []}, {"$or": []}, {"$nor": []}, {"$or": [{}, {"n": 1}, 5]}, {"$and": [{"n": 1}, 5]}, {"$or": "x"}, {"$nor": [{"n": 1}, {"b": False}]}, {"n": {"$not": {"$gt": 2}}}, {"zz": {"$not": {"$gt": 2}}},
    {"$or": [{"n": 1}], "s": "never looked at"}, {"$and": [{"n": 1}], "$nor": [{"n": 1}]}, {"n": {"$near": 1}}, {"o": {"city": "Oslo"}}, {"o": {}}, {"s": {"$eq": ""}},
]


@pytest.fixture(scope="module")
def variants(spark):
    rows = [(d["id"], json.dumps(d)) for d in DOCS]
    return spark.createDataFrame(rows, "id string, body string").select("id", F.parse_json("body").alias("doc")).cache()


@pytest.mark.filterwarnings("ignore:only")
def test_variant_filters_match_the_rules(variants):
    tests = variants.select("id", *(filters.variant_predicate(q, "doc").alias(f"q{i}") for i, q in enumerate(QUERIES)))
    for row in tests.collect():
        doc = next(d for d in DOCS if d["id"] == row.id)
        wrong = [(q, row[f"q{i}"]) for i, q in enumerate(QUERIES) if row[f"q{i}"] is not matches(q, doc)]
        assert not wrong, (row.id, wrong)


@pytest.mark.filterwarnings("ignore:only")
def test_typed_filters_match_the_rules(spark):
    deal = random.Random(1701)
    docs = [
        {k: v for k, v in {"id": i, "n": deal.choice([None, 1, 2, 3]), "d": deal.choice([None, 0.5, 2.0]), "s": deal.choice([None, "a", "b", "B c", "2"]), "b": deal.choice([None, True, False]), "t": deal.choice([None, [], [1], [1, 2], [2, 1]]), "o": {"p": deal.choice([1, 2]), "q": deal.choice(["x", "y"])}}.items() if v is not None}
        for i in range(60)
    ]
    df = spark.createDataFrame([{**dict.fromkeys(("n", "d", "s", "b", "t")), **d} for d in docs], "id long, n int, d double, s string, b boolean, t array<int>, o struct<p int, q string>")
    ops = ["$eq", "$ne", "$gt", "$gte", "$lt", "$lte"]

    def leaf():
        f = deal.choice(["n", "d", "s", "b", "t", "o.p", "o.q", "zz", "id"])
        v = {"n": 2, "d": 2, "s": "b", "b": True, "t": [1, 2], "o.p": 1, "o.q": "x", "zz": 1, "id": 30}[f]
        kind = deal.randrange(6)
        if kind == 0:
            return {f: {deal.choice(["$in", "$nin"]): [v, deal.choice([1, "a"])]}}
        if kind == 1:
            return {f: {"$exists": deal.random() < 0.5}}
        if kind == 2 and f == "t":
            return {f: {deal.choice(["$size", "$all"]): deal.choice([1, 2])} if deal.random() < 0.5 else {"$all": [1]}}
        return {f: {deal.choice(ops[:2] if f in ("b", "t") else ops): v}}

    def tree(depth):
        if depth == 0 or deal.random() < 0.3:
            return leaf()
        op = deal.choice(["$and", "$or", "$nor", "$not"])
        return {op: tree(depth - 1) if op == "$not" else [tree(depth - 1) for _ in range(deal.randrange(1, 4))]}

    queries = [tree(3) for _ in range(80)]
    rows = df.select("id", *(filters.predicate(q, df.schema).alias(f"q{i}") for i, q in enumerate(queries))).collect()
    for row in rows:
        doc = next(d for d in docs if d["id"] == row.id)
        wrong = [(q, row[f"q{i}"]) for i, q in enumerate(queries) if row[f"q{i}"] is not matches(q, doc)]
        assert not wrong, (doc, wrong[:3])


def test_golden_counts(spark):
    nums = spark.range(1, 11).select(F.col("id").cast("int").alias("n"), (F.col("id") % 2 == 0).alias("even"))
    want = [({"n": {"$gt": 5}}, 5), ({"n": {"$gte": 5}}, 6), ({"n": {"$lt": 3}}, 2), ({"n": {"$lte": 3}}, 3), ({"n": {"$ne": 5}}, 9), ({"n": {"$in": [1, 3, 5]}}, 3), ({"$or": [{"n": 1}, {"n": 3}]}, 2), ({"even": True}, 5), ({"n": {"$gte": 7}}, 4)]
    assert [filters.count(nums, q).first().n for q, _ in want] == [n for _, n in want]


@pytest.mark.parametrize("pattern", [r"(a)\1", "(?=a)", "(?!a)", "(?<=a)b", "a++", "x" * 4097, "(", 5])
def test_refused_patterns(pattern):
    with pytest.raises(filters.FilterError):
        filters.parse({"s": {"$regex": pattern}})


LINES = ["abc", "abc\n", "a\rc", "a\nc", "xyz:", "abc123", "aaaa!", "", "É", "ſ", "K", "Straße", "x" * 50_000 + "y", "a.c", None]


@pytest.mark.parametrize("options", ["", "i"])
@pytest.mark.parametrize("pattern", ["[[:digit:]]+", "abc$", "a.c", "(a+)+$", "^a", "^$", "x+y$", r"a\.c", r"\d{3}$", "[^a-z]", "[A-Z]", "k", "s", "é", "(a|b)*c", ".$", "(x+x+)+z", "^x*$", "[a-c]{3}", "a-c", r"\w+$"])
def test_patterns_are_re2s(spark, pattern, options):
    """What RE2 itself finds, also where the pattern is rewritten for Java."""
    import pyarrow as pa
    import pyarrow.compute as pc

    df = spark.createDataFrame(list(enumerate(LINES)), "id long, s string")
    got = {r.id for r in filters.find(df, {"s": {"$regex": pattern, "$options": options}}).collect()}
    want = pc.match_substring_regex(pa.array(LINES), pattern=pattern, ignore_case=bool(options)).to_pylist()
    assert got == {i for i, x in enumerate(want) if x}


def test_patterns_within_elements(spark):
    df = spark.createDataFrame([(1, [("ab\n",)]), (2, [("ab",), ("x",)])], "id long, items array<struct<s string>>")
    assert [r.id for r in filters.find(df, {"items": {"$elemMatch": {"s": {"$regex": "b$"}}}}).collect()] == [2]
    with pytest.raises(filters.FilterError):
        filters.find(df, {"items": {"$elemMatch": {"s": {"$regex": "(b|c)+$"}}}})


def test_refused_options_and_operands():
    for q in ({"s": {"$regex": "a", "$options": "m"}}, {"s": {"$text": "a"}}, {"$vectorSearch": 3}):
        with pytest.raises(filters.FilterError):
            filters.parse(q)
    with pytest.warns(UserWarning, match="only"):
        filters.parse({"$or": [{"a": 1}], "b": 2})


def test_threshold_filter(spark):
    df = spark.createDataFrame([("u", [1.0, 0.0]), ("v", [0.0, 1.0]), ("z", [0.0, 0.0]), ("w", [1.0, 0.0, 0.0]), ("n", None)], "id string, vector array<double>")
    find = lambda **spec: [r.id for r in filters.find(df, {"$vectorSearch": {"queryVector": [1.0, 0.0], **spec}}).orderBy("id").collect()]
    assert find() == ["u"] and find(threshold=0) == ["u", "v", "z"] and find(metric="euclidean", threshold=0.45) == ["u", "z"]
    assert find(metric="dot_product", threshold=0) == ["u", "v", "z"] and find(metric="odd") == ["u"] and find(field="none") == []


def test_lint_lookup_explain():
    assert filters.lint({})["cost"] == 100 and filters.lint({"a": {"$regex": "x"}})["cost"] == 40 and filters.lint({"a": {"$nin": [1]}, "b": {"$ne": 1}})["cost"] == 65
    assert not filters.lint([1])["valid"] and filters.lint({"$or": [{"a": 1}] * 6})["cost"] == 40
    assert filters.fixed(filters.parse({"$and": [{"id": "x"}, {"$or": [{"b": 1}]}], "c": 1})) == {"id": "x"} and filters.fixed(filters.parse({"name": {"$gt": "x"}})) == {}
    assert filters.explain({"name": "Ada"})["plan"] == "FULL_SCAN" and filters.explain({"name": "Ada", "a": 1}, indexed=["name"])["index_field"] == "name" and filters.explain({"score": {"$gt": 1}}, indexed=["score"])["plan"] == "FULL_SCAN"
    deep = {"a": 1}
    for _ in range(11):
        deep = {"$and": [deep, {"b": 1}]}
    assert filters.lint(deep)["cost"] == 30


def test_pipeline_rules(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("b", None, "y"), ("c", 1, "z"), ("d", 3, None)], "id string, score int, name string")
    run = lambda stages: [tuple(r) for r in pipeline.aggregate(df, stages, "id").collect()]
    assert run([{"$sort": {"score": 1}}, {"$project": {"id": 1}}]) == [("c",), ("a",), ("d",), ("b",)]
    assert run([{"$sort": {"score": -1}}, {"$project": {"id": 1}}]) == [("b",), ("a",), ("d",), ("c",)]
    assert run([{"$match": {"score": 3}}, {"$count": "n"}]) == [(2,)] and run([{"$match": {"score": 99}}, {"$count": "n"}]) == [(0,)]
    assert run([{"$sort": {"id": 1}}, {"$skip": 1}, {"$limit": 2}, {"$project": {"name": True, "o.p": 1}}]) == [("y",), ("z",)]
    for bad in ([{"$group": {}}], [{"$limit": 0}], [{"$skip": -1}], [{"$project": {"a": 0}}], [{"$sort": {"a": 2}}], [{"$count": "n"}, {"$limit": 1}], [{"$match": {}, "$limit": 1}], [{"$limit": True}]):
        with pytest.raises(pipeline.PipelineError):
            pipeline.aggregate(df, bad)
    out, seen = pipeline.aggregate_counted(df, [{"$match": {"score": 3}}, {"$project": {"id": 1}}, {"$limit": 1}])
    assert out.count() == 1 and [tuple(s) for s in seen.orderBy("position").collect()] == [(0, "$match", 4, 2), (1, "$project", 2, 2), (2, "$limit", 2, 1)]


def test_sort_of_mixed_values(spark):
    """Strings, then numbers by value, then all else by its JSON text; what is missing counts as null."""
    docs = ['{"v": 10}', '{"v": "b"}', '{"v": -2.5}', '{"v": null}', "{}", '{"v": true}', '{"v": [1]}', '{"v": {"a": 1}}', '{"v": "a"}', '{"v": false}', '{"v": 9}']
    df = spark.createDataFrame(list(enumerate(docs)), "id long, t string").withColumn("doc", F.parse_json("t"))
    up = [r.id for r in pipeline.sort_documents(df, {"v": 1}, "doc", "id").collect()]
    assert up == [8, 1, 2, 10, 0, 6, 9, 3, 4, 5, 7]
    assert [r.id for r in pipeline.sort_documents(df, {"v": -1}, "doc", "id").collect()] == [7, 5, 3, 4, 9, 6, 0, 10, 2, 1, 8]


def test_english():
    q = english.compile_question("first 5 users where age greater than 18 sort by name")
    assert q == {"query": {"age": {"$gt": 18}}, "limit": 5, "sort": {"name": 1}}
    q = english.compile_question("whose a is at least 2.5 and b is not 'x' and ok = TRUE order by z descending")
    assert q == {"query": {"a": {"$gte": 2.5}, "b": {"$ne": "x"}, "ok": True}, "limit": 20, "sort": {"z": -1}}
    assert english.compile_question("top 500")["limit"] == 100
    for text, code in (("", "INVALID_QUESTION"), ("x" * 1001, "INVALID_QUESTION"), ("delete users", "READ_ONLY"), ("where it resembles something", "AMBIGUOUS")):
        with pytest.raises(english.QuestionError) as e:
            english.compile_question(text)
        assert e.value.code == code
    q = english.compile_question('show the top 3 rows with name = "Smith and Sons" and price < 5.50 order by price')
    assert q == {"query": {"name": "Smith and Sons", "price": {"$lt": 5.5}}, "limit": 3, "sort": {"price": 1}}
    q = english.compile_question("rows where size greater than or equal to 4 and size less than or equal to 9")
    assert q["query"] == {"size": {"$lte": 9}} and q["limit"] == 20 and q["sort"] is None
    assert english.compile_question("where owner is O'Neil and x != null and y equal to -3")["query"] == {"owner": "O'Neil", "x": {"$ne": None}, "y": -3}
    for text in ("where a", "where a is", "where 5 is a", "where a is 1 and", "where a not 5"):
        with pytest.raises(english.QuestionError):
            english.compile_question(text)
