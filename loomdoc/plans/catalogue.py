"""Every query of the engine's own operators by name, and its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.functions.text import tokens
from loomdoc.functions.vectors import sparse_score
from loomdoc.functions.values import Variant
from loomdoc.operators import ann, english, filters, flat, indexes, lexical, pipeline, vector_search, versions, writes
from loomdoc.sources import media
from loomdoc.sources.scratch import file_states, scratch
from loomdoc.sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that returns the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Filters ------------------------------------------------------------------------------

#: name: (table, columns, filter, the same condition in SQL)
FILTERS: dict[str, tuple[str, tuple[str, ...], dict, str]] = {
    "filter_all": ("supplier", ("s_suppkey",), {}, "true"),
    "filter_eq": ("orders", ("o_orderkey", "o_totalprice"), {"o_orderstatus": "F"}, "o_orderstatus = 'F'"),
    "filter_eq_number": ("lineitem", ("l_orderkey", "l_linenumber"), {"l_quantity": 5}, "l_quantity = 5"),
    "filter_eq_none": ("customer", ("c_custkey",), {"c_name": None}, "false"),
    "filter_ne": ("orders", ("o_orderkey",), {"o_orderpriority": {"$ne": "1-URGENT"}}, "o_orderpriority <> '1-URGENT'"),
    "filter_range": ("lineitem", ("l_orderkey", "l_linenumber", "l_quantity"), {"l_quantity": {"$gte": 10, "$lt": 20}, "l_discount": {"$gt": 0.05, "$lte": 0.08}}, "l_quantity >= 10 and l_quantity < 20 and l_discount > 0.05::double and l_discount <= 0.08::double"),
    "filter_range_text": ("orders", ("o_orderkey",), {"o_orderpriority": {"$gt": "3-"}}, "o_orderpriority > '3-'"),
    "filter_range_mixed": ("lineitem", ("l_orderkey", "l_linenumber"), {"l_linenumber": {"$gt": "3"}}, "l_linenumber::varchar > '3'"),
    "filter_date": ("orders", ("o_orderkey",), {"o_orderdate": {"$gte": "1996-01-01", "$lt": "1997-01-01"}}, "o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01'"),
    "filter_in": ("lineitem", ("l_orderkey", "l_linenumber"), {"l_returnflag": {"$in": ["A", "R"]}, "l_linenumber": {"$in": [1, 3]}}, "l_returnflag in ('A', 'R') and l_linenumber in (1, 3)"),
    "filter_nin": ("lineitem", ("l_orderkey", "l_linenumber"), {"l_returnflag": {"$nin": ["A", "R"]}}, "l_returnflag not in ('A', 'R')"),
    "filter_and": ("orders", ("o_orderkey",), {"$and": [{"o_orderstatus": "O"}, {"o_totalprice": {"$gt": 100000}}]}, "o_orderstatus = 'O' and o_totalprice > 100000"),
    "filter_or": ("orders", ("o_orderkey",), {"$or": [{"o_orderstatus": "P"}, {}, {"o_totalprice": {"$lt": 20000}}]}, "o_orderstatus = 'P' or o_totalprice < 20000"),
    "filter_or_empty": ("orders", ("o_orderkey",), {"$or": [{}]}, "false"),
    "filter_nor": ("orders", ("o_orderkey",), {"$nor": [{"o_orderstatus": "O"}, {"o_totalprice": {"$gte": 50000}}]}, "not (o_orderstatus = 'O' or o_totalprice >= 50000)"),
    "filter_not": ("orders", ("o_orderkey",), {"o_totalprice": {"$not": {"$gt": 30000}}}, "not (o_totalprice > 30000)"),
    "filter_not_missing": ("orders", ("o_orderkey",), {"$not": {"no_such_field": {"$gt": 1}}}, "true"),
    "filter_ne_missing": ("orders", ("o_orderkey",), {"no_such_field": {"$ne": 1}}, "false"),
    "filter_invalid": ("orders", ("o_orderkey",), {"o_orderstatus": {"$in": "F"}}, "false"),
    "filter_invalid_not": ("supplier", ("s_suppkey",), {"$not": {"s_name": {"$in": "F"}}}, "true"),
    "filter_unknown_operator": ("supplier", ("s_suppkey",), {"s_name": {"$near": 1}}, "false"),
    "filter_exists": ("part", ("p_partkey",), {"p_brand": {"$exists": True}, "p_missing": {"$exists": False}}, "p_brand is not null"),
    "filter_type": ("part", ("p_partkey",), {"$and": [{"p_size": {"$type": "int"}}, {"p_retailprice": {"$type": 1}}, {"p_name": {"$type": "string"}}]}, "true"),
    "filter_regex": ("part", ("p_partkey",), {"p_name": {"$regex": "^[A-M].*[R-Z]$", "$options": "i"}}, "regexp_matches(p_name, '^[A-M].*[R-Z]$', 'i')"),
    "filter_regex_plain": ("part", ("p_partkey",), {"p_name": {"$regex": "^.[a-m]+ .*t$"}}, "regexp_matches(p_name, '^.[a-m]+ .*t$')"),
    "filter_regex_class": ("documents", ("doc_id",), {"text": {"$regex": "[[:digit:]]{3}"}}, "regexp_matches(text, '[[:digit:]]{3}')"),
    "filter_regex_nested": ("supplier", ("s_suppkey",), {"s_name": {"$regex": "(0+)+1$"}}, "regexp_matches(s_name, '(0+)+1$')"),
    "filter_regex_either": ("part", ("p_partkey",), {"p_name": {"$regex": "(red|blue) (ring|b.l)"}}, "regexp_matches(p_name, '(red|blue) (ring|b.l)')"),
    "filter_regex_and": ("part", ("p_partkey",), {"p_type": {"$regex": "A"}, "p_size": {"$ne": 7}}, "regexp_matches(p_type, 'A') and p_size <> 7"),
    "filter_text": ("documents", ("doc_id",), {"text": {"$text": {"$search": "THE On"}}}, "contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the on')"),
    "filter_vector_threshold": (
        "embeddings", ("vec_id",), {"$vectorSearch": {"field": "embedding", "queryVector": [1.0] * 32 + [-1.0] * 32, "threshold": 0.1}},
        "list_cosine_similarity(embedding::double[], list_concat(list_transform(range(32), lambda i: 1.0::double), list_transform(range(32), lambda i: -1.0::double))) >= 0.1",
    ),
    "filter_vector_euclidean": (
        "embeddings", ("vec_id",), {"$vectorSearch": {"field": "embedding", "queryVector": [0.1] * 64, "threshold": 0.44, "metric": "euclidean"}},
        "1 / (1 + list_distance(embedding::double[], list_transform(range(64), lambda i: 0.1::double))) >= 0.44",
    ),
}


def _filtered(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    at, columns, body, _ = FILTERS[name]
    return filters.find(table(spark, sf_dir, at), body).select(*columns)


for _name, (_at, _columns, _, _sql) in FILTERS.items():
    QUERIES[_name] = partial(_filtered, name=_name)
    ORACLES[_name] = f"select {', '.join(_columns)} from {_at} where {_sql}"


def _orders_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
    return lines.agg(F.array_sort(F.collect_list("l_linenumber")).alias("numbers"), F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag")).alias("lines"))


@query("select l_orderkey from lineitem group by 1 having count(*) = 4")
def filter_size(spark, sf_dir):
    return filters.find(_orders_with_lines(spark, sf_dir), {"numbers": {"$size": 4}}).select("l_orderkey")


@query("select l_orderkey from lineitem group by 1 having count(*) filter (l_linenumber = 2) > 0 and count(*) filter (l_linenumber = 4) > 0")
def filter_array_all(spark, sf_dir):
    return filters.find(_orders_with_lines(spark, sf_dir), {"numbers": {"$all": [4, 2]}}).select("l_orderkey")


@query("select l_orderkey from lineitem group by 1 having count(*) filter (l_linenumber in (5, 6)) > 0")
def filter_array_in(spark, sf_dir):
    return filters.find(_orders_with_lines(spark, sf_dir), {"numbers": {"$in": [6, 5]}}).select("l_orderkey")


@query("select l_orderkey from lineitem group by 1 having list(l_linenumber order by l_linenumber) = [1, 2, 3]")
def filter_array_eq(spark, sf_dir):
    return filters.find(_orders_with_lines(spark, sf_dir), {"numbers": [1, 2, 3]}).select("l_orderkey")


@query("select l_orderkey from lineitem group by 1 having count(*) filter (l_quantity > 45 and l_returnflag = 'R') > 0")
def filter_elem_match(spark, sf_dir):
    return filters.find(_orders_with_lines(spark, sf_dir), {"lines": {"$elemMatch": {"l_quantity": {"$gt": 45}, "l_returnflag": "R"}}}).select("l_orderkey")


@query("select c_custkey from customer join nation on c_nationkey = n_nationkey where n_regionkey = 1")
def filter_dotted(spark, sf_dir):
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    docs = customers.join(nations.select("n_nationkey", F.struct("n_name", "n_regionkey").alias("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return filters.find(docs, {"nation.n_regionkey": 1}).select("c_custkey")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("doc", F.parse_json("props"))


def _variant(spark: SparkSession, sf_dir: str, body: dict) -> DataFrame:
    return _events(spark, sf_dir).where(filters.variant_predicate(body, "doc")).select("event_id")


@query("select event_id from events where (props->>'$.k')::int > 50")
def variant_range(spark, sf_dir):
    return _variant(spark, sf_dir, {"k": {"$gt": 50}})


@query("select event_id from events where (props->>'$.k')::int not in (1, 2, 3)")
def variant_nin(spark, sf_dir):
    return _variant(spark, sf_dir, {"k": {"$nin": [1, 2, 3]}})


@query("select event_id from events")
def variant_exists_type(spark, sf_dir):
    return _variant(spark, sf_dir, {"k": {"$exists": True, "$type": "int"}, "z": {"$exists": False}})


@query("select event_id from events where (props->>'$.k') > '7'")
def variant_mixed_range(spark, sf_dir):
    return _variant(spark, sf_dir, {"k": {"$gt": "7"}})


@query("select event_id, (props->>'$.k')::int in (1, 5) as loose from events where (props->>'$.k')::int < 10")
def script_filter(spark, sf_dir):
    docs = _events(spark, sf_dir).where(filters.script_predicate({"k": {"$lt": 10}, "z": {"$ne": 4}}, Variant(F.col("doc"))))
    return docs.select("event_id", filters.script_predicate({"$or": [{"k": 1}, {"k": {"$in": [5]}}]}, Variant(F.col("doc"))).alias("loose"))


# Pipelines and reads ------------------------------------------------------------------


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'O' order by o_totalprice desc, o_orderkey limit 20")
def pipeline_match_sort_limit(spark, sf_dir):
    stages = [{"$match": {"o_orderstatus": "O"}}, {"$sort": {"o_totalprice": -1}}, {"$limit": 20}, {"$project": {"o_orderkey": 1, "o_totalprice": 1}}]
    return pipeline.aggregate(table(spark, sf_dir, "orders"), stages, "o_orderkey")


@query("select c_custkey from customer order by c_mktsegment, c_nationkey desc, c_custkey limit 15 offset 30")
def pipeline_sort_skip(spark, sf_dir):
    stages = [{"$sort": {"c_nationkey": -1, "c_mktsegment": 1}}, {"$skip": 30}, {"$limit": 15}, {"$project": {"c_custkey": 1}}]
    return pipeline.aggregate(table(spark, sf_dir, "customer"), stages, "c_custkey")


@query("select c_name, c_acctbal from customer where c_acctbal < 0")
def pipeline_project(spark, sf_dir):
    return pipeline.aggregate(table(spark, sf_dir, "customer"), [{"$match": {"c_acctbal": {"$lt": 0}}}, {"$project": {"c_name": 1, "c_acctbal": True, "address.city": 1}}])


@query(
    """with m as (select count(*) as n from orders where o_orderstatus = 'O'), p as (select count(*) as n from (select * from orders where o_orderstatus = 'O' order by o_totalprice desc, o_orderkey limit 40 offset 10) where o_orderpriority = '1-URGENT')
    select * from (values (0, '$match', (select count(*) from orders), (select n from m)), (1, '$sort', (select n from m), (select n from m)), (2, '$skip', (select n from m), (select n from m) - 10), (3, '$limit', (select n from m) - 10, 40),
        (4, '$match', 40, (select n from p)), (5, '$count', (select n from p), 1)) t(position, stage, input_count, output_count)"""
)
def pipeline_counters(spark, sf_dir):
    stages = [{"$match": {"o_orderstatus": "O"}}, {"$sort": {"o_totalprice": -1}}, {"$skip": 10}, {"$limit": 40}, {"$match": {"o_orderpriority": "1-URGENT"}}, {"$count": "n"}]
    return pipeline.aggregate_counted(table(spark, sf_dir, "orders"), stages, "o_orderkey")[1]


@query("select count(*) as n from lineitem where l_shipdate < timestamp '1995-06-01'")
def pipeline_count(spark, sf_dir):
    return pipeline.aggregate(table(spark, sf_dir, "lineitem"), [{"$match": {"l_shipdate": {"$lt": "1995-06-01"}}}, {"$count": "n"}])


@query("select count(*) as n from orders where false")
def pipeline_count_none(spark, sf_dir):
    return pipeline.aggregate(table(spark, sf_dir, "orders"), [{"$match": {"o_orderkey": -1}}, {"$count": "n"}])


@query("select coalesce(nullif(c_mktsegment, 'BUILDING'), null) as seg, c_custkey from customer order by nullif(c_mktsegment, 'BUILDING') desc nulls first, c_custkey limit 25")
def pipeline_sort_nulls(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"), "c_custkey")
    return pipeline.aggregate(docs, [{"$sort": {"seg": -1}}, {"$limit": 25}], "c_custkey")


@query("select c_custkey, c_name from (select * from customer order by c_custkey limit 5000) where c_acctbal > 0 order by c_name limit 10")
def pipeline_script(spark, sf_dir):
    stages = [{"$match": {"c_acctbal": {"$gt": 0}}}, {"$sort": {"c_name": 1}}, {"$limit": 10}, {"$project": {"c_name": 1}}]
    return pipeline.script_aggregate(table(spark, sf_dir, "customer"), stages, key="c_custkey")


@query("select o_orderkey, o_custkey from orders where o_totalprice > 200000 order by o_orderkey limit 25 offset 50")
def find_page(spark, sf_dir):
    return filters.find(table(spark, sf_dir, "orders"), {"o_totalprice": {"$gt": 200000}}, 25, 50, "o_orderkey").select("o_orderkey", "o_custkey")


@query("select o_orderkey from orders where o_orderstatus = 'F' order by o_orderkey limit 1")
def find_one(spark, sf_dir):
    return filters.find_one(table(spark, sf_dir, "orders"), {"o_orderstatus": "F"}, "o_orderkey").select("o_orderkey")


@query("select count(*) as n from lineitem where l_quantity >= 25 and l_returnflag <> 'N'")
def count_filtered(spark, sf_dir):
    return filters.count(table(spark, sf_dir, "lineitem"), {"l_quantity": {"$gte": 25}, "l_returnflag": {"$ne": "N"}})


@query("select c_custkey, c_acctbal from customer where c_acctbal > 5000 and c_mktsegment = 'BUILDING' order by c_acctbal desc, c_custkey limit 7")
def english_question(spark, sf_dir):
    """Read by the grammar's tokens."""
    return english.ask(table(spark, sf_dir, "customer"), "top 7 customers where c_acctbal is above 5000 and c_mktsegment is BUILDING sort by c_acctbal desc", "c_custkey").select("c_custkey", "c_acctbal")


@query("select c_custkey from customer where c_mktsegment <> 'BUILDING' and c_nationkey <= 10 and c_acctbal >= 100 order by c_name limit 12")
def english_several(spark, sf_dir):
    said = "which customers whose c_mktsegment is not \"BUILDING\" and c_nationkey at most 10 and c_acctbal >= 100 ordered by c_name asc, limit 12"
    return english.ask(table(spark, sf_dir, "customer"), said, "c_custkey").select("c_custkey")


# Versions -----------------------------------------------------------------------------

_LATEST = "select * from (select *, row_number() over (partition by user_id order by event_id desc) as r from events{}) where r = 1"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumns({"version": F.col("event_id"), "_deleted": F.col("event_type") == "error"})


@query(f"select user_id, event_id, event_type from ({_LATEST.format('')})")
def latest_wins(spark, sf_dir):
    return versions.latest(_log(spark, sf_dir), "user_id", deleted=None).select("user_id", "event_id", "event_type")


@query(f"select user_id, event_id from ({_LATEST.format('')}) where event_type <> 'error'")
def latest_wins_tombstone(spark, sf_dir):
    return versions.latest(_log(spark, sf_dir), "user_id").select("user_id", "event_id")


@query(f"select user_id, event_id from ({_LATEST.format(' where event_id <= 300')}) where event_type <> 'error'")
def time_travel(spark, sf_dir):
    return versions.latest(versions.visible(_log(spark, sf_dir), applied=300), "user_id").select("user_id", "event_id")


@query(f"select user_id, event_id from ({_LATEST.format(' where event_id % 3 <> 0')}) where event_type <> 'error'")
def pending_hidden(spark, sf_dir):
    log = _log(spark, sf_dir).withColumn("_visibility_state", F.when(F.col("event_id") % 3 == 0, "PENDING"))
    return versions.latest(versions.visible(log), "user_id").select("user_id", "event_id")


@query(f"select user_id, event_id from ({_LATEST.format('')}) where event_type <> 'error' and value > 50")
def filter_after_versions(spark, sf_dir):
    return filters.find(versions.latest(_log(spark, sf_dir), "user_id"), {"value": {"$gt": 50}}).select("user_id", "event_id")


@query(f"select user_id, event_id from ({_LATEST.format('')}) where event_type <> 'error'")
def merge_layers(spark, sf_dir):
    log = _log(spark, sf_dir)
    return versions.merge([log.where("event_id % 2 = 0"), log.where("event_id % 2 = 1")], "user_id").select("user_id", "event_id")


@query("select event_id from events where event_id <= 500 and (event_id % 7 <> 0 or event_id + 100 > 500)")
def visible_to_transaction(spark, sf_dir):
    log = table(spark, sf_dir, "events").withColumns({"created_txn": F.col("event_id"), "deleted_txn": F.when(F.col("event_id") % 7 == 0, F.col("event_id") + 100).otherwise(0)})
    return versions.as_of(log, 500).select("event_id")


# Writes -------------------------------------------------------------------------------


@query("select s_suppkey, case when s_nationkey = 3 then 'x' else s_name end as s_name, case when s_nationkey = 3 then trunc(s_acctbal)::bigint + 10 else s_acctbal end::double as s_acctbal, case when s_nationkey = 3 then null else s_nationkey end as s_nationkey from supplier")
def update_many(spark, sf_dir):
    update = {"$set": {"s_name": "x"}, "$inc": {"s_acctbal": 10}, "$unset": ["s_nationkey"]}
    return writes.update_many(table(spark, sf_dir, "supplier"), {"s_nationkey": 3}, update)


@query("select s_suppkey, case when s_suppkey = (select min(s_suppkey) from supplier where s_acctbal > 0) then 'first' else s_name end as s_name from supplier")
def update_one(spark, sf_dir):
    return writes.update_one(table(spark, sf_dir, "supplier"), {"s_acctbal": {"$gt": 0}}, {"s_name": "first"}, "s_suppkey").select("s_suppkey", "s_name")


@query("select c_custkey from customer where c_acctbal >= 0 or c_acctbal is null")
def delete_many(spark, sf_dir):
    return writes.delete_many(table(spark, sf_dir, "customer"), {"c_acctbal": {"$lt": 0}}).select("c_custkey")


@query("select c_custkey from customer where c_custkey <> (select min(c_custkey) from customer where c_acctbal < 0)")
def delete_one(spark, sf_dir):
    return writes.delete_one(table(spark, sf_dir, "customer"), {"c_acctbal": {"$lt": 0}}, "c_custkey").select("c_custkey")


@query("select s_suppkey, case when s_suppkey % 10 = 0 then 'new' else s_name end as s_name from supplier union all select s_suppkey + 1000000, s_name from supplier where s_suppkey % 10 = 1")
def bulk_upsert(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    rows = s.where("s_suppkey % 10 = 0").withColumn("s_name", F.lit("new")).unionByName(s.where("s_suppkey % 10 = 1").withColumn("s_suppkey", F.col("s_suppkey") + 1000000))
    return writes.upsert(s, rows, "s_suppkey")


@query("select s_suppkey, case when s_suppkey % 10 = 0 then 'second' else s_name end as s_name from supplier union all select s_suppkey + 1000000, 'second' from supplier where s_suppkey % 10 = 1")
def upsert_repeated(spark, sf_dir):
    """Two new rows for each key: the last one wins."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    new = s.where("s_suppkey % 10 = 0").unionByName(s.where("s_suppkey % 10 = 1").withColumn("s_suppkey", F.col("s_suppkey") + 1000000))
    rows = new.withColumn("n", F.explode(F.array(F.lit(2), F.lit(1)))).withColumn("s_name", F.when(F.col("n") == 1, "first").otherwise("second"))
    return writes.upsert(s.withColumn("n", F.lit(0)), rows, "s_suppkey", "n").drop("n")


@query("select 'new' as found, s_suppkey, s_name from (select s_suppkey + 1000000 as s_suppkey, 'a' as s_name from supplier where s_suppkey % 3 = 0) union all select 'conflict', s_suppkey + 1000000, 'b' from supplier where s_suppkey % 3 = 0 union all select 'conflict', s_suppkey, 'other' from supplier where s_suppkey % 5 = 0")
def insert_once(spark, sf_dir):
    """Known rows again, known keys with other contents, and new keys with two contents, one of them twice."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.lit(0).alias("at"))
    fresh = s.where("s_suppkey % 3 = 0").select((F.col("s_suppkey") + 1000000).alias("s_suppkey"), F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("a"))).alias("s_name"))
    rows = s.select("s_suppkey", "s_name").unionByName(s.where("s_suppkey % 5 = 0").select("s_suppkey", F.lit("other").alias("s_name"))).unionByName(fresh)
    new, clash = writes.insert_once(s.drop("at"), rows, "s_suppkey")
    return new.select(F.lit("new").alias("found"), "*").unionByName(clash.select(F.lit("conflict").alias("found"), "*"))


def _suppliers(spark: SparkSession, sf_dir: str):
    """A collection of suppliers with a base and several deltas."""
    store = Store(spark, scratch(spark, "store"))
    store.create_database("shop")
    held = store.database("shop").create_collection("suppliers", table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), "s_suppkey")
    held.create_index("s_nationkey")
    held.update_many({"s_nationkey": 3}, {"$set": {"s_name": "three"}, "$inc": {"s_acctbal": 1}})
    held.delete_many({"s_nationkey": 4})
    held.insert_many(spark.createDataFrame([(5, "five", 5, 5.0), (5, "cinq", 5, 6.0), (2000000, "new", 3, 0.5)], held.read().schema))
    return held


_SUPPLIERS = """select s_suppkey, case when s_nationkey = 3 then 'three' else s_name end as s_name, s_nationkey, case when s_nationkey = 3 then trunc(s_acctbal) + 1 else s_acctbal end::double as s_acctbal
    from supplier where s_nationkey <> 4 and s_suppkey <> 5 union all select * from (values (5, 'cinq', 5, 6.0::double), (2000000, 'new', 3, 0.5::double)) t"""


@query(_SUPPLIERS)
def store_deltas(spark, sf_dir):
    return _suppliers(spark, sf_dir).read()


@query(_SUPPLIERS)
def store_compacted(spark, sf_dir):
    held = _suppliers(spark, sf_dir)
    held.compact()
    return held.read()


@query(f"select * from ({_SUPPLIERS}) where s_nationkey = 3 and s_acctbal > 0")
def store_indexed_find(spark, sf_dir):
    """By a field index as new as the collection; the plan says so."""
    held = _suppliers(spark, sf_dir)
    held.rebuild_index("s_nationkey")
    asked = {"s_nationkey": 3, "s_acctbal": {"$gt": 0}}
    if held.explain(asked)["plan"] != "INDEX_LOOKUP":
        raise ValueError("the index is not used")
    return held.find(asked)


@query("select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def store_time_travel(spark, sf_dir):
    return _suppliers(spark, sf_dir).read(1)


@query(_SUPPLIERS)
def store_restored(spark, sf_dir):
    """Backed up, emptied, and restored."""
    held, target = _suppliers(spark, sf_dir), scratch(spark, "backup")
    held.store.backup(target)
    held.delete_many({})
    held.store.restore(target, "shop", "suppliers")
    return held.read()


@query("select n_nationkey, case when n_nationkey = 1 then 'one' else n_name end as n_name, '1' as failed from nation where n_nationkey <> 2 union all select 100, 'hundred', '1'")
def bulk_operations(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    operations = [
        {"insertOne": {"document": {"n_nationkey": 100, "n_name": "hundred"}}},
        {"renameOne": {}},
        {"updateOne": {"filter": {"n_nationkey": 1}, "update": {"$set": {"n_name": "one"}}}},
        {"deleteOne": {"filter": {"n_nationkey": 2}}},
    ]
    rows, errors = writes.bulk(nations, operations, "n_nationkey")
    return rows.withColumn("failed", F.lit(",".join(str(e["index"]) for e in errors)))


@query("select event_id from events where user_id = 7 order by event_id")
def tombstone_rows(spark, sf_dir):
    return writes.tombstones(table(spark, sf_dir, "events"), {"user_id": 7}, 10**9).where("_deleted and deleted_txn = 1000000000").select("event_id")


# Indexes ------------------------------------------------------------------------------


@query("select c_mktsegment as value, count(*) as n, min(c_custkey) as first_id, max(c_custkey) as last_id from customer group by 1")
def index_postings(spark, sf_dir):
    return indexes.posting_sizes(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey")


@query("select count(*) filter (c_custkey % 5 <> 0 and c_custkey % 7 <> 0) as valid, count(*) filter (c_custkey % 7 = 0 and c_custkey % 5 <> 0) as stale, 1 as extra, count(*) filter (c_custkey % 5 = 0 or c_custkey % 7 = 0) as missing from customer")
def index_validate(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    held = indexes.postings(customers, "c_mktsegment", "c_custkey").where("id % 5 <> 0").withColumn("value", F.when(F.col("id") % 7 == 0, "OLD").otherwise(F.col("value")))
    extra = spark.range(1).select(F.lit("GONE").alias("value"), F.lit(-1).cast("long").alias("id"))
    return indexes.validate(customers, held.unionByName(extra), "c_mktsegment", "c_custkey")


@query("select c_custkey from customer where c_mktsegment = 'BUILDING'")
def index_lookup(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    return indexes.lookup(customers, indexes.postings(customers, "c_mktsegment", "c_custkey"), "c_mktsegment", "BUILDING", "c_custkey").select("c_custkey")


_LANES = " || ':' || ".join(f"sum(('0x' || substr(h, {1 + 12 * i}, 12))::bigint)::varchar" for i in range(5))


@query(
    f"""with rows as (select sha256('{{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}}') as h from customer)
    select 'OK' as status, count(*) as documents, sha256(count(*)::varchar || ':' || {_LANES}) as digest from rows"""
)
def digest_table(spark, sf_dir):
    return indexes.digest(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name", "c_nationkey"), "c_custkey")


@query()
def digest_lineitem(spark, sf_dir):
    """The digest itself, over the largest table; its lanes of SHA-256 are this engine's own, so no SQL returns it."""
    return indexes.digest(table(spark, sf_dir, "lineitem"), "l_orderkey")


# Vectors ------------------------------------------------------------------------------

_VECTOR = [((i * 37) % 64 - 32) / 64 for i in range(64)]
_SQL_VECTOR = "list_transform(range(64), lambda i: (((i * 37) % 64) - 32) / 64::double)"


def _nearest(spark, sf_dir, metric, **how):
    rows = vector_search.search(table(spark, sf_dir, "embeddings"), _VECTOR, 10, metric, key="vec_id", column="embedding", payload=False, **how)
    return rows.select("vec_id", F.round("score", 6).alias("score"))


def _nearest_sql(score: str, where: str = "true") -> str:
    return f"select vec_id, round({score}, 6) as score from embeddings where {where} order by {score} desc, vec_id limit 10"


@query(_nearest_sql(f"list_cosine_similarity(embedding::double[], {_SQL_VECTOR})"))
def vector_cosine_topk(spark, sf_dir):
    return _nearest(spark, sf_dir, "cosine")


@query(_nearest_sql(f"-list_distance(embedding::double[], {_SQL_VECTOR})"))
def vector_l2_topk(spark, sf_dir):
    return _nearest(spark, sf_dir, "l2")


@query(_nearest_sql(f"list_inner_product(embedding::double[], {_SQL_VECTOR})"))
def vector_dot_topk(spark, sf_dir):
    return _nearest(spark, sf_dir, "dot")


@query(_nearest_sql(f"list_cosine_similarity(embedding::double[], {_SQL_VECTOR})"))
def vector_flat_topk(spark, sf_dir):
    """By the packed index."""
    index = flat.build_flat(table(spark, sf_dir, "embeddings"), scratch(spark, "flat"), "embedding", "vec_id")
    return flat.search_flat(spark, index, _VECTOR).withColumn("score", F.round("score", 6))


@query(_nearest_sql(f"list_cosine_similarity(embedding::double[], {_SQL_VECTOR})", "label in (1, 2)"))
def vector_filtered_topk(spark, sf_dir):
    return _nearest(spark, sf_dir, "cosine", query={"label": {"$in": [1, 2]}})


@query(f"select vec_id, round(list_inner_product(embedding::double[], {_SQL_VECTOR}), 6) as score from embeddings where vec_id % 2 = 1 order by list_inner_product(embedding::double[], {_SQL_VECTOR}) desc, vec_id limit 5")
def vector_named_space(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.select("vec_id", F.when(F.col("vec_id") % 2 == 1, F.create_map(F.lit("image"), F.col("embedding"))).otherwise(F.create_map(F.lit("text"), F.col("embedding"))).alias("vectors"))
    return vector_search.search(rows, _VECTOR, 5, "dot", name="image", key="vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(_nearest_sql(f"list_cosine_similarity(embedding::double[], {_SQL_VECTOR})", "label = 4"))
def vector_modality(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("modality", F.when(F.col("label") == 4, "image").otherwise("text"))
    return vector_search.search(rows, _VECTOR, 10, "cosine", modality="image", key="vec_id", column="embedding").select("vec_id", F.round("score", 6).alias("score"))


@query(
    "select query_id, rank::int as rank, id, round(score, 6) as score from (select q.vec_id as query_id, v.vec_id as id, list_cosine_similarity(v.embedding::double[], q.embedding::double[]) as score, "
    "row_number() over (partition by q.vec_id order by list_cosine_similarity(v.embedding::double[], q.embedding::double[]) desc, v.vec_id) as rank from embeddings q, embeddings v where q.vec_id % 100 = 0) where rank <= 5"
)
def vector_batch_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector_search.search_many(rows, asked, 5, "cosine", "vec_id", "embedding").select("query_id", "rank", "id", F.round("score", 6).alias("score"))


_BATCH = (
    "select query_id, rank::int as rank, id, round(score, 6) as score from (select q.vec_id as query_id, v.vec_id as id, list_cosine_similarity(v.embedding::double[], q.embedding::double[]) as score, "
    "row_number() over (partition by q.vec_id order by list_cosine_similarity(v.embedding::double[], q.embedding::double[]) desc, v.vec_id) as rank from {0} q, {0} v where q.vec_id % 100 = 0) where rank <= 10"
)


@query(_BATCH.format("embeddings"))
def ann_all_cells(spark, sf_dir):
    """With all cells probed, approximate search is exact."""
    rows = table(spark, sf_dir, "embeddings")
    index = ann.build(rows, scratch(spark, "ann"), column="embedding", key="vec_id", cells=10)
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return ann.search_index_many(spark, index, asked, 10, probes=10).withColumn("score", F.round("score", 6))


@query("with moved as (select vec_id, case when vec_id % 4 = 0 then list_transform(embedding, lambda x: -x) else embedding end as embedding from embeddings where vec_id % 50 <> 7) " + _BATCH.format("moved"))
def ann_upsert(spark, sf_dir):
    """A quarter of the rows moved to other cells and some taken out, after the index was built."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = ann.build(rows, scratch(spark, "ann"), column="embedding", key="vec_id", cells=10)
    moved = rows.where("vec_id % 4 = 0 and vec_id % 50 <> 7").withColumn("embedding", F.transform("embedding", lambda x: -x))
    ann.upsert_index(spark, index, moved, gone=rows.where("vec_id % 50 = 7"))
    asked = index.rows(spark).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return ann.search_index_many(spark, index, asked, 10, probes=99).withColumn("score", F.round("score", 6))


@query()
def ann_topk(spark, sf_dir):
    """Approximate: no SQL returns the same rows; recall is tested against exact search."""
    rows = table(spark, sf_dir, "embeddings")
    index = ann.build(rows, scratch(spark, "ann"), column="embedding", key="vec_id", cells=10)
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return ann.search_index_many(spark, index, asked, 10, probes=8)


_PLACES = "list_filter(range(1, 65), lambda i: abs(embedding[i]) >= 0.15)"


@query(
    f"select vec_id, round(coalesce(list_sum(list_transform(list_filter({_PLACES}, lambda i: i % 2 = 1), lambda i: embedding[i]::double * i)), 0), 6) as dot from embeddings"
)
def vector_sparse_dot(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    places = F.filter(F.sequence(F.lit(1), F.lit(64)), lambda i: F.abs(F.element_at("embedding", i)) >= 0.15)
    rows = rows.withColumn("places", places).withColumn("numbers", F.transform("places", lambda i: F.element_at("embedding", i).cast("double")))
    odd = [i for i in range(1, 65) if i % 2]
    return rows.select("vec_id", F.round(sparse_score("dot", F.col("places"), F.col("numbers"), F.lit(odd).cast("array<int>"), F.lit([float(i) for i in odd])), 6).alias("dot"))


@query("select vec_id, len(embedding) <> 64 as bad from embeddings")
def vector_schema(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    good, bad = vector_search.split_by_schema(rows, {"embedding": vector_search.Space(64, required=True)})
    return good.select("vec_id", F.lit(False).alias("bad")).unionByName(bad.select("vec_id", F.lit(True).alias("bad")))


# Words and hybrid search --------------------------------------------------------------

_TEXT = "The password of Licensed under the License"
_TERMS = ["the", "password", "of", "licensed", "under", "license"]


def _bm25_sql(terms: list[str], k: int, every: bool = False, extra: str = "") -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""
    with toks as (select doc_id, lang, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'), lambda t: t <> '') as w from documents where text is not null),
    sizes as (select doc_id, lang, len(w)::double as n from toks),
    totals as (select count(*)::double as docs, avg(n) as mean from sizes),
    tf as (select doc_id, t, count(*)::double as f from (select doc_id, unnest(w) as t from toks) where t in ({listed}) group by 1, 2),
    df as (select t, count(*)::double as d from tf group by 1),
    scored as (
        select doc_id as id, sum(ln(1 + (docs - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))) as score, count(*) as hits
        from tf join df using (t) join sizes using (doc_id), totals where true {extra} group by 1)
    select id, score from scored where hits >= {len(terms) if every else 1} order by round(score, 9) desc, id limit {k}"""


_INDEXES: dict[tuple, lexical.LexicalIndex] = {}


def lexical_index(spark: SparkSession, sf_dir: str) -> lexical.LexicalIndex:
    """The inverted index of the documents, built once for a session and a state of their files, as a store keeps it beside its collection."""
    path = f"{sf_dir}/documents.parquet"
    state = (spark.sparkContext.applicationId, path, *file_states(spark, path))
    if state not in _INDEXES:
        _INDEXES[state] = lexical.build_lexical(table(spark, sf_dir, "documents"), scratch(spark, "lexical"), "doc_id")
    return _INDEXES[state]


def _words(spark: SparkSession, sf_dir: str, text: str, query: dict | None = None, **how) -> DataFrame:
    found = lexical.bm25_indexed(spark, lexical_index(spark, sf_dir), text, 10, table(spark, sf_dir, "documents") if query else None, query, **how)
    return found.select("id", F.round("score", 6).alias("score"))


@query(f"select id, round(score, 6) as score from ({_bm25_sql(_TERMS, 10)})")
def bm25_topk(spark, sf_dir):
    return _words(spark, sf_dir, _TEXT)


@query(f"select id, round(score, 6) as score from ({_bm25_sql(_TERMS, 10)})")
def bm25_scan(spark, sf_dir):
    """Without an index."""
    return lexical.bm25(table(spark, sf_dir, "documents"), _TEXT, 10, key="doc_id").select("id", F.round("score", 6).alias("score"))


@query(f"select id, round(score, 6) as score from ({_bm25_sql(['released', 'mit'], 10, every=True)})")
def bm25_all_terms(spark, sf_dir):
    return _words(spark, sf_dir, "MIT released mit", every_term=True)


_FRENCH = "and lang = 'fr'"


@query(f"select id, round(score, 6) as score from ({_bm25_sql(['the', 'released'], 10, extra=_FRENCH)})")
def bm25_filtered(spark, sf_dir):
    return _words(spark, sf_dir, "the released", {"lang": "fr"})


@query(
    "select term, count(distinct doc_id) as docs, count(*) as tokens from (select doc_id, unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^a-z0-9\\x{80}-\\x{10FFFF}]+'), lambda t: t <> '')) as term from documents) group by 1"
)
def lexical_postings(spark, sf_dir):
    """Every term of the index, with its documents and tokens."""
    rows = spark.read.parquet(f"{lexical_index(spark, sf_dir).path}/postings").where("term is not null")
    return rows.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("tokens"))


@query("select sum(len(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\\x{80}-\\x{10FFFF}]+'), lambda t: t <> '')))::bigint as n from documents")
def token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.sum(F.size(tokens(F.col("text")))).alias("n"))


def _hybrid_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return table(spark, sf_dir, "documents").join(vectors, "doc_id", "left")


_NEAR = f"select vec_id as id, list_cosine_similarity(embedding::double[], {_SQL_VECTOR}) as score from embeddings where vec_id in (select doc_id from documents) order by 2 desc, 1 limit 100"


@query(
    f"""with a as (select id, row_number() over (order by score desc, id) as r from ({_NEAR})),
    b as (select id, row_number() over (order by round(score, 9) desc, id) as r from ({_bm25_sql(_TERMS, 100)}))
    select id, round(score, 6) as score from (select coalesce(a.id, b.id) as id, coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0) as score from a full join b on a.id = b.id)
    order by score desc, id limit 10"""
)
def hybrid_topk(spark, sf_dir):
    return lexical.hybrid(_hybrid_docs(spark, sf_dir), _VECTOR, _TEXT, 10, key="doc_id", column="embedding", index=lexical_index(spark, sf_dir)).select("id", F.round("score", 6).alias("score"))


@query(
    """with a as (select o_orderkey as id, row_number() over (order by o_totalprice desc, o_orderkey) as r from orders order by r limit 50),
    b as (select o_orderkey as id, row_number() over (order by o_orderdate desc, o_orderkey) as r from orders order by r limit 50)
    select id, round(score, 6) as score from (select coalesce(a.id, b.id) as id, coalesce(2.0 / (10 + a.r), 0) + coalesce(1.0 / (10 + b.r), 0) as score from a full join b on a.id = b.id) order by score desc, id limit 20"""
)
def rrf_fusion(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    dear = orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score")).orderBy(F.desc("score"), "id").limit(50)
    new = orders.select(F.col("o_orderkey").alias("id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(50)
    return lexical.fuse(dear, new, 20, 2.0, 1.0, 10.0).select("id", F.round("score", 6).alias("score"))


# Media --------------------------------------------------------------------------------


@query("select page_id::varchar as media_id, case when page_id % 10 = 0 then 'uploading' when page_id % 10 = 1 then 'failed' else 'ready' end as state, strlen(html)::bigint as size from pages")
def media_states(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("media_id"), F.col("html").cast("binary").alias("content"))
    manifests, chunks = media.chunked(files, 1024)
    number = F.col("media_id").cast("long") % 10
    chunks = chunks.where((number != 0) | (F.col("index") != 0))
    broken = chunks.where((number == 1) & (F.col("index") == 0)).withColumns({"data": F.base64(F.lit("other").cast("binary")), "sha256": F.lit("other")})
    again = chunks.where((number == 2) & (F.col("index") == 0))
    return media.verified(manifests, chunks.unionByName(broken).unionByName(again)).select("media_id", "state", "size")


@query("select page_id::varchar as media_id, sha256(html) as sha256 from pages")
def media_content(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("media_id"), F.col("html").cast("binary").alias("content"))
    manifests, chunks = media.chunked(files, 4096)
    return media.content(media.verified(manifests, chunks), chunks).select("media_id", F.sha2("content", 256).alias("sha256"))


@query("select event_type, count(*) as n, round(sum(value), 4) as total from events where event_id % 4 <> 0 group by 1")
def expired_hidden(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("expires_at", F.when(F.col("event_id") % 4 == 0, 5).otherwise(F.lit(None).cast("int")))
    return indexes.expire(events, 10).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


FLAGSHIP = hybrid_topk
