"""Connected components by repeated contraction, all of it in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.common import hot_keys, join_spread, settle, tidy


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a long, b long).

    Each round every node goes to the least of itself and its neighbours, and the links
    follow; those that became loops go. Node ids are hashes, so a constant part of the
    nodes goes in each round, also in long chains. Only groups' minima are gathered, which
    partial aggregation forms before the shuffle; nodes of many links and roots of many nodes
    are joined in parts.
    """
    with tidy(links.sparkSession) as keep:
        return keep(_contracted(links))


def _contracted(links: DataFrame) -> DataFrame:
    here = settle(links.where("a != b").selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct(), "links")
    done: DataFrame | None = None
    while True:
        both = here.select("a", "b").union(here.select("b", "a"))
        to = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root"), F.count("*").alias("n"))
        to = settle(to, "roots")
        if done is None:
            done = to.drop("n")
        else:
            step = to.select(F.col("node").alias("root"), F.col("root").alias("_to"))
            hot = hot_keys(done.groupBy("root").count(), "root", "count", done.count())
            done = join_spread(done, step, "root", "node", hot, "left").select("node", F.coalesce("_to", "root").alias("root"))
        done = settle(done, "roots")
        hot = hot_keys(to, "node", "n", 2 * here.count())
        named = lambda k: None if hot is None else hot.withColumnRenamed("node", k)
        a, b = to.select(F.col("node").alias("a"), F.col("root").alias("ra")), to.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = join_spread(join_spread(here, a, "a", "b", named("a")), b, "b", "a", named("b"))
        here = settle(moved.where("ra != rb").selectExpr("least(ra, rb) as a", "greatest(ra, rb) as b").distinct(), "links")
        if here.isEmpty():
            return done
