"""Connected components of an edge table, as joins and aggregates with written steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendscope.llm.scratch import Scratch


def smallest_reachable(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (a, b) -> (node, label): the smallest node each node reaches, for all nodes of
    the edges. Alternating large-star and small-star steps until nothing changes; each is an
    aggregate with partial sums and a join on the node, so a hub is split by the skew join."""
    def state(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())

    edges = scratch.table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = state(edges)
    while True:
        # large star: larger neighbours of a node point to its smallest neighbour (or itself)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = scratch.table(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: smaller neighbours of a node, and the node, point to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))).distinct()
        small = scratch.table(small)
        scratch.drop(large, edges)
        edges, before, was = small, was, state(small)
        if was == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
