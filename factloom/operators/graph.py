"""The subject-object graph: edges, neighbourhoods, spreading activation, co-activation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N


def edges_of(facts: DataFrame) -> DataFrame:
    return facts.where("subject <> '' and object_value <> ''").select(F.lower("subject").alias("src"), F.lower("object_value").alias("dst")).distinct()


def stats(edges: DataFrame) -> DataFrame:
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("n")).agg(F.countDistinct("n").alias("nodes"))
    return edges.distinct().agg(F.count("*").alias("edges")).join(nodes)  # one row each


def related(edges: DataFrame, seeds: DataFrame, cap: int | None = 1000) -> DataFrame:
    """(seed, node, degree, rank): nodes within two hops either way, without the seed; of each seed the ``cap`` best connected.
    Where ``cap`` is None all of them, as (seed, node)."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    one = seeds.select("seed").join(both, F.col("seed") == F.col("src")).select("seed", F.col("dst").alias("node"))
    two = one.join(both, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"))
    near = one.unionByName(two).where("node <> seed").distinct()
    if cap is None:
        return near
    degree = both.groupBy(F.col("src").alias("_n")).agg(F.count("*").alias("degree"))
    order = Window.partitionBy("seed").orderBy(F.col("degree").desc(), "node")
    return near.join(degree, F.col("node") == F.col("_n")).drop("_n").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def spread(edges: DataFrame, seeds: DataFrame, decay: float = 0.5) -> DataFrame:
    """(query_id, node, activation) of seeds (query_id, node): 1 at the seed, one hop both ways, two more forward, each hop
    diluted by fan-out; what arrives twice counts by its maximum. Hops go level by level. Two shuffles of a frontier a hop."""
    fan_of = lambda end: N.fan(F.count("*").over(Window.partitionBy(end)))
    forward = edges.select("src", "dst", fan_of("src").alias("fan"))
    reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), fan_of("dst").alias("fan"))
    start = seeds.select("query_id", F.col("node").alias("seed")).distinct()
    first = start.join(forward.unionByName(reverse), F.col("seed") == F.col("src")).select("query_id", "seed", F.col("dst").alias("node"), (decay * F.col("fan")).alias("a"))
    first = first.groupBy("query_id", "seed", "node").agg(F.max("a").alias("a"))

    def hop(level: DataFrame, least: float) -> DataFrame:
        step = level.join(forward, F.col("node") == F.col("src")).where(F.col("dst") != F.col("seed"))
        moved = step.select("query_id", "seed", F.col("dst").alias("node"), (F.col("a") * decay * F.col("fan")).alias("a")).where(F.col("a") > least)
        return moved.groupBy("query_id", "seed", "node").agg(F.max("a").alias("a"))

    second = hop(first, 0.01)
    third = hop(second, 0.005)
    every = start.select("query_id", "seed", F.col("seed").alias("node"), F.lit(1.0).alias("a")).unionByName(first).unionByName(second).unionByName(third)
    return every.groupBy("query_id", "node").agg(F.max("a").alias("activation"))


def traces(results: DataFrame, top: int = 10) -> DataFrame:
    """(a, b, n, synapse): how often two of a query's first ten results came together; the synapse gains .05 a time, 1 at most.

    Pairs are made within one query's ten rows, so their number is bound by the number of queries.
    """
    few = results.where(F.col("rank") <= top).select("query_id", "rank", "id")
    other = few.select(F.col("query_id").alias("_q"), F.col("rank").alias("_rank"), F.col("id").alias("_id"))
    pairs = few.join(other, (F.col("query_id") == F.col("_q")) & (F.col("rank") < F.col("_rank")))
    return pairs.groupBy(F.least("id", "_id").alias("a"), F.greatest("id", "_id").alias("b")).agg(F.count("*").alias("n")).withColumn("synapse", F.least(F.lit(1.0), 0.05 * F.col("n")))


def resonance(cands: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, id, resonance): co-activation of each candidate with the query's other candidates."""
    both = pairs.select("a", "b", "n").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    mine = cands.select("query_id", "id")
    met = mine.join(both, F.col("id") == F.col("a")).join(mine.select(F.col("query_id").alias("_q"), F.col("id").alias("_id")), (F.col("query_id") == F.col("_q")) & (F.col("b") == F.col("_id")))
    return met.groupBy("query_id", "id").agg(F.least(F.lit(1.0), F.log2(1.0 + F.sum("n")) / 5.0).alias("resonance"))
