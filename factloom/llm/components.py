"""Connected components by alternating large and small stars, as joins and minimum aggregates; and within one array."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component.

    Each round is two shuffles of edges; minimum aggregates combine before the shuffle and a hub's rows can be split by
    the adaptive skew join. Rounds are written to the shared folder. Nothing is collected but two sums a round.
    """
    cur = materialize(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v").distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        cur = materialize(small.where("u <> v").distinct(), "edges")
        new = tuple(cur.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def least_reachable(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest label each item reaches over the links (i, j): hooking and pointer jumping, logarithmic in practice."""
    order = np.argsort(labels, kind="stable")
    rank = np.empty(len(labels), np.int64)
    rank[order] = np.arange(len(labels))
    a, b, low = rank[i], rank[j], np.arange(len(labels))
    while True:
        least, new = np.minimum(low[a], low[b]), low.copy()
        for at in (a, b, low[a], low[b]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == low).all():
            return labels[order][low[rank]]
        low = new


def least_reachable_dense(labels_a: np.ndarray, labels_b: np.ndarray, linked: np.ndarray, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """The same for links given as a matrix, with little more memory than the matrix."""
    a, b, none = labels_a.copy(), labels_b.copy(), np.iinfo(np.int64).max
    while True:
        before = a.sum(dtype=object), b.sum(dtype=object)
        for s in range(0, len(a), step):
            part = linked[s : s + step]
            a[s : s + step] = np.minimum(a[s : s + step], np.where(part, b, none).min(1, initial=none))
            np.minimum(b, np.where(part, a[s : s + step, None], none).min(0, initial=none), out=b)
        if before == (a.sum(dtype=object), b.sum(dtype=object)):
            return a, b
