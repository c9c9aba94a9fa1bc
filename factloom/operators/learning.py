"""State that grows with use: channel weights, co-occurrence counts, corrections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import CHANNELS, WEIGHTS

RATE, FLOOR = 0.1, 0.02


def fold_weights(updates: DataFrame) -> DataFrame:
    """(key, weights, updates): an exponential moving average over each key's updates (key, seq, scores), in order; each step is
    floored and normalised. Updates stream past in the order of their keys: what is held is one key's weights."""
    kind = dict(updates.dtypes)["key"]
    start = np.array([WEIGHTS[c] for c in CHANNELS])

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, w, n = None, start, 0
        for f in frames:
            out = []
            given = np.array([[s.get(c) if s.get(c) is not None else np.nan for c in CHANNELS] for s in f["scores"].map(dict)], np.float64)
            total = f["scores"].map(lambda s: sum(x for x in dict(s).values() if x is not None)).to_numpy(np.float64)
            for k, u, t in zip(f["key"], given, total, strict=True):
                if n and k != key:
                    out.append((key, dict(zip(CHANNELS, w.tolist(), strict=True)), n))
                    w, n = start, 0
                key, n = k, n + 1
                if t > 0:
                    moved = np.where(np.isnan(u), w, (1 - RATE) * w + RATE * u / t)
                    floored = np.maximum(FLOOR, moved / moved.sum())
                    w = floored / floored.sum()
            if out:
                yield pd.DataFrame(out, columns=["key", "weights", "updates"])
        if n:
            yield pd.DataFrame([(key, dict(zip(CHANNELS, w.tolist(), strict=True)), n)], columns=["key", "weights", "updates"])

    laid = updates.where("key is not null").select("key", "seq", "scores").repartition("key").sortWithinPartitions("key", "seq")
    return laid.mapInPandas(fold, f"key {kind}, weights map<string,double>, updates int")


def cooccurrence_counts(entities: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, n): entities that occur in the same texts (seq, entity), ``least`` times or more."""
    one = entities.select("seq", "entity").distinct()
    other = one.select(F.col("seq").alias("_s"), F.col("entity").alias("_e"))
    pairs = one.join(other, (F.col("seq") == F.col("_s")) & (F.col("entity") < F.col("_e")))
    return pairs.groupBy(F.col("entity").alias("a"), F.col("_e").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def drop_weakest(pairs: DataFrame, share: float) -> DataFrame:
    """Pairs (a, b, n) without the weakest share of them (rounded up), ties by name.

    The cut's weight comes from counts by weight (few values); only pairs of just that weight are ranked.
    """
    counts = pairs.groupBy("n").agg(F.count("*").alias("c"))
    below = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    total = counts.agg(F.ceil(F.sum("c") * share).alias("_gone"))
    cut = counts.withColumn("_below", F.coalesce(F.sum("c").over(below), F.lit(0))).join(F.broadcast(total), F.lit(True))
    cut = cut.select(F.col("n").alias("_n"), F.greatest(F.lit(0), F.least(F.col("c"), F.col("_gone") - F.col("_below"))).alias("_drop"), "c")
    marked = pairs.join(F.broadcast(cut), F.col("n") == F.col("_n"))
    whole = marked.where("_drop = 0").select("a", "b", "n")
    edge = marked.where("_drop > 0 and _drop < c").withColumn("_r", F.row_number().over(Window.partitionBy("n").orderBy("a", "b"))).where(F.col("_r") > F.col("_drop")).select("a", "b", "n")
    return whole.unionByName(edge)
