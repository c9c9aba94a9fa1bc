"""Profiles, budgets and benchmark statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import numeric as N
from ..functions.text import COMMIT
from .beliefs import believed, live


def profile_worthy() -> Column:
    """Structural filter of a profile: no raw text, no parser debris, no commit artefacts."""
    p, obj = F.col("predicate"), F.length(F.trim("object_value"))
    shape = (p != "stated") & F.length(p).between(3, 25) & p.rlike("[aeiou]") & ~p.rlike("^(" + "|".join(L.COMMIT_TYPES) + ").")
    return shape & ~F.coalesce("source_text", F.lit("")).rlike(COMMIT) & obj.between(2, 80)


def profile(facts: DataFrame, as_of: float) -> DataFrame:
    """(subject, predicate, values): believed facts by predicate, the surest value first.

    A group is one subject's values of one predicate.
    """
    rows = believed(facts, as_of).where("predicate <> 'stated'").withColumn("_p", N.posterior_of())
    item = F.struct((-F.round("_p", 9)).alias("order"), F.col("seq").alias("seq"), F.col("object_value").alias("value"), F.round("_p", 3).alias("confidence"), F.col("evidence_count").alias("evidence"), F.col("is_negation").alias("negation"), F.col("scope").alias("scope"))
    return rows.groupBy("subject", "predicate").agg(F.array_sort(F.collect_list(item)).alias("values"))


def compact(facts: DataFrame, as_of: float, budget: int, newest: int = 50) -> DataFrame:
    """Each subject's best facts up to a token budget (four characters a token), over its ``newest`` live rows."""
    fresh = live(facts, as_of).withColumn("_n", F.row_number().over(Window.partitionBy("subject").orderBy(F.col("updated_at").desc(), "seq"))).where(F.col("_n") <= newest)
    cost = (F.floor(F.length(F.concat(F.col("predicate"), F.lit(": "), F.col("object_value"))) / 4) + 1).cast("long")
    order = Window.partitionBy("subject").orderBy(F.col("evidence_count").desc(), F.round(N.posterior_of(), 9).desc(), "seq").rowsBetween(Window.unboundedPreceding, 0)
    return fresh.withColumn("used", F.sum(cost).over(order)).where(F.col("used") <= budget).drop("_n")


def nearest_rank(df: DataFrame, key: str, value: str, points: dict[str, float], cells: int = 256) -> DataFrame:
    """Exact nearest-rank percentiles of each key: the value at position round(p * (n - 1)). Null values count last.

    Rows are counted by cell, of equal widths between a key's least and greatest value; only the rows of the cells that hold a
    wanted position are ranked, so a key with a large share of all rows is no one task's work.
    """
    rows = df.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    ends = rows.groupBy("_k").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    both = rows.join(ends.withColumnRenamed("_k", "_e"), F.col("_k").eqNullSafe(F.col("_e"))).drop("_e")
    width = (F.col("_hi") - F.col("_lo")).cast("double")
    cell = F.when(F.col("_v").isNull(), cells).when(width > 0, F.least(F.lit(cells - 1), F.floor((F.col("_v") - F.col("_lo")) / width * cells).cast("int"))).otherwise(0)
    both = both.withColumn("_c", cell)
    counts = both.groupBy("_k", "_n", "_c").agg(F.count("*").alias("_m"))
    below = Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_below", F.coalesce(F.sum("_m").over(below), F.lit(0)))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.round(F.lit(p) * (F.col("_n") - 1)).cast("long").alias("at")) for name, p in points.items()])
    found = counts.select("_k", "_c", "_below", "_m", F.explode(wanted).alias("_w")).where((F.col("_w")["at"] >= F.col("_below")) & (F.col("_w")["at"] < F.col("_below") + F.col("_m")))
    few = found.groupBy(F.col("_k").alias("_fk"), F.col("_c").alias("_fc"), "_below").agg(F.collect_list("_w").alias("_w"))
    some = both.join(few, F.col("_k").eqNullSafe(F.col("_fk")) & (F.col("_c") == F.col("_fc")))
    rank = F.row_number().over(Window.partitionBy("_k", "_c").orderBy(F.col("_v").asc_nulls_last())) - 1 + F.col("_below")
    hits = some.withColumn("_r", rank).select("_k", "_v", F.explode("_w").alias("_w"), "_r").where(F.col("_w")["at"] == F.col("_r"))
    return hits.groupBy(F.col("_k").alias(key)).agg(*[F.max(F.when(F.col("_w")["name"] == name, F.col("_v"))).alias(name) for name in points])


def accuracy(results: DataFrame, expected: DataFrame, top: int) -> DataFrame:
    """(category, n, hits, share): questions with half of their expected words, at least one, in the text of their first ``top`` results.

    results: (query_id, rank, text); expected: (query_id, category, words).
    """
    near = results.where(F.col("rank") <= top).groupBy("query_id").agg(F.concat_ws(" ", F.collect_list(F.lower("text"))).alias("said"))
    both = expected.join(near, "query_id", "left")
    there = F.size(F.filter("words", lambda w: F.contains(F.coalesce("said", F.lit("")), F.lower(w))))
    hit = (there > 0) & (there >= 0.5 * F.size("words"))
    return both.groupBy("category").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits")).withColumn("share", F.col("hits") / F.col("n"))
