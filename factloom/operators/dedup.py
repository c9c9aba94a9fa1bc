"""Fact dedup in tiers: exact, near, superseding, cross-tool. Batch forms, by windows over the order of writing (``seq``)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PERSONAL, Identity


def exact(facts: DataFrame) -> DataFrame:
    """Structured facts that repeat an earlier one word for word."""
    order = Window.partitionBy("subject", "predicate", "object_value", "is_negation").orderBy("seq")
    return facts.withColumn("_n", F.row_number().over(order)).where("_n > 1").drop("_n")


def near(facts: DataFrame, threshold: float = 0.92, identity: Identity = PERSONAL, block: int = 1024) -> DataFrame:
    """(a, b, cosine): facts of one subject, canonical predicate and polarity whose embeddings are that close, of multi-valued
    predicates only; not those that say the same predicate of different objects. ``a`` is the smaller id.

    A group is cut into blocks; each pair of blocks meets in one task as a matrix product, so none holds a whole group.
    """
    rows = facts.where((F.col("predicate") != "stated") & (F.size("embedding") > 0)).withColumn("_canon", identity.canon(F.col("predicate")))
    rows = rows.where(~F.col("_canon").isin(list(identity.single_valued)))
    group = ["subject", "_canon", "is_negation"]
    sizes = rows.groupBy(*group).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    rows = rows.select("id", *group, "predicate", F.lower("object_value").alias("object"), F.col("embedding").cast("array<double>").alias("embedding"))
    dealt = rows.join(sizes, group).withColumn("_at", F.pmod(F.xxhash64("id"), F.col("_blocks").cast("long")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.withColumn("_x", F.least("_at", "_other")).withColumn("_y", F.greatest("_at", "_other")).drop("_blocks", "_other")
    kind = dict(rows.dtypes)["id"]

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        x, y = f[f["_at"] == f["_x"].iloc[0]], f[f["_at"] == f["_y"].iloc[0]]
        for dims in set(x["embedding"].map(len)) & set(y["embedding"].map(len)):
            left, right = (s[s["embedding"].map(len) == dims] for s in (x, y))
            u, v = (_unit(np.stack(s["embedding"].to_list())) for s in (left, right))
            cos = u @ v.T
            i, j = np.nonzero(cos >= threshold)
            for p, q in zip(i, j, strict=True):
                a, b = left.iloc[p], right.iloc[q]
                if (a["id"] < b["id"] or f["_x"].iloc[0] != f["_y"].iloc[0]) and a["id"] != b["id"] and not (a["predicate"] == b["predicate"] and a["object"] != b["object"]):
                    out.append((min(a["id"], b["id"]), max(a["id"], b["id"]), cos[p, q]))
        return pd.DataFrame(out, columns=["a", "b", "cosine"])

    return dealt.groupBy(*group, "_x", "_y").applyInPandas(compare, f"a {kind}, b {kind}, cosine double")


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def superseded_by(facts: DataFrame, identity: Identity = PERSONAL) -> DataFrame:
    """Positive facts of single-valued predicates that the next one replaces with another value."""
    rows = facts.where(~F.col("is_negation") & (F.col("predicate") != "stated")).withColumn("canon", identity.canon(F.col("predicate"))).where(F.col("canon").isin(list(identity.single_valued)))
    order = Window.partitionBy("subject", "canon").orderBy("seq")
    return rows.withColumn("by_id", F.lead("id").over(order)).withColumn("_next", F.lead("object_value").over(order)).where(F.col("_next") != F.col("object_value")).drop("_next")


def cross_tool(facts: DataFrame, identity: Identity = PERSONAL) -> DataFrame:
    """Facts that several writes or tools agree on, by canonical predicate and object."""
    keyed = facts.select("subject", identity.canon(F.col("predicate")).alias("canon"), F.lower("object_value").alias("object"), "is_negation", "source_type")
    return keyed.groupBy("subject", "canon", "object", "is_negation").agg(F.count("*").alias("n"), F.countDistinct("source_type").alias("tools")).where("n > 1")


def expired(facts: DataFrame, as_of: float) -> DataFrame:
    """Facts that repeat (predicate, object, polarity) of an expired one of the same subject."""
    old = facts.where(F.col("valid_until") <= as_of).select(*[F.col(c).alias(f"_{c}") for c in ("subject", "predicate", "object_value", "is_negation")], F.col("seq").alias("_seq"))
    on = F.col("_seq") < F.col("seq")
    for c in ("subject", "predicate", "object_value", "is_negation"):
        on &= F.col(c) == F.col(f"_{c}")
    return facts.join(old, on, "left_semi")


def tiers(facts: DataFrame, identity: Identity = PERSONAL) -> DataFrame:
    """What each write meets among all earlier ones: ``exact``, else ``supersede``, else ``merge``, else ``new``."""
    rows = facts.withColumn("canon", identity.canon(F.col("predicate")))
    before = lambda *by: F.count("*").over(Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    same, of_canon = before("subject", "predicate", "object_value", "is_negation"), before("subject", "canon")
    replaces = ~F.col("is_negation") & F.col("canon").isin(list(identity.single_valued)) & (of_canon - before("subject", "canon", "object_value") > 0)
    merges = before("subject", "canon", F.lower("object_value"), "is_negation") > 0
    return rows.withColumn("tier", F.when(same > 0, "exact").when(replaces, "supersede").when(merges, "merge").otherwise("new"))
