"""Write-time safety: injected markup, hedged statements, reported speech; each as one projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import numeric as N
from ..functions import text as T
from ..schema import literal

TAG = "<[!/a-zA-Z][^>]*>"
THRESHOLD = 0.38


def has_tag(text: Column) -> Column:
    return F.coalesce(text.rlike(TAG), F.lit(False))


def is_hedged(text: Column) -> Column:
    return F.coalesce(F.lower(F.ltrim(text)).rlike("^(" + "|".join(L.HEDGES) + r")\s"), F.lit(False))


def with_likeness(rows: DataFrame, text: str, embed: Callable[[Column], Column], prototypes: tuple[str, ...], name: str, by_sentence: bool = False) -> DataFrame:
    """Adds ``name``: how near a text comes to the nearest of the prototypes, by the embedding given; with ``by_sentence`` also each of its
    sentences of eight characters or more. Each distinct text is embedded once; null texts are near to nothing."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(p,) for p in prototypes], "p string").select(embed(F.col("p")).alias("e")).collect()  # as many as prototypes
    words = rows.where(F.col(text).isNotNull()).select(F.col(text).alias("_text")).distinct()
    parts = F.filter(F.transform(F.split("_text", r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: F.length(s) >= 8)
    each = words.select("_text", F.explode(F.array_union(F.array("_text"), parts) if by_sentence else F.array("_text")).alias("_part")).withColumn("_e", embed(F.col("_part")))
    near = F.greatest(F.lit(0.0), *[N.cosine(F.col("_e"), F.expr(literal([float(x) for x in r["e"]]))) for r in known])
    best = each.groupBy("_text").agg(F.max(near).alias("_near"))
    return rows.join(best, F.col(text) == F.col("_text"), "left").withColumn(name, F.coalesce("_near", F.lit(0.0))).drop("_text", "_near")


def injection_score(text: Column, similarity: Column | None = None) -> Column:
    """1 for any tag; else the similarity to known payloads, if an embedding gives one."""
    return F.when(has_tag(text), 1.0).otherwise(similarity if similarity is not None else F.lit(0.0))


def flag_writes(facts: DataFrame, embed: Callable[[Column], Column] | None = None, injections: bool = True, hedges: bool = True) -> DataFrame:
    """``injections`` and ``hedges`` turn the two checks on; with ``embed`` both also go by likeness to prototypes. Injected texts keep their raw row only, marked suspicious; hedged ones too, at confidence .35 at most; facts whose
    subject reports someone's words go to the speaker, at .45 at most. Flags are kept as columns."""
    alike, unsure = F.lit(0.0), F.lit(0.0)
    if embed is not None:
        facts = with_likeness(facts, "source_text", embed, L.INJECTION_PROTOTYPES, "_alike", by_sentence=True)
        facts = with_likeness(facts, "source_text", embed, L.HYPOTHETICAL_PROTOTYPES, "_unsure")
        alike, unsure = F.col("_alike"), F.col("_unsure")
    bad = F.lit(injections) & (injection_score(F.col("source_text"), alike) >= THRESHOLD)
    hedged = F.lit(hedges) & ~bad & (is_hedged(F.col("source_text")) | (unsure >= THRESHOLD))
    who = T.speaker(F.col("subject"))
    out = facts.withColumn("suspicious", bad).withColumn("hypothetical", hedged).where(~(F.col("suspicious") | F.col("hypothetical")) | (F.col("predicate") == "stated"))
    out = out.withColumn("source_type", F.when(F.col("suspicious"), "suspicious").otherwise(F.col("source_type")))
    out = out.withColumn("source_speaker", F.when(~F.col("suspicious"), who)).withColumn("subject", F.coalesce("source_speaker", "subject"))
    limit = F.least(F.col("confidence"), F.when(F.col("hypothetical"), 0.35).otherwise(1.0), F.when(F.col("source_speaker").isNotNull(), 0.45).otherwise(1.0))
    return out.withColumn("confidence", limit).drop("_alike", "_unsure")
