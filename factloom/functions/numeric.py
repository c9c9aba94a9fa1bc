"""Belief, decay, similarity and embedding as JVM-side column expressions. Times are epoch seconds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..schema import lookup

DAY = 86400.0


def age_days(at: Column, as_of: float) -> Column:
    return (as_of - at) / DAY


def linear_boost(similarity: Column) -> Column:
    """0 under a similarity of .3, rising to 1 at .8."""
    return F.when(similarity >= 0.3, F.least(F.lit(1.0), (similarity - 0.3) / 0.5)).otherwise(0.0)


def posterior(confidence: Column, source_type: Column, evidence: Column, contradictions: Column) -> Column:
    """Mean of a Beta posterior whose prior weighs two observations by confidence and source."""
    w = confidence * F.coalesce(lookup(L.SOURCE_WEIGHTS, source_type), F.lit(0.7))
    a, b = w * 2 + evidence, (1 - w) * 2 + contradictions
    return F.when(a + b > 0, a / (a + b)).otherwise(0.5)


def posterior_of(prefix: str = "") -> Column:
    c = lambda n: F.col(prefix + n)
    return posterior(c("confidence"), c("source_type"), c("evidence_count"), c("contradiction_count"))


def unexpired(valid_until: Column, as_of: float) -> Column:
    return valid_until.isNull() | (valid_until > as_of)


def recency(updated: Column, valid_until: Column, as_of: float) -> Column:
    """Halves every 30 days; 0 for expired facts."""
    return F.when(valid_until < as_of, 0.0).otherwise(F.least(F.lit(1.0), F.exp(-0.693 * (as_of - updated) / (30 * DAY))))


def frequency(count: Column, most: Column) -> Column:
    return F.log2(1.0 + count) / F.log2(1.0 + F.greatest(most, F.lit(1)))


def forgetting(updated: Column, access: Column, belief: Column, decay: Column, as_of: float) -> Column:
    """Ebbinghaus retention; 1 where the predicate does not decay."""
    return F.when(decay > 0, F.exp(-((as_of - updated) / DAY) / (F.greatest(F.lit(0.1), access * belief) * (1.0 / decay) * 30))).otherwise(1.0)


def fan(n: Column) -> Column:
    return 1.0 / F.log2(n + 2.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for vectors of different or no length, and for zero vectors."""
    na, nb = norm(a), norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(0.0)


def hash_embedding(text: Column, dims: int = 384) -> Column:
    """A deterministic unit vector: eight bytes of SHA-256(text, counter) for every eight dimensions."""
    block = lambda i: F.sha2(F.concat(F.encode(text, "utf-8"), F.unhex(F.lpad(F.hex(i), 8, "0"))), 256)
    byte = lambda h, k: F.conv(F.substring(h, 1 + 2 * k, 2), 16, 10).cast("double") / 127.5 - 1.0
    raw = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(dims - 8), F.lit(8)), lambda i: F.array(*[byte(block(i), k) for k in range(8)])))
    # The length is computed once a text: a one-element array carries it into the division.
    with_length = F.transform(F.array(raw), lambda r: F.struct(r.alias("v"), norm(r).alias("n")))
    return F.flatten(F.transform(with_length, lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(x))))


def embedded(df: DataFrame, text: str, name: str, embed: Callable[[Column], Column] = hash_embedding) -> DataFrame:
    """``df`` with the embedding of its texts, made once for each distinct one."""
    made = df.where(F.col(text).isNotNull()).select(F.col(text).alias("_text")).distinct().withColumn(name, embed(F.col("_text")))
    return df.join(made, F.col(text) == F.col("_text"), "left").drop("_text")
