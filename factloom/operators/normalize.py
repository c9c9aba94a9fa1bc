"""Subjects, predicates and objects in canonical form. Order-dependent rules are ordered folds of one tenant's values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import text as T


def resolve_subject(subject: Column, user: Column, aliases: Column | None = None) -> Column:
    """The user for an empty subject, first person, a known alias, or a name contained in the user's id or the other way
    round; "my <relation>" and all else stay as they are."""
    s, u = F.lower(F.trim(subject)), F.lower(user)
    related = F.startswith(s, F.lit("my ")) & F.exists(F.split(F.trim(F.substring(s, 4, 1_000_000)), r"\s+"), lambda w: w.isin(list(L.SUBJECT_RELATIONSHIPS)))
    known = s.isin(list(L.FIRST_PERSON) + ["user", "current_user", "the user"])
    if aliases is not None:
        known = known | F.coalesce(F.array_contains(aliases, s), F.lit(False))
    contained = (F.length(u) > 0) & (F.contains(u, s) | F.contains(s, u))
    return F.when(F.length(s) == 0, user).when(related, subject).when(known | contained, user).otherwise(subject)


def learned_aliases(utterances: DataFrame) -> DataFrame:
    """(seq, user_id, alias) from "my name is", "I am" and "call me"; names of one to four words, no descriptions."""
    low = F.lower("text")
    name = lambda p: F.trim(F.regexp_extract(low, p + r"\s+([^.,]+)", 1))
    found = F.array(name("my name is"), name("(?:^|[^a-z])i(?:'m| am)").alias("x"), name("call me"))
    rows = utterances.select("seq", "user_id", F.explode(F.filter(found, lambda n: F.length(n) > 1)).alias("alias"))
    return rows.where((F.size(F.split("alias", r"\s+")) <= 4) & ~F.col("alias").rlike("^(a |an |the |working|living|based)"))


def near_objects(values: DataFrame, name: str, ratio: float = 0.85) -> DataFrame:
    """(a, b, d): pairs of distinct values whose Levenshtein ratio is above ``ratio``.

    Such values share a length band; the join is on it, and the built-in distance stops at the bound.
    """
    one = values.select(F.col(name).alias("a")).distinct().withColumn("_n", F.length("a"))
    two = one.select(F.col("a").alias("b"), F.explode(F.sequence(F.ceil(F.col("_n") * ratio).cast("int"), F.floor(F.col("_n") / ratio).cast("int"))).alias("_m"))
    both = one.join(two, F.col("_n") == F.col("_m")).where("a < b")
    most = F.greatest(F.length("a"), F.length("b"))
    return both.withColumn("d", F.levenshtein("a", "b")).where(1 - F.col("d") / most > ratio).select("a", "b", "d")


def canonicalize_objects(rows: DataFrame, key: str, ratio: float = 0.85) -> DataFrame:
    """(key, seq, object_value, canonical): each tenant's objects in order; suffixes go, then the same text in any case,
    then the first containing or contained one (the shorter wins), then the nearest by edit distance, else a new form.

    An ordered fold by nature: a tenant's distinct values stream past in order; its canonical forms are all that is held.
    """
    first = rows.where(F.col(key).isNotNull() & F.col("object_value").isNotNull()).groupBy(key, "object_value").agg(F.min("seq").alias("seq"))
    first = first.withColumn("_norm", F.lower(T.strip_suffixes(F.col("object_value"))))
    kind = dict(rows.dtypes)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tenant, forms = None, {}
        for f in frames:
            out = []
            for k, norm, raw in zip(f[key], f["_norm"], f["object_value"], strict=True):
                if k != tenant:
                    tenant, forms = k, {}
                if norm not in forms:
                    forms[norm] = _match(norm, raw.strip(), forms, ratio)
                out.append(forms[norm])
            yield f[[key, "object_value"]].assign(canonical=out)

    laid = first.repartition(key).sortWithinPartitions(key, "seq", "object_value")
    done = laid.mapInPandas(fold, f"{key} {kind[key]}, object_value string, canonical string")
    done = done.select(F.col(key).alias("_k"), F.col("object_value").alias("_o"), "canonical")
    return rows.join(done, (F.col(key) == F.col("_k")) & (F.col("object_value") == F.col("_o"))).select(key, "seq", "object_value", "canonical")


def _match(norm: str, raw: str, forms: dict[str, str], ratio: float) -> str:
    nearest, best = raw, ratio
    for other, form in forms.items():
        if norm in other or other in norm:
            return min((form if len(other) <= len(norm) else raw), form, key=len)
        bound = max(len(norm), len(other))
        if abs(len(norm) - len(other)) > (1 - best) * bound:  # that many edits at least
            continue
        score = 1 - edit_distance(norm, other) / bound if bound else 0.0
        if score > best:
            nearest, best = form, score
    return nearest


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a numpy row at a time."""
    x = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    row = np.arange(len(x) + 1)
    for i, ch in enumerate(a, 1):
        cost = np.minimum(row[1:] + 1, row[:-1] + (x != ord(ch)))
        # What a run of insertions adds is a running minimum of cost minus position.
        full = np.concatenate([[i], cost]) - np.arange(len(x) + 1)
        row = np.minimum.accumulate(full) + np.arange(len(x) + 1)
    return int(row[-1])


def leader_clusters(rows: DataFrame, threshold: float = 0.82) -> DataFrame:
    """(key, seq, leader): leader clustering of each key's embeddings in order: a row joins the most similar leader that is
    near enough, else leads a cluster. An ordered fold; rows stream past by key, and leaders' vectors are all that is held.

    Each batch meets the leaders known before it as one matrix product; only rows that none of them takes are looked at one by
    one, against the leaders of the batch itself. Rows with a null key or embedding are left out."""
    kind = dict(rows.dtypes)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, leaders, names = None, np.zeros((0, 0)), []
        for f in frames:
            for k, part in f.groupby("key", sort=False):  # keys come sorted: groups are runs
                if k != key or not names:
                    key, leaders, names = k, np.zeros((0, len(part["embedding"].iloc[0]))), []
                out = []
                for at in range(0, len(part), 256):
                    block = part.iloc[at : at + 256]
                    u = np.stack([np.asarray(v, np.float64) for v in block["embedding"]])
                    length = np.sqrt((u * u).sum(1, keepdims=True))
                    u = u / np.where(length > 0, length, 1.0)
                    sims = u @ leaders.T
                    before = len(names)
                    for i, seq in enumerate(block["seq"]):
                        here = sims[i]
                        if len(names) > before:
                            here = np.concatenate([here, leaders[before:] @ u[i]])
                        if len(here) and here.max() >= threshold:
                            out.append(names[int(here.argmax())])
                        else:
                            leaders = np.concatenate([leaders, u[i : i + 1]])
                            names.append(seq)
                            out.append(seq)
                yield pd.DataFrame({"key": key, "seq": part["seq"].to_numpy(), "leader": out})

    laid = rows.where("key is not null and embedding is not null").select("key", "seq", "embedding").repartition("key").sortWithinPartitions("key", "seq")
    return laid.mapInPandas(fold, f"key {kind['key']}, seq {kind['seq']}, leader {kind['seq']}")
