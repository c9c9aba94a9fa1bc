"""Belief revision and lifecycle of facts: supersession, contradiction, loss, decay, upsert, feedback, deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import numeric as N
from ..schema import NATURAL_KEY, PERSONAL, Identity


def live(facts: DataFrame, as_of: float) -> DataFrame:
    """Active and not expired."""
    return facts.where((F.col("state") == "active") & N.unexpired(F.col("valid_until"), as_of))


def believed(facts: DataFrame, as_of: float) -> DataFrame:
    return live(facts, as_of).where(N.posterior_of() > L.POSTERIOR_FLOOR)


def upsert(batch: DataFrame) -> DataFrame:
    """One row per natural key: how often it was written, first and last time, latest confidence (by ``seq``)."""
    return batch.groupBy(*NATURAL_KEY).agg(
        F.count("*").alias("evidence_count"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"), F.max_by("confidence", "seq").alias("confidence"), F.min("seq").alias("first_seq")
    )


def merge_snapshot(snapshot: DataFrame, batch: DataFrame, now: float) -> DataFrame:
    """Upsert a batch into a snapshot: a row of the same key that is active, deleted or archived gains the evidence and
    lives again (an active one first); superseded rows stay as they are and new keys become new rows."""
    new = upsert(batch).select(*[F.col(c).alias(f"_{c}") for c in (*NATURAL_KEY, "evidence_count", "created_at", "updated_at", "confidence")])
    key = Window.partitionBy(*NATURAL_KEY).orderBy((F.col("state") == "superseded").cast("int"), (F.col("state") != "active").cast("int"), F.col("updated_at").desc(), "id")
    ranked = snapshot.withColumn("_n", F.row_number().over(key))
    on = (F.col("_n") == 1) & (F.col("state") != "superseded")
    for c in NATURAL_KEY:
        on &= F.col(c) == F.col(f"_{c}")
    both = ranked.join(new, on, "full_outer")
    hit, fresh = F.col("_subject").isNotNull() & F.col("id").isNotNull(), F.col("id").isNull()
    put = {
        "evidence_count": F.when(hit, F.col("evidence_count") + F.col("_evidence_count")).when(fresh, F.col("_evidence_count")).otherwise(F.col("evidence_count")),
        "state": F.when(hit | fresh, "active").otherwise(F.col("state")),
        "updated_at": F.when(hit | fresh, F.lit(now)).otherwise(F.col("updated_at")),
        "created_at": F.coalesce("created_at", "_created_at"),
        "confidence": F.coalesce("confidence", "_confidence"),
        "id": F.coalesce("id", F.sha2(F.concat_ws("\x1f", *[F.col(f"_{c}").cast("string") for c in NATURAL_KEY]), 256)),
    } | {c: F.coalesce(c, f"_{c}") for c in NATURAL_KEY}
    return both.select(*[put.get(c, F.col(c)).alias(c) for c in snapshot.columns])


def supersession(facts: DataFrame, identity: Identity = PERSONAL) -> DataFrame:
    """History of single-valued predicates, per subject and canonical predicate in the order of ``seq``: runs of one value
    are one row with its evidence; all but the last are superseded. Positive, structured facts only.

    Within a run a repeat in the run's first spelling is rejected and adds nothing; another spelling adds evidence.
    """
    rows = facts.where(~F.col("is_negation") & (F.col("predicate") != "stated")).withColumn("canon", identity.canon(F.col("predicate"))).where(F.col("canon").isin(list(identity.single_valued)))
    order = Window.partitionBy("subject", "canon").orderBy("seq")
    changed = F.coalesce((F.lag("object_value").over(order) != F.col("object_value")).cast("int"), F.lit(1))
    runs = rows.withColumn("_new", changed).withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spelled = runs.withColumn("_first", F.first("predicate").over(Window.partitionBy("subject", "canon", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    out = spelled.groupBy("subject", "canon", "run").agg(F.min("seq").alias("seq"), F.first("object_value").alias("object_value"), (1 + F.count_if(F.col("predicate") != F.col("_first"))).alias("evidence"))
    last = F.max("run").over(Window.partitionBy("subject", "canon"))
    return out.withColumn("state", F.when(F.col("run") == last, "active").otherwise("superseded"))


def contradictions(facts: DataFrame, identity: Identity = PERSONAL) -> DataFrame:
    """Facts that a later fact of the same subject and canonical predicate contradicts: the same value with the other
    polarity, or another value of a single-valued predicate asserted positively. Adds the count of such facts.

    One window of each key; no self-join: later facts are counted by value, by polarity and in all.
    """
    rows = facts.withColumn("canon", identity.canon(F.col("predicate")))
    later = lambda *more: Window.partitionBy("subject", "canon", *more).orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    positive = (~F.col("is_negation")).cast("long")
    flips = F.coalesce(F.count("*").over(later("object_value")) - F.coalesce(F.sum(positive).over(later("object_value")), F.lit(0)), F.lit(0))
    rows = rows.withColumn("_neg_same", flips).withColumn("_pos_same", F.coalesce(F.sum(positive).over(later("object_value")), F.lit(0))).withColumn("_pos_all", F.coalesce(F.sum(positive).over(later()), F.lit(0)))
    single = F.col("canon").isin(list(identity.single_valued))
    polarity = F.when(F.col("is_negation"), F.col("_pos_same")).otherwise(F.col("_neg_same"))
    rewrites = F.when(single, F.col("_pos_all") - F.col("_pos_same")).otherwise(0)
    return rows.withColumn("contradicted_by", (polarity + rewrites).cast("long")).drop("_neg_same", "_pos_same", "_pos_all").where("contradicted_by > 0")


def cross_scope(shared: DataFrame, private: DataFrame, identity: Identity = PERSONAL) -> DataFrame:
    """Private facts that shared ones of single-valued predicates disagree with: (id, n). They are counted, not superseded."""
    value = lambda df, p: df.where(~F.col("is_negation")).withColumn("canon", identity.canon(F.col("predicate"))).where(F.col("canon").isin(list(identity.single_valued))).select(*[F.col(c).alias(p + c) for c in ("id", "subject", "canon", "object_value")])
    counts = value(shared, "s_").groupBy("s_subject", "s_canon", "s_object_value").agg(F.count("*").alias("same"))
    total = counts.groupBy("s_subject", "s_canon").agg(F.sum("same").alias("total"))
    mine = value(private, "p_").join(total, (F.col("p_subject") == F.col("s_subject")) & (F.col("p_canon") == F.col("s_canon"))).drop("s_subject", "s_canon")
    agree = (F.col("p_subject") == F.col("s_subject")) & (F.col("p_canon") == F.col("s_canon")) & (F.col("p_object_value") == F.col("s_object_value"))
    return mine.join(counts, agree, "left").select(F.col("p_id").alias("id"), (F.col("total") - F.coalesce("same", F.lit(0))).alias("n")).where("n > 0")


def losses(facts: DataFrame, events: DataFrame, as_of: float) -> DataFrame:
    """Ids of live possessions whose object is the subject of a loss event (subject, predicate): "passed away" and its like."""
    lost = events.where(F.col("predicate").isin(list(L.LOSS_PREDICATES))).select(F.trim(F.lower("subject")).alias("gone")).where(~F.col("gone").isin("", "i", "we", "me", "us", "my")).distinct()
    return live(facts, as_of).where(F.col("predicate").isin(list(L.POSSESSION))).join(lost, F.trim(F.lower("object_value")) == F.col("gone"), "left_semi").select("id")


def consolidate(facts: DataFrame, as_of: float, replay: DataFrame | None = None, identity: Identity = PERSONAL) -> DataFrame:
    """All facts with ``new_state``, ``decayed`` and ``replayed``: replayed facts gain evidence, then those that have faded or
    are hardly believed are archived. Raw text younger than the protection time is left alone."""
    rows = facts
    if replay is not None:
        hits = replay.where("n >= 3").select(F.col("id").alias("_r")).distinct()
        rows = rows.join(hits, F.col("id") == F.col("_r"), "left").withColumn("replayed", F.col("_r").isNotNull()).drop("_r")
    else:
        rows = rows.withColumn("replayed", F.lit(False))
    bump = F.col("replayed").cast("long")
    rows = rows.withColumn("evidence_count", F.col("evidence_count") + bump).withColumn("access_count", F.col("access_count") + bump)
    rows = rows.withColumn("posterior", N.posterior_of())
    decay = identity.decay_of(F.col("predicate"))
    kept = N.forgetting(F.when(F.col("replayed"), F.lit(as_of)).otherwise(F.col("updated_at")), F.col("access_count"), F.col("posterior"), decay, as_of)
    subject = (F.col("state") == "active") & N.unexpired(F.col("valid_until"), as_of)
    subject &= (F.col("predicate") != "stated") | ((as_of - F.col("created_at")) / N.DAY >= identity.protection_days)
    faded = (decay > 0) & (kept < 0.1) & (F.col("posterior") < 0.3)
    weak = (F.col("posterior") < 0.15) | (F.col("confidence") < 0.1) & (F.col("evidence_count") <= 1)
    return rows.withColumn("decayed", subject & faded).withColumn("new_state", F.when(subject & (faded | weak), "archived").otherwise(F.col("state")))


def accessed(facts: DataFrame, uses: DataFrame, now: float) -> DataFrame:
    """Fold uses (id[, at]) into access counts and times; a use without a time is of ``now``."""
    at = F.coalesce(F.col("at").cast("double"), F.lit(now)) if "at" in uses.columns else F.lit(now)
    sums = uses.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("_n"), F.max(at).alias("_at"))
    both = facts.join(sums, F.col("id") == F.col("_id"), "left")
    return both.withColumn("access_count", F.col("access_count") + F.coalesce("_n", F.lit(0))).withColumn("last_accessed", F.greatest("last_accessed", F.coalesce("_at", "last_accessed"))).drop("_id", "_n", "_at")


def feedback(facts: DataFrame, votes: DataFrame) -> DataFrame:
    """Fold votes (id, helpful) into evidence, access and contradiction counts."""
    sums = votes.groupBy("id").agg(F.count_if("helpful").alias("_up"), F.count_if(~F.col("helpful")).alias("_down")).withColumnRenamed("id", "_id")
    both = facts.join(sums, F.col("id") == F.col("_id"), "left")
    up, down = F.coalesce("_up", F.lit(0)), F.coalesce("_down", F.lit(0))
    return both.withColumn("evidence_count", F.col("evidence_count") + up).withColumn("access_count", F.col("access_count") + up).withColumn("contradiction_count", F.col("contradiction_count") + down).drop("_id", "_up", "_down")


def set_state(facts: DataFrame, ids: DataFrame, state: str, now: float) -> DataFrame:
    """Facts whose id is in ``ids`` take the state; deletion notes its time, recovery clears it."""
    hit = ids.select(F.col(ids.columns[0]).alias("_id")).distinct()
    both = facts.join(hit, F.col("id") == F.col("_id"), "left")
    chosen = F.col("_id").isNotNull()
    gone = F.lit(now) if state == "deleted" else F.lit(None).cast("double")
    return both.withColumn("state", F.when(chosen, state).otherwise(F.col("state"))).withColumn("deleted_at", F.when(chosen, gone).otherwise(F.col("deleted_at"))).drop("_id")


def fold_states(facts: DataFrame, changes: DataFrame) -> DataFrame:
    """Facts after a log of changes (id, seq, state): the last one of each id counts; deletion notes its ``seq`` as its time."""
    last = changes.groupBy(F.col("id").alias("_id")).agg(F.max_by("state", "seq").alias("_state"), F.max("seq").alias("_seq"))
    both = facts.join(last, F.col("id") == F.col("_id"), "left")
    gone = F.when(F.col("_state") == "deleted", F.col("_seq").cast("double")).when(F.col("_state").isNotNull(), None).otherwise(F.col("deleted_at"))
    return both.withColumn("state", F.coalesce("_state", "state")).withColumn("deleted_at", gone).drop("_id", "_state", "_seq")


def purge(facts: DataFrame, scope: str, owner: str) -> DataFrame:
    """All but one tenant's facts."""
    who = F.when(F.col("scope") == "private", F.col("user_id")).when(F.col("scope") == "shared", F.col("org_id")).otherwise(F.col("repo_id") if "repo_id" in facts.columns else F.lit(""))
    return facts.where(~((F.col("scope") == scope) & (who == owner)))


def hard_delete(facts: DataFrame, ids: DataFrame) -> DataFrame:
    return facts.join(ids.select(F.col(ids.columns[0]).alias("_id")), F.col("id") == F.col("_id"), "left_anti")


def siblings(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids of facts from the same sentence of the same subject as those given, these included."""
    seed = facts.join(ids.select(F.col(ids.columns[0]).alias("_id")), F.col("id") == F.col("_id"), "left_semi")
    said = seed.where("source_text <> ''").select(F.col("subject").alias("_s"), F.col("source_text").alias("_t")).distinct()
    near = facts.join(said, (F.col("subject") == F.col("_s")) & (F.col("source_text") == F.col("_t")), "left_semi").select("id")
    return near.unionByName(seed.select("id")).distinct()
