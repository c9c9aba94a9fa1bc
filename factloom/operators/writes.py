"""The write path as windows: what a batch of facts does to a snapshot, fact by fact in the order of time.

A new structured fact repeats a live one and is rejected (same words) or merged (another spelling); else it supersedes what it
contradicts - the same value with the other polarity, another value of a single-valued predicate - and is inserted, or revives a
deleted or archived row of its own words. Raw text (``stated``) gains evidence only. All facts of one owner, subject and canonical
predicate meet in one window; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import numeric as N
from ..functions import text as T
from ..schema import FACTS, NATURAL_KEY, PERSONAL, Identity
from ..sources.snapshots import owner

COLUMNS = [c.split(" ")[0] for c in FACTS.split(", ")]
#: What a caller gives for each new fact, with what is missing filled in.
NEW = "seq long, at double, scope string, context string, user_id string, org_id string, repo_id string, subject string, predicate string, object_value string, is_negation boolean, confidence double, source_text string, source_type string, valid_until double, metadata string, embedding array<float>, single_valued boolean, source_tool string"
ACTIONS = ("created", "deduplicated", "rejected", "revived")


def flagged() -> Column:
    """Hedged, reported and suspicious facts beat nothing."""
    meta = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    yes = lambda k: F.coalesce(F.try_element_at(meta, F.lit(k)), F.lit("")).isin("", "false") == F.lit(False)
    return yes("hypothetical") | yes("source_speaker") | (F.col("source_type") == "suspicious")


def settle(old: DataFrame, new: DataFrame, now: float, identity: Identity = PERSONAL) -> tuple[DataFrame, DataFrame]:
    """(facts, log): the snapshot after the writes, and of each write (seq, subject, predicate, object_value, source_text,
    source_tool, at) the fact_id it went to and its action. ``facts`` has a further column _beaten: superseded by this batch.

    Facts of equal time count in the order of ``seq``. Rows with a null subject, predicate or object are left out of ``new``.
    """
    new = new.where("subject is not null and predicate is not null and object_value is not null").withColumn("is_negation", F.coalesce("is_negation", F.lit(False)))
    facts, log = _structured(old.where("predicate <> 'stated'"), new.where("predicate <> 'stated'"), now, identity)
    raw, raw_log = _stated(old.where("predicate = 'stated'"), new.where("predicate = 'stated'"))
    return facts.unionByName(raw), log.unionByName(raw_log)


def _inserted(rows: DataFrame, key: list[str]) -> DataFrame:
    """New facts as rows of the table."""
    put = {
        "id": F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in key], F.col("at").cast("string"), F.col("seq").cast("string")), 256), "evidence_count": F.lit(1).cast("long"), "contradiction_count": F.lit(0).cast("long"),
        "access_count": F.lit(0).cast("long"), "created_at": F.col("at"), "updated_at": F.col("at"), "last_accessed": F.col("at"), "deleted_at": F.lit(None).cast("double"), "state": F.lit("active"),
    }
    return rows.select(*[put.get(c, F.col(c)).alias(c) for c in COLUMNS], "seq", "at", "single_valued", "source_tool")


def _structured(old: DataFrame, new: DataFrame, now: float, identity: Identity) -> tuple[DataFrame, DataFrame]:
    live = (F.col("state") == "active") & N.unexpired(F.col("valid_until"), now)
    words = ["scope", "_owner", *NATURAL_KEY]
    none = {"seq": "long", "at": "double", "single_valued": "boolean", "source_tool": "string"}
    before = old.where(live).select(*COLUMNS, *[F.lit(None).cast(t).alias(c) for c, t in none.items()]).withColumn("at", F.col("updated_at"))
    both = before.withColumn("_new", F.lit(False)).unionByName(_inserted(new.withColumn("_owner", owner()), words).withColumn("_new", F.lit(True)))
    both = both.withColumn("_owner", owner()).withColumn("_canon", identity.canon(F.col("predicate"))).withColumn("_flag", flagged())
    slot = ["scope", "_owner", "subject", "_canon"]
    preset = F.col("_canon").isin(list(identity.single_valued))
    own = (F.get_json_object("metadata", "$.single_valued") == "true") | F.coalesce("single_valued", F.lit(False))
    both = both.withColumn("_single", preset | F.coalesce(F.bool_or(own & F.col("_new")).over(Window.partitionBy(*slot)), F.lit(False)))
    both = _beaten(both, slot)
    # A write repeats the live fact before it in its group. Single-valued: the very words. Else spelling of object or predicate may differ.
    form = F.when(F.col("_single"), F.col("object_value")).otherwise(F.lower(T.strip_suffixes(F.col("object_value"))))
    both = both.withColumn("_form", form)
    group = Window.partitionBy(*slot, "_form", "is_negation")
    order = group.orderBy("at", F.col("seq").asc_nulls_first(), "id")
    last = F.lag(F.struct("predicate", "object_value", "_gone")).over(order)
    alive = last.isNotNull() & (last["_gone"].isNull() | (last["_gone"] > F.col("at")))
    alike = F.col("_single") | (last["predicate"] != F.col("predicate")) | (F.lower(last["object_value"]) == F.lower("object_value"))
    both = both.withColumn("_again", F.col("_new") & alive & alike)
    both = both.withColumn("_fact", F.sum((~F.col("_again")).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*slot, "_form", "is_negation", "_fact").orderBy("at", F.col("seq").asc_nulls_first(), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.first(F.struct("id", "predicate", "object_value")).over(run)
    other = F.col("_again") & ((head["predicate"] != F.col("predicate")) | (head["object_value"] != F.col("object_value")))
    both = both.withColumn("_head", head["id"]).withColumn("_other", other)
    both = both.withColumn("_merged", F.count_if("_other").over(run)).withColumn("_touched", F.max(F.when(F.col("_other"), F.col("at"))).over(run))
    stay = both.where(~F.col("_again"))
    gone, bump = F.col("_gone").isNotNull(), (F.col("_gone").isNotNull() & ~F.col("_quiet")).cast("long")
    touched = lambda c: F.greatest(F.col(c), F.coalesce("_touched", F.col(c))).alias(c)
    changed = {"evidence_count": F.col("evidence_count") + F.col("_merged"), "access_count": F.col("access_count") + F.col("_merged"), "contradiction_count": F.col("contradiction_count") + bump, "state": F.when(gone, "superseded").otherwise(F.col("state"))}
    stay = stay.select(*[touched(c) if c in ("updated_at", "last_accessed") else changed.get(c, F.col(c)).alias(c) for c in COLUMNS], "_owner", "_new", gone.alias("_beaten"), "_head")
    # The first new fact of some words revives a deleted, archived or expired row of those words.
    sleeping = old.where(~live).withColumn("_owner", owner())
    may = F.col("state").isin("active", "deleted", "archived")
    newest = Window.partitionBy(*words).orderBy(may.desc(), (F.col("state") == "active").desc(), F.col("updated_at").desc(), "id")
    sleeping = sleeping.withColumn("_wake", may & (F.row_number().over(newest) == 1))
    first = stay.where("_new").withColumn("_n", F.row_number().over(Window.partitionBy(*words).orderBy("created_at", "id"))).where("_n = 1")
    call = first.select(*[F.col(c).alias(f"_{c}_" if c != "_owner" else "_owner_") for c in words], F.col("id").alias("_by"), F.col("state").alias("_to"), F.col("updated_at").alias("_when"), F.col("evidence_count").alias("_more"), F.col("access_count").alias("_reads"), F.col("contradiction_count").alias("_against"), F.col("_beaten").alias("_lost"))
    on = F.col("_wake")
    for c in words:
        on &= F.col(c) == F.col(f"_{c}_" if c != "_owner" else "_owner_")
    met = sleeping.join(call, on, "left")
    woken = F.col("_by").isNotNull()
    wake = {
        "state": F.coalesce("_to", "state"), "evidence_count": F.col("evidence_count") + F.coalesce("_more", F.lit(0)), "access_count": F.col("access_count") + F.coalesce("_reads", F.lit(0)), "contradiction_count": F.col("contradiction_count") + F.coalesce("_against", F.lit(0)),
        "updated_at": F.coalesce("_when", "updated_at"), "last_accessed": F.coalesce("_when", "last_accessed"), "deleted_at": F.when(woken, None).otherwise(F.col("deleted_at")),
        "valid_until": F.when(woken & ~N.unexpired(F.col("valid_until"), now), None).otherwise(F.col("valid_until")),
    }
    rest = met.select(*[wake.get(c, F.col(c)).alias(c) for c in COLUMNS], F.coalesce("_lost", F.lit(False)).alias("_beaten"))
    revived = met.where(woken).select(F.col("_by").alias("_from"), F.col("id").alias("_into"))
    kept = stay.join(revived.select("_from"), F.col("id") == F.col("_from"), "left_anti")
    log = both.where("_new").select("seq", "subject", "predicate", "object_value", "source_text", "source_tool", "at", F.col("_head").alias("_id"), F.when(~F.col("_again"), "created").when(F.col("_other"), "deduplicated").otherwise("rejected").alias("_action"))
    log = log.join(revived, F.col("_id") == F.col("_from"), "left")
    log = log.select("seq", "subject", "predicate", "object_value", "source_text", "source_tool", "at", F.coalesce("_into", "_id").alias("fact_id"), F.when((F.col("_action") == "created") & F.col("_into").isNotNull(), "revived").otherwise(F.col("_action")).alias("action"))
    return kept.select(*COLUMNS, "_beaten").unionByName(rest), log


def _beaten(rows: DataFrame, slot: list[str]) -> DataFrame:
    """Adds _gone, the time of the first new fact that contradicts the row, and _quiet: it does so as another value of a single-valued
    predicate, which adds no contradiction.

    Facts that repeat the one before them contradict nothing new; what counts is where a value, or a polarity, begins anew.
    """
    event = F.col("_new") & ~F.col("_flag")
    sure = ~F.col("_flag")

    def begins(window, counts: Column, what: str) -> Column:  # noqa: ANN001
        """Struct of a row's time and value where ``what`` differs from the last that counts."""
        said = F.last(F.when(counts, F.struct(F.col(what).alias("v"))), ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))
        return F.when(event & counts & (said.isNull() | (said["v"] != F.col(what))), F.struct(F.col("at"), F.col(what).alias("v")))

    def first_other(window, start: str, what: str) -> Column:  # noqa: ANN001
        """Time of the first beginning after the row that has another value; two that follow each other always differ."""
        ahead = window.rowsBetween(1, Window.unboundedFollowing)
        near = F.first(start, ignorenulls=True).over(ahead)
        return F.when(near["v"] != F.col(what), near["at"]).otherwise(near["next"])

    def with_next(df: DataFrame, window, start: str) -> DataFrame:  # noqa: ANN001
        ahead = window.rowsBetween(1, Window.unboundedFollowing)
        after = F.first(start, ignorenulls=True).over(ahead)["at"]
        return df.withColumn(start, F.when(F.col(start).isNotNull(), F.struct(F.col(start)["at"].alias("at"), F.col(start)["v"].alias("v"), after.alias("next"))))

    by = ["at", F.col("seq").asc_nulls_first(), "id"]
    values = Window.partitionBy(*slot).orderBy(*by)
    signs = Window.partitionBy(*slot, "object_value").orderBy(*by)
    rows = rows.withColumn("_v", begins(values, sure & ~F.col("is_negation") & F.col("_single"), "object_value")).withColumn("_s", begins(signs, sure, "is_negation"))
    rows = with_next(with_next(rows, values, "_v"), signs, "_s")
    rows = rows.withColumn("_rewritten", first_other(values, "_v", "object_value")).withColumn("_flipped", first_other(signs, "_s", "is_negation"))
    quiet = F.col("_rewritten").isNotNull() & (F.col("_flipped").isNull() | (F.col("_rewritten") <= F.col("_flipped")))
    return rows.withColumn("_gone", F.least("_rewritten", "_flipped")).withColumn("_quiet", quiet).drop("_v", "_s", "_rewritten", "_flipped")


def _stated(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw text: a repetition is evidence for the row that has it, an active one first; superseded rows stay as they are."""
    words = ["scope", "_owner", *NATURAL_KEY]
    rows = _inserted(new.withColumn("_owner", owner()), words).withColumn("_owner", owner())
    one = Window.partitionBy(*words).orderBy("at", "seq", "id")
    rows = rows.withColumn("_n", F.row_number().over(one)).withColumn("_all", F.count("*").over(Window.partitionBy(*words))).withColumn("_last", F.max("at").over(Window.partitionBy(*words))).withColumn("_head", F.first("id").over(one))
    first = rows.where("_n = 1")
    rank = Window.partitionBy(*words).orderBy((F.col("state") == "superseded").cast("int"), (F.col("state") != "active").cast("int"), F.col("updated_at").desc(), "id")
    ranked = old.withColumn("_owner", owner()).withColumn("_rank", F.row_number().over(rank))
    call = first.select(*[F.col(c).alias(f"_{c}_") for c in words], F.col("_all").alias("_more"), F.col("_last").alias("_when"), F.col("id").alias("_by"))
    on = (F.col("_rank") == 1) & (F.col("state") != "superseded")
    for c in words:
        on &= F.col(c) == F.col(f"_{c}_")
    met = ranked.join(call, on, "left")
    hit = F.col("_by").isNotNull()
    put = {"evidence_count": F.col("evidence_count") + F.coalesce("_more", F.lit(0)), "state": F.when(hit, "active").otherwise(F.col("state")), "updated_at": F.coalesce("_when", "updated_at"), "last_accessed": F.coalesce("_when", "last_accessed"), "deleted_at": F.when(hit, None).otherwise(F.col("deleted_at"))}
    kept = met.select(*[put.get(c, F.col(c)).alias(c) for c in COLUMNS])
    into = met.where(hit).select(F.col("_by").alias("_from"), F.col("id").alias("_into"))
    fresh = first.join(into, F.col("id") == F.col("_from"), "left_anti").select(*[F.col("_all").alias(c) if c == "evidence_count" else F.col("_last").alias(c) if c in ("updated_at", "last_accessed") else F.col(c) for c in COLUMNS])
    log = rows.select("seq", "subject", "predicate", "object_value", "source_text", "source_tool", "at", "_head", "_n").join(into, F.col("_head") == F.col("_from"), "left")
    action = F.when(F.col("_into").isNotNull() | (F.col("_n") > 1), "deduplicated").otherwise("created")
    log = log.select("seq", "subject", "predicate", "object_value", "source_text", "source_tool", "at", F.coalesce("_into", "_head").alias("fact_id"), action.alias("action"))
    return kept.unionByName(fresh).withColumn("_beaten", F.lit(False)), log


def lost(facts: DataFrame, new: DataFrame) -> DataFrame:
    """Facts after loss events among ``new``: what an owner possesses goes when its name is the subject of "passed away" and its
    like. Superseded and contradicted once; ``_beaten`` is set."""
    sure = new.where(F.col("predicate").isin(list(L.LOSS_PREDICATES)) & ~flagged())
    gone = sure.select(F.col("scope").alias("_s"), owner().alias("_o"), F.trim(F.lower("subject")).alias("_g")).where(~F.col("_g").isin("", "i", "we", "me", "us", "my")).distinct()
    hit = (F.col("scope") == F.col("_s")) & (owner() == F.col("_o")) & (F.trim(F.lower("object_value")) == F.col("_g")) & (F.col("state") == "active") & F.col("predicate").isin(list(L.POSSESSION))
    both = facts.join(gone, hit, "left")
    yes = F.col("_g").isNotNull()
    return both.withColumn("state", F.when(yes, "superseded").otherwise(F.col("state"))).withColumn("contradiction_count", F.col("contradiction_count") + yes.cast("long")).withColumn("_beaten", F.col("_beaten") | yes).drop("_s", "_o", "_g")
