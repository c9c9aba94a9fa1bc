"""The user-facing API: a fact memory over versioned Parquet snapshots. Reads are DataFrames; writes make a new version."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexicon as L
from .functions import numeric as N
from .functions import text as T
from .operators import beliefs as B
from .operators import graph as G
from .operators import extract as X
from .operators import grammar, normalize, profiles, safety
from .operators import retrieval as R
from .operators import writes as W
from .schema import CONTEXTS, FACTS, PERSONAL, Identity
from .sources import files, git
from .sources.snapshots import BUCKETS, Snapshots, bucket_of, owner

PROVENANCE = "seq long, subject string, predicate string, object_value string, source_text string, source_tool string, at double, fact_id string, action string"
ALIASES = "user_id string, alias string"
EDGES = "owner string, src string, dst string"
CORRECTIONS = "wrong string, right string, object string, at double"


@dataclass(frozen=True)
class Options:
    """``embed``: a model of meaning as a column expression or Arrow UDF; writes are then checked by likeness too, and questions for what
    they ask about. ``buckets`` of tenants count when the table is made."""

    injection_defense: bool = True
    hypothetical_detection: bool = True
    clarification: float = 0.15
    embed: Callable[[Column], Column] | None = None
    buckets: int = BUCKETS


class Memory:
    """Facts of many tenants. Every read names its user; private facts of others are never candidates.

    ``root`` is a folder all executors share. ``extractor`` maps utterances (seq, user_id, text) to facts (seq, subject,
    predicate, object, confidence, is_negation[, single_valued, sentence]) and may be replaced. A folder that holds a table is
    opened at its newest version; a write of two that start from one version fails with ``ConflictError``.
    """

    def __init__(self, spark: SparkSession, root: str, identity: Identity = PERSONAL, options: Options | None = None, extractor: Callable[[DataFrame, str], DataFrame] = grammar.extract):
        self.spark, self.root, self.identity, self.options, self.extractor = spark, root.rstrip("/"), identity, options or Options(), extractor
        self.table = Snapshots(spark, self.root, FACTS, self.options.buckets)
        self._work: list[str] = []
        stored = self.table.manifest["meta"].get("identity")
        if stored and stored != identity.key():
            warnings.warn(f"the facts in {root} were written under another identity ({stored}, now {identity.key()})", stacklevel=2)

    # -- snapshots
    @property
    def version(self) -> int:
        return self.table.version

    def facts(self, only: set[int] | None = None) -> DataFrame:
        return self.table.read(only)

    def meta(self) -> dict[str, str]:
        return dict(self.table.manifest["meta"])

    def provenance(self) -> DataFrame:
        """Every write and the fact it went to, with its tool and words."""
        return self.table.extra("provenance", PROVENANCE)

    def history(self, ids: DataFrame) -> DataFrame:
        """(fact_id, writes): of the facts in ``ids``, what was written to each, in the order of time."""
        rows = self.provenance().join(ids.select(F.col(ids.columns[0]).alias("_id")).distinct(), F.col("fact_id") == F.col("_id"), "left_semi")
        return rows.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("at", "seq", "source_tool", "subject", "predicate", "object_value", "source_text", "action"))).alias("writes"))

    def _commit(self, facts: DataFrame, touched: set[int] | None = None, extra: dict[str, DataFrame] | None = None) -> None:
        self.table.commit(facts, touched, {"identity": self.identity.key()}, extra)

    def numbered(self, only: set[int] | None = None) -> DataFrame:
        """Facts with ``seq``, an order of writing for ties."""
        return self.facts(only).withColumn("seq", (F.col("created_at") * 1e6).cast("long"))

    # -- writes
    def store(self, utterances: DataFrame, now: float, context: str = "personal", scope: str = "private", org_id: str = "", tool: str = "") -> dict[str, int]:
        """Extract and write (seq, user_id, text[, speaker]). Later rows win over earlier ones within the batch. Personal texts that are
        no sentences (key-value pairs, signatures, notes) are read without grammar too. Blank and null texts are left out; texts
        end at 50,000 characters."""
        if context not in CONTEXTS.get(scope, ()):
            raise ValueError(f"context {context} is not one of scope {scope}")
        said = utterances.where(F.length(F.trim(F.col("text").cast("string"))) > 0).withColumn("text", F.substring(F.trim(F.col("text").cast("string")), 1, 50_000))
        rows = _filled(self.extractor(said, context))
        if context == "personal":
            other = said.where(X.source_type(F.col("text")) != "sentence")
            rows = rows.unionByName(_filled(X.grammar_free(other, self.corrections())))
        return self._store_said(rows, said, now, context, scope, org_id, tool)

    def store_from_tool(self, utterances: DataFrame, tool: str, now: float) -> dict[str, int]:
        """Any tool's texts, read both without grammar and with it."""
        said = utterances.where(F.length(F.trim(F.col("text").cast("string"))) > 0).withColumn("text", F.substring(F.trim(F.col("text").cast("string")), 1, 50_000))
        return self._store_said(_filled(X.grammar_free(said, self.corrections())).unionByName(_filled(self.extractor(said, "personal"))), said, now, "personal", "private", "", tool)

    def _store_said(self, rows: DataFrame, said: DataFrame, now: float, context: str, scope: str, org_id: str, tool: str) -> dict[str, int]:
        text = said.select(F.col("seq").alias("_s"), "user_id", F.substring("text", 1, 500).alias("source_text"))
        rows = rows.join(text, F.col("seq") == F.col("_s")).drop("_s").withColumnRenamed("object", "object_value").withColumn("source_type", F.lit("user_stated"))
        ends = T.valid_until(F.coalesce("sentence", "source_text"), now) if context == "personal" else F.lit(None).cast("double")
        past = F.coalesce(F.col("sentence"), F.lit("")).rlike(r"(?i)\b\w+ed\b") & (ends > now)
        rows = rows.withColumn("valid_until", F.when(F.col("predicate") != "stated", F.when(past, now - 1).otherwise(ends)))
        if context != "company" and (self.options.injection_defense or self.options.hypothetical_detection):
            rows = safety.flag_writes(rows, self.options.embed, self.options.injection_defense, self.options.hypothetical_detection)
        return self._write(rows, now, context, scope, org_id, tool, normalize.learned_aliases(said))

    def corrections(self) -> DataFrame:
        return self.table.extra("corrections", CORRECTIONS)

    def learn_correction(self, wrong: str, right: str, now: float, about: str | None = None) -> None:
        """From now on read the predicate ``wrong`` as ``right``, of the object ``about`` or of any, in texts read without grammar."""
        row = self.spark.createDataFrame([(wrong, right, about, float(now))], CORRECTIONS)
        self._commit(self.spark.createDataFrame([], FACTS), set(), {"corrections": row})

    def store_facts(self, utterances: DataFrame, now: float, context: str = "personal", scope: str = "private", org_id: str = "", tool: str = "") -> dict[str, int]:
        """Texts with the facts a model found in them: (seq, user_id, text, facts array<struct<subject, predicate, object[, confidence,
        is_negation]>>). The text is kept as ``stated``; facts without a predicate or object are left out; ``user`` is the user."""
        return self._write(llm_facts(utterances), now, context, scope, org_id, tool)

    def store_triples(self, triples: DataFrame, now: float, context: str = "personal", scope: str = "private", org_id: str = "", repo_id: str = "") -> dict[str, int]:
        """Write (seq, user_id, subject, predicate, object_value, confidence) as they are; predicates are normalised."""
        if context not in CONTEXTS.get(scope, ()):
            raise ValueError(f"context {context} is not one of scope {scope}")
        rows = triples.withColumn("predicate", T.norm_predicate(F.col("predicate")))
        return self._write(rows, now, context, scope, org_id, "", repo_id=repo_id)

    def ingest_repo(self, path: str, now: float, user_id: str = "", commits: int = 50) -> dict[str, int]:
        """Commits and the file tree of a git repository on the driver, as facts of the repository."""
        repo = git.repo_id(path)
        said = git.commits_to_facts(git.read_commits(self.spark, path, commits)).withColumnRenamed("created_at", "at").drop("sha")
        tree = git.tree_to_facts(git.read_tree(self.spark, path)).withColumn("source_text", F.lit("")).withColumn("at", F.lit(float(now)))
        rows = said.unionByName(tree).withColumn("source_type", F.lit("system"))
        rows = rows.withColumn("seq", F.row_number().over(W.Window.orderBy("at", "predicate", "subject", "object_value")))  # of 50 commits at most
        return self._write(rows.withColumn("user_id", F.lit(user_id)), now, "repo", "repo", "", "repo_parser", repo_id=repo)

    def _write(self, rows: DataFrame, now: float, context: str, scope: str, org_id: str, tool: str, aliases: DataFrame | None = None, repo_id: str = "") -> dict[str, int]:
        """Normalise, settle, check other scopes, note losses, commit. Returns how many facts were created, deduplicated (rejected,
        merged, revived) and contradicted."""
        fixed = {"scope": scope, "context": context, "org_id": org_id, "repo_id": repo_id, "source_tool": tool}
        given = {"is_negation": False, "source_text": "", "source_type": "user_stated", "single_valued": False, "confidence": 0.7}
        for name, value in (fixed | {k: v for k, v in given.items() if k not in rows.columns}).items():
            rows = rows.withColumn(name, F.lit(value))
        for name, kind in (("valid_until", "double"), ("embedding", "array<float>")):
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast(kind))
        flags = {"hypothetical": F.col("hypothetical").cast("string")} if "hypothetical" in rows.columns else {}
        flags |= {"source_speaker": F.col("source_speaker")} if "source_speaker" in rows.columns else {}
        flags |= {"single_valued": F.when(F.col("single_valued"), "true")}
        meta = F.map_filter(F.create_map(*[x for k, v in flags.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull() & (v != "false"))
        rows = rows.withColumn("metadata", F.to_json(meta)).withColumn("at", F.col("at").cast("double") if "at" in rows.columns else F.lit(float(now)) + F.col("seq") / 1e6).withColumn("seq", F.col("seq").cast("long"))
        tables = {}
        if scope == "private":
            known = self.table.extra("aliases", ALIASES)
            if aliases is not None:
                aliases = aliases.select("user_id", "alias").distinct().join(known.withColumnRenamed("user_id", "_u").withColumnRenamed("alias", "_a"), (F.col("user_id") == F.col("_u")) & (F.col("alias") == F.col("_a")), "left_anti")
                tables["aliases"] = aliases
                known = known.unionByName(aliases)
            names = known.groupBy(F.col("user_id").alias("_u")).agg(F.collect_set("alias").alias("_names"))
            rows = rows.join(names, F.col("user_id") == F.col("_u"), "left")
            rows = rows.withColumn("subject", F.when((F.col("predicate") == "stated") | F.col("subject").isNull(), F.col("subject")).otherwise(normalize.resolve_subject(F.col("subject"), F.col("user_id"), F.col("_names")))).drop("_u", "_names")
        new = rows.select(*[F.col(c.split(" ")[0]).cast(c.split(" ", 1)[1]) for c in W.NEW.split(", ")])
        new = self._keep(new, "new")
        touched = self.table.touched(new)
        private = {bucket_of("private", r[0], self.table.manifest["n"]) for r in new.select("user_id").distinct().collect()} if scope == "shared" else set()
        old = self.facts(touched | private)
        facts, log = W.settle(old, new, now, self.identity)
        facts = W.lost(facts, new)
        if scope == "shared":
            facts = self._disagree(facts, new)
        facts, log = self._keep(facts, "facts"), self._keep(log, "log")
        done = {r[0]: r[1] for r in log.groupBy("action").count().collect()}
        beaten = facts.where("_beaten").count()
        self._commit(facts, touched | private, tables | {"provenance": log})
        while self._work:
            self.table.delete(self._work.pop())
        return {"created": done.get("created", 0), "deduplicated": sum(done.get(k, 0) for k in ("deduplicated", "rejected", "revived")), "contradictions": beaten}

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        """A step's rows as a table beside the data: each write is computed once, whatever counts and files are made of it."""
        path = f"{self.root}/work/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self._work.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _disagree(self, facts: DataFrame, new: DataFrame) -> DataFrame:
        """What a writer shares against the writer's own private facts: those that disagree gain a contradiction, no more."""
        by = lambda df: df.withColumn("subject", F.concat_ws("\x1f", "user_id", "subject"))
        shared = new.where((F.col("predicate") != "stated") & ~W.flagged()).withColumn("id", F.col("seq").cast("string"))
        against = B.cross_scope(by(shared), by(facts.where("scope = 'private' and state = 'active'")), self.identity).select(F.col("id").alias("_id"), F.col("n").alias("_more"))
        both = facts.join(against, F.col("id") == F.col("_id"), "left")
        hit = F.col("_id").isNotNull()
        return both.withColumn("contradiction_count", F.col("contradiction_count") + F.coalesce("_more", F.lit(0))).withColumn("_beaten", F.col("_beaten") | hit).drop("_id", "_more")

    # -- reads
    def visible(self, user_id: str, org_id: str = "", repo_id: str = "") -> DataFrame:
        """The user's own facts, those of the organisation and of the repository if given; only their buckets are read."""
        n = self.table.manifest["n"]
        scopes = [("private", user_id), *([("shared", org_id)] if org_id else []), *([("repo", repo_id)] if repo_id else [])]
        seen = F.lit(False)
        for scope, who in scopes:
            seen |= (F.col("scope") == scope) & (owner() == who)
        return self.numbered({bucket_of(scope, who, n) for scope, who in scopes}).where(seen)

    def query(self, questions: DataFrame, user_id: str, now: float, top_k: int = 20, org_id: str = "", traces: DataFrame | None = None, vectors: DataFrame | None = None, repo_id: str = "") -> DataFrame:
        """Ranked facts for (query_id, text[, embedding, predicate_hint, subject_hint, negation, past]). Blank and null questions have
        no results. Reading changes nothing. ``traces`` and ``vectors`` as in ``retrieval.recall``."""
        asked = questions.where(F.length(F.trim(F.col("text").cast("string"))) > 0).withColumn("user_id", F.lit(user_id))
        if self.options.embed is not None and "past" not in asked.columns:
            asked = R.with_intents(asked, self.options.embed)
        seen = self.visible(user_id, org_id, repo_id).drop("user_id")
        return R.recall(asked, seen, now, top_k, G.edges_of(seen), traces, vectors)

    def query_one(self, questions: DataFrame, user_id: str, now: float, org_id: str = "", traces: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
        return R.certainty(self.query(questions, user_id, now, 5, org_id, traces, vectors), self.options.clarification)

    def edges(self) -> DataFrame:
        """The graph of all tenants' facts, by owner."""
        return self.table.extra("edges", EDGES)

    def profile(self, user_id: str, now: float, org_id: str = "") -> DataFrame:
        return profiles.profile(self.visible(user_id, org_id).where(profiles.profile_worthy()).where("source_type <> 'suspicious'"), now)

    def profile_compact(self, user_id: str, now: float, tokens: int = 300) -> DataFrame:
        return profiles.compact(self.visible(user_id).where("subject = user_id and source_type <> 'suspicious'"), now, tokens)

    def stats(self) -> DataFrame:
        return self.facts().groupBy("scope", "context").agg(F.count("*").alias("n"), F.count_if(F.col("state") == "active").alias("active"))

    # -- maintenance
    def save_edges(self) -> None:
        """Keep the graph of the version at hand as a table: (owner, src, dst), for reads that do not want to derive it again."""
        rows = self.facts().where("subject <> '' and object_value <> '' and state = 'active'").select(F.concat_ws(":", "scope", owner()).alias("owner"), F.lower("subject").alias("src"), F.lower("object_value").alias("dst")).distinct()
        self.table.manifest["extra"]["edges"] = []
        self._commit(self.spark.createDataFrame([], FACTS), set(), {"edges": rows})

    def compact(self) -> None:
        """Rewrite all buckets: small files of many writes become few."""
        self._commit(self.facts(), None)

    def vacuum(self, keep: int = 2) -> int:
        """Delete the data of all but the newest ``keep`` versions."""
        return self.table.vacuum(keep)

    def purge(self, scope: str, who: str) -> None:
        """Everything of one tenant, for good in the new version: only its bucket is rewritten."""
        only = {bucket_of(scope, who, self.table.manifest["n"])}
        self._commit(self.facts(only).where(~((F.col("scope") == scope) & (owner() == who))), only)

    def _own(self, user_id: str) -> set[int]:
        return {bucket_of("private", user_id, self.table.manifest["n"])}

    def access(self, ids: DataFrame, now: float) -> None:
        """Note that facts were used: (id[, at]) rows, each a use."""
        self._commit(B.accessed(self.facts(), ids, now))

    def forget(self, user_id: str, now: float, subject: str | None = None, predicate: str | None = None, ids: DataFrame | None = None, hard: bool = False) -> int:
        """A user's private facts, by ids (with their sentence's other facts) or by subject and predicate; soft (active ones), or for
        good in a new version (all states). Returns how many were hit."""
        rows = self.facts(self._own(user_id))
        own = rows.where((F.col("scope") == "private") & (F.col("user_id") == user_id))
        if ids is not None:
            hit = B.siblings(own, ids)
        else:
            hit = own.where((F.lit(subject is None) | (F.col("subject") == (subject or ""))) & (F.lit(predicate is None) | (F.col("predicate") == (predicate or "")))).where(F.lit(hard) | (F.col("state") == "active")).select("id")
        n = hit.count()
        self._commit(B.hard_delete(rows, hit) if hard else B.set_state(rows, hit, "deleted", now), self._own(user_id))
        return n

    def recover(self, ids: DataFrame, now: float) -> None:
        self._commit(B.set_state(self.facts(), ids, "active", now))

    def feedback(self, votes: DataFrame) -> None:
        self._commit(B.feedback(self.facts(), votes))

    def consolidate(self, now: float, replay: DataFrame | None = None) -> dict[str, int]:
        done = B.consolidate(self.facts(), now, replay, self.identity)
        before = done.agg(F.count_if((F.col("new_state") == "archived") & (F.col("state") == "active")).alias("archived"), F.count_if("decayed").alias("decayed"), F.count_if("replayed").alias("replayed")).first()
        self._commit(done.withColumn("state", F.col("new_state")))
        return before.asDict()

    def export_jsonl(self, path: str) -> None:
        files.export_jsonl(self.facts(), path)

    def import_jsonl(self, path: str) -> None:
        old = self.facts()
        new = files.import_jsonl(self.spark, path, old).withColumn("embedding", F.lit(None).cast("array<float>"))
        self._commit(old.unionByName(new, allowMissingColumns=True))


def _filled(rows: DataFrame) -> DataFrame:
    """An extractor's rows with all columns that a write asks for."""
    for name, kind, value in (("is_negation", "boolean", False), ("single_valued", "boolean", False), ("sentence", "string", None)):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(value).cast(kind))
    return rows.select("seq", "subject", "predicate", "object", F.col("confidence").cast("double").alias("confidence"), "is_negation", "single_valued", "sentence")


def llm_facts(utterances: DataFrame) -> DataFrame:
    """Rows to write of (seq, user_id, text, facts): the text as ``stated``, and each fact that has a predicate and an object."""
    kind = utterances.schema["facts"].dataType.elementType
    f = lambda name, default: F.coalesce(F.col(f"f.{name}"), F.lit(default)) if name in kind.names else F.lit(default)
    raw = utterances.select("seq", "user_id", F.col("user_id").alias("subject"), F.lit("stated").alias("predicate"), F.substring("text", 1, 500).alias("object_value"), F.lit(1.0).alias("confidence"), F.lit(False).alias("is_negation"), F.substring("text", 1, 500).alias("source_text"))
    each = utterances.select("seq", "user_id", F.substring("text", 1, 500).alias("source_text"), F.explode("facts").alias("f"))
    subject = F.trim(F.coalesce(F.nullif(f("subject", ""), F.lit("")), F.col("user_id")))
    made = each.where((F.trim(f("predicate", "")) != "") & (F.trim(f("object", "")) != "")).select(
        "seq", "user_id", F.when(F.lower(subject) == "user", F.col("user_id")).otherwise(subject).alias("subject"), T.norm_predicate(f("predicate", "")).alias("predicate"), F.substring(F.trim(f("object", "")), 1, 500).alias("object_value"),
        f("confidence", 0.9).cast("double").alias("confidence"), f("is_negation", False).alias("is_negation"), "source_text",
    )
    return raw.where("length(trim(source_text)) > 0").unionByName(made).withColumn("source_type", F.lit("user_stated"))


def believed_only(facts: DataFrame, now: float) -> DataFrame:
    return B.live(facts, now).where(N.posterior_of() > L.POSTERIOR_FLOOR)
