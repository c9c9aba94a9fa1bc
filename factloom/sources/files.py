"""JSON-lines export and import of facts, conversation files, and versioned snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FACTS

EXPORTED = [c.split(" ")[0] for c in FACTS.split(", ") if not c.startswith("embedding")]


def export_jsonl(facts: DataFrame, path: str) -> None:
    """All rows of any state in the order of creation, without embeddings; text is written as UTF-8."""
    have = [c for c in EXPORTED if c in facts.columns]
    facts.select(*have).orderBy("created_at", "id").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def import_jsonl(spark: SparkSession, path: str, existing: DataFrame | None = None) -> DataFrame:
    """Rows of the file, bad lines left out, defaults filled in, ids that exist already left out."""
    schema = ", ".join(c for c in FACTS.split(", ") if not c.startswith("embedding"))
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("id is not null")
    defaults = {"scope": "private", "context": "personal", "user_id": "", "org_id": "", "repo_id": "", "subject": "", "predicate": "stated", "object_value": "", "source_text": "", "is_negation": False, "source_type": "imported", "confidence": 0.7, "evidence_count": 1, "contradiction_count": 0, "access_count": 0, "state": "active", "metadata": "{}"}
    rows = rows.fillna(defaults)
    if existing is not None:
        rows = rows.join(existing.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_anti")
    return rows


def metadata(column: str = "metadata") -> F.Column:
    """Metadata as a map; what is no JSON object counts as empty."""
    return F.coalesce(F.from_json(column, "map<string,string>"), F.create_map().cast("map<string,string>"))


def conversations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A long-conversation benchmark file: (session, turn, speaker, text) and (question, answer, category)."""
    raw = spark.read.option("multiLine", "true").json(path)
    talk = raw.select(F.from_json(F.to_json("conversation"), "map<string,string>").alias("c")).select(F.explode("c").alias("session", "body")).where("session RLIKE '^session_[0-9]+$'")
    turns = talk.select("session", F.posexplode(F.from_json("body", "array<struct<speaker:string,text:string>>")).alias("turn", "t")).select("session", "turn", "t.speaker", "t.text")
    return turns, raw.select(F.explode("qa").alias("q")).select("q.question", F.col("q.answer").cast("string").alias("answer"), F.col("q.category").cast("string").alias("category"))


def write_snapshot(facts: DataFrame, root: str, version: int) -> str:
    """A version of the facts, partitioned by tenant so that a tenant's reads and purges touch its own files only.

    The path being read is never overwritten: versions are new folders.
    """
    path = f"{root}/facts/v={version}"
    facts.withColumn("owner_key", F.coalesce(F.nullif("user_id", F.lit("")), F.nullif("org_id", F.lit("")), "repo_id")).repartition("scope", "owner_key").sortWithinPartitions("subject", "predicate").write.partitionBy("scope", "owner_key").parquet(path)
    return path


def read_tenant(spark: SparkSession, path: str, scope: str, owner: str) -> DataFrame:
    return spark.read.parquet(path).where((F.col("scope") == scope) & (F.col("owner_key") == owner))
