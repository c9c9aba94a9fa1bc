"""Git as a source: commits and tracked files of a repository as DataFrames, and the facts they make."""

from __future__ import annotations

import hashlib
import os
import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMMITS = "sha string, author string, date double, message string, files array<string>, insertions int, deletions int"
RECORD, FIELD = "\x1e", "\x1f"


def repo_id(path: str) -> str:
    """The id of a repository on the driver, as ``functions.text.repo_id`` has it of the resolved path."""
    return hashlib.sha256(os.path.realpath(path).encode()).hexdigest()[:16]


def read_commits(spark: SparkSession, path: str, limit: int = 50) -> DataFrame:
    """The latest commits; a repository is read where the driver is, and ``limit`` bounds what it holds."""
    log = subprocess.run(["git", "-C", path, "log", f"-{limit}", f"--format={RECORD}%H{FIELD}%an{FIELD}%at{FIELD}%s", "--numstat"], capture_output=True, text=True, timeout=60)
    rows = []
    for block in log.stdout.split(RECORD)[1:] if log.returncode == 0 else ():
        head, *stats = block.strip("\n").split("\n")
        sha, author, at, message = (head.split(FIELD) + [""] * 4)[:4]
        parts = [s.split("\t") for s in stats if s.count("\t") == 2]
        count = lambda k: sum(int(p[k]) for p in parts if p[k].isdigit())  # noqa: B023, E731
        rows.append((sha, author, float(at) if at.isdigit() else 0.0, message, [p[2] for p in parts], count(0), count(1)))
    return spark.createDataFrame(rows, COMMITS)


def read_tree(spark: SparkSession, path: str, limit: int = 500) -> DataFrame:
    out = subprocess.run(["git", "-C", path, "ls-files"], capture_output=True, text=True, timeout=60)
    return spark.createDataFrame([(p,) for p in out.stdout.split("\n")[:limit] if p], "path string")


def commits_to_facts(commits: DataFrame) -> DataFrame:
    """One ``committed`` fact of the author a commit and one ``changed_by`` of each of its first ten files."""
    text = F.concat(F.lit("sha:"), F.col("sha"), F.lit(" files:"), F.array_join(F.slice("files", 1, 5), ","), F.lit(" +"), F.col("insertions").cast("string"), F.lit("-"), F.col("deletions").cast("string"))
    head = [F.lit(0.95).alias("confidence"), F.col("date").alias("created_at")]
    said = commits.select("sha", F.col("author").alias("subject"), F.lit("committed").alias("predicate"), F.substring("message", 1, 200).alias("object_value"), text.alias("source_text"), *head)
    files = commits.select("sha", "author", "date", "message", F.explode(F.slice("files", 1, 10)).alias("f"))
    changed = files.select("sha", F.col("f").alias("subject"), F.lit("changed_by").alias("predicate"), F.col("author").alias("object_value"), F.substring("message", 1, 200).alias("source_text"), *head)
    return said.unionByName(changed)


def tree_to_facts(paths: DataFrame) -> DataFrame:
    """The repository's top directories and its languages by extension, with their numbers of files."""
    counts = tree_counts(paths)
    folder = F.col("kind") == "directory"
    name = F.when(folder, F.concat("name", F.lit("/"))).otherwise(F.concat(F.lit("."), F.col("name")))
    value = F.concat(name, F.lit(" ("), F.col("n").cast("string"), F.lit(" files)"))
    return counts.select(F.lit("repo").alias("subject"), F.when(folder, "has_directory").otherwise("uses_language").alias("predicate"), value.alias("object_value"), F.lit(0.99).alias("confidence"))


def tree_counts(paths: DataFrame, directories: int = 20, extensions: int = 10) -> DataFrame:
    """(kind, name, n): files by top directory and by extension, the most frequent of each."""
    top = paths.where("path LIKE '%/%'").select(F.lit("directory").alias("kind"), F.split("path", "/")[0].alias("name"))
    ext = paths.where(r"path RLIKE '\\.[^./]+$'").select(F.lit("extension").alias("kind"), F.regexp_extract("path", r"\.([^./]+)$", 1).alias("name"))
    counts = top.unionByName(ext).groupBy("kind", "name").agg(F.count("*").alias("n"))
    order = Window.partitionBy("kind").orderBy(F.col("n").desc(), "name")
    return counts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= F.when(F.col("kind") == "directory", directories).otherwise(extensions)).drop("_r")
