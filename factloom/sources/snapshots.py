"""A versioned fact table in a shared folder: buckets of tenants as Parquet, a manifest a version, committed by one atomic create.

A commit writes the buckets it touches to a new folder and then the manifest, which names for every bucket the folder that
holds it. Nothing is overwritten: readers keep what they opened, and of two writers of one version the second fails.
"""

from __future__ import annotations

import json
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets that tenants are dealt to.
BUCKETS = 64


class ConflictError(RuntimeError):
    """Another writer committed the version first. Open the table again and repeat the write."""


def owner() -> Column:
    """Whom a fact belongs to: the user of a private one, the organisation of a shared one, the repository's."""
    return F.when(F.col("scope") == "private", F.col("user_id")).when(F.col("scope") == "shared", F.col("org_id")).otherwise(F.col("repo_id"))


def bucket_of(scope: str, who: str, n: int = BUCKETS) -> int:
    return zlib.crc32(f"{scope}:{who}".encode()) % n


def bucket(n: int = BUCKETS) -> Column:
    return (F.crc32(F.concat_ws(":", "scope", owner()).cast("binary")) % n).cast("int")


class Snapshots:
    def __init__(self, spark: SparkSession, root: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.manifest = self._newest() or {"version": 0, "buckets": {}, "n": buckets, "meta": {}, "extra": {}}

    @property
    def version(self) -> int:
        return self.manifest["version"]

    def _path(self, *parts: str):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, *parts: str) -> list[str]:
        fs, path = self._path(*parts)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _newest(self) -> dict | None:
        names = sorted(n for n in self._names("log") if n.endswith(".json"))
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.root}/log/{names[-1]}").collect())) if names else None

    def refresh(self) -> None:
        """Take up what other writers have committed since."""
        self.manifest = self._newest() or self.manifest

    def read(self, only: set[int] | None = None) -> DataFrame:
        """Facts of the version at hand, of some buckets or of all."""
        paths = [f"{folder}/bucket={b}" for b, folder in sorted(self.manifest["buckets"].items()) if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def extra(self, name: str, schema: str) -> DataFrame:
        """An append-only table that is committed along with the facts."""
        paths = self.manifest["extra"].get(name, [])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def touched(self, rows: DataFrame) -> set[int]:
        """Buckets of the rows: at most as many numbers as there are buckets."""
        return {r[0] for r in rows.select(bucket(self.manifest["n"]).alias("b")).distinct().collect()}

    def commit(self, rows: DataFrame, touched: set[int] | None, meta: dict | None = None, extra: dict[str, DataFrame] | None = None) -> None:
        """The next version: buckets ``touched`` (None: all) hold ``rows``, the others what they held."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        columns = [c.split(" ")[0] for c in self.schema.split(", ")]
        laid = rows.select(*columns, bucket(self.manifest["n"]).alias("bucket"))
        # A tenant with a large share of all facts is written by several tasks.
        laid.repartition(F.col("bucket"), F.pmod(F.xxhash64("subject", "object_value"), F.lit(8))).sortWithinPartitions("bucket", "subject", "predicate").write.partitionBy("bucket").parquet(folder)
        kept = {b: f for b, f in self.manifest["buckets"].items() if touched is not None and int(b) not in touched}
        written = {n.removeprefix("bucket="): folder for n in self._names(*folder.removeprefix(self.root + "/").split("/")) if n.startswith("bucket=")}
        tables = dict(self.manifest["extra"])
        for name, df in (extra or {}).items():
            path = f"{self.root}/{name}/{uuid.uuid4().hex}"
            df.write.parquet(path)
            tables[name] = [*tables.get(name, []), path]
        self._publish({"version": self.version + 1, "buckets": kept | written, "n": self.manifest["n"], "meta": self.manifest["meta"] | (meta or {}), "extra": tables})

    def _publish(self, manifest: dict) -> None:
        fs, path = self._path("log", f"{manifest['version']:012d}.json")
        if fs.exists(path):
            raise ConflictError(f"version {manifest['version']} of {self.root} was committed by another writer")
        try:
            out = fs.create(path, False)
        except Exception as e:  # noqa: BLE001
            raise ConflictError(f"version {manifest['version']} of {self.root} could not be created") from e
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        self.manifest = manifest

    def delete(self, path: str) -> None:
        """A folder under the root that no manifest names."""
        fs, where = self._path(path.removeprefix(self.root + "/"))
        fs.delete(where, True)

    def vacuum(self, keep: int = 2) -> int:
        """Delete data folders that none of the newest ``keep`` versions names, and older manifests. Returns the folders deleted.
        Not to be run while another writer is between its data and its manifest."""
        logs = sorted(n for n in self._names("log") if n.endswith(".json"))
        live: set[str] = set()
        for n in logs[-keep:]:
            live |= set(json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.root}/log/{n}").collect()))["buckets"].values())
        gone = [n for n in self._names("data") if f"{self.root}/data/{n}" not in live]
        for parts in [("log", n) for n in logs[:-keep]] + [("data", n) for n in gone]:
            fs, path = self._path(*parts)
            fs.delete(path, True)
        return len(gone)
