"""Shared plumbing of the training-data operators: tables in the shared folder, Arrow batches, row numbers."""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Bytes of text that one vectorised step works on; bounds a worker's memory whatever the batch holds.
STEP_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, one of our own on a single machine; an error on a cluster, whose
    executors do not see each other's local folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """Like ``materialize``, in ``n`` buckets by ``key``: a later join on it in ``n`` partitions does not move this side again.
    ``df`` should lie in ``n`` partitions by ``key`` already. The catalog entry goes at once; what was read from it stays."""
    spark = df.sparkSession
    label = f"{name}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{label}").bucketBy(n, key).format("parquet").saveAsTable(label)
    out = spark.table(label)
    out.schema  # noqa: B018
    spark.sql(f"DROP TABLE {label}")
    return out


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: nothing to do where the workers' path has it, else send a zip."""
    roots = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p} | {os.path.realpath(os.getcwd())}
    if os.path.realpath(ROOT) in roots or getattr(spark.sparkContext, "_factloom_shipped", False):
        return
    folder = os.path.join("/tmp", f"factloom-{uuid.uuid4().hex}")
    os.makedirs(folder)
    path = os.path.join(folder, "factloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(os.path.join(ROOT, "factloom")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, ROOT))
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._factloom_shipped = True


def tidy() -> None:
    """Give freed memory back at the end of a task: workers are reused, and what one task held must not add to the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str | None = "text", step: int = STEP_BYTES) -> DataFrame:
    """``mapInArrow`` over slices of at most ``step`` bytes of column ``text`` (one row at least)."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, step):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out
        tidy()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: str | None, step: int) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    if text is None:
        yield batch
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0), dtype=np.int64)
    at, ends = 0, np.cumsum(sizes)
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + step, "right")))
        yield batch.slice(at, to - at)
        at = to


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as (bytes, offsets); nulls count as empty."""
    kind = pa.large_binary() if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else pa.large_string()
    arr = pc.fill_null(arr.cast(kind), b"" if kind == pa.large_binary() else "")
    offsets = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8)
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def binaries(data: bytes | np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from concatenated bytes and offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(data)])


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A list column from concatenated values and offsets."""
    return pa.ListArray.from_arrays(pa.array(np.ascontiguousarray(offsets, np.int32)), pa.array(values))


def ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each first to its last, and which pair each is of."""
    sizes = last - first + 1
    of = np.repeat(np.arange(len(first)), sizes)
    return np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[of], of


def project(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed inner names, so that extra or clashing columns can do no harm."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keep_only(docs: DataFrame, ids: DataFrame, how: str, id_col: str = "doc_id") -> DataFrame:
    """Semi or anti join (``how``) of ``docs`` with the one column of ``ids``, whatever other columns ``docs`` has."""
    (key,) = fresh(docs, "_key")
    return docs.join(ids.toDF(key), F.col(id_col) == F.col(key), how)


def join_hot(rows: DataFrame, table: DataFrame, on: dict[str, str], weight: str, share: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row for each key and in ``weight`` how many rows have it.

    Keys of more than a ``share``-th of all rows, fewer than ``share`` of them, are broadcast; only the rows of the others are
    shuffled, of which no key has many. ``rows`` is read twice, so it should be a written table of few columns.
    """
    total = int(table.agg(F.sum(weight)).first()[0] or 0)
    meet = lambda: [F.col(a) == F.col(b) for a, b in on.items()]
    hot = table.where(F.col(weight) * share > total)
    few = rows.join(F.broadcast(hot), meet())
    rest = rows.join(F.broadcast(hot.select(*on.values())), meet(), "left_anti").join(table.where(F.col(weight) * share <= total), meet())
    return few.unionByName(rest)


def numbered(df: DataFrame, order: list[str], name: str = "row_number", slots: int | None = None) -> DataFrame:
    """Add a gapless global row number (from 0) in the order of the columns ``order``.

    A range exchange, a sort within partitions and per-partition offsets: no task sees all rows, and the driver gets
    one count a partition. The sorted rows are written once, so that counts and numbers come from the same layout.
    """
    spark = df.sparkSession
    n = slots or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c).asc_nulls_first() for c in order]
    laid = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    laid = materialize(laid.withColumn("_part", F.shiftright("_id", 33).cast("int")).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id"), "numbered")
    counts = sorted((r[0], r[1]) for r in laid.groupBy("_part").count().collect())
    offsets, total = {}, 0
    for part, count in counts:
        offsets[part] = total
        total += count
    table = spark.createDataFrame(list(offsets.items()) or [(0, 0)], "_part int, _base long")
    out = laid.join(F.broadcast(table), "_part").withColumn(name, F.col("_base") + F.col("_at"))
    return out.drop("_part", "_at", "_base")


def count_rows(df: DataFrame) -> int:
    return df.count()


def total_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts (one scan of one column)."""
    return int(df.select(F.sum(F.octet_length(text)).alias("n")).first()[0] or 0)
