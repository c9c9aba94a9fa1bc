"""Operator 2, exact dedup: an extendible-hash index in shared files.

The directory maps hash prefixes to buckets. It starts with one bucket; an overfull bucket splits on its next hash bit and
the directory doubles when a bucket's depth passes its own. A bucket is a range of hash keys with one owner task, which
walks its entries in key order, chains entries of equal hash and tells them apart by comparing bytes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP_BYTES, column, fresh, join_hot, materialize, project, shared_dir, ship, slices, tidy

#: Bytes of distinct text a bucket may hold before it splits, as long as that makes no more than MOST_BUCKETS of them; beyond,
#: buckets hold as much more. (Owners stream their buckets, so a larger one needs no more memory.)
BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 1 << 16
#: Bytes of a combined batch; of texts seen before that a map task holds back to send once.
BATCH_BYTES, HELD_BYTES = 4 << 20, 8 << 20


#: Stands for a null doc_id: it beats no other.
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Directory:
    """Extendible-hash directory: slot (top ``depth`` hash bits) -> bucket, numbered in key order."""

    depth: int
    slots: tuple[int, ...]
    local: tuple[int, ...]  # depth of each bucket

    def write(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps({"depth": self.depth, "slots": self.slots, "local": self.local}),)], "directory string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> Directory:
        x = json.loads(spark.read.text(path).first()[0])
        return Directory(x["depth"], tuple(x["slots"]), tuple(x["local"]))


def grow(sizes: np.ndarray, capacity: int, old: Directory | None = None) -> Directory:
    """Split overfull buckets, doubling the directory as needed. sizes: by hash prefix, 2^max_depth of them.

    Starts from the buckets of ``old`` where there is one: buckets split, they never merge. A bucket of the greatest depth
    that is still overfull stays: its entries are chained (equal hashes cannot split).
    """
    deepest = int(len(sizes)).bit_length() - 1
    sums = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    weight = lambda prefix, depth: int(sums[(prefix + 1) << (deepest - depth)] - sums[prefix << (deepest - depth)])
    depth, done, todo = 0, [], [(0, 0)]
    if old is not None:
        first = {bucket: slot for slot, bucket in reversed(list(enumerate(old.slots)))}
        depth, todo = old.depth, [(first[k] >> (old.depth - local), local) for k, local in reversed(list(enumerate(old.local)))]
    while todo:
        prefix, local = todo.pop()
        if local < deepest and weight(prefix, local) > capacity:
            depth = max(depth, local + 1)  # the directory doubles
            todo += [(2 * prefix + 1, local + 1), (2 * prefix, local + 1)]
        else:
            done.append((prefix, local))
    slots = []
    for bucket, (_, local) in enumerate(done):
        slots += [bucket] * (1 << (depth - local))
    return Directory(depth, tuple(slots), tuple(local for _, local in done))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = project(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.select("doc_id", "text", F.xxhash64("text").alias("h"))


def build_directory(keyed: DataFrame, capacity: int = BUCKET_BYTES, old: Directory | None = None) -> Directory:
    """Size the directory from the distinct hashes: one aggregate by hash, one by prefix, at most 2^depth sums to the driver.

    The prefix length follows the number of buckets (16 prefixes a bucket), so the sums grow with buckets, not rows.
    """
    total = int(keyed.select(F.sum(F.octet_length("text"))).first()[0] or 0)
    capacity = max(capacity, total // MOST_BUCKETS)
    bits = int(max(4, np.ceil(np.log2(max(1, total / capacity))) + 4, old.depth if old else 0))
    distinct = keyed.groupBy("h").agg(F.max(F.octet_length("text")).alias("n"))
    sums = distinct.groupBy(F.shiftrightunsigned("h", 64 - bits).alias("p")).agg(F.sum("n").alias("n")).collect()
    sizes = np.zeros(1 << bits, np.int64)
    for p, n in sums:
        sizes[p] = n
    return grow(sizes, capacity, old)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, doc_id, copies, text): the copies in a batch as one entry, with the largest doc_id. A text that comes again is held
    back to the end of the task, so that one a third of all rows share costs its owner an entry a task."""
    held: dict[int, dict[str, list]] = {}  # hash: text: [doc_id, copies]
    size = 0
    for whole in batches:
        for batch in slices(whole, "text", BATCH_BYTES):
            codes = column(batch, "text").dictionary_encode()
            code = np.asarray(codes.indices)
            copies = np.bincount(code, column(batch, "copies"), len(codes.dictionary)).astype(np.int64)
            best = np.full(len(copies), NO_ID, np.int64)
            np.maximum.at(best, code, np.asarray(pc.fill_null(column(batch, "doc_id"), NO_ID)))
            first = np.zeros(len(best), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            h = np.asarray(column(batch, "h"))[first]
            out = np.ones(len(best), bool)
            for k in np.flatnonzero((copies > 1) | np.isin(h, list(held))).tolist():
                text, there = codes.dictionary[k].as_py(), held.get(int(h[k]), {})
                if text in there:
                    x = there[text]
                    x[0], x[1] = max(x[0], int(best[k])), x[1] + int(copies[k])
                elif copies[k] > 1 and size + len(text) <= HELD_BYTES:
                    held.setdefault(int(h[k]), {})[text] = [int(best[k]), int(copies[k])]
                    size += len(text)
                else:
                    continue
                out[k] = False
            at = pa.array(np.flatnonzero(out))
            yield pa.RecordBatch.from_arrays([pa.array(h).take(at), pa.array(best).take(at), pa.array(copies).take(at), codes.dictionary.take(at)], ["h", "doc_id", "copies", "text"])
    if held:
        cols = list(zip(*[(h, *x, text) for h, texts in held.items() for text, x in texts.items()], strict=True))
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], ["h", "doc_id", "copies", "text"])
        held.clear()
    tidy()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_BYTES) -> tuple[DataFrame, str]:
    """Write the index (``directory`` and ``buckets``) to the shared folder.

    Returns the bucket table (bucket, h, chain, doc_id, copies, digest, text: one row per distinct text, doc_id the largest)
    and the path, by which ``insert`` adds a batch.
    """
    keyed = _keyed(docs, id_col, text_col)
    return _write(docs.sparkSession, keyed.withColumn("copies", F.lit(1).cast("long")), build_directory(keyed, capacity))


def insert(path: str, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_BYTES) -> tuple[DataFrame, str]:
    """Add a batch of documents to the index at ``path``: what ``build_index`` returns, of a new version beside the old one.

    Its directory grows from the old one's: only buckets that the batch makes overfull split. Owners meet the old entries of
    their buckets again with the new ones.
    """
    spark = docs.sparkSession
    old = Directory.read(spark, f"{path}/directory")
    known = spark.read.parquet(f"{path}/buckets").select("doc_id", "text", "h", "copies")
    both = known.unionByName(_keyed(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "h", F.lit(1).cast("long").alias("copies")))
    return _write(spark, both, build_directory(both, capacity, old))


def _write(spark: SparkSession, entries: DataFrame, directory: Directory) -> tuple[DataFrame, str]:
    ship(spark)
    path = f"{shared_dir(spark)}/extendible-{uuid.uuid4().hex}"
    directory.write(spark, f"{path}/directory")
    slots, shift = np.array(directory.slots, np.int32), 64 - directory.depth

    def address(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _combine(batches):
            h = np.asarray(column(batch, "h"))
            bucket = slots[(h.view(np.uint64) >> np.uint64(shift)).astype(np.int64)] if directory.depth else np.zeros(len(h), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *batch.columns], ["bucket", *batch.schema.names])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: list[list] = []  # of the current hash: [bucket, h, doc_id, copies, text]
        out: list[tuple] = []
        size = 0
        for batch in (part for whole in batches for part in slices(whole, "text", STEP_BYTES)):
            for entry in zip(*(column(batch, n).to_pylist() for n in ("bucket", "h", "doc_id", "copies", "text")), strict=True):
                if chain and chain[0][1] != entry[1]:
                    out += [(*x, k) for k, x in enumerate(chain)]
                    chain = []
                for x in chain:
                    if x[4] == entry[4]:  # equal bytes
                        x[2], x[3] = max(x[2], entry[2]), x[3] + entry[3]
                        break
                else:
                    chain.append(list(entry))
                    size += len(entry[4])
            if size > 1 << 20:
                yield rows(out)
                out, size = [], 0
        out += [(*x, k) for k, x in enumerate(chain)]
        yield rows(out)
        del out, chain
        tidy()

    def rows(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["bucket", "h", "doc_id", "copies", "text", "chain"])

    addressed = entries.select("doc_id", "text", "h", "copies").mapInArrow(address, "bucket int, h long, doc_id long, copies long, text string")
    # Signed order of h within a bucket is as good as any: all that is needed is that equal hashes stand together.
    n = max(len(directory.local), 1)
    owned = addressed.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "h").mapInArrow(own, "bucket int, h long, doc_id long, copies long, text string, chain int")
    owned.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).write.parquet(f"{path}/buckets")
    return spark.read.parquet(f"{path}/buckets"), path


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Null text counts as empty; texts are equal when their bytes are. Of equal texts the largest doc_id stays; rows that
    repeat that doc_id too are all marked kept (they cannot be told apart). A null doc_id never beats another; if all ids
    of a group are null, keep_id is null and kept false. Empty table: no rows. Other columns are ignored.
    """
    index, _ = build_index(docs, id_col, text_col, capacity)
    found = index.select(F.col("h").alias("_h"), F.col("digest").alias("_d"), F.nullif(F.col("doc_id"), F.lit(NO_ID)).alias("keep_id"), F.col("copies").alias("group_size"), "bucket", "chain")
    rows = materialize(_keyed(docs, id_col, text_col).select("doc_id", "h", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")), "digests")
    out = join_hot(rows, found, {"h": "_h", "text_sha256": "_d"}, "group_size")
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256", "bucket", "chain")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty) the document with the largest doc_id stays. Where a doc_id stands on several texts
    each is judged by itself; rows that repeat both doc_id and text cannot be told apart and stay or go together. A row with a
    null doc_id goes if a row with an id has its text; of rows with null ids only, one of each text stays. Empty table: no
    rows. All columns stay, whatever their names."""
    rows = exact_dedup(docs)
    doc, digest, own = fresh(docs, "_doc", "_digest", "_own")
    gone = rows.where("not kept and keep_id is not null").select("doc_id", "text_sha256").distinct().toDF(doc, digest)
    mine = docs.withColumn(own, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    left = mine.join(gone, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(digest)), "left_anti")
    return left.where("doc_id is not null").unionByName(left.where("doc_id is null").dropDuplicates([own])).drop(own)
