"""Operator 5, sharding: a Feistel permutation with cycle walking over global row numbers.

Row r of N (in the order of doc_id, then content) goes to place p(r), a bijection of 0..N-1 given by a seed; its shard is
p mod S and its slot p div S. Shard and slot of any row can be computed, and p inverted, without a table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, fresh, map_arrow, numbered, project
from .hashing import mix, seeds


class Feistel:
    """An unbalanced-modulus Feistel network on a*b >= n points, walked along its cycles until the point is below n.

    a = ceil(sqrt(n)) and b = ceil(n/a), so fewer than a of the a*b points lie outside and few points walk at all.
    """

    def __init__(self, n: int, seed: int = 42, rounds: int = 6):
        if n < 0:
            raise ValueError("n must not be negative")
        self.n, self.rounds = n, rounds
        self.a = max(1, math.isqrt(max(n - 1, 0)) + 1)
        self.b = max(1, -(-n // self.a))
        self.keys = seeds(rounds, seed)

    def _round(self, half: np.ndarray, key: np.uint64, modulus: int) -> np.ndarray:
        return (mix(half.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + key) % np.uint64(modulus)).astype(np.int64)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x // self.b, x % self.b
        for i in reversed(range(self.rounds)) if back else range(self.rounds):
            sign = -1 if back else 1
            if i % 2:
                left = (left + sign * self._round(right, self.keys[i], self.a)) % self.a
            else:
                right = (right + sign * self._round(left, self.keys[i], self.b)) % self.b
        return left * self.b + right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = np.asarray(x, np.int64)
        if len(x) and (x.min() < 0 or x.max() >= self.n):
            raise ValueError("a row number is out of range")
        out = self._once(x, back)
        while (far := np.flatnonzero(out >= self.n)).size:
            out[far] = self._once(out[far], back)
        return out

    def place(self, rows: np.ndarray) -> np.ndarray:
        return self._walk(rows, False)

    def row(self, places: np.ndarray) -> np.ndarray:
        return self._walk(places, True)


def locate(row: int, n_rows: int, n_shards: int, seed: int = 42) -> tuple[int, int]:
    """(shard, slot) of a row number, without any table."""
    p = int(Feistel(n_rows, seed).place(np.array([row]))[0])
    return p % n_shards, p // n_shards


def row_at(shard: int, slot: int, n_rows: int, n_shards: int, seed: int = 42) -> int:
    """The row number that lies in a slot of a shard."""
    return int(Feistel(n_rows, seed).row(np.array([slot * n_shards + shard]))[0])


def shard_rows(docs: DataFrame, n_shards: int, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, row_number, shard, slot.

    Null text: size 16 and the checksum of no bytes (0). Null ids come first in the row order; equal ids are ordered by
    size and checksum, and rows equal in all three are interchangeable. Empty table: no rows. Only ids, sizes and
    checksums are shuffled, never texts; other columns are ignored.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    rows = project(docs, doc_id=id_col, text=text_col).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    ordered = numbered(rows, ["doc_id", "size", "text_crc32"])
    feistel = Feistel(ordered.count(), seed)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = feistel.place(np.asarray(column(batch, "row_number")))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array((p % n_shards).astype(np.int32)), pa.array(p // n_shards)], [*batch.schema.names, "shard", "slot"])

    kind = dict(rows.dtypes)["doc_id"]
    return map_arrow(ordered, place, f"doc_id {kind}, size long, text_crc32 long, row_number long, shard int, slot long", text=None)


def write_shards(docs: DataFrame, path: str, n_shards: int, seed: int = 42, id_col: str = "doc_id") -> None:
    """Write whole rows as Parquet, ``shard=k`` folders in slot order. ``docs`` must have unique, non-null ids.

    A shard is written by several tasks, each with a range of slots, so one shard may exceed a task's memory.
    """
    key, shard, slot = fresh(docs, "_key", "shard", "slot")
    spread = shard_rows(docs, n_shards, seed, id_col).select(F.col("doc_id").alias(key), F.col("shard").alias(shard), F.col("slot").alias(slot))
    rows = docs.join(spread, F.col(id_col) == F.col(key)).drop(key)
    n = max(n_shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows.repartitionByRange(n, shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: counts of the 40 shards differ by one at most."""
    out = shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
