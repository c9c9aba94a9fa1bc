"""Operator 9, best-fit packing: pattern packing by non-negative least squares.

Pieces shorter than a sequence are counted by length. Patterns of up to three lengths that fill a sequence exactly are
enumerated; repeat counts that reproduce the histogram are fitted by non-negative least squares and rounded down; the
residual pieces are packed best fit first, on the histogram too. The plan has a row for each pattern and length: its size
depends on the sequence length alone. Pieces find their place by their rank among pieces of equal length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, map_arrow, materialize, numbered, project

#: Tokens of a sequence, steps of the least-squares fit, whitespace-separated parts a worker remembers the ids of.
LENGTH, STEPS, REMEMBERED = 1024, 300, 150_000
END_ID = 2


class Encoder:
    """Ids of a text as packed little-endian 32-bit numbers, equal to the tokenizer file's own.

    Byte-level BPE splits a text before each single space that a non-space follows, whatever stands around it. So a text of
    Latin letters with no other spaces is taken part by part, and ids of parts are remembered; a new part is merged by the
    same ranks. Other texts, and files whose merges do not follow their ids, are encoded whole.
    """

    ODD = re.compile(r"[^\n -~\xa1-\xac\xae-\u024f]")
    SPACES = ("  ", " \n", "\n ", "\n\n")

    def __init__(self, path: str):
        self.path, self.whole = path, None
        self.known: dict[str, bytes] = {}
        self.merge = self._ranks(path)

    def _ranks(self, path: str):  # noqa: ANN202
        """The encoding of one part, or None where the file is of another kind."""
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            x = json.load(f)
        self.specials = [t["content"] for t in x.get("added_tokens", [])]
        vocab, kind = x["model"].get("vocab"), x.get("pre_tokenizer") or {}
        plain = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not x.get("normalizer")
        merges = [m if isinstance(m, str) else " ".join(m) for m in x["model"].get("merges", [])]
        if not plain or any(vocab.get(m.replace(" ", "", 1)) != 256 + k for k, m in enumerate(merges)):
            return None
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t["content"] for t in x.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        if self.whole is None:  # only where a text asks for it
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side as it is
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _part(self, part: str) -> bytes:
        ids = self.known[part] = np.array(self.merge(part), "<u4").tobytes()
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        known, out, odd = self.known, [], []
        for k, text in enumerate(texts):
            if not text or self.merge is None or text[-1] in " \n" or any(s in text for s in self.SPACES) or self.ODD.search(text) or any(s in text for s in self.specials):
                odd.append(k)
                out.append(b"")
                continue
            first, *rest = text.split(" ")
            parts = [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]
            try:
                out.append(b"".join([known[x] for x in parts]))
            except KeyError:
                out.append(b"".join([known.get(x) or self._part(x) for x in parts]))
            if len(known) > REMEMBERED:
                known.clear()
        for k, ids in zip(odd, self._encode([texts[k] for k in odd]), strict=True):
            out[k] = ids
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


@dataclass
class Plan:
    """Slots of each length, in the order of rank. Row k: pieces of ``size[k]`` with ranks from ``first[k]`` on fill, one a
    sequence, ``repeat[k]`` sequences from ``base[k]`` on, at ``offset[k]``."""

    size: np.ndarray
    first: np.ndarray
    repeat: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, sizes: np.ndarray, ranks: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces given by length and rank."""
        start = np.searchsorted(self.size, np.arange(length + 2))
        total = int(self.first.max() + self.repeat.max() + 1) if len(self.first) else 1
        row = np.searchsorted(self.size.astype(np.float64) * total + self.first, sizes.astype(np.float64) * total + ranks, "right") - 1 if total * (length + 1) < 1 << 52 else np.array([start[s] + np.searchsorted(self.first[start[s] : start[s + 1]], r, "right") - 1 for s, r in zip(sizes.tolist(), ranks.tolist(), strict=True)], np.int64)
        return self.base[row] + ranks - self.first[row], self.offset[row]


def patterns(length: int) -> np.ndarray:
    """All multisets of one to three lengths that add up to ``length``, as rows of three (0: none), longest first."""
    one = [(length, 0, 0)]
    two = [(a, length - a, 0) for a in range((length + 1) // 2, length)]
    three = [(a, b, length - a - b) for a in range(-(-length // 3), length - 1) for b in range(-(-(length - a) // 2), min(a, length - a - 1) + 1)]
    return np.array(one + two + three, np.int64)


def fit(histogram: np.ndarray, length: int, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeat counts x of the patterns that least miss the histogram: accelerated projected gradient.

    Longer pieces weigh more, as they are harder to place later.
    """
    p = patterns(length)
    weight = np.arange(length + 1) / length
    weight[0] = 0
    target = histogram * weight
    scale = max(1.0, float(np.abs(target).max()))
    used = (p > 0).all(1) & (histogram[p] > 0).all(1) | (p[:, 2] == 0) & (histogram[p[:, 0]] > 0) & ((p[:, 1] == 0) | (histogram[p[:, 1]] > 0))
    index, p = np.flatnonzero(used), p[used]
    out = np.zeros(len(used))
    if not len(p):
        return out

    def forward(x: np.ndarray) -> np.ndarray:
        y = np.zeros(length + 1)
        for k in range(3):
            y += np.bincount(p[:, k], x, length + 1)
        return y * weight

    def back(r: np.ndarray) -> np.ndarray:
        r = r * weight
        return r[p[:, 0]] + r[p[:, 1]] + r[p[:, 2]]

    v = np.ones(len(p))
    for _ in range(12):  # the largest eigenvalue, for the step
        v = back(forward(v))
        top = float(np.linalg.norm(v))
        v /= top
    rate = 1 / (1.02 * top)
    goal = target / scale
    x = np.zeros(len(p))
    z, t = x, 1.0
    for _ in range(steps):
        new = np.maximum(0, z - rate * back(forward(z) - goal))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if ((z - new) @ (new - x)) > 0:  # restart when the momentum points uphill
            after = 1.0
            z = new
        else:
            z = new + (t - 1) / after * (new - x)
        x, t = new, after
    out[index] = x * scale
    return out


def make_plan(histogram: np.ndarray, length: int) -> Plan:
    """histogram[s]: pieces of s tokens, s from 1 to ``length``."""
    left = histogram.astype(np.int64).copy()
    bins: list[tuple[list[int], int]] = []  # (lengths, repeats)
    if left[length]:
        bins.append(([length], int(left[length])))
        left[length] = 0
    p, x = patterns(length), fit(left, length)
    # Rounding carries fractions on from pattern to pattern, in the order of the longest lengths, so that sums stay right.
    order = np.lexsort((p[:, 1], -p[:, 0]))
    carried = np.floor(np.cumsum(x[order]) + 0.5).astype(np.int64)
    counts = np.diff(np.concatenate([[0], carried]))
    for k, c in zip(order[counts > 0].tolist(), counts[counts > 0].tolist(), strict=True):
        parts = [int(s) for s in p[k] if s]
        need = {s: parts.count(s) for s in parts}
        times = min(c, *[int(left[s]) // n for s, n in need.items()])
        if times > 0:
            bins.append((parts, times))
            for s, n in need.items():
                left[s] -= n * times
    bins += residual(left, length)
    rows, sequence = [], 0
    rank = np.zeros(length + 1, np.int64)
    for parts, times in bins:
        at = 0
        for s in parts:
            rows.append((s, rank[s], times, sequence, at))
            rank[s] += times
            at += s
        sequence += times
    table = np.array(sorted(rows) or np.zeros((0, 5)), np.int64).reshape(-1, 5)
    return Plan(*table.T.copy(), sequence)


def residual(left: np.ndarray, length: int) -> list[tuple[list[int], int]]:
    """Best fit decreasing, on counts: a piece goes to the open sequence with the least room that holds it. Sequences with
    equal contents are one group, so the work follows the number of lengths and groups, not of pieces."""
    rooms: dict[int, list[tuple[list[int], int]]] = {}  # room -> groups (lengths, sequences)
    open_rooms = np.zeros(length + 1, np.int64)  # groups by room
    for s in range(length, 0, -1):
        n = int(left[s])
        while n:
            fits = np.flatnonzero(open_rooms[s:])
            if len(fits):
                room = s + int(fits[0])
                parts, count = rooms[room].pop()
                open_rooms[room] -= 1
            else:
                room, parts, count = length, [], n
            each = min(room // s, n)
            take = min(count, n // each)
            if take < count and parts:
                rooms.setdefault(room, []).append((parts, count - take))
                open_rooms[room] += 1
            rooms.setdefault(room - each * s, []).append(([*parts, *[s] * each], take))
            open_rooms[room - each * s] += 1
            n -= each * take
    return [g for groups in rooms.values() for g in groups]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids (packed little-endian 32-bit)."""
    rows = project(docs, doc_id=id_col, text=text_col)
    kind = dict(rows.dtypes)["doc_id"]
    tail = np.array([end_id], "<u4").tobytes() if end_id is not None else b""

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in column(batch, "text").to_pylist()]
        row, number, start, size, crc, ids = [], [], [], [], [], []
        for k, raw in enumerate(encoder(tokenizer).encode(texts)):
            raw += tail
            n = len(raw) // 4
            at = 0
            for i in range(-(-n // length)):
                to = at + (n - 1) % length + 1 if i == 0 else at + length
                part = raw[4 * at : 4 * to]
                row.append(k)
                number.append(i)
                start.append(at)
                size.append(to - at)
                crc.append(zlib.crc32(part))
                ids.append(part)
                at = to
        return pa.RecordBatch.from_arrays([column(batch, "doc_id").take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return map_arrow(rows, encode, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary", step=1 << 20)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and ``end_id``; one longer than ``length`` is cut into pieces of ``length``, of which the
    first may be shorter. Null and empty texts are ``end_id`` alone (no row where there is none). Rows with null or
    repeated ids are packed like others. Empty table: no rows. Other columns are ignored. ``pieces`` has the ids themselves.
    """
    cut = materialize(pieces(docs, tokenizer, length, end_id, id_col, text_col).drop("ids"), "pieces")
    histogram = np.zeros(length + 1, np.int64)
    for size, n in cut.groupBy("length").count().collect():  # at most ``length`` rows
        histogram[size] = n
    plan = make_plan(histogram, length)
    before = np.concatenate([[0], np.cumsum(histogram)[:-1]])
    ranked = numbered(cut, ["length", "doc_id", "piece", "ids_crc32"])
    held = docs.sparkSession.sparkContext.broadcast((plan, before))  # bounded by the number of patterns
    kind = dict(cut.dtypes)["doc_id"]

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        plan, before = held.value
        size = np.asarray(column(batch, "length"))
        sequence, offset = plan.place(size, np.asarray(column(batch, "row_number")) - before[size], length)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.RecordBatch.from_arrays([*[column(batch, n) for n in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return map_arrow(ranked, place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", text=None)


def sequences(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int | None = END_ID) -> DataFrame:
    """(sequence_id, ids): the packed token sequences, for documents with unique ids. A sequence has ``length`` ids at most."""
    where = pack(docs, tokenizer, length, end_id).select(F.col("doc_id").alias("_d"), F.col("piece").alias("_p"), "sequence_id", "offset")
    whole = pieces(docs, tokenizer, length, end_id).join(where, (F.col("doc_id") == F.col("_d")) & (F.col("piece") == F.col("_p")))
    dealt = whole.select("sequence_id", "offset", "ids").repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        out: list[tuple[int, np.ndarray]] = []
        for batch in batches:
            for s, ids in zip(column(batch, "sequence_id").to_pylist(), column(batch, "ids").to_pylist(), strict=True):
                if s != key:
                    if parts:
                        out.append((key, np.frombuffer(b"".join(parts), "<u4").astype(np.int32)))
                    key, parts = s, []
                parts.append(ids)
            if len(out) > 1000:
                yield rows(out)
                out = []
        if parts:
            out.append((key, np.frombuffer(b"".join(parts), "<u4").astype(np.int32)))
        yield rows(out)

    def rows(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([v for _, v in out], pa.list_(pa.int32()))], ["sequence_id", "ids"])

    return dealt.mapInArrow(join, "sequence_id long, ids array<int>")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in sequences of 1024 tokens. Null and empty texts are their end mark alone; rows with
    null or repeated ids are packed like others. Empty table: no rows. Other columns do not matter, whatever their names."""
    return pack(docs, tokenizer_path())
