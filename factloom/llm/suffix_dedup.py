"""Operator 6, suffix-array dedup: a logarithmic family of suffix arrays, merge-scanned for long matches.

A byte is removed when a string of ``width`` bytes that covers it also starts in a document with a smaller doc_id.

1. Texts are laid out once, in packed blocks of some megabytes, bucketed in the shared folder; whatever a later step finds
   is answered to blocks. Texts equal to one with a smaller doc_id go as a whole and take no further part.
2. Minimizers narrow the work without loss: any two equal strings of ``width`` bytes have the same minimizer (a k-byte
   string in it that its bytes alone choose) at the same place. So a string can only repeat if its minimizer occurs in two
   documents. A block sends each of its minimizers' keys once, as 32 bits, and gets back one bit for each. Modulo
   minimizers are used: they are as sparse as common ones of shorter strings, and chance repeats fall with the length.
3. Around each such minimizer the bytes of all strings that have it are cut out and sent to the owner of its hash; of
   equal pieces a block sends one.
4. An owner takes its pieces in the order of doc_id, in batches. A batch gets a suffix array (suffixes cut to ``width``
   bytes), is scanned against each level of the index for matches, and then becomes a level itself; two levels of like
   size merge into one of twice the size, so there are logarithmically many levels and each suffix is rewritten as often.
5. Matched spans go back to their blocks, where their union is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, column, materialize, project, ranges, ship, tidy, total_bytes
from .hashing import Rolling

#: Bytes of a match; of a minimizer; suffixes of a batch of the index.
WIDTH, GRAM, BATCH_SUFFIXES = 50, 30, 1 << 16
#: Bytes of text in a block, in a bucket of blocks, of one vectorised step, for an owner of pieces; entries of a key bucket.
BLOCK_BYTES, PART_BYTES, STEP, OWNER_BYTES, BUCKET_ENTRIES = 2 << 20, 64 << 20, 1 << 20, 3 << 20, 1 << 20
#: Bytes of the shortest string whose hash chooses a minimizer.
SEED = 4
_roll = Rolling(41)
_second = Rolling(43)


class SuffixLevels:
    """The index family: sorted distinct suffixes (cut to ``width`` bytes) with the smallest document each starts in."""

    def __init__(self, width: int = WIDTH):
        self.width, self.levels = width, []  # of (keys, documents), largest first

    def keys(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The strings of ``width`` bytes that start at ``at``; a last byte of 1 keeps trailing zeros significant."""
        out = np.ones((len(at), self.width + 1), np.uint8)
        out[:, : self.width] = np.lib.stride_tricks.sliding_window_view(data, self.width)[at] if len(at) else 0
        return out.view(f"S{self.width + 1}").ravel()

    def add(self, keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Whether each suffix also starts in a smaller document, of this batch or before; then index the batch.

        Batches may come in any order of documents as long as no later one has a smaller document than it compares with;
        the owners below take them in ascending order.
        """
        order = np.lexsort((docs, keys)) if len(keys) > 1 else np.arange(len(keys))  # the batch's suffix array
        k, d = keys[order], docs[order]
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(start, len(k)))
        unique, least = k[start], d[start]
        known = least.copy()
        for level, owners in self.levels:
            at = np.minimum(np.searchsorted(level, unique), len(level) - 1)
            hit = level[at] == unique
            known[hit] = np.minimum(known[hit], owners[at[hit]])
        found = np.zeros(len(keys), bool)
        found[order] = d > np.repeat(known, sizes)
        if len(unique):
            self.levels.append((unique, least))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) > len(self.levels[-2][0]):
            self.levels.append(self._merge(self.levels.pop(), self.levels.pop()))
        return found

    def _merge(self, small: tuple, large: tuple) -> tuple:
        """Two levels as one: of equal suffixes one stays, with the smaller document."""
        at = np.searchsorted(large[0], small[0])
        near = np.minimum(at, len(large[0]) - 1)
        same = large[0][near] == small[0]
        docs = large[1].copy()
        np.minimum.at(docs, near[same], small[1][same])
        fresh = ~same
        return np.insert(large[0], at[fresh], small[0][fresh]), np.insert(docs, at[fresh], small[1][fresh])


def minimizers(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all strings of ``width`` bytes within a text, grouped by minimizer: (hash, second hash, place of the minimizer,
    first string, last string), ascending; a text's strings with one minimizer stand together."""
    none = np.zeros(0, np.int64)
    apart = width - gram + 1  # places a minimizer may have in a string
    seed = SEED + (gram - SEED) % apart if gram > SEED else gram
    if len(data) < width:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    sums = _roll.sums(data)
    h = _roll.windows(sums, seed)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    m, span = 1, width - seed + 1
    while 2 * m <= span:  # least seed hash of each string, the leftmost of equals
        low = np.minimum(low[:-m], low[m:])
        m *= 2
    if m < span:
        low = np.minimum(low[: m - span], low[span - m :])
    valid = np.zeros(len(low) + 1, np.int8)  # strings that end within their text
    sizes = np.diff(offsets)
    long = sizes >= width
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, (offsets[1:] - width + 1)[long], -1)
    first = np.flatnonzero(np.cumsum(valid[:-1], dtype=np.int8))
    least = (low[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    place = first + (least - first) % apart
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (first[1:] != first[:-1] + 1)]))
    last = first[np.append(new[1:], len(first)) - 1]
    place = place[new]
    return _roll.of(sums, place, place + gram), _second.of(_second.sums(data), place, place + gram), place, first[new], last


def slabs(offsets: np.ndarray, width: int, step: int) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """(start, end, offsets from start, first row): whole texts of about ``step`` bytes together; a longer text alone, in parts
    that overlap by ``width`` - 1 bytes, so that each string of ``width`` bytes is in just one."""
    row, n = 0, len(offsets) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + step, "right")) - 1)
        s, e = int(offsets[row]), int(offsets[to])
        if e - s <= 2 * step:
            yield s, e, offsets[row : to + 1] - s, row
        else:
            for at in range(s, max(s + 1, e - width + 1), step):
                stop = min(at + step + width - 1, e)
                yield at, stop, np.array([0, stop - at]), row
        row = to


class Entries:
    """The minimizers of a block of texts: bucket and key of each distinct one, and where it occurs."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, skip: np.ndarray, width: int, gram: int, n_buckets: int, pieces: bool = False):
        """``pieces`` adds the two hashes of all bytes around each minimizer."""
        codes, rows, firsts, lasts, whole, one, two = [], [], [], [], [], [], []
        for s, e, inner, row in slabs(offsets, width, STEP):
            h, second, _, first, last = minimizers(data[s:e], inner, width, gram)
            r = row + np.searchsorted(inner[1:], first, "right")
            keep = ~skip[r]
            # A key of 32 bits tells the million entries of a bucket apart; a chance hit only adds strings to look at.
            code = (second % np.uint64(n_buckets)) << np.uint64(32) | h >> np.uint64(32)
            for store, x in ((codes, code), (rows, r), (firsts, first + s), (lasts, last + s), *([(whole, h)] if pieces else [])):
                store.append(x[keep])
            if pieces:
                for store, roll in ((one, _roll), (two, _second)):
                    store.append(roll.of(roll.sums(data[s:e]), first[keep], last[keep] + width))
        none = np.zeros(0, np.int64)
        self.row, self.first, self.last = (np.concatenate([none, *x]) for x in (rows, firsts, lasts))
        self.hash, self.one, self.two, code = (np.concatenate([none.astype(np.uint64), *x]) for x in (whole, one, two, codes))
        del codes, rows, firsts, lasts, whole, one, two
        self.distinct, self.nth = np.unique(code, return_inverse=True)
        least, most = np.full(len(self.distinct), len(skip)), np.zeros(len(self.distinct), np.int64)
        np.minimum.at(least, self.nth, self.row)
        np.maximum.at(most, self.nth, self.row)
        self.several = least != most  # two texts of this block have it
        bucket = (self.distinct >> np.uint64(32)).astype(np.int64)
        self.edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else none
        self.buckets = bucket[self.edges]

    def told(self, answers: list) -> np.ndarray:
        """Which occurrences are of minimizers that two texts have. answers: (bucket, packed bits) of this block."""
        hit, ends = self.several.copy(), np.append(self.edges[1:], len(self.distinct))
        for bucket, bits in answers:
            k = int(np.searchsorted(self.buckets, bucket))
            s, e = self.edges[k], ends[k]
            hit[s:e] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=e - s).astype(bool)
        return hit[self.nth]


def lay_blocks(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """The texts as packed blocks in the shared folder, bucketed by ``home``; the number of buckets; bytes of all texts.

    A block is one row: home, part, ids, sizes, shas, text. Later steps answer to blocks, not to documents, and meet
    the blocks without moving the texts again.
    """
    spark = docs.sparkSession
    rows = project(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = total_bytes(rows)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(np.ceil(total / PART_BYTES)))
    homes = 4 * n
    laid = rows.withColumn("home", F.pmod(F.xxhash64("doc_id", "text"), F.lit(homes))).repartition(n, "home")
    ship(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size: dict[int, int] = {}
        parts: dict[int, int] = {}

        def close(home: int) -> pa.RecordBatch:
            ids, texts = zip(*held.pop(home), strict=True)
            part = parts[home] = parts.get(home, -1) + 1
            size[home] = 0
            shas = b"".join(hashlib.sha256(t).digest() for t in texts)
            known = np.array([d is not None for d in ids], np.uint8)
            cells = [np.array([d or 0 for d in ids], np.int64).tobytes(), known.tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), shas, b"".join(texts)]
            return pa.RecordBatch.from_arrays([pa.array([home], pa.int64()), pa.array([part], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]], BLOCK_COLUMNS)

        for batch in batches:
            for home, doc, text in zip(column(batch, "home").to_pylist(), column(batch, "doc_id").to_pylist(), column(batch, "text").cast(pa.binary()), strict=True):
                raw = text.as_py()
                held.setdefault(home, []).append((doc, raw))
                size[home] = size.get(home, 0) + len(raw) + 64
                if size[home] >= BLOCK_BYTES:
                    yield close(home)
        for home in list(held):
            yield close(home)
        tidy()

    blocks = laid.mapInArrow(pack, "home long, part int, ids binary, known binary, sizes binary, shas binary, text binary")
    return bucketed(blocks, "blocks", "home", n), n, total


BLOCK_COLUMNS = ["home", "part", "ids", "known", "sizes", "shas", "text"]


@dataclass
class Block:
    home: int
    part: int
    ids: np.ndarray
    known: np.ndarray
    sizes: np.ndarray
    shas: list[bytes]
    data: np.ndarray

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)])

    def copies(self, width: int, lows: list | None) -> np.ndarray:
        """Rows whose whole text, of ``width`` bytes or more, a row with a smaller doc_id has too. lows: (part, sha, doc_id)."""
        least: dict[bytes, int] = {}
        live = self.known & (self.sizes >= width)
        for k in np.flatnonzero(live).tolist():
            least[self.shas[k]] = min(least.get(self.shas[k], self.ids[k]), self.ids[k])
        for x in lows or ():
            if x["part"] == self.part:
                least[bytes(x["sha"])] = min(least[bytes(x["sha"])], x["low"])
        return np.array([bool(v) and least[s] < d for v, s, d in zip(live, self.shas, self.ids, strict=True)], bool)


def blocks_of(batch: pa.RecordBatch) -> Iterator[tuple[Block, int]]:
    """Each block of a batch, and its row there; without the column ``text`` its bytes are empty."""
    with_text = "text" in batch.schema.names
    for k in range(batch.num_rows):
        get = lambda name: column(batch, name)[k].as_buffer()  # noqa: B023, E731
        shas = get("shas").to_pybytes()
        data = np.frombuffer(get("text"), np.uint8) if with_text else np.zeros(0, np.uint8)
        yield Block(column(batch, "home")[k].as_py(), column(batch, "part")[k].as_py(), np.frombuffer(get("ids"), np.int64), np.frombuffer(get("known"), np.uint8).astype(bool), np.frombuffer(get("sizes"), np.int64), [shas[i : i + 32] for i in range(0, len(shas), 32)], data), k


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each bucket together; rows come sorted by bucket."""
    bucket, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != bucket:
                if held:
                    yield held
                bucket, held = row["bucket"], []
            held.append(row)
    if held:
        yield held


_KEYS = "home long, part int, bucket int, keys binary"
_BITS = "home long, part int, bucket int, bits binary"
_SENT = "bucket int, home long, part int, rows binary, at binary, sizes binary, ids binary, pieces binary"
_SPANS = "home long, part int, spans binary"


def _known_copies(blocks: DataFrame, width: int, n: int) -> DataFrame:
    """(home, lows): of the texts of each block that a smaller doc_id elsewhere has too, the digest and that doc_id."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, _ in blocks_of(batch):
                least: dict[bytes, int] = {}
                for k in np.flatnonzero(b.known & (b.sizes >= width)).tolist():
                    least[b.shas[k]] = min(least.get(b.shas[k], b.ids[k]), b.ids[k])
                yield _table([(s, int(d), b.home, b.part) for s, d in least.items()], "sha binary, doc long, home long, part int")

    each = blocks.select("home", "part", "ids", "known", "sizes", "shas").mapInArrow(texts, "sha binary, doc long, home long, part int")
    low = each.groupBy("sha").agg(F.min("doc").alias("low"), F.max("doc").alias("most")).where("low < most").select(F.col("sha").alias("_sha"), "low")
    later = each.join(low, F.col("sha") == F.col("_sha")).where("doc > low")
    return later.repartition(n, "home").groupBy("home").agg(F.collect_list(F.struct("part", "sha", "low")).alias("lows")).withColumnRenamed("home", "_home")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """What ``suffix_dedup`` returns, with the removed ``spans`` (start, end) and, if ``texts``, the bytes ``kept``."""
    blocks, n, total = lay_blocks(docs, id_col, text_col)
    n_buckets, n_owners = max(1, -(-total // (14 * BUCKET_ENTRIES))), max(1, -(-total // OWNER_BYTES))
    lows = materialize(_known_copies(blocks, width, n), "copies")
    marked = blocks.join(lows.repartition(n, "_home"), F.col("home") == F.col("_home"), "left").drop("_home")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, k in blocks_of(batch):
                skip = ~b.known | b.copies(width, column(batch, "lows")[k].as_py())
                x = Entries(b.data, b.offsets, skip, width, gram, n_buckets)
                keys = (x.distinct & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                yield _table([(b.home, b.part, int(bucket), keys[s:e].tobytes()) for bucket, s, e in zip(x.buckets, x.edges, np.append(x.edges[1:], len(keys)), strict=True)], _KEYS)
        tidy()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            each = [np.frombuffer(r["keys"], np.uint32) for r in rows]
            keys = np.concatenate(each)
            order = np.argsort(keys, kind="stable")
            same = keys[order][1:] == keys[order][:-1]  # a block sends a key once, so equal keys are of two blocks
            hit = np.zeros(len(keys), bool)
            hit[order[1:][same]] = hit[order[:-1][same]] = True
            parts = np.split(hit, np.cumsum([len(x) for x in each])[:-1])
            yield _table([(r["home"], r["part"], r["bucket"], np.packbits(p).tobytes()) for r, p in zip(rows, parts, strict=True) if p.any()], _BITS)
        tidy()

    keyed = marked.mapInArrow(send, _KEYS).repartition(n_buckets, "bucket").sortWithinPartitions("bucket")
    answers = keyed.mapInArrow(meet, _BITS).repartition(n, "home").groupBy("home").agg(F.collect_list(F.struct("part", "bucket", "bits")).alias("answers"))
    asked = marked.join(materialize(answers, "answers").repartition(n, "home").withColumnRenamed("home", "_a"), F.col("home") == F.col("_a"), "left").drop("_a")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, k in blocks_of(batch):
                skip = ~b.known | b.copies(width, column(batch, "lows")[k].as_py())
                x = Entries(b.data, b.offsets, skip, width, gram, n_buckets, pieces=True)
                hit = x.told([(a["bucket"], a["bits"]) for a in column(batch, "answers")[k].as_py() or () if a["part"] == b.part])
                yield _table(_pieces(b, x, hit, width, n_owners), _SENT)
        tidy()

    spread = F.when(F.col("bucket") >= 0, F.col("bucket").cast("long")).otherwise(F.xxhash64("home", "part"))
    sent = asked.mapInArrow(cut_out, _SENT).repartition(n_owners, spread).sortWithinPartitions("bucket")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            if rows[0]["bucket"] < 0:  # matched within their block
                yield _table([(r["home"], r["part"], r["pieces"]) for r in rows], _SPANS)
            else:
                yield _table(scan(rows, width), _SPANS)
        tidy()

    spans = sent.mapInArrow(own, _SPANS).repartition(n, "home").groupBy("home").agg(F.collect_list(F.struct("part", "spans")).alias("spans"))
    done = marked.join(spans.withColumnRenamed("home", "_s"), F.col("home") == F.col("_s"), "left").drop("_s")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, k in blocks_of(batch):
                offsets, copies = b.offsets, b.copies(width, column(batch, "lows")[k].as_py())
                got = [np.frombuffer(s["spans"], np.uint32).reshape(-1, 3).astype(np.int64) for s in column(batch, "spans")[k].as_py() or () if s["part"] == b.part]
                row, start, end = np.concatenate(got).T if got else np.zeros((3, 0), np.int64)
                edge = np.zeros(len(b.data) + 1, np.int32)
                np.add.at(edge, offsets[row] + start, 1)
                np.add.at(edge, offsets[row] + end, -1)
                gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
                touched = copies.copy()
                touched[row] = True
                removed, runs, kept, hashes = np.zeros(len(b.ids), np.int64), [], [], []
                for i, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    if not touched[i]:
                        runs.append([])
                        hashes.append(b.shas[i].hex())
                        kept.append(b.data[s:e].tobytes() if texts else None)
                        continue
                    g = np.ones(e - s, bool) if copies[i] else gone[s:e]
                    flips = np.diff(np.concatenate([[0], g.astype(np.int8), [0]]))
                    left = b.data[s:e][~g].tobytes()
                    removed[i] = e - s - len(left)
                    runs.append([{"start": int(p), "end": int(q)} for p, q in zip(np.flatnonzero(flips == 1), np.flatnonzero(flips == -1), strict=True)])
                    hashes.append(hashlib.sha256(left).hexdigest())
                    kept.append(left if texts else None)
                cols = [pa.array(b.ids, mask=~b.known), pa.array(b.sizes), pa.array(removed), pa.array([len(r) for r in runs], pa.int64()), pa.array(hashes, pa.string()), pa.array(runs, kind), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])
        tidy()

    return done.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>, kept binary")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Matches are judged on the input, in UTF-8 bytes, and never cross texts. Null text counts as empty. Rows that share a
    doc_id never take from each other; rows with a null doc_id keep all and take nothing. Texts under ``width`` bytes
    keep all. Empty table: no rows. Other columns are ignored. ``removals`` gives the spans themselves.
    """
    return removals(docs, id_col, text_col, width, gram).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _pieces(b: Block, x: Entries, hit: np.ndarray, width: int, n_owners: int) -> list[tuple]:
    """The strings around the minimizers hit, packed by owner. Of equal ones the smallest document's is sent; those of the
    block's other documents are matched here and go, as spans, under bucket -1."""
    row, s, e = x.row[hit], x.first[hit], x.last[hit] + width
    if not len(row):
        return []
    one, two = x.one[hit], x.two[hit]
    doc = b.ids[row]
    order = np.lexsort((doc, two, one))
    new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
    least = np.empty(len(doc), np.int64)
    least[order] = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    mine = doc == least
    out = []
    start = (s - b.offsets[row]).astype(np.int64)
    if not mine.all():
        spans = np.stack([row, start, start + e - s], 1)[~mine].astype(np.uint32)
        out.append((-1, b.home, b.part, b"", b"", b"", b"", spans.tobytes()))
    bucket = ((x.hash[hit] >> np.uint64(7)) % np.uint64(n_owners)).astype(np.int64)
    at_sent = np.flatnonzero(mine)
    at_sent = at_sent[np.argsort(bucket[at_sent], kind="stable")]
    for part in np.split(at_sent, np.flatnonzero(np.diff(bucket[at_sent])) + 1):
        # ``ids`` holds a doc_id a document of the block that takes part; ``rows`` says whose each piece is.
        rows, nth = np.unique(row[part], return_inverse=True)
        pos, _ = ranges(s[part], e[part] - 1)
        whose = np.concatenate([np.array([len(rows)], np.uint32), rows.astype(np.uint32), nth.astype(np.uint32)])
        out.append((int(bucket[part[0]]), b.home, b.part, whose.tobytes(), start[part].astype(np.uint32).tobytes(), (e - s)[part].astype(np.uint16).tobytes(), b.ids[rows].tobytes(), b.data[pos].tobytes()))
    return out


def piece_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each piece."""
    return tuple(r.of(r.sums(data), bounds[:-1], bounds[1:]) for r in (_roll, _second))


def scan(rows: list[dict], width: int) -> list[tuple]:
    """Spans matched among the pieces of one owner, by block: its pieces join the index family in the order of doc_id."""
    whose = [np.frombuffer(r["rows"], np.uint32) for r in rows]
    counts = [int(w[0]) for w in whose]
    row = np.concatenate([w[1 : 1 + c][w[1 + c :]] for w, c in zip(whose, counts, strict=True)]).astype(np.int64)
    doc = np.concatenate([np.frombuffer(r["ids"], np.int64)[w[1 + c :]] for r, w, c in zip(rows, whose, counts, strict=True)])
    start = np.concatenate([np.frombuffer(r["at"], np.uint32) for r in rows]).astype(np.int64)
    size = np.concatenate([np.frombuffer(r["sizes"], np.uint16) for r in rows]).astype(np.int64)
    block = np.repeat(np.arange(len(rows)), [len(w) - 1 - c for w, c in zip(whose, counts, strict=True)])
    data = np.frombuffer(b"".join(r["pieces"] for r in rows), np.uint8)
    bounds = np.concatenate([[0], np.cumsum(size)])
    # A piece seen before in a smaller document is matched in whole.
    one, two = piece_hashes(data, bounds)
    order = np.lexsort((doc, two, one))
    new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
    whole = np.zeros(len(doc), bool)
    whole[order] = doc[order] > doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    out = [np.stack([block[whole], row[whole], start[whole], start[whole] + size[whole]], 1)]
    rest = np.flatnonzero(~whole)
    rest = rest[np.argsort(doc[rest], kind="stable")]
    suffixes = np.cumsum(size[rest] - width + 1)
    index = SuffixLevels(width)
    edges = np.searchsorted(suffixes, np.arange(BATCH_SUFFIXES, suffixes[-1] + BATCH_SUFFIXES, BATCH_SUFFIXES)) + 1 if len(rest) else []
    for a, z in zip([0, *edges[:-1]], edges, strict=True):
        part = rest[a:z]
        if not len(part):
            continue
        at, of = ranges(bounds[part], bounds[part + 1] - width)
        hit = index.add(index.keys(data, at), doc[part][of])
        begins = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1] & (of[1:] == of[:-1])]))
        ends = np.flatnonzero(hit & ~np.concatenate([hit[1:] & (of[1:] == of[:-1]), [False]]))
        p = part[of[begins]]
        base = start[p] - bounds[p]
        out.append(np.stack([block[p], row[p], base + at[begins], base + at[ends] + width], 1))
    every = np.concatenate(out)
    every = every[np.argsort(every[:, 0], kind="stable")]
    parts = np.split(every, np.flatnonzero(np.diff(every[:, 0])) + 1)
    return [(rows[x[0, 0]]["home"], rows[x[0, 0]]["part"], x[:, 1:].astype(np.uint32).tobytes()) for x in parts if len(x)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
