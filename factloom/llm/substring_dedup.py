"""Operator 3, substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest.

Cuts depend on the last 16 bytes and the next one only, so an insertion moves no cut farther behind it. They fall behind white
space (about every 40 bytes), between characters of scripts without spaces, and seldom elsewhere. Every window of MIN_RUN bytes
stands for its longest whole chunk (the leftmost of equals), which its bytes alone choose; a window without one takes a backup
chunk behind its least gear hash. So equal windows have equal chunks at the same place, and meet at the owner of the chunk's
digest. Where all bytes around a repeated chunk agree, nothing more is needed; else those bytes are compared, window by
window. So a repeat goes to its true ends, not to the ends of its chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, flat, fresh, map_arrow, materialize, project, ranges, tidy, total_bytes
from .hashing import Rolling, seeds

#: Bytes of a repeat that is removed, at least.
MIN_RUN = 160
#: Chance of a cut, in 256ths, behind white space, behind a byte of a non-ASCII character, and behind any other.
CUT_SPACE, CUT_WIDE, CUT_ANY = 44, 20, 1
#: Bytes the gear hash sees; of the shortest chunk a window stands for; of a backup chunk.
GEAR_BYTES, MIN_CHUNK, BACKUP = 16, 16, 32
#: Bytes of text a map batch has; windows' entries (about) an owner's bucket has, and bytes of text for each; bytes of all texts for
#: an owner that compares bytes.
BATCH_BYTES, BUCKET_ENTRIES, ENTRY_BYTES, OWNER_BYTES = 1 << 20, 1 << 19, 40, 3 << 20
_GEAR = (seeds(256, 97) >> np.uint64(32)).astype(np.uint32)
_roll = Rolling(89)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CUT = np.where(_SPACE, CUT_SPACE, np.where(np.arange(256) >= 128, CUT_WIDE, CUT_ANY)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of gear[byte i-k] << k for k < 16, modulo 2^32: the rolling hash at every byte.

    Doubling: a window of 2m bytes is a window of m plus the one before it, shifted by m.
    """
    h = _GEAR[data]
    m = 1
    while m < GEAR_BYTES:
        later = h[m:] + (h[:-m] << np.uint32(m))
        h = np.concatenate([h[:m], later])
        m *= 2
    return h


def cuts(data: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places, ascending, where a chunk ends and the next begins, by the gear hashes ``h``."""
    follows = np.append(data[1:], 0)
    cut = ((h >> np.uint32(8)) & np.uint32(0xFF)) < _CUT[data]
    cut &= ((follows & 0xC0) != 0x80) & ~(_SPACE[follows] & _SPACE[data])
    return np.flatnonzero(cut) + 1


def longest(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Of the chunks between the cuts ``at`` numbered lo to hi - 1, the longest, leftmost of equals; -1 for none of MIN_CHUNK bytes."""
    sizes = np.diff(at)
    out = np.full(len(lo), -1)
    some = np.flatnonzero(hi > lo)
    if not len(some) or not len(sizes):
        return out
    n = len(sizes)
    levels = [(sizes.astype(np.int64) << 32) | np.arange(n, 0, -1)]  # larger is better; ties go to the left
    span = hi[some] - lo[some]
    depth = np.frexp(span)[1] - 1
    while len(levels) <= depth.max():
        half = 1 << (len(levels) - 1)
        levels.append(np.maximum(levels[-1][:-half], levels[-1][half:]))
    best = np.empty(len(some), np.int64)
    for d in np.unique(depth):
        k = depth == d
        best[k] = np.maximum(levels[d][lo[some][k]], levels[d][hi[some][k] - (1 << int(d))])
    out[some] = np.where(best >> 32 >= MIN_CHUNK, n - (best & 0xFFFFFFFF), -1)
    return out


def marks(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, key, digest, hashes): the windows of ``width`` bytes inside a text by the chunk they stand
    for; windows of one chunk lie side by side.

    key is the digest of the chunk, digest that of all bytes of its windows, hashes that of the window at every byte.
    """
    none, n = np.zeros(0, np.int64), len(data)
    if not (np.diff(offsets) >= width).any():
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint64)
    h = gear(data)
    at = cuts(data, h)
    # A cut counts in a window if the bytes that make it are inside: from the 16th on, before the last.
    early, late = GEAR_BYTES, width - 1
    long = np.flatnonzero(np.diff(offsets) >= width)
    opens, closes = offsets[:-1][long], offsets[1:][long] - width  # first and last window of each text
    edges = np.unique(np.concatenate([at - early + 1, at - late, opens, closes + 1]))
    edges = edges[(edges >= 0) & (edges < n)]
    text = np.searchsorted(opens, edges, "right") - 1
    inside = (text >= 0) & (edges <= closes[text])
    text, first = text[inside], edges[inside]
    last = np.minimum(np.append(edges[1:], n)[inside] - 1, closes[text])
    lo, hi = np.searchsorted(at, first + early), np.searchsorted(at, first + late, "right") - 1
    chunk = longest(at, lo, hi)
    has = chunk >= 0
    place, end = np.where(has, at[chunk] if len(at) else 0, 0), np.where(has, at[np.minimum(chunk + 1, len(at) - 1)] if len(at) else 0, 0)
    if not has.all():
        w, of = ranges(first[~has], last[~has])
        span, m = width - BACKUP - early + 1, 1
        least = (h.astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
        while 2 * m <= span:
            least = np.minimum(least[:-m], least[m:])
            m *= 2
        least = np.minimum(least[: len(least) - (span - m)], least[span - m :])
        backup = (least[w + early - 1] & np.uint64(0xFFFFFFFF)).astype(np.int64) + 1
        text = np.concatenate([text[has], text[~has][of]])
        first, last = np.concatenate([first[has], w]), np.concatenate([last[has], w])
        place, end = np.concatenate([place[has], backup]), np.concatenate([end[has], backup + BACKUP])
        order = np.argsort(first, kind="stable")
        text, first, last, place, end = (x[order] for x in (text, first, last, place, end))
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (end[1:] != end[:-1]) | (text[1:] != text[:-1])]))
    last = last[np.append(new[1:], len(last)) - 1]
    text, first, place, end = text[new], first[new], place[new], end[new]
    sums = _roll.sums(data)
    return long[text], first, last, _roll.of(sums, place, end), _roll.of(sums, first, last + width), _roll.windows(sums, width)


def short_key(text_key: F.Column) -> F.Column:
    """Half of a text key: it only tells rows of one doc_id apart."""
    return text_key.bitwiseAND(F.lit(0xFFFFFFFF))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return project(docs, doc_id=id_col, text=text_col).where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), short_key(F.xxhash64("text")).alias("text_key"), "text")


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans, as spans that do not touch."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]


def not_first(keys: np.ndarray, group: np.ndarray, order_by: np.ndarray) -> np.ndarray:
    """Whether an element with the same key and group has a smaller order_by."""
    order = np.lexsort((order_by, keys, group))
    k, g, o = keys[order], group[order], order_by[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (g[1:] != g[:-1])])[: len(k)]
    out = np.zeros(len(keys), bool)
    out[order] = o != o[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _pack(kind: int, bucket: int, key: np.ndarray, digest: np.ndarray, doc: np.ndarray, text: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple:
    base = int(doc.min())
    small = doc.tobytes() if int(doc.max()) - base >= 1 << 32 else (doc - base).astype(np.uint32).tobytes()
    return kind, bucket, base, key.tobytes(), digest.tobytes(), small, text.astype(np.uint32).tobytes(), at.astype(np.uint32).tobytes(), size.astype(np.uint32).tobytes()


_PACKED = "kind int, bucket int, base long, keys binary, digests binary, docs binary, texts binary, places binary, sizes binary"
_FOUND = "doc_id long, text_key long, kind int, spans binary"


def _found(kind: np.ndarray, doc: np.ndarray, text: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """One row a document and kind; spans are pairs (start, size) of 32-bit numbers."""
    order = np.lexsort((at, kind, text, doc))
    kind, doc, text = kind[order], doc[order], text[order]
    pairs = np.stack([at[order], size[order]], 1).astype(np.uint32)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (kind[1:] != kind[:-1])])
    s = np.flatnonzero(new)
    return pa.RecordBatch.from_arrays([pa.array(doc[s]), pa.array(text[s].astype(np.int64)), pa.array(kind[s].astype(np.int32)), pa.array([x.tobytes() for x in np.split(pairs, s[1:])], pa.binary())], ["doc_id", "text_key", "kind", "spans"])


#: Of spans: all of it repeats; only its bytes can tell how much of it does.
FULL, PART = 0, 1


def find_windows(rows: DataFrame, width: int, n_buckets: int) -> DataFrame:
    """(doc_id, text_key, kind, spans) of ``rows`` (doc_id, text_key, text): where windows of ``width`` bytes may repeat, by one exchange."""

    def send(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        data, offsets = flat(column(batch, "text"))
        row, first, last, key, digest, hashes = marks(data, offsets, width)
        if not len(row):
            return None
        ids, keys = np.asarray(column(batch, "doc_id")), np.asarray(column(batch, "text_key"))
        out = []
        # Within a text: of equal windows all but the first go.
        order = np.lexsort((key, row))
        same = (key[order][1:] == key[order][:-1]) & (row[order][1:] == row[order][:-1])
        twice = np.zeros(len(row), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        if twice.any():
            at, of = ranges(first[twice], last[twice])
            of = row[twice][of]
            gone = not_first(hashes[at], of, at)
            if gone.any():
                s, e = merged(at[gone], at[gone] + width)  # windows of two texts do not overlap
                r = np.searchsorted(offsets[1:], s, "right")
                # Texts that touch: a span ends with its text.
                cut = np.flatnonzero(e > offsets[1:][r])
                if len(cut):
                    parts = [merged(at[gone][of[gone] == t], at[gone][of[gone] == t] + width) for t in np.unique(of[gone])]
                    s, e = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
                    r = np.searchsorted(offsets[1:], s, "right")
                out.append(_pack(FULL, -1, key[:0], digest[:0], ids[r], keys[r], s - offsets[r], e - s))
            # Of a string's equal surroundings in one text the first stand for all.
            stay = ~not_first(key ^ digest, row, first)
            row, first, last, key, digest = (x[stay] for x in (row, first, last, key, digest))
        doc, text, at, size = ids[row], keys[row], first - offsets[row], last - first + width
        least = ~not_first(digest, key, doc)
        if not least.all():
            out.append(_pack(FULL, -1, key[:0], digest[:0], doc[~least], text[~least], at[~least], size[~least]))
        doc, text, at, size, key, digest = (x[least] for x in (doc, text, at, size, key, digest))
        b = ((key >> np.uint64(17)) % np.uint64(n_buckets)).astype(np.int64)
        by = np.argsort(b, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(b[by])) + 1):
            out.append(_pack(PART, int(b[part[0]]), key[part], digest[part], doc[part], text[part], at[part], size[part]))
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[3:]]], [x.split()[0] for x in _PACKED.split(", ")])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                text, at, size = (np.frombuffer(r[n], np.uint32) for n in ("texts", "places", "sizes"))
                doc = np.frombuffer(r["docs"], np.int64) if len(r["docs"]) == 8 * len(at) else np.frombuffer(r["docs"], np.uint32).astype(np.int64) + r["base"]
                if r["kind"] == FULL:
                    yield _found(np.full(len(at), FULL), doc, text, at, size)
                    continue
                if r["bucket"] != bucket:
                    yield from settle(held)
                    bucket = r["bucket"]
                held.append((np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["digests"], np.uint64), doc, text, at, size))
        yield from settle(held)
        tidy()

    def settle(held: list) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        key, digest, doc, text, at, size = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((doc, digest, key))
        key, digest, doc, text, at, size = (x[order] for x in (key, digest, doc, text, at, size))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        s, of = np.flatnonzero(new), np.cumsum(new) - 1
        alike = np.concatenate([[True], new[1:] | (digest[1:] != digest[:-1])])
        full = doc != doc[np.flatnonzero(alike)][np.cumsum(alike) - 1]
        several = ((np.minimum.reduceat(doc, s) != np.maximum.reduceat(doc, s)) & (np.add.reduceat(alike, s, dtype=np.int64) > 1))[of]
        told = full | several
        if told.any():
            yield _found(np.where(full, FULL, PART)[told], doc[told], text[told], at[told], size[told])

    packed = map_arrow(rows, send, _PACKED, step=BATCH_BYTES)
    spread = F.when(F.col("kind") == PART, F.col("bucket").cast("long")).otherwise(F.xxhash64("base", "docs", "places"))
    return packed.repartition(n_buckets, spread).sortWithinPartitions("kind", "bucket").mapInArrow(own, _FOUND)


def compare_windows(laid: DataFrame, width: int, n_buckets: int) -> DataFrame:
    """(doc_id, text_key, kind, spans): the windows within the given stretches of a text that a smaller doc_id has too."""

    def send(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        data, offsets = flat(column(batch, "text"))
        pairs = [np.frombuffer(b"".join(x), np.uint32).astype(np.int64).reshape(-1, 2) for x in column(batch, "spans").to_pylist()]
        n = np.array([len(x) for x in pairs])
        if not n.sum():
            return None
        at, size = np.concatenate(pairs).T
        row = np.repeat(np.arange(len(n)), n)
        _, first, _, key, _, _ = marks(data, offsets, width)
        k = key[np.searchsorted(first, offsets[row] + at)]
        raw = data.tobytes()
        s = (offsets[row] + at).tolist()
        doc, text = np.asarray(column(batch, "doc_id"))[row], np.asarray(column(batch, "text_key"))[row]
        b = ((k >> np.uint64(17)) % np.uint64(n_buckets)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(b), pa.array(doc), pa.array(text), pa.array(at), pa.array([raw[x : x + z] for x, z in zip(s, size.tolist(), strict=True)], pa.binary())], ["bucket", "doc_id", "text_key", "at", "bytes"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            b = np.asarray(column(batch, "bucket"))
            for part in np.split(np.arange(len(b)), np.flatnonzero(np.diff(b)) + 1):
                if len(part):
                    if b[part[0]] != bucket:
                        yield from settle(held)
                        bucket = b[part[0]]
                    held.append(batch.slice(part[0], len(part)))
        yield from settle(held)
        tidy()

    def settle(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        # In the order of doc_id: then a stable sort by hash puts the smallest document's window first.
        rows = pa.Table.from_batches(held).sort_by("doc_id").combine_chunks().to_batches()
        held.clear()
        for batch in rows:
            doc, text, at = (np.asarray(column(batch, n)) for n in ("doc_id", "text_key", "at"))
            data, offsets = flat(column(batch, "bytes"))
            w, of = ranges(offsets[:-1], offsets[1:] - width)
            of = of.astype(np.int32)
            h = _roll.of(_roll.sums(data), w, w + width)
            order = np.argsort(h, kind="stable")
            new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
            least = doc[of[order[new]]]
            later = np.zeros(len(h), bool)
            later[order] = doc[of[order]] > least[np.cumsum(new) - 1]
            del h, order, new
            k = np.flatnonzero(later)
            if len(k):
                apart = np.concatenate([[True], (k[1:] != k[:-1] + 1) | (of[k][1:] != of[k][:-1])])
                s = k[apart]
                e = k[np.append(np.flatnonzero(apart)[1:] - 1, len(k) - 1)]
                r = of[s]
                first = at[r] + w[s] - offsets[r]
                yield _found(np.full(len(s), FULL), doc[r], text[r], first, w[e] - w[s] + width)

    sent = map_arrow(laid, send, "bucket int, doc_id long, text_key long, at long, bytes binary", step=BATCH_BYTES)
    return sent.repartition(n_buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(own, _FOUND)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` less its repeats, and _n_bytes, _n_removed, _spans (start, end).

    What leaves ``text`` is every string of ``min_run`` bytes (100 at least) that a document with a smaller doc_id has too, or the
    document itself further ahead. No repeat of that length is missed, and each goes to its true ends (drawn in to whole
    characters). Rows with null text or id are left as they are and count for nothing; columns named like the three added ones
    are replaced. Rows that share a doc_id never take from each other. Empty texts stay empty. Empty table: no rows.
    """
    docs = docs.drop("_n_bytes", "_n_removed", "_spans")
    names, kinds = docs.columns, {f.name: f.dataType.simpleString() for f in docs.schema}
    row_id, row_key, row_spans, own_key = fresh(docs, "_id", "_key", "_places", "_own")
    rows = keyed(docs, id_col, text_col)
    total = total_bytes(rows)
    n = max(1, -(-total // (ENTRY_BYTES * BUCKET_ENTRIES)))
    found = materialize(find_windows(rows, min_run, n), "windows")
    part = found.where(F.col("kind") == PART).groupBy("doc_id", "text_key").agg(F.collect_list("spans").alias("spans")).toDF(row_id, row_key, row_spans)
    own = docs.withColumn(own_key, short_key(F.xxhash64(F.col(text_col))))
    on = (F.col(id_col).cast("long") == F.col(row_id)) & (F.col(own_key) == F.col(row_key))
    some = own.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).join(part, on)
    some = some.select(F.col(row_id).alias("doc_id"), F.col(row_key).alias("text_key"), F.col(text_col).alias("text"), F.col(row_spans).alias("spans"))
    gone = found.where(F.col("kind") == FULL).union(compare_windows(some, min_run, max(1, -(-total // OWNER_BYTES))))
    per = gone.groupBy("doc_id", "text_key").agg(F.collect_list("spans").alias("spans")).toDF(row_id, row_key, row_spans)
    joined = own.join(per, on, "left").drop(row_id, row_key, own_key)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = column(batch, text_col)
        whole, n_bytes, removed, cuts = [], [], [], []
        for t, packed in zip(text.to_pylist(), column(batch, row_spans).to_pylist(), strict=True):
            raw = (t or "").encode()
            spans_ = []
            if packed:
                at, size = np.frombuffer(b"".join(packed), np.uint32).astype(np.int64).reshape(-1, 2).T
                for s, e in zip(*(x.tolist() for x in merged(at, at + size)), strict=True):
                    while s < e and raw[s] & 0xC0 == 0x80:
                        s += 1
                    while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
                        e -= 1
                    spans_.append((s, e))
                kept, to = [], 0
                for s, e in spans_:
                    kept.append(raw[to:s])
                    to = e
                t = b"".join([*kept, raw[to:]]).decode()
            whole.append(t)
            n_bytes.append(len(raw))
            removed.append(sum(e - s for s, e in spans_))
            cuts.append([{"start": s, "end": e} for s, e in spans_])
        cols = [pa.array(whole, text.type) if c == text_col else column(batch, c) for c in names]
        return pa.RecordBatch.from_arrays([*cols, pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(cuts, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], [*names, "_n_bytes", "_n_removed", "_spans"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", _n_bytes long, _n_removed long, _spans array<struct<start: long, end: long>>"
    return map_arrow(joined, cut, schema, text=text_col, step=1 << 20)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = substring_dedup(docs)
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.size("_spans").cast("long").alias("n_spans"), kept.alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats leave the texts; n_chars follows. No document is dropped: rows with null text or id are handed on as they are, a
    text that repeats as a whole becomes empty. Rows that share a doc_id stay, each with its own text. Empty table: no rows."""
    out = substring_dedup(docs).drop("_n_bytes", "_n_removed", "_spans")
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
