"""Operator 1, n-gram Jaccard join: MinHash banding, then exact verification on full n-gram sets.

Texts with equal word sequences form a class, which joins as one. A class's signature is cut into bands; classes that
share a band's hash are candidates. Candidate clusters (components over shared bands) are verified block by block on
their full shingle sets, so no pair is ever a row and no task sees an unbounded cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, column, fresh, join_hot, lists, map_arrow, materialize, project, ship, tidy
from .components import components, least_reachable, least_reachable_dense
from .hashing import mix, seeds, sequence_keys, shingles, words

#: Words of a shingle, least similarity, chance to find a pair of just that similarity.
NGRAM, SIMILARITY, RECALL = 5, 0.8, 0.9999
#: Shingles and classes of one block of a cluster, at most about.
BLOCK_SHINGLES, BLOCK_CLASSES = 1 << 18, 4000


def band_plan(similarity: float, recall: float, budget: int = 160) -> tuple[int, int]:
    """(bands, rows): the most rows a band, thus the fewest false candidates, that reach ``recall`` at ``similarity``."""
    for rows in range(12, 0, -1):
        p = similarity**rows
        bands = int(np.ceil(np.log1p(-recall) / np.log1p(-p))) if p < 1 else 1
        if bands * rows <= budget:
            return bands, rows
    raise ValueError("the recall asked for needs more hashes than the budget")


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 31):
        self.bands, self.rows = bands, rows
        self.a = (seeds(bands * rows, seed) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.b = (seeds(bands * rows, seed + 1) >> np.uint64(32)).astype(np.uint32)

    def band_hashes(self, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(texts, bands) hashes of the shingles of each text; every text must have a shingle."""
        low = values.astype(np.uint32)
        out = np.zeros((len(bounds) - 1, self.bands), np.uint64)
        for k in range(self.bands * self.rows):
            h = low * self.a[k]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h += self.b[k]
            least = np.minimum.reduceat(h, bounds[:-1]).astype(np.uint64)
            out[:, k // self.rows] = mix(out[:, k // self.rows] * np.uint64(31) + least + np.uint64(k + 1))
        return out


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int, plan: MinHash) -> DataFrame:
    """doc_id, text_key, k1, k2 (the word sequence's key; null without words) and the band hashes."""

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, bounds, *_ = words(column(batch, "text"))
        values, ends = shingles(hashes, bounds, n)
        has = np.diff(bounds) > 0
        keys = sequence_keys(hashes, bounds).view(np.int64)
        bands = plan.band_hashes(values, np.append(ends[:-1][has], ends[-1])).view(np.int64) if has.any() else np.zeros((0, plan.bands), np.int64)
        sizes = np.where(has, plan.bands, 0)
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "text_key"), pa.array(keys[:, 0], mask=~has), pa.array(keys[:, 1], mask=~has), lists(bands.ravel(), np.concatenate([[0], np.cumsum(sizes)]))], ["doc_id", "text_key", "k1", "k2", "bands"])

    rows = project(docs, doc_id=id_col, text=text_col).withColumn("text_key", F.xxhash64("text"))
    return map_arrow(rows, sign, "doc_id long, text_key long, k1 long, k2 long, bands array<long>")


def clusters(classes: DataFrame) -> DataFrame:
    """(cid, root): classes that share a band hash with another are linked to the smallest class in that bucket."""
    rows = classes.select("cid", F.posexplode("bands").alias("band", "hash"))
    least = rows.groupBy("band", "hash").agg(F.min("cid").alias("low"), F.count("*").alias("n")).where("n > 1").select(F.col("band").alias("_b"), F.col("hash").alias("_h"), "low")
    links = rows.join(least, (F.col("band") == F.col("_b")) & (F.col("hash") == F.col("_h"))).where("cid <> low").select("cid", "low").distinct()
    return components(links, "cid", "low").select(F.col("node").alias("cid"), "root")


def _settle(a: list, b: list | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, low) of the classes of a, then of b: how many rows each is linked to here, and the smallest class it reaches.

    Linked are classes, of a and b or within a, that share a band and reach the similarity on their full shingle sets.
    A class is (cid, copies, bands, sorted distinct shingles).
    """
    other = a if b is None else b
    bands_a, bands_b = np.stack([x[2] for x in a]), np.stack([x[2] for x in other])
    near = np.zeros((len(a), len(other)), bool)
    for k in range(bands_a.shape[1]):
        near |= bands_a[:, k, None] == bands_b[None, :, k]
    if b is None:
        near &= np.tri(len(a), k=-1, dtype=bool).T
    size_a, size_b = np.array([len(x[3]) for x in a]), np.array([len(x[3]) for x in other])
    for k, size in enumerate(size_a):
        near[k] &= np.minimum(size, size_b) >= similarity * np.maximum(size, size_b) - 1e-9
    n = int(near.sum())
    if n <= 200 or n * 20 < near.size:
        for i, j in zip(*np.nonzero(near), strict=True):
            both = len(np.intersect1d(a[i][3], other[j][3], assume_unique=True))
            near[i, j] = both >= similarity * (size_a[i] + size_b[j] - both) - 1e-9
    else:
        shared = _shared(a, other, b is None)
        for k, size in enumerate(size_a):
            near[k] &= shared[k] >= similarity * (size + size_b - shared[k]) - 1e-9
    copies_a, copies_b = np.array([x[1] for x in a], np.float64), np.array([x[1] for x in other], np.float64)
    from_b, from_a = near @ copies_b, copies_a @ near
    links = from_b + from_a if b is None else np.concatenate([from_b, from_a])
    cid_a, cid_b = np.array([x[0] for x in a], np.int64), np.array([x[0] for x in other], np.int64)
    if near.sum() <= 1 << 20:
        i, j = np.nonzero(near)
        low = least_reachable(cid_a if b is None else np.concatenate([cid_a, cid_b]), i, j if b is None else j + len(a))
    elif b is None:
        low = least_reachable_dense(cid_a, cid_a, near | near.T)[0]
    else:
        low = np.concatenate(least_reachable_dense(cid_a, cid_b, near))
    return links.astype(np.int64), low


def _shared(a: list, b: list, same: bool) -> np.ndarray:
    """Sizes of all intersections, as products of 0/1 matrices over the shingles that both sides have, a few at a time."""
    flat = np.concatenate([x[3] for x in a] + ([] if same else [x[3] for x in b]))
    owner = np.repeat(np.arange(len(a) + (0 if same else len(b))), [len(x[3]) for x in a] + ([] if same else [len(x[3]) for x in b]))
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    sizes = np.diff(np.append(starts, len(flat)))
    col = np.repeat(np.arange(len(starts)), sizes)
    if same:
        use = sizes > 1
    else:
        left = np.zeros(len(starts), bool)
        left[col[owner < len(a)]] = True
        right = np.zeros(len(starts), bool)
        right[col[owner >= len(a)]] = True
        use = left & right
    rank = np.cumsum(use) - 1
    keep = use[col]
    col, owner = rank[col[keep]], owner[keep]
    out = np.zeros((len(a), len(b)), np.float32)
    width = max(64, min(4096, (1 << 24) // max(1, len(a) + len(b))))
    edges = np.searchsorted(col, np.arange(0, (rank[-1] if len(rank) else -1) + width + 1, width))
    for k, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        m = np.zeros((int(owner[s:e].max(initial=-1)) + 1 if same else len(a) + len(b), width), np.float32)
        m[owner[s:e], col[s:e] - k * width] = 1
        if same:
            out[: len(m), : len(m)] += m @ m.T
        else:
            out += m[: len(a)] @ m[len(a) :].T
    return out


def ngram_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, group_id, text_key, kept.

    Words are the lower-cased text's runs of ASCII letters, digits and non-ASCII characters. Two texts are linked when
    the Jaccard similarity of their sets of n-word shingles is at least ``similarity``; a text of fewer than n words has
    one shingle, all its words. ``class_id`` is the smallest doc_id with the same word sequence, ``n_links`` the number
    of other rows linked directly (copies included), ``group_id`` the smallest doc_id reachable by links. Null texts and
    texts without words link with nothing and stand alone. Rows with a null doc_id stand alone too, with null ids.
    Rows that repeat a doc_id are rows of their own: with the same text they link as copies do, with others by what they say.
    ``text_key`` (xxhash64 of the text) tells them apart; ``kept`` marks one text of each group, that of the smallest doc_id (of
    several texts under it, that of the smallest class key). Other columns are ignored. Empty table: no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    plan = MinHash(*band_plan(similarity, recall))
    signed = materialize(signatures(docs, id_col, text_col, n, plan), "signatures")
    worded = signed.where("k1 is not null and doc_id is not null")
    classes = worded.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    # A class goes by a number of its own: a doc_id may stand on several texts, and so on several classes.
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    grouped = materialize(clusters(classes), "clusters")
    members = classes.join(grouped.withColumnRenamed("cid", "_c"), F.col("cid") == F.col("_c")).select("cid", "rep", "k1", "k2", "copies", "bands", "root")
    # Texts of the class's smallest doc_id; those under it that are of another class fall out by their keys.
    texts = project(docs, doc_id=id_col, text=text_col).withColumn("text_key", F.xxhash64("text")).join(members, F.col("doc_id") == F.col("rep")).dropDuplicates(["cid", "text_key"])

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, bounds, *_ = words(column(batch, "text"))
        values, ends = shingles(hashes, bounds, n)
        keys = sequence_keys(hashes, bounds).view(np.int64)
        mine = np.flatnonzero((np.diff(bounds) > 0) & (keys[:, 0] == np.asarray(column(batch, "k1"))) & (keys[:, 1] == np.asarray(column(batch, "k2"))))
        each = [np.unique(values[ends[k] : ends[k + 1]]) for k in mine]
        sizes = np.array([len(x) for x in each], np.int64)
        raw = np.concatenate(each).tobytes() if each else b""
        rest = [column(batch, c).take(pa.array(mine)) for c in ("cid", "copies", "bands", "root")]
        return pa.RecordBatch.from_arrays([*rest, pa.array(sizes), binaries(raw, 8 * np.concatenate([[0], np.cumsum(sizes)]))], ["cid", "copies", "bands", "root", "size", "shingles"])

    full = materialize(map_arrow(texts, sets, "cid long, copies long, bands array<long>, root long, size long, shingles binary"), "shingles")
    # Blocks of a cluster: as many as its shingles and classes ask for. Each pair of blocks is one group of the verification.
    per = full.groupBy("root").agg(F.ceil(F.greatest(F.sum("size") / BLOCK_SHINGLES, F.count("*") / BLOCK_CLASSES)).cast("int").alias("blocks")).withColumnRenamed("root", "_root")
    dealt = full.join(per, F.col("root") == F.col("_root")).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks").cast("long")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("cid", "copies", "bands", "root", "shingles", "block", other).select("*", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    found = materialize(_verify(dealt, similarity), "links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links")).withColumnRenamed("cid", "_l")
    roots = components(found.where("low <> cid"), "cid", "low").select(F.col("node").alias("_n"), F.col("root").alias("_root"))
    # The class that stands for a component: that of the smallest doc_id.
    named = classes.select("cid", "rep", "k1", "k2").join(roots, F.col("cid") == F.col("_n"))
    least = named.groupBy("_root").agg(F.min(F.struct("rep", "k1", "k2", "cid")).alias("least")).select(F.col("_root").alias("_r"), "least")
    heads = named.join(least, F.col("_root") == F.col("_r")).select(F.col("cid").alias("_m"), F.col("least")["rep"].alias("group_id"), F.col("least")["cid"].alias("head"))
    per_class = classes.select("cid", "k1", "k2", F.col("rep").alias("class_id"), "copies").join(links, F.col("cid") == F.col("_l"), "left").join(heads, F.col("cid") == F.col("_m"), "left")
    per_class = per_class.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id"), (F.coalesce("head", "cid") == F.col("cid")).alias("head"), "copies")
    per_class = materialize(per_class, "per-class")
    alone = signed.where("k1 is null or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("group_id"), "text_key", F.lit(True).alias("kept"))
    out = join_hot(worded.drop("bands"), per_class, {"k1": "_k1", "k2": "_k2"}, "copies")
    return out.select("doc_id", "class_id", "n_links", "group_id", "text_key", (F.col("head") & (F.col("doc_id") == F.col("class_id"))).alias("kept")).unionByName(alone)


def _verify(dealt: DataFrame, similarity: float) -> DataFrame:
    """(cid, links, low): links each class found in a pair of blocks, weighted by copies, and the smallest class joined to it there."""

    def settle(group: list) -> tuple[list, list, list]:
        same = group[0][5] == group[0][6]
        a = [g for g in group if g[4] == g[5]]
        b = None if same else [g for g in group if g[4] != g[5]]
        if b is not None and (not a or not b):
            return [], [], []
        strip = lambda gs: [(g[0], g[1], np.array(g[2], np.int64), np.frombuffer(g[3], np.uint64)) for g in gs]
        a, b = strip(a), None if b is None else strip(b)
        links, low = _settle(a, b, similarity)
        cids = np.array([x[0] for x in (*a, *(b or []))], np.int64)
        some = np.flatnonzero(links)
        return cids[some].tolist(), links[some].tolist(), low[some].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        out: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            if len(group) > 1:
                for store, more in zip(out, settle(group), strict=True):
                    store.extend(more)

        for batch in batches:
            names = ("cid", "copies", "bands", "shingles", "block", "x", "y", "root")
            cols = [column(batch, n) for n in names]
            for k in range(batch.num_rows):
                row = [cols[0][k].as_py(), cols[1][k].as_py(), cols[2][k].values, cols[3][k].as_buffer(), cols[4][k].as_py(), cols[5][k].as_py(), cols[6][k].as_py(), cols[7][k].as_py()]
                if key != (row[7], row[5], row[6]):
                    close()
                    key, group = (row[7], row[5], row[6]), []
                if not group or (group[-1][0], group[-1][4]) != (row[0], row[4]):  # texts that say the same under one doc_id
                    group.append(row)
            if len(out[0]) > 10_000:
                yield pack(out)
                out = ([], [], [])
        close()
        yield pack(out)
        group.clear()
        tidy()

    def pack(out: tuple[list, list, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["cid", "links", "low"])

    return dealt.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", "cid").mapInArrow(run, "cid long, links long, low long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links", "group_id")


#: Brute force over shared shingles: exact where the join is approximate in the last ten-thousandth of its recall.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:least(i + 4, len(ws))], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE c >= 0.8 * (nx.n + ny.n - c) - 1e-9
), r AS (SELECT x AS a, x AS b FROM l UNION SELECT r.a, l.y FROM r JOIN l ON l.x = r.b
), k AS (SELECT doc_id, array_to_string(ws, ' ') AS seq FROM w WHERE len(ws) > 0)
SELECT d.doc_id, coalesce(min(k.doc_id) OVER (PARTITION BY k.seq), d.doc_id) AS class_id,
       coalesce(q.n_links, 0) AS n_links, coalesce(g.group_id, d.doc_id) AS group_id
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id
LEFT JOIN (SELECT x, count(*) AS n_links FROM l GROUP BY 1) q ON q.x = d.doc_id
LEFT JOIN (SELECT a, min(b) AS group_id FROM r GROUP BY 1) g ON g.a = d.doc_id
"""
# Documents without words share no sequence; each is its own class.
SQL = SQL.replace("coalesce(min(k.doc_id) OVER (PARTITION BY k.seq), d.doc_id)", "CASE WHEN k.seq IS NULL THEN d.doc_id ELSE min(k.doc_id) OVER (PARTITION BY k.seq) END")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near duplicates stays: that of the smallest doc_id. Rows with a null doc_id, null texts and texts
    without words stay. Where a doc_id stands on several texts each is judged by itself; rows that repeat both doc_id and text
    cannot be told apart and stay or go together. Empty table: no rows. All columns stay, whatever their names."""
    gone = ngram_jaccard(docs).where("not kept").select("doc_id", "text_key").distinct()
    doc, key = fresh(docs, "_doc", "_key")
    return docs.join(gone.toDF(doc, key), (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(key)), "left_anti")
