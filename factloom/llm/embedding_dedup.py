"""Operator 8, embedding near-dedup: epsilon grid order join.

Unit vectors with cosine >= c lie within eps = sqrt(2 - 2c) of each other, and a projection on orthonormal directions
brings no two farther apart. So vectors are sorted by the eps-grid cells of their leading principal coordinates; the
sequence is cut into intervals, intervals whose boxes are farther apart than eps are skipped - first runs of blocks, then
blocks, then halves of blocks - and what remains is compared in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, map_arrow, materialize, numbered, project, ship
from .components import components, least_reachable

#: Principal coordinates of the grid, vectors of a block, blocks of a run, vectors of an interval that is not halved again.
LEADING, BLOCK, RUN, LEAF = 6, 2048, 32, 64
#: Principal coordinates by whose cells runs meet.
MET = 2
#: Vectors (about) on which the principal directions are fitted. They only steer what is skipped, never what is found.
SAMPLE = 10_000


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, first by their largest component so that nothing overflows."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rows_of(lists: pa.Array) -> list[np.ndarray]:
    values = np.asarray(lists.values if hasattr(lists, "values") else lists.flatten())
    offsets = np.asarray(lists.offsets)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def principal(sample: np.ndarray, leading: int) -> np.ndarray:
    """Orthonormal directions (dims, leading), of the largest variance first."""
    centred = sample - sample.mean(0)
    _, vectors = np.linalg.eigh(centred.T @ centred)
    return np.ascontiguousarray(vectors[:, ::-1][:, :leading])


def box_gap(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> float:
    """Squared distance of two boxes."""
    gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float(gap @ gap)


def interval_join(a: np.ndarray, pa_: np.ndarray, b: np.ndarray, pb: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Recursive join of two sequence intervals (unit vectors and their projections): index pairs with that cosine at least."""
    eps2 = (2 - 2 * cosine) * (1 + 1e-9) + 1e-12
    left, right = [], []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        s, e, t, f = todo.pop()
        if s >= e or t >= f or same and f <= s:
            continue
        if box_gap(pa_[s:e].min(0), pa_[s:e].max(0), pb[t:f].min(0), pb[t:f].max(0)) > eps2:
            continue
        if e - s <= LEAF and f - t <= LEAF:
            i, j = np.nonzero(a[s:e] @ b[t:f].T >= cosine)
            i, j = i + s, j + t
            if same:
                i, j = i[i < j], j[i < j]
            left.append(i)
            right.append(j)
            continue
        m, k = (s + e) // 2, (t + f) // 2
        halves_a = [(s, m), (m, e)] if e - s > LEAF else [(s, e)]
        halves_b = [(t, k), (k, f)] if f - t > LEAF else [(t, f)]
        todo += [(*x, *y) for x in halves_a for y in halves_b]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def near_dedup(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors are linked when their labels are equal and not null and their cosine, in double precision, is at least
    ``cosine`` (above 0). Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing, nor
    do vectors of different length or rows with a null id; each is a component of its own and kept. Equal vectors join as
    one and count as links of each other. Rows that share a vec_id are vectors of their own. Empty table: no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = project(vectors, vec_id=id_col, embedding=vector_col, label=label_col)
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
    sound &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    # A class goes by a number of its own: a vec_id may stand on several vectors, and so on several classes.
    classes = rows.where("sound").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("dims", F.size("embedding")).withColumn("cid", F.monotonically_increasing_id()), "vectors")
    directions = _directions(classes)
    kind = dict(classes.dtypes)

    def cells(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = np.zeros((batch.num_rows, LEADING))
        each, dims = rows_of(column(batch, "embedding")), np.asarray(column(batch, "dims"))
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            u = unit(np.stack([each[k] for k in at])) @ directions[int(d)]
            out[at, : u.shape[1]] = u
        coordinates = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, LEADING, np.int32)), pa.array(out.ravel()))
        return pa.RecordBatch.from_arrays([*batch.columns, coordinates], [*batch.schema.names, "at"])

    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-9
    placed = map_arrow(classes.drop("rep"), cells, f"label {kind['label']}, embedding {kind['embedding']}, copies long, dims int, cid long, at array<double>", text=None)
    grid = [F.floor(F.col("at")[k] / eps).alias(f"c{k}") for k in range(LEADING)]
    laid = numbered(placed.select("*", *grid), ["label", "dims", *[f"c{k}" for k in range(LEADING)], "cid"])
    laid = materialize(laid.select("label", "dims", "cid", "copies", "embedding", "at", F.floor(F.col("row_number") / BLOCK).alias("block")), "ego")
    pairs = _block_pairs(laid, eps)
    mine = laid.join(pairs.select("label", "dims", F.col("x").alias("block"), "x", "y"), ["label", "dims", "block"])
    theirs = laid.join(pairs.where("x <> y").select("label", "dims", F.col("y").alias("block"), "x", "y"), ["label", "dims", "block"])
    found = materialize(_compare(mine.unionByName(theirs), cosine), "links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links")).withColumnRenamed("cid", "_r")
    roots = components(found.where("low <> cid"), "cid", "low").select(F.col("node").alias("_n"), "root")
    named = classes.select("cid", "rep").join(roots, F.col("cid") == F.col("_n")).select("cid", "rep", "root")
    least = named.groupBy("root").agg(F.min("rep").alias("least")).withColumnRenamed("root", "_root")
    heads = named.join(least, F.col("root") == F.col("_root")).select(F.col("cid").alias("_m"), "least")
    per_class = classes.join(links, F.col("cid") == F.col("_r"), "left").join(heads, F.col("cid") == F.col("_m"), "left")
    per_class = per_class.select(F.col("label").alias("_l"), F.col("embedding").alias("_e"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    joined = rows.where("sound").join(per_class, (F.col("label") == F.col("_l")) & (F.col("embedding") == F.col("_e"))).select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _directions(classes: DataFrame) -> dict[int, np.ndarray]:
    counts = {r[0]: r[1] for r in classes.groupBy("dims").count().collect()}
    out = {}
    for dims, n in counts.items():
        share = int(min(1.0, SAMPLE / n) * (1 << 30))
        got = classes.where((F.col("dims") == dims) & (F.pmod(F.xxhash64("embedding", F.lit("sample")), F.lit(1 << 30)) < share)).select("embedding").collect()
        sample = unit(np.array(sorted(r[0] for r in got), np.float64)) if got else np.zeros((1, dims))
        out[dims] = principal(sample, min(LEADING, dims))
    return out


def _block_pairs(laid: DataFrame, eps: float) -> DataFrame:
    """(label, dims, x, y), x <= y: blocks whose boxes are within eps, found by way of runs of blocks whose boxes are."""
    ends = [f(F.col("at")[k]).alias(f"{n}{k}") for k in range(LEADING) for n, f in (("lo", F.min), ("hi", F.max))]
    blocks = materialize(laid.groupBy("label", "dims", "block").agg(*ends).withColumn("run", F.floor(F.col("block") / RUN)), "blocks")
    wider = [f(f"{n}{k}").alias(f"{n}{k}") for k in range(LEADING) for n, f in (("lo", F.min), ("hi", F.max))]
    runs = blocks.groupBy("label", "dims", "run").agg(*wider)

    def near(a: str, b: str) -> F.Column:
        gap = [F.greatest(F.lit(0.0), F.col(f"{a}lo{k}") - F.col(f"{b}hi{k}"), F.col(f"{b}lo{k}") - F.col(f"{a}hi{k}")) for k in range(LEADING)]
        return sum((g * g for g in gap), F.lit(0.0)) <= eps * eps

    def named(df: DataFrame, p: str, only: set[str] = frozenset({"label", "dims"})) -> DataFrame:
        return df.select(*[F.col(c).alias(c if c in only else p + c) for c in df.columns])

    def cells(p: str, more: int) -> list[F.Column]:
        """The cells of the first MET coordinates that a run's box touches, ``more`` cells wider."""
        return [F.sequence(F.floor(F.col(f"{p}lo{k}") / eps) - more, F.floor(F.col(f"{p}hi{k}") / eps) + more) for k in range(MET)]

    left, right = named(runs, "a_"), named(runs, "b_")
    for k in range(MET):
        left = left.withColumn(f"cell{k}", F.explode(cells("a_", 0)[k]))
        right = right.withColumn(f"cell{k}", F.explode(cells("b_", 1)[k]))
    met = left.join(right, ["label", "dims", *[f"cell{k}" for k in range(MET)]]).where("a_run <= b_run")
    run_pairs = met.where(near("a_", "b_")).select("label", "dims", "a_run", "b_run").distinct()
    both = run_pairs.join(named(blocks, "a_"), ["label", "dims", "a_run"]).join(named(blocks, "b_"), ["label", "dims", "b_run"])
    return both.where("a_block <= b_block").where(near("a_", "b_")).select("label", "dims", F.col("a_block").alias("x"), F.col("b_block").alias("y"))


def _compare(dealt: DataFrame, cosine: float) -> DataFrame:
    """(cid, links, low): links each class finds in a pair of blocks, weighted by copies, and the smallest class joined to it."""

    def settle(t: pa.Table) -> tuple:
        block, x, y = (np.asarray(t[n].combine_chunks()) for n in ("block", "x", "y"))
        cid, copies = np.asarray(t["cid"].combine_chunks()), np.asarray(t["copies"].combine_chunks())
        u = unit(np.stack(rows_of(t["embedding"].combine_chunks())))
        at = np.stack(rows_of(t["at"].combine_chunks()))
        same = x[0] == y[0]
        a, b = np.flatnonzero(block == x[0]), np.flatnonzero(block == y[0])
        i, j = interval_join(u[a], at[a], u[b], at[b], cosine, same)
        i, j = a[i], b[j]
        links = np.bincount(i, copies[j], len(cid)) + np.bincount(j, copies[i], len(cid))
        low = least_reachable(cid, i, j)
        some = np.flatnonzero(links)
        return cid[some], links[some].astype(np.int64), low[some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            keys = list(zip(column(batch, "label").to_pylist(), column(batch, "dims").to_pylist(), column(batch, "x").to_pylist(), column(batch, "y").to_pylist(), strict=True))
            start = 0
            for k in range(len(keys)):
                if keys[k] != key:
                    if k > start:
                        held.append(batch.slice(start, k - start))
                    if held:
                        yield pack(settle(pa.Table.from_batches(held)))
                    held, key, start = [], keys[k], k
            held.append(batch.slice(start))
        if held:
            yield pack(settle(pa.Table.from_batches(held)))

    def pack(cols: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["cid", "links", "low"])

    return dealt.select("label", "dims", "x", "y", "block", "cid", "copies", "embedding", "at").repartition("label", "dims", "x", "y").sortWithinPartitions("label", "dims", "x", "y", "block", *[F.col("at")[k] for k in range(LEADING)]).mapInArrow(run, "cid long, links long, low long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (SELECT x AS a, x AS b FROM l UNION SELECT r.a, l.y FROM r JOIN l ON l.x = r.b)
SELECT d.vec_id, coalesce(q.n, 0) AS n_links, coalesce(g.c, d.vec_id) AS component_id, d.vec_id = coalesce(g.c, d.vec_id) AS kept
FROM embeddings d LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY 1) q ON q.x = d.vec_id
LEFT JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) g ON g.a = d.vec_id
"""
