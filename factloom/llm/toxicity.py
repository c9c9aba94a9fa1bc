"""Operator 4, toxicity: a convolutional text classifier over hashed word embeddings.

A word's vector is the sum of the embeddings of four hashed features (the word, its first four, five and six bytes).
Filters one, two and three words wide, rectified, are pooled by their maximum over the whole text and feed a logistic
unit. Trained in numpy with Adam; gradients flow through the positions of the maxima only. The cut of the score (0.5) is
calibrated on a validation part of the training sample, and further thresholds by language for those who want them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, map_arrow, project
from .hashing import Rolling, words

#: Feature buckets (the last stands for padding), embedding size, filters of each width, widths.
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 4, (1, 2, 3)
#: Training documents of each class at most, with their whole texts.
DOCS_PER_CLASS = 2000
#: Training documents a bucket must occur in; steps of training at least.
MIN_DOCS, MIN_STEPS = 4, 400
PREFIXES = (4, 5, 6)
SLOTS = [(w, k) for w in WIDTHS for k in range(w)]  # (width, offset): a block of FILTERS columns each
_roll = Rolling(23)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words, 4) bucket numbers, and where each text's words begin. Two padding words end every text."""
    hashes, bounds, data, starts, ends = words(texts)
    n = len(bounds) - 1
    out_bounds = bounds + 2 * np.arange(n + 1)
    ids = np.full((int(out_bounds[-1]), 1 + len(PREFIXES)), BUCKETS - 1, np.uint16)
    if len(hashes):
        at = np.arange(len(hashes)) + 2 * np.repeat(np.arange(n), np.diff(bounds))
        sums = _roll.sums(data)
        ids[at, 0] = hashes % np.uint64(BUCKETS - 1)
        for k, size in enumerate(PREFIXES, 1):
            ids[at, k] = (_roll.of(sums, starts, np.minimum(ends, starts + size)) + np.uint64(k)) % np.uint64(BUCKETS - 1)
    return ids, out_bounds


@dataclass
class Cnn:
    params: dict[str, np.ndarray]
    thresholds: dict[str, float] = field(default_factory=dict)  # by language, on the score
    shift: float = 0.0

    @staticmethod
    def fresh(seed: int = 5) -> Cnn:
        r = np.random.default_rng(seed)
        f = lambda *s, k: (r.standard_normal(s) * k).astype(np.float32)
        e = f(BUCKETS, DIM, k=0.1)
        e[-1] = 0
        return Cnn({"e": e, "w": f(DIM, len(SLOTS) * FILTERS, k=0.3), "b": f(len(WIDTHS) * FILTERS, k=0), "v": f(len(WIDTHS) * FILTERS, k=0.3), "c": f(1, k=0)})

    def table(self) -> np.ndarray:
        """Each bucket's share in each filter column."""
        return (self.params["e"] @ self.params["w"]).astype(np.float32)

    def pooled(self, ids: np.ndarray, bounds: np.ndarray, table: np.ndarray, want: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Maximum of each filter over each text, and the word where it first is reached."""
        at = ids.T.astype(np.int64)
        y, more = np.take(table, at[0], axis=0, mode="clip"), np.empty((len(ids), table.shape[1]), np.float32)
        for k in range(1, len(at)):
            y += np.take(table, at[k], axis=0, out=more, mode="clip")
        y = np.ascontiguousarray(y.T)  # a row for each filter column: what follows runs along words
        n = len(bounds) - 1
        out = np.empty((len(WIDTHS) * FILTERS, n), np.float32)
        where = np.empty((len(WIDTHS) * FILTERS, n), np.int64) if want else None
        slot = 0
        for i, width in enumerate(WIDTHS):
            conv = y[slot * FILTERS : (slot + 1) * FILTERS]
            for k in range(1, width):
                conv[:, :-k] += y[(slot + k) * FILTERS : (slot + k + 1) * FILTERS, k:]
            for k in range(1, width):  # no filter reaches into the next text
                conv[:, bounds[1:] - k] = -1e30
            part = slice(i * FILTERS, (i + 1) * FILTERS)
            out[part] = np.maximum.reduceat(conv, bounds[:-1], axis=1)
            if want:
                at = np.where(conv == np.repeat(out[part], np.diff(bounds), axis=1), np.arange(conv.shape[1]), conv.shape[1])
                where[part] = np.minimum.reduceat(at, bounds[:-1], axis=1)
            slot += width
        return out.T, where.T if want else None

    def logits(self, ids: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> np.ndarray:
        best, _ = self.pooled(ids, bounds, table)
        return np.maximum(best + self.params["b"], 0) @ self.params["v"] + self.params["c"][0]

    def scores(self, ids: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(ids, bounds, table).astype(np.float64) - self.shift)

    def fit(self, docs: list[np.ndarray], y: np.ndarray, langs: list[str | None], epochs: int = 12, batch: int = 64, rate: float = 0.01, drop: float = 0.3, seed: int = 9) -> float:
        """Adam with word dropout; the epoch with the least validation loss stays. Returns that loss."""
        r = np.random.default_rng(seed)
        order = r.permutation(len(docs))
        cut = max(1, len(order) // 5) if len(order) > 4 else 0
        held, use = order[:cut], order[cut:]
        p, m, v2 = self.params, {}, {}
        best, best_loss, step = {k: a.copy() for k, a in p.items()}, np.inf, 0
        # A bucket seen in fewer than MIN_DOCS training documents says nothing general: it stays at zero.
        seen = np.zeros(BUCKETS, np.int64)
        for k in use:
            seen[np.unique(docs[k])] += 1
        live = (seen >= MIN_DOCS)[:, None]
        p["e"] *= live
        epochs = max(epochs, -(-MIN_STEPS * batch // max(1, len(use))))
        weight = np.where(y == 1, 0.5 / max(1e-9, (y == 1).mean()), 0.5 / max(1e-9, (y == 0).mean()))
        for _ in range(epochs):
            r.shuffle(use)
            for at in range(0, len(use), batch):
                pick = use[at : at + batch]
                ids, bounds = join([docs[k] for k in pick])
                ids[r.random(len(ids)) < drop] = BUCKETS - 1
                g = self._gradients(ids, bounds, y[pick], weight[pick])
                step += 1
                for k, a in g.items():
                    m[k] = m[k] * 0.9 + 0.1 * a if k in m else 0.1 * a
                    v2[k] = v2[k] * 0.99 + 0.01 * a * a if k in v2 else 0.01 * a * a
                    p[k] -= rate * ((m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-6) + (1e-4 * p[k] if k in "ew" else 0))
                p["e"] *= live
                p["e"][-1] = 0
            loss = self._loss(docs, y, held if cut else use, weight)
            if loss < best_loss:
                best_loss, best = loss, {k: a.copy() for k, a in p.items()}
        self.params = best
        self._calibrate(docs, y, langs, held if cut else use)
        return best_loss

    def _gradients(self, ids: np.ndarray, bounds: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, table = self.params, self.table()
        best, where = self.pooled(ids, bounds, table, want=True)
        hidden = np.maximum(best + p["b"], 0)
        d = ((sigmoid(hidden @ p["v"] + p["c"][0]) - y) * weight / len(y)).astype(np.float32)
        dh = d[:, None] * p["v"] * (hidden > 0)
        g = {"v": hidden.T @ d, "c": np.array([d.sum()], np.float32), "b": dh.sum(0), "e": np.zeros_like(p["e"]), "w": np.zeros_like(p["w"])}
        for s, (width, k) in enumerate(SLOTS):
            for f in range(FILTERS):
                col, i = s * FILTERS + f, WIDTHS.index(width) * FILTERS + f
                three = ids[np.minimum(where[:, i] + k, len(ids) - 1)]
                g["w"][:, col] += dh[:, i] @ p["e"][three].sum(1)
                np.add.at(g["e"], three.ravel(), np.repeat(dh[:, i], three.shape[1])[:, None] * p["w"][:, col])
        g["e"][-1] = 0
        return g

    def _loss(self, docs: list[np.ndarray], y: np.ndarray, some: np.ndarray, weight: np.ndarray) -> float:
        z = self._logits_of([docs[k] for k in some])
        return float((np.logaddexp(0, np.where(y[some] == 1, -z, z)) * weight[some]).mean())

    def _logits_of(self, docs: list[np.ndarray], batch: int = 200) -> np.ndarray:
        table, out = self.table(), []
        for at in range(0, len(docs), batch):
            out.append(self.logits(*join(docs[at : at + batch]), table))
        return np.concatenate(out).astype(np.float64) if out else np.zeros(0)

    def _calibrate(self, docs: list[np.ndarray], y: np.ndarray, langs: list[str | None], some: np.ndarray) -> None:
        """Shift logits so that 0.5 is the cut with the best F1 over the validation part; then one cut a language."""
        z, truth = self._logits_of([docs[k] for k in some]), y[some]
        self.shift = best_cut(z, truth)
        spoken = np.array([langs[k] or "" for k in some])
        for lang in sorted(set(spoken)):
            own = spoken == lang
            if truth[own].sum() >= 5 and (1 - truth[own]).sum() >= 5:
                self.thresholds[lang] = float(sigmoid(np.array(best_cut(z[own], truth[own]) - self.shift)))


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """Middle of the widest gap among the cuts with the greatest F1."""
    if not len(z) or not y.any() or y.all():
        return 0.0
    order = np.argsort(-z)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
    zs = np.append(z[order], z.min() - 1)
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = top[np.argmax(zs[top] - zs[top + 1])]
    return float((zs[k] + zs[k + 1]) / 2)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def join(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])])


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, docs_per_class: int = DOCS_PER_CLASS, epochs: int = 12) -> Cnn | None:
    """Fit on a bounded sample of rows: about ``docs_per_class`` labelled documents of each class, picked by a hash of doc_id, with
    their whole texts. Held-out rows have no part. A document
    labelled more than once counts as toxic if any label says so; null labels are left out. None without two classes."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(~held_out())
    counts = {r[0]: r[1] for r in marks.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    scale = 1 << 30
    rate = F.when(F.col("toxic") == 1, int(min(1.0, docs_per_class / counts.get(1, 1)) * scale)).otherwise(int(min(1.0, docs_per_class / counts.get(0, 1)) * scale))
    picked = marks.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.lit(scale)) < rate).select(F.col("doc_id").alias("_k"), "toxic")
    # The sample has a bound, so it may be broadcast.
    rows = project(docs, doc_id="doc_id", text="text", lang="lang").join(F.broadcast(picked), F.col("doc_id") == F.col("_k"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, bounds = features(column(batch, "text"))
        out = [np.ascontiguousarray(ids[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), column(batch, "toxic"), column(batch, "lang"), column(batch, "doc_id")], ["ids", "toxic", "lang", "doc_id"])

    kinds = dict(rows.dtypes)
    got = sorted(map_arrow(rows, cut, f"ids binary, toxic {kinds['toxic']}, lang {kinds['lang']}, doc_id {kinds['doc_id']}").collect(), key=lambda r: (r["doc_id"], bytes(r["ids"])))
    y = np.array([int(r["toxic"]) for r in got])
    if not len(y) or y.min() == y.max():
        return None
    model = Cnn.fresh()
    model.fit([np.frombuffer(bytes(r["ids"]), np.uint16).reshape(-1, 1 + len(PREFIXES)) for r in got], y, [r["lang"] for r in got], epochs)
    return model


def score(docs: DataFrame, model: Cnn | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, flagged.

    ``score`` depends on the text alone; ``predicted`` is score >= 0.5; ``flagged`` compares the score with the threshold
    calibrated for the row's language (0.5 where there is none). Null and empty texts are scored as texts without words;
    without a model every score is 0. Empty table: no rows. Other columns are ignored.
    """
    rows = project(docs, doc_id="doc_id", text="text", lang="lang").withColumn("held_out", held_out())
    table = model.table() if model else None
    slim = Cnn({k: v for k, v in model.params.items() if k in "bvc"}, model.thresholds, model.shift) if model else None
    held = docs.sparkSession.sparkContext.broadcast(table)  # 3 MB by its parameters, whatever the data

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = column(batch, "text")
        s = slim.scores(*features(text), held.value) if slim else np.zeros(len(text))
        cut = np.array([slim.thresholds.get(x or "", 0.5) if slim else 0.5 for x in column(batch, "lang").to_pylist()])
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(s >= cut)], ["doc_id", "held_out", "score", "predicted", "flagged"])

    return map_arrow(rows, each, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int, flagged boolean", step=1 << 17)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
