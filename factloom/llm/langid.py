"""Operator 7, language identification: a bidirectional gated recurrent network over bytes.

Every byte of a text gets a label distribution; a document's distribution is the mean over its bytes. Texts are run as
segments of 64 bytes (all of them: nothing is cut off), many side by side, so each step is one small matrix product.
Arrays are laid out (features, segments). Trained in numpy by backpropagation through time, with Adam.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, flat, map_arrow, materialize, project, tidy

#: Bytes in a segment, hidden units of a direction, training documents of a language at most (whole texts).
SEGMENT, HIDDEN, DOCS_PER_LANG = 64, 8, 400
#: Of the filtering stage: steps of training; the share of held-out documents a cut may cost, what is added to it for safety, the
#: least cut, and the sizes in bytes up to which texts have one of their own.
STAGE_STEPS, MAY_LOSE, MARGIN, LEAST_CUT, BANDS = 900, 0.001, 0.1, 0.25, (64, 256)
#: Bits of a score that one pass of ``at_rank`` settles.
DIGIT = 13
#: Label of what is in no learned language.
NOISE = "und"
#: First and last code points of scripts that noise is drawn from.
SCRIPTS = ((0x21, 0x7E), (0x30, 0x39), (0x370, 0x3FF), (0x400, 0x4FF), (0x5D0, 0x5EA), (0x620, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x3041, 0x3096), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
LETTER = re.compile(r"[^\W\d_]")


def _gates(g: np.ndarray, h: int) -> None:
    """In place: logistic function of the first 2h rows."""
    s = g[: 2 * h]
    s *= 0.5
    np.tanh(s, out=s)
    s *= 0.5
    s += 0.5


@dataclass
class BiGru:
    """table: (2, 3H, 256) input by byte; u: (2, 3H, H); bn: (2, H, 1); v: (2, L, H); c: (L, 1)."""

    langs: list[str]
    params: dict[str, np.ndarray]

    @staticmethod
    def fresh(langs: list[str], hidden: int = HIDDEN, seed: int = 7) -> BiGru:
        r = np.random.default_rng(seed)
        f = lambda *s, k: (r.standard_normal(s) * k).astype(np.float32)
        h, n = hidden, len(langs)
        return BiGru(langs, {"table": f(2, 3 * h, 256, k=0.3), "u": f(2, 3 * h, h, k=h**-0.5), "bn": f(2, h, 1, k=0), "v": f(2, n, h, k=0.3), "c": f(n, 1, k=0)})

    def run(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """x: (T, B) bytes. Logits (T, L, B), and what training needs of each step."""
        p, (steps, width), h = self.params, x.shape, self.params["u"].shape[2]
        logits = np.empty((steps, len(self.langs), width), np.float32)
        logits[:] = p["c"]
        saved = []
        for d in range(2):
            table, u, bn, v = p["table"][d], p["u"][d], p["bn"][d], p["v"][d]
            state, kept = np.zeros((h, width), np.float32), []
            gate, rec, tmp = np.empty((3 * h, width), np.float32), np.empty((3 * h, width), np.float32), np.empty((h, width), np.float32)
            for t in range(steps) if d == 0 else reversed(range(steps)):
                if keep:
                    gate, rec, tmp = np.empty_like(gate), np.empty_like(rec), np.empty_like(tmp)
                np.take(table, x[t], axis=1, out=gate, mode="clip")
                np.matmul(u, state, out=rec)
                gate[: 2 * h] += rec[: 2 * h]
                _gates(gate, h)
                un = rec[2 * h :]
                un += bn
                np.multiply(gate[h : 2 * h], un, out=tmp)
                n = gate[2 * h :]
                n += tmp
                np.tanh(n, out=n)
                before = state
                state = state - n
                state *= gate[:h]
                state += n
                logits[t] += v @ state
                if keep:
                    kept.append((t, gate, un, before, state))
            saved.append(kept)
        return logits, saved

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Cross-entropy at every valid position, and its gradients by backpropagation through time."""
        p, h = self.params, self.params["u"].shape[2]
        logits, saved = self.run(x, keep=True)
        prob = softmax(logits)
        total = max(1.0, float(mask.sum()))
        right = np.take_along_axis(prob, y[None, None, :].repeat(len(x), 0), 1)[:, 0]
        loss = float(-(np.log(right + 1e-9) * mask).sum() / total)
        d = prob
        d[:, y, np.arange(len(y))] -= 1
        d *= (mask / total)[:, None]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["c"][:, 0] = d.sum((0, 2))
        for way in range(2):
            u, v = p["u"][way], p["v"][way]
            back = np.zeros((h, x.shape[1]), np.float32)
            inputs = np.empty((3 * h, *x.shape), np.float32)
            for t, gate, un, before, after in reversed(saved[way]):
                z, r, n = gate[:h], gate[h : 2 * h], gate[2 * h :]
                g["v"][way] += d[t] @ after.T
                dh = v.T @ d[t] + back
                dan = dh * (1 - z) * (1 - n * n)
                daz = dh * (before - n) * z * (1 - z)
                dar = dan * un * r * (1 - r)
                dun = dan * r
                dg = np.concatenate([daz, dar, dun])
                g["u"][way] += dg @ before.T
                g["bn"][way] += dun.sum(1, keepdims=True)
                back = dh * z + u.T @ dg
                inputs[:, t] = np.concatenate([daz, dar, dan])
            flatx = x.ravel()
            for k in range(3 * h):
                g["table"][way, k] = np.bincount(flatx, inputs[k].ravel(), 256)
        return loss, g

    def fit(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray, steps: int = 260, batch: int = 256, rate: float = 0.02, seed: int = 3) -> float:
        """Adam on batches of segments (``pack``) drawn evenly over labels. Returns the mean loss of the last steps."""
        r, m, v2, losses = np.random.default_rng(seed), {}, {}, []
        pools = [np.flatnonzero(labels == k) for k in range(len(self.langs))]
        pools = [q for q in pools if len(q)]
        for step in range(1, steps + 1):
            pick = np.concatenate([r.choice(q, max(1, batch // len(pools))) for q in pools])
            loss, g = self.gradients(x[:, pick], labels[pick], mask[:, pick].astype(np.float32))
            losses.append(loss)
            lr = rate * min(1, 20 * (1 - (step - 1) / steps) / 10)
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            for k, a in g.items():
                a *= min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m.get(k, 0) + 0.1 * a
                v2[k] = 0.99 * v2.get(k, 0) + 0.01 * a * a
                self.params[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)
        return float(np.mean(losses[-20:])) if losses else 0.0

    def documents(self, data: np.ndarray, offsets: np.ndarray, width: int = 2048) -> np.ndarray:
        """Mean label distribution (documents, L) over the bytes of each text; zeros for an empty one."""
        sizes = np.diff(offsets)
        per = -(-sizes // SEGMENT)
        doc = np.repeat(np.arange(len(sizes)), per)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        starts, ends = offsets[:-1][doc] + nth * SEGMENT, offsets[1:][doc]
        out = np.zeros((len(self.langs), len(sizes)))
        for at in range(0, len(doc), width):
            s, e = starts[at : at + width], ends[at : at + width]
            where = s + np.arange(SEGMENT)[:, None]
            mask = where < e
            x = np.where(mask, data[np.minimum(where, len(data) - 1)], 0)
            prob = softmax(self.run(x)[0])
            prob *= mask[:, None]
            each = prob.sum(0)
            for k in range(len(self.langs)):
                out[k] += np.bincount(doc[at : at + width], each[k], len(sizes))
        return (out / np.maximum(sizes, 1)).T

    def positions(self, text: str) -> np.ndarray:
        """Label distribution (bytes, L) of every byte of one text."""
        raw = text.encode()
        x, mask = pack([raw[i : i + SEGMENT] for i in range(0, len(raw), SEGMENT)] or [b""])
        return softmax(self.run(x)[0]).transpose(2, 0, 1)[mask.T.astype(bool)]


def softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


def pack(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((SEGMENT, len(segments)), np.uint8)
    mask = np.zeros((SEGMENT, len(segments)), bool)
    for k, s in enumerate(segments):
        x[: len(s), k] = np.frombuffer(s, np.uint8)
        mask[: len(s), k] = True
    return x, mask


def pack_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, mask, text of each) of all segments of whole texts, without an object a segment."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    per = -(-sizes // SEGMENT)
    of = np.repeat(np.arange(len(texts)), per)
    start = (np.cumsum(sizes) - sizes)[of] + (np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)) * SEGMENT
    x, mask = np.zeros((SEGMENT, len(of)), np.uint8), np.zeros((SEGMENT, len(of)), bool)
    end = np.cumsum(sizes)[of]
    for k in range(SEGMENT):
        mask[k] = start + k < end
        x[k, mask[k]] = data[(start + k)[mask[k]]]
    return x, mask, of


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def noise(segments: np.ndarray, n: int, seed: int = 11) -> list[bytes]:
    """n segments in no language: three in four are letters of real segments in random order, the others random characters of
    some script, with blanks between runs of random lengths."""
    r, out = np.random.default_rng(seed), []
    for k in range(n):
        if k % 4 and len(segments):
            letters = list(bytes(segments[int(r.integers(len(segments)))]).decode("utf-8", "ignore"))
            r.shuffle(letters)
        else:
            low, high = SCRIPTS[int(r.integers(len(SCRIPTS)))]
            blank = r.random(SEGMENT) < (0, 0.05, 0.15)[int(r.integers(3))]
            letters = [" " if b else chr(c) for b, c in zip(blank, r.integers(low, high + 1, SEGMENT), strict=True)]
        at = int(r.integers(4))  # a segment may begin inside a character
        out.append("".join(letters).encode()[at : at + SEGMENT])
    return out


def _sample(rows: DataFrame, per_lang: int) -> DataFrame | None:
    """About ``per_lang`` rows of each language; a hash of doc_id picks them."""
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    scale = 1 << 30
    rate = F.element_at(F.create_map(*[F.lit(x) for k in sorted(counts) for x in (k, int(min(1.0, per_lang / counts[k]) * scale))]), F.col("lang"))
    return rows.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(scale)) < rate)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG, steps: int = 260, with_noise: bool = False) -> BiGru | None:
    """Fit on a bounded sample of rows: about ``docs_per_lang`` documents of each language (a doc_id hash picks them), with
    their whole texts. Held-out rows and rows with null text or language have no part. ``with_noise`` adds a label ``und``,
    learned from as much generated noise as a language has segments. None if there is nothing to learn from."""
    rows = project(docs, doc_id=id_col, text=text_col, lang=lang_col).where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    picked = _sample(rows, docs_per_lang)
    if picked is None:
        return None

    got = sorted((r["lang"], r["text"].encode()) for r in picked.select("lang", "text").where("length(text) > 0").collect())
    if not got:
        return None
    langs = sorted({k for k, _ in got})
    number = {k: i for i, k in enumerate(langs)}
    x, mask, of = pack_texts([t for _, t in got])
    labels = np.array([number[k] for k, _ in got])[of]
    del got
    if with_noise:
        whole = np.flatnonzero(mask.all(0))
        more, there = pack(noise(x[:, whole].T, max(256, len(of) // len(langs))))
        x, mask, labels = np.concatenate([x, more], 1), np.concatenate([mask, there], 1), np.concatenate([labels, np.full(more.shape[1], len(langs))])
        langs = [*langs, NOISE]
    model = BiGru.fresh(langs)
    model.fit(x, mask, labels, steps)
    del x, mask
    tidy()  # the driver keeps no more than the model
    return model


def noise_cuts(docs: DataFrame, model: BiGru) -> np.ndarray:
    """By band of size, the share of ``und`` above which a text goes: what at most MAY_LOSE of all held-out documents with a
    language (whole texts with letters) pass, and MARGIN; never under LEAST_CUT. A half in a band without any.

    Every such document is scored. Its band and score are written, 12 bytes a row, and the driver gets counts only."""
    out = np.full(len(BANDS) + 1, 0.5)
    rows = project(docs, doc_id="doc_id", text="text", lang="lang").where(held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = flat(column(batch, "text"))
        share = np.maximum(model.documents(data, offsets)[:, -1], 0.0)
        return pa.RecordBatch.from_arrays([pa.array(bands(np.diff(offsets)).astype(np.int32)), pa.array(share.view(np.int64))], ["band", "bits"])

    scores = materialize(map_arrow(rows.select("text"), score, "band int, bits long"), "noise")
    sizes = {r[0]: r[1] for r in scores.groupBy("band").count().collect()}
    for k, share in at_rank(scores, {k: int(np.ceil((n - 1) * (1 - MAY_LOSE))) for k, n in sizes.items()}).items():
        out[k] = max(LEAST_CUT, share + MARGIN)
    return out


def at_rank(scores: DataFrame, ranks: dict[int, int]) -> dict[int, float]:
    """By band, the score at a position (from 0) in ascending order, exactly. ``scores``: (band, bits), bits of a double that is
    not negative, which sort as the numbers do. Their digits are settled one by one, the highest first, from counts of the rows
    that agree in those before: a few thousand counts a band and pass, and no task gets all rows, nor all that are equal."""
    found = dict.fromkeys(ranks, 0)
    for shift in range(4 * DIGIT, -1, -DIGIT) if ranks else ():
        top = F.shiftright("bits", shift)
        agree = F.lit(False)
        for k, x in found.items():
            agree |= (F.col("band") == k) & top.between(x << DIGIT, (x + 1 << DIGIT) - 1)
        counts = scores.where(agree).groupBy("band", top.alias("top")).count().collect()
        for k in found:
            values, n = np.array(sorted((r[1], r[2]) for r in counts if r[0] == k)).T
            below = np.cumsum(n) - n
            i = np.searchsorted(below, ranks[k], "right") - 1
            found[k], ranks = int(values[i]), ranks | {k: ranks[k] - int(below[i])}
    return {k: float(np.int64(x).view(np.float64)) for k, x in found.items()}


def bands(sizes: np.ndarray) -> np.ndarray:
    return np.searchsorted(BANDS, sizes, "left")


def predict(docs: DataFrame, model: BiGru | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter (empty ones too) are ``und`` with score 0; so is all without a model. Ties take
    the language first in alphabetical order. Whole texts, any length. Empty table: no rows. Other columns are ignored.
    """
    rows = project(docs, doc_id=id_col, text=text_col).withColumn("held_out", held_out())
    kind = dict(rows.dtypes)["doc_id"]

    def label(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = column(batch, "text")
        lettered = np.array([x is not None and LETTER.search(x) is not None for x in text.to_pylist()])
        if model is None:
            lettered[:] = False
            best, score = np.zeros(len(text), int), np.zeros(len(text))
        else:
            prob = model.documents(*flat(text))
            best, score = prob.argmax(1), prob.max(1)
        names = np.array([*(model.langs if model else []), "und"], object)
        out = names[np.where(lettered, best, len(names) - 1)]
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held_out"), pa.array(out, pa.string()), pa.array(np.where(lettered, np.clip(score, 0, 1), 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return map_arrow(rows, label, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay. Null texts and texts without a letter go, and those the network, taught noise as a
    further label, finds to be noise by more than ``noise_cuts`` allows texts of their size. Rows with a null or repeated doc_id are judged like any other,
    each by its text. Without labelled rows only texts without a letter go. Empty table: no rows. All columns stay, whatever
    their names."""
    model = train(docs, steps=STAGE_STEPS, with_noise=True)
    cuts = None if model is None else noise_cuts(docs, model)
    names = docs.columns
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = column(batch, "text")
        ok = np.array([x is not None and LETTER.search(x) is not None for x in text.to_pylist()])
        if model is not None:
            data, offsets = flat(text)
            ok &= model.documents(data, offsets)[:, -1] <= cuts[bands(np.diff(offsets))]
        return batch.filter(pa.array(ok))

    return map_arrow(docs, keep, ", ".join(f"`{n}` {kinds[n]}" for n in names))
