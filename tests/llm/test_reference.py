"""The registered queries of operators without SQL, against plain-Python versions of their own making, document by document."""

import math
import re
import time
import zlib

import numpy as np
import pytest

from factloom.llm import exact_dedup, langid, packing, sentencepiece_codec, sharding, toxicity

from .helpers import SF
from .test_operators import brute_exact, check_packing, same


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.collect()]


def logistic(x):
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def slow_language(model, raw: bytes) -> np.ndarray:
    """Mean label distribution of a text, byte by byte."""
    p = {k: v.astype(np.float64) for k, v in model.params.items()}
    h, total = p["u"].shape[2], np.zeros(len(model.langs))
    for at in range(0, len(raw), langid.SEGMENT):
        piece = raw[at : at + langid.SEGMENT]
        # What stands behind the end of a text is zero bytes; the backward direction starts there.
        padded = piece + b"\0" * (langid.SEGMENT - len(piece))
        logits = np.repeat(p["c"].T, len(padded), 0)
        for way in (0, 1):
            state = np.zeros(h)
            for t in range(len(padded)) if way == 0 else reversed(range(len(padded))):
                into, back = p["table"][way][:, padded[t]], p["u"][way] @ state
                z = np.array([logistic(x) for x in into[:h] + back[:h]])
                r = np.array([logistic(x) for x in into[h : 2 * h] + back[h : 2 * h]])
                n = np.tanh(into[2 * h :] + r * (back[2 * h :] + p["bn"][way][:, 0]))
                state = (1 - z) * n + z * state
                logits[t] += p["v"][way] @ state
        for t in range(len(piece)):
            e = np.exp(logits[t] - logits[t].max())
            total += e / e.sum()
    return total / max(1, len(raw))


def test_language_query(spark, docs, rows):
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.query(spark, SF).collect()}
    assert len(got) == len(rows)
    for d, text, *_ in rows[:40]:
        want = slow_language(model, (text or "").encode()[:2000]) if len((text or "").encode()) <= 2000 else None
        r = got[d]
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1)
        if not re.search(r"[^\W\d_]", text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif want is not None:
            assert abs(r["score"] - want.max()) < 1e-4 and (r["lang_pred"] == model.langs[want.argmax()] or np.sort(want)[-1] - np.sort(want)[-2] < 1e-4)
    held = [r for r in rows if got[r[0]]["held_out"] and r[2]]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in held) >= 0.9 * len(held)


def slow_toxicity(model, ids: np.ndarray) -> float:
    """Score of one text: every filter at every place, one product at a time. ids: (words and two padding words, features)."""
    p = {k: v.astype(np.float64) for k, v in model.params.items()}
    vectors = [sum(p["e"][f] for f in word) for word in ids]
    out, slot = float(p["c"][0]), 0
    for i, width in enumerate(toxicity.WIDTHS):
        for k in range(toxicity.FILTERS):
            filters = [p["w"][:, (slot + j) * toxicity.FILTERS + k] for j in range(width)]
            best = max(sum(float(v @ w) for v, w in zip(vectors[a : a + width], filters, strict=True)) for a in range(len(vectors) - width + 1))
            c = i * toxicity.FILTERS + k
            out += max(0.0, best + float(p["b"][c])) * float(p["v"][c])
        slot += width
    return logistic(out - model.shift)


def test_toxicity_query(spark, docs, rows):
    import pyarrow as pa

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.query(spark, SF).collect()}
    assert len(got) == len(rows)
    for d, text, *_ in rows[:60]:
        want = slow_toxicity(model, toxicity.features(pa.array([text or ""]))[0])
        r = got[d]
        assert abs(r["score"] - want) < 1e-3 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0)


def test_toxicity_thresholds_by_language(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert model.thresholds and all(0 < t < 1 for t in model.thresholds.values())
    lang = {r[0]: r[1] for r in docs.select("doc_id", "lang").collect()}
    assert all(r["flagged"] == (r["score"] >= model.thresholds.get(lang[r["doc_id"]], 0.5)) for r in toxicity.score(docs, model).collect())


def slow_place(x: int, n: int, seed: int = 42, rounds: int = 6) -> int:
    """The permutation in plain integers."""
    mask = (1 << 64) - 1

    def stir(v):
        v ^= v >> 33
        v = v * 0xFF51AFD7ED558CCD & mask
        v ^= v >> 29
        v = v * 0xC4CEB9FE1A85EC53 & mask
        return v ^ v >> 32

    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    keys = [stir((i + seed * 1_000_003) * 0x9E3779B97F4A7C15 & mask) for i in range(1, rounds + 1)]
    while True:
        left, right = divmod(x, b)
        for i, key in enumerate(keys):
            if i % 2:
                left = (left + stir((right * 0x9E3779B97F4A7C15 + key) & mask) % a) % a
            else:
                right = (right + stir((left * 0x9E3779B97F4A7C15 + key) & mask) % b) % b
        x = left * b + right
        if x < n:
            return x


def test_sharding_query(spark, rows):
    got = {r["doc_id"]: r for r in sharding.query(spark, SF).collect()}
    assert len(got) == len(rows)
    for k, (d, text, *_) in enumerate(sorted(rows, key=lambda r: r[0])):
        raw = (text or "").encode()
        p = slow_place(k, len(rows))
        r = got[d]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        assert (r["shard"], r["slot"]) == (p % 40, p // 40)


def test_exact_query(spark, rows):
    same(exact_dedup.query(spark, SF).collect(), brute_exact(rows))


def test_packing_query(spark, rows):
    check_packing(packing.query(spark, SF).collect(), [r[1] for r in rows], 1024)


def test_long_unbroken_text_is_encoded(monkeypatch):
    """Text without a space, many times as long as other tests hold: fast, and as the steps of arrays have it."""
    codec = sentencepiece_codec.codec(sentencepiece_codec.model_path())
    flat = lambda *texts: (np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]))
    r = np.random.default_rng(3)
    short = ["".join(chr(c) for c in r.choice([97, 98, 116, 104, 101, 0xE9, 0x4E2D, 0x1F600], 300)) for _ in range(5)]
    one, ends = codec.encode(*flat(*short))
    monkeypatch.setattr(sentencepiece_codec, "FEW", 0)
    slow, same_ends = codec.encode(*flat(*short))
    assert (one == slow).all() and (ends == same_ends).all()
    monkeypatch.undo()
    text = "".join(chr(97 + i * i % 23) for i in range(1_000_000))
    began = time.time()
    ids, bounds = codec.encode(*flat(text))
    data, _ = codec.decode(ids, bounds)
    assert data.tobytes().decode() == text and time.time() - began < 60
