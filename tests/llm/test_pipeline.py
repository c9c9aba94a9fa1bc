"""The pipeline against plain Python, stage by stage, and as a whole."""

import random
import re
import zlib

import corpus_pipeline as pipeline
import numpy as np
import pyarrow as pa
from factloom.llm import langid
from factloom.llm.common import flat

from .helpers import SF, awkward, frame, sentence, shingle_set, words
from .test_operators import check_packing
from .test_windows import repeats


def lettered(rows: list[tuple], docs) -> list[tuple]:
    """Rows in a learned language, text by text."""
    model = langid.train(docs, steps=langid.STAGE_STEPS, with_noise=True)
    cuts = langid.noise_cuts(docs, model)
    noise = [float(model.documents(*flat(pa.array([r[1] or ""])))[0, -1]) for r in rows]
    band = [sum(len((r[1] or "").encode()) > edge for edge in langid.BANDS) for r in rows]
    return [r for r, p, k in zip(rows, noise, band, strict=True) if re.search(r"[^\W\d_]", r[1] or "") and p <= cuts[k]]


def distinct(rows: list[tuple]) -> list[tuple]:
    """Of equal texts the largest doc_id (with its repetitions), else one row without an id."""
    out, best, taken = [], {}, set()
    for r in rows:
        if r[0] is not None:
            best[r[1] or ""] = max(best.get(r[1] or "", r[0]), r[0])
    for r in rows:
        t = r[1] or ""
        if r[0] is None and t not in best and t not in taken or r[0] is not None and best[t] == r[0]:
            out.append(r)
            taken.add(t)
    return out


def unlike(rows: list[tuple]) -> list[tuple]:
    """One text of each group of near duplicates: that of the smallest doc_id. (No doc_id has two texts in one group here.)"""
    sets = [shingle_set(words(r[1])) if r[0] is not None else frozenset() for r in rows]
    group = list(range(len(rows)))
    near = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    for _ in rows:
        for i, j in near:
            group[i] = group[j] = min(group[i], group[j], key=lambda k: rows[k][0])
    return [r for r, g in zip(rows, group, strict=True) if r[0] is None or rows[g][0] == r[0]]


def less_repeats(rows: list[tuple]) -> list[tuple]:
    out = []
    found = {}
    for d, t, spans in repeats(rows, 160):
        found.setdefault((d, t), spans)
    for r in rows:
        raw, at, parts = (r[1] or "").encode(), 0, []
        for s, e in found[r[0], r[1]]:
            parts.append(raw[at:s])
            at = e
        text = r[1] and b"".join([*parts, raw[at:]]).decode()
        out.append((r[0], text, r[2], r[3], len(text) if text is not None else r[4]))
    return out


def check_stages(spark, docs, rows):
    columns = ("doc_id", "text", "lang", "source", "n_chars")
    wants = [lettered(rows, docs)]
    for step in (distinct, unlike, less_repeats):
        wants.append(step(wants[-1]))
    cur = docs
    for (name, stage), want in zip(pipeline.STAGES[:-1], wants, strict=True):
        cur = pipeline.materialize(stage(spark, cur, SF), "test")
        assert cur.columns == docs.columns
        assert sorted(map(repr, map(tuple, cur.select(*columns).collect()))) == sorted(map(repr, want)), name
    return wants


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wants = check_stages(spark, docs, [tuple(r) for r in docs.collect()])
    out = pipeline.run(spark, SF)
    check_packing(out.collect(), [r[1] for r in wants[-1]], 1024)


def test_stages_equal_brute_force_on_awkward_rows(spark):
    """Null and repeated ids, null, empty and very long texts, columns with the names that the operators use inside."""
    rows = awkward(2)
    rows += [(None, "a text without an id", None, None, 20), (None, "a text without an id", None, None, 20), (900, rows[0][1], "en", "s", 1), (900, sentence(random.Random(5), 70), "en", "s", 1)]
    rows += [(1000 + k, sentence(random.Random(k), 40), "en" if k % 2 else "fr", "s", 1) for k in range(60)]
    docs = frame(spark, rows)
    check_stages(spark, docs, rows)
    pipeline.STAGES[-1][1](spark, docs, SF).count()


def test_stages_of_an_empty_table(spark):
    cur = frame(spark, [])
    for _, stage in pipeline.STAGES[:-1]:
        nxt = stage(spark, cur, SF)
        assert nxt.columns == cur.columns and not nxt.count()
    assert not pipeline.STAGES[-1][1](spark, cur, SF).count()


def test_language_stage_rejects_what_is_in_no_learned_language(spark):
    """Shuffled letters, other scripts and codes go; of held-out documents hardly one does."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").cache()
    r = random.Random(8)
    real = [x["text"] for x in docs.limit(200).collect()]
    shuffled = ["".join(r.sample(t[:600], len(t[:600]))) for t in real if len(t) > 200]
    greek = [" ".join("".join(chr(r.randrange(0x3B1, 0x3C9)) for _ in range(r.randint(2, 9))) for _ in range(60)) for _ in range(60)]
    codes = ["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(400)) for _ in range(60)]
    junk = [*shuffled, *greek, *codes, "12 34", None]
    more = spark.createDataFrame([(10_000_000 + k, t, None, "junk", len(t or "")) for k, t in enumerate(junk)], docs.schema)
    out = langid.stage(spark, docs.unionByName(more), "").select("doc_id").collect()
    ids = np.array([x["doc_id"] for x in out])
    assert (ids < 10_000_000).sum() >= 0.995 * docs.count()
    left = {junk[i - 10_000_000] for i in ids[ids >= 10_000_000]}
    for kind, share in ((shuffled, 0.9), (greek, 0.95), (codes, 0.95), (["12 34", None], 1)):
        assert len(left & set(kind)) <= (1 - share) * len(kind), kind[0]


def test_cuts_of_the_language_stage_come_from_all_held_out_documents(spark):
    """Far more documents than 1000 a language, many of them with equal scores; scores stand in the texts here."""

    class Told:
        def documents(self, data, offsets):
            p = np.array([float(bytes(data[s + 1 : s + 10])) for s in offsets[:-1]])
            return np.stack([1 - p, p], 1)

    r = random.Random(6)
    score = [0.0, 0.3, *[r.choice([0.4, r.random(), r.random() ** 3]) for _ in range(19_998)]]
    rows = [(i, f"x{p:.7f}" + " and so on" * (i % 3 * 15), "en" if i % 5 else "fr" if i % 7 else None, "s", 1) for i, p in enumerate(score)]
    got = langid.noise_cuts(frame(spark, rows), Told())
    parts = [[], [], []]
    for i, text, lang, *_ in rows:
        if lang and zlib.crc32(str(i).encode()) % 3 == 1:
            parts[sum(len(text) > edge for edge in langid.BANDS)].append(float(text[1:10]))
    assert min(map(len, parts)) > 1000
    want = [max(langid.LEAST_CUT, np.quantile(p, 1 - langid.MAY_LOSE, method="higher") + langid.MARGIN) if p else 0.5 for p in parts]
    assert list(got) == want
    assert list(langid.noise_cuts(frame(spark, [x for x in rows if not x[2]]), Told())) == [0.5] * 3
