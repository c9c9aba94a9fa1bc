"""Small tables with every awkward case, and plain-Python versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np

SF = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(r: random.Random, n: int) -> str:
    syllables = "er th an tion re on ing st he ou ñe ä le".split()
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))


def awkward(seed: int = 1) -> list[tuple]:
    """Nulls, empty and blank texts, a very long one, copies, near copies, shared passages, repeated rows, no letters."""
    r = random.Random(seed)
    base = [sentence(r, r.randint(1, 120)) for _ in range(12)]
    passage = sentence(r, 60)
    near = sentence(r, 200).split(" ")
    changed = [*near[:50], "other", *near[51:]]
    texts = [
        *base, base[3], base[3], base[5], None, "", "", "   \n ", "12 34 !!", "é", "one two three", "one two three",
        f"{base[0]} {passage} {base[1]}", f"{passage} {base[2]}", f"{base[4]} {passage}", " ".join(near), " ".join(changed),
        sentence(r, 6000), "x" * 5000, "漢字" * 900, "a b " * 700, "tab\tand\x00nul  double", "<|endoftext|> <unk>",
    ]
    rows = [(i, t, None if i % 9 == 8 else ("en", "fr")[i % 2], f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[2], (None, base[3], "en", "src0", 3), (None, None, None, None, None)]
    return rows


def frame(spark, rows: list[tuple]):
    """With further columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, KINDS)
    from pyspark.sql import functions as F

    for name in ("h", "rep", "bucket", "_k", "_id", "text_key", "places", "row_number", "held_out", "score", "bands"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words(text: str | None) -> list[str]:
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def shingle_set(ws: list[str], n: int = 5) -> frozenset:
    return frozenset(tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))) if ws else frozenset()


def jaccard_groups(rows: list[tuple]) -> list[tuple]:
    """(doc_id, class_id, n_links, group_id) by comparing all pairs."""
    real = [(d, words(t)) for d, t, *_ in rows if d is not None and words(t)]
    sets = [shingle_set(w) for _, w in real]
    links = [[] for _ in real]
    for i in range(len(real)):
        for j in range(len(real)):
            both = len(sets[i] & sets[j])
            if i != j and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i].append(j)
    group = list(range(len(real)))
    for _ in real:
        for i, js in enumerate(links):
            for j in js:
                group[i] = group[j] = min(group[i], group[j], key=lambda k: real[k][0])
    classes = {}
    for d, w in real:
        classes[tuple(w)] = min(classes.get(tuple(w), d), d)
    out = [(d, classes[tuple(w)], len(links[i]), real[group[i]][0]) for i, (d, w) in enumerate(real)]
    out += [(d, d, 0, d) for d, t, *_ in rows if d is None or not words(t)]
    return out


def remove_windows(rows: list[tuple], width: int = 50) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by looking up every window in all smaller documents."""
    first: dict[bytes, int] = {}
    for d, t, *_ in rows:
        raw = (t or "").encode()
        if d is not None:
            for a in range(len(raw) - width + 1):
                w = raw[a : a + width]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t, *_ in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        if d is not None:
            for a in range(len(raw) - width + 1):
                if first[raw[a : a + width]] < d:
                    gone[a : a + width] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        left = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((d, len(raw), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return out
