"""Operator 3: no repeat of the length limit is missed, whatever stands around it and whatever its script."""

import random

import numpy as np

from factloom.llm import substring_dedup
from factloom.llm.substring_dedup import MIN_RUN

from .helpers import awkward, frame, sentence


def repeats(rows: list[tuple], width: int) -> list[tuple]:
    """(doc_id, spans) by looking up every window in all smaller documents and in the text before it."""
    first: dict[bytes, int] = {}
    for d, t, *_ in rows:
        raw = (t or "").encode()
        if d is not None:
            for a in range(len(raw) - width + 1):
                w = raw[a : a + width]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t, *_ in rows:
        raw, spans, seen = (t or "").encode(), [], set()
        for a in range(len(raw) - width + 1) if d is not None else ():
            w = raw[a : a + width]
            if first[w] < d or w in seen:
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = a + width
                else:
                    spans.append([a, a + width])
            seen.add(w)
        for s in spans:
            while raw[s[0]] & 0xC0 == 0x80:
                s[0] += 1
            while s[1] < len(raw) and raw[s[1]] & 0xC0 == 0x80:
                s[1] -= 1
        out.append((d, t, tuple(map(tuple, spans))))
    return sorted(out, key=repr)


def planted() -> list[tuple]:
    """Passages of 51 words, of unspaced characters and of just the limit, each twice between different texts."""
    r, texts = random.Random(7), []
    makers = [lambda: sentence(r, 51)] * 30 + [lambda: "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(60))] * 10 + [lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(MIN_RUN))] * 10
    for make in makers:
        passage = make()
        texts += [f"{sentence(r, r.randint(0, 30))}.{passage}!{sentence(r, r.randint(0, 30))}", f"{sentence(r, r.randint(0, 30))},{passage}?{sentence(r, r.randint(0, 30))}", f"{passage[: len(passage) // 3]};{sentence(r, 9)}"]
    order = list(range(len(texts)))
    r.shuffle(order)
    return [(order[i], t, "en", "s", len(t)) for i, t in enumerate(texts)]


def check(spark, rows):
    out = substring_dedup.substring_dedup(frame(spark, rows).repartition(5)).collect()
    got = [(r["doc_id"], tuple(tuple(s) for s in r["_spans"])) for r in out]
    want = repeats(rows, MIN_RUN)
    assert sorted(got, key=repr) == sorted(((d, s) for d, _, s in want), key=repr)
    kept = []
    for d, t, spans in want:
        raw, at, parts = (t or "").encode(), 0, []
        for s, e in spans:
            parts.append(raw[at:s])
            at = e
        kept.append((d, t and b"".join([*parts, raw[at:]]).decode()))
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=repr) == sorted(kept, key=repr)
    return want


def test_planted_passages_all_go(spark):
    rows = planted()
    want = check(spark, rows)
    assert sum(bool(s) for _, _, s in want) == 50


def kept(rows: list[tuple], width: int = MIN_RUN) -> dict:
    """doc_id -> text without its repeats."""
    out = {}
    for d, t, spans in repeats(rows, width):
        raw = (t or "").encode()
        gone = {i for s, e in spans for i in range(s, e)}
        out[d] = t and bytes(b for i, b in enumerate(raw) if i not in gone).decode()
    return out


def test_windows_stand_for_chunks_chosen_by_their_bytes_alone():
    """Every window, cut out and set between other texts, has the same chunk."""
    r = random.Random(3)
    texts = [sentence(r, 90), "".join(r.choice("abcdefgh") for _ in range(500)), "漢字仮名" * 60, "x" * 300, " ".join("ab" for _ in range(99))]
    for t in texts:
        raw = t.encode()
        data, offsets = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
        row, first, last, key, *_ = substring_dedup.marks(data, offsets, MIN_RUN)
        assert first[0] == 0 and last[-1] == len(raw) - MIN_RUN and (first[1:] == last[:-1] + 1).all()
        for s in range(0, len(raw) - MIN_RUN + 1, 7):
            other = b"quite another text " * 9
            mixed = np.frombuffer(other + raw[s : s + MIN_RUN] + other, np.uint8)
            bounds = np.array([0, len(other), len(other) + MIN_RUN, len(mixed)])
            row2, first2, last2, key2, *_ = substring_dedup.marks(mixed, bounds, MIN_RUN)
            mine = np.flatnonzero(row2 == 1)
            assert len(mine) == 1 and first2[mine[0]] == last2[mine[0]] == len(other)
            assert key2[mine[0]] == key[np.searchsorted(first, s, "right") - 1]


def test_awkward_rows(spark):
    check(spark, awkward())
    check(spark, [])


def test_query_removes_planted_passages(spark, tmp_path):
    rows = planted()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.query(spark, str(tmp_path)).collect()}
    assert got == {d: sum(e - s for s, e in spans) for d, _, spans in repeats(rows, MIN_RUN)}
