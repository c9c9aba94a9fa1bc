"""The candidate pool of recall against a plain fold over all facts, branch by branch."""

import math
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import graph as G
from factloom.operators import retrieval as R
from factloom.plans.derive import AS_OF, facts, questions

SF = "/root/testdata/sf0.001"
K = 10


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def fold(rows, asked, vectors, k):
    """(query_id -> ids in order of entry), scope by scope."""
    out = {}
    for scope in sorted({r["scope"] for r in rows}):
        for q, ids in fold_one([r for r in rows if r["scope"] == scope], asked, vectors, k).items():
            out[q] = out.get(q, []) + ids
    return out


def fold_one(rows, asked, vectors, k):
    newest = lambda some, by: sorted(some, key=lambda r: (-r[by], -r["seq"]))
    live = [r for r in rows if r["live"]]
    past = [r for r in rows if r["state"] == "superseded"]
    out = {}
    for q in asked:
        terms = [t for t in q["terms"] if len(t) >= 2]
        hits = [r for r in (live + past if q["temporal"] else live) if any(d.startswith(t) for t in terms for d in r["tokens"])]
        cands = [r["id"] for r in sorted(hits, key=lambda r: r["seq"])[: 5 * k]]
        sims = [(-cosine(q["embedding"], vectors[r["id"]]), r["id"]) for r in live] if vectors else []
        cands += [i for s, i in sorted(sims) if s < 0][: max(min(3 * k, 25), k)]
        if q["temporal"]:
            cands += [r["id"] for r in newest(past, "updated_at")[:k]]
        if len(set(cands)) < k:
            cands += [r["id"] for r in newest(live, "last_accessed")[:k]]
        if q["first"]:
            own = newest([r for r in live if r["subject"] == q["user_id"]], "updated_at")
            cands += [r["id"] for r in own[:50]] + [r["id"] for r in own if r["predicate"] != "stated"][:2000]
        out[q["query_id"]] = list(dict.fromkeys(cands))
    return out


@pytest.fixture(scope="module")
def few(spark):
    return facts(spark, SF).where("seq < 600").cache()


def collected(few, asked):
    live = {r["id"] for r in R.live_rows(few, AS_OF).select("id").collect()}
    text = F.concat_ws(" ", "source_text", "object_value", F.regexp_replace("predicate", "_", " "))
    rows = [r.asDict() | {"live": r["id"] in live} for r in few.withColumn("tokens", T.tokens(text)).collect()]
    flags = R.intents(F.col("text"))
    return rows, [r.asDict() for r in asked.withColumns({"terms": R.expanded_terms(F.col("text")), "temporal": flags["temporal"], "first": flags["first_person"]}).collect()]


def entered(pool):
    out = {}
    for r in sorted(pool.select("query_id", "cand_ord", "id").collect()):
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def test_pool_equals_fold(few, spark):
    asked = questions(spark)
    rows, qs = collected(few, asked)
    want = {q: ids for q, ids in fold(rows, qs, None, K).items() if ids}
    assert entered(R.pool(asked, few, AS_OF, K)) == want
    state = {r["id"]: r["state"] for r in rows}
    assert all(want.get(q["query_id"]) for q in qs)  # no question is left without candidates
    assert all(any(state[i] == "superseded" for i in want[q["query_id"]]) == q["temporal"] for q in qs)


def test_pool_with_vectors_equals_fold(few, spark):
    r = random.Random(5)
    ids = [x["id"] for x in few.select("id").collect()]
    table = {i: [r.gauss(0, 1) for _ in range(8)] for i in ids}
    vectors = spark.createDataFrame(list(table.items()), "id string, embedding array<double>")
    asks = [(*x, [r.gauss(0, 1) for _ in range(8)]) for x in map(tuple, questions(spark).collect())]
    asked = spark.createDataFrame(asks, "query_id int, user_id string, text string, embedding array<double>")
    rows, qs = collected(few, asked)
    assert entered(R.pool(asked, few, AS_OF, K, vectors)) == fold(rows, qs, table, K)
    top = R.recall(asked, few, AS_OF, K, None, None, vectors).select("query_id", "id", "semantic").collect()
    emb = {a[0]: a[3] for a in asks}
    assert top and all(x["semantic"] == pytest.approx(max(0.0, cosine(emb[x["query_id"]], table[x["id"]]))) for x in top)


def test_recall_of_superseded_facts_and_traces(few, spark):
    out = R.recall(questions(spark), few, AS_OF, K).select("query_id", "rank", "id", "state", "resonance").cache()
    found = {q for (q,) in out.where("state = 'superseded'").select("query_id").distinct().collect()}
    assert found and found <= {3, 6}
    assert out.select("query_id").distinct().count() == 12 and out.where("resonance > 0").count() == 0
    again = R.recall(questions(spark), few, AS_OF, K, None, G.traces(out)).select("query_id", "id", "resonance")
    assert again.where("resonance > 0").count() > 0


def plain_recall(cands, k):
    """Fusion, boosts, inhibition, diversity of one query's candidates (with channel columns and single boosts), one by one."""
    channels = R.CHANNELS
    for scope in {c["scope"] for c in cands}:
        mine = [c for c in cands if c["scope"] == scope]
        for c in mine:
            c["score"] = 0.05 * c["semantic"]
        for ch in channels:
            ranked = sorted([c for c in mine if c[ch] > 0], key=lambda c: (-c[ch], c["cand_ord"]))  # noqa: B023
            for c in mine:
                rank = ranked.index(c) if c in ranked else len(ranked)
                c["score"] += R.WEIGHTS[ch] / (20 + rank + 1)
    for c in cands:
        f = (1 + c["align"]) * (1 + c["denied"]) * (1 + c["gone"])
        f *= 1 + 0.3 * min(c["evidence_count"], 5) / 5 if c["broad"] else 1
        f *= 0.75 if c["predicate"] == "stated" else 1.3
        f *= (1.5 if c["temporal_q"] else 0.1) if c["state"] == "superseded" else 1
        f *= 0.4 if c["hypothetical"] else 1
        f *= 1 + c["about"]
        f *= 0.5 if c["predicate"] in ("is_a", "name", "am", "is", "stated", "be") and (c["specific"] or c["align"] > 0) else 1
        f *= 1 + c["named"]
        f *= 1.8 if c["company"] and c["scope"] == "shared" else 1
        f *= 3 if c["predicate_hint"] and c["predicate"] == c["predicate_hint"] else 1
        c["score"] *= f
    order = sorted(cands, key=lambda c: (-c["score"], c["cand_ord"]))
    seen, kept = set(), []
    for c in order:
        slot = (c["subject"].lower(), c["predicate"])
        if c["predicate"] in R.L.INHIBITED:
            if slot in seen:
                continue
            seen.add(slot)
        kept.append(c)
    preds, objs, out = {}, {}, []
    for n, c in enumerate(kept):
        o = c["object_value"].lower().strip()[:50]
        preds[c["predicate"]], objs[o] = preds.get(c["predicate"], 0) + 1, objs.get(o, 0) + 1
        if n < k:
            out.append((c["score"] * (0.5 if preds[c["predicate"]] > 2 else 1) * (0.3 if objs[o] > 2 else 1), n, c["id"]))
    return [(i, round(s, 9)) for s, _, i in sorted(out, key=lambda x: (-x[0], x[1]))]


def test_recall_equals_plain_python(few, spark):
    facts_ = few.withColumn("metadata", F.when(F.col("seq") % 9 == 0, '{"hypothetical":"true"}').otherwise("{}"))
    hint = F.when(F.col("query_id") % 3 == 0, "likes")
    asked = questions(spark).withColumn("predicate_hint", hint).withColumn("negation", F.col("query_id") / 12).withColumn("past", F.col("query_id") / 24)
    edges, pairs = G.edges_of(facts_.where("seq < 200")), spark.createDataFrame([("f3", "f4", 5), ("f4", "f6", 2)], "a string, b string, n long")
    got = R.recall(asked, facts_, AS_OF, K, edges, pairs)
    # Channels and single boosts come from the operators, which have tests of their own; how they are put together is done again.
    flags = R.intents(F.col("text"))
    cands = R.channel_scores(R.pool(asked, facts_, AS_OF, K), AS_OF)
    act = {(r["query_id"], r["node"]): r["activation"] for r in G.spread(edges, asked.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("node"))).collect()}
    met = {(r["query_id"], r["id"]): r["resonance"] for r in G.resonance(cands, pairs).collect()}
    cols = {
        "align": R.predicate_alignment(F.col("text"), F.col("predicate"), F.col("object_value"), F.col("source_text")), "denied": R.negation_alignment(F.col("negation"), F.col("is_negation")),
        "gone": R.past_alignment(F.col("text"), F.col("past"), F.col("is_negation"), F.col("state")), "about": R.subject_alignment(F.col("text"), F.col("asker"), F.col("subject"), F.col("object_value"), F.col("source_text")),
        "named": R.entity_boost(F.col("text"), F.col("object_value"), F.col("source_text")), "broad": flags["broad"], "specific": flags["specific"], "company": flags["company"],
        "temporal_q": flags["temporal"] | (F.col("past") > 0.25), "hypothetical": F.col("seq") % 9 == 0,
    }
    by_query = {}
    for r in cands.withColumns(cols).collect():
        c = r.asDict()
        c["graph"] = min(1.0, max(act.get((c["query_id"], c["subject"].lower()), 0.0), act.get((c["query_id"], c["object_value"].lower()), 0.0)))
        c["resonance"] = met.get((c["query_id"], c["id"]), 0.0)
        by_query.setdefault(c["query_id"], []).append(c)
    want = {q: plain_recall(cs, K) for q, cs in by_query.items()}
    have = {}
    for r in got.orderBy("query_id", "rank").collect():
        have.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 9)))
    assert have == want
    assert any(c["graph"] > 0 for cs in by_query.values() for c in cs) and any(c["resonance"] > 0 for cs in by_query.values() for c in cs)
