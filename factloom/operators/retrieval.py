"""Hybrid retrieval for batches of queries: candidate pool, seven channels, rank fusion, boosts, diversity, certainty.

A query batch is (query_id, text[, user_id]); every step is keyed by query_id, so many queries share each shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import numeric as N
from ..functions import text as T
from ..schema import PERSONAL, Identity, lookup

#: Vectors of a block.
BLOCK = 2048
#: A query's candidates are pooled and ranked scope by scope, as each scope is a store of its own.
POOL = ("query_id", "scope")
# ---- fixed values: what questions about denials and about the past are like ----
PROTOTYPES = {
    "negation": "what doesn't the person like, dislike, hate, avoid, can't, not",
    "past": "what did the person do before, previously, in the past, former, used to, earlier, prior history",
}
PAST_KEYWORDS = ("before", "previous", "previously", "formerly", "used to", "earlier", "prior", "ago", "past")
CHANNELS = ("semantic", "keyword", "temporal", "belief", "frequency", "graph", "resonance")
WEIGHTS = dict(zip(CHANNELS, (0.30, 0.15, 0.10, 0.15, 0.10, 0.10, 0.10), strict=True))


def postings(facts: DataFrame, longest: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """(prefix, id, seq, token, and the columns ``keep``): the inverted index. Each token stands under its first two to ``longest`` letters, so that a
    term's prefix match is one equi-join whatever the term's length."""
    text = F.concat_ws(" ", "source_text", "object_value", F.regexp_replace("predicate", "_", " "))
    tokens = facts.select("id", "seq", *keep, F.explode(F.array_distinct(T.tokens(text))).alias("token"))
    heads = F.array_distinct(F.transform(F.sequence(F.lit(2), F.lit(longest)), lambda n: F.substring(F.col("token"), F.lit(1), n)))
    return tokens.select("id", "seq", *keep, "token", F.explode(heads).alias("prefix"))


def keyword_score(terms: Column, source: Column, obj: Column, predicate: Column) -> Column:
    """Share of terms that overlap a document token as a prefix either way, with bonuses for the object."""
    objects = T.tokens(obj)
    every = F.array_union(F.array_union(T.tokens(source), objects), T.tokens(F.regexp_replace(predicate, "_", " ")))
    near = lambda doc: F.filter(terms, lambda t: F.exists(doc, lambda d: F.startswith(d, t) | F.startswith(t, d)))
    n = F.size(terms)
    score = F.size(near(every)) / n + 0.3 * F.size(near(objects)) / n + 0.5 * F.size(F.filter(terms, lambda t: F.array_contains(objects, t))) / n
    return F.when((n > 0) & (F.size(near(every)) > 0), F.least(F.lit(1.0), score)).otherwise(0.0)


def expanded_terms(text: Column) -> Column:
    """Query tokens and their synonyms."""
    terms = T.tokens(text)
    return F.concat(terms, F.flatten(F.transform(F.filter(terms, lambda t: t.isin(list(L.SYNONYMS))), lambda t: lookup(L.SYNONYMS, t))))


def intents(text: Column) -> dict[str, Column]:
    """Flags of a query: first_person, temporal, company, broad, specific."""
    q = F.lower(text)
    words = F.split(F.trim(q), r"\s+")
    return {
        "first_person": q.rlike(r"(^|[^a-z0-9_])(i|my|me|mine|myself)($|[^a-z0-9_])"),
        "temporal": T.contains_any(q, L.TEMPORAL_KEYWORDS) | q.rlike(r"(^|[^a-z0-9_])(my|the|our|their|his|her|a|an)\s+old($|[^a-z0-9_])"),
        "company": T.contains_any(q, L.COMPANY_KEYWORDS),
        "broad": T.contains_any(q, ("tell me about", "what do you know", "what about", "describe", "summarize")),
        "specific": F.exists(words, lambda w: (F.length(w) > 2) & ~w.isin(list(L.INTENT_STOPWORDS))),
    }


def with_intents(queries: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """Adds ``negation`` and ``past``: how near a question is to the prototypes of the two, by the embedding in use."""
    for name, words in PROTOTYPES.items():
        queries = queries.withColumn(name, N.cosine(embed(F.col("text")), embed(F.lit(words))))
    return queries


def negation_alignment(similarity: Column, negated: Column) -> Column:
    """Boost of negated facts for questions near enough to the prototype."""
    return F.when(negated & (similarity >= 0.35), F.least(F.lit(2.0), (similarity - 0.25) * 4)).otherwise(0.0)


def past_alignment(text: Column, similarity: Column, negated: Column, state: Column) -> Column:
    """Boost of negated and superseded facts for questions about the past, by keyword or by nearness to the prototype. (Facts about
    the present are not demoted: only positive alignments count.)"""
    keyword = T.contains_any(F.lower(text), PAST_KEYWORDS)
    by_word = F.greatest(F.lit(1.5), F.least(F.lit(2.5), (similarity - 0.1) * 5))
    by_sense = F.greatest(F.lit(0.5), F.least(F.lit(2.5), (similarity - 0.15) * 5))
    asked = F.when(keyword, by_word).when(similarity >= 0.2, by_sense).otherwise(0.0)
    return F.when(negated | (state == "superseded"), asked).otherwise(0.0)


def target_predicates(text: Column) -> Column:
    """Predicates that the curated keywords in a query ask for."""
    q = F.lower(text)
    words = F.filter(T.ANY_OF(L.QUERY_PREDICATES), lambda k: F.contains(q, k))
    return F.array_distinct(F.flatten(F.transform(words, lambda k: lookup(L.QUERY_PREDICATES, k))))


def predicate_alignment(query: Column, predicate: Column, obj: Column, source: Column, similarity: Column | float = 0.0, identity: Identity = PERSONAL) -> Column:
    """Boost for predicates that answer the query. A curated keyword lifts its predicates to 2 and takes the similarity
    base from all others; words shared with the predicate or the text come on top as maxima; nothing is negative."""
    similarity = F.lit(similarity) if isinstance(similarity, (int, float)) else similarity
    base = N.linear_boost(similarity)
    targets, content = target_predicates(query), T.content_words(query)
    on_axis = F.array_contains(targets, predicate) | F.array_contains(targets, identity.canon(predicate))
    score = F.when(F.size(targets) == 0, base).when(on_axis, F.greatest(base, F.lit(2.0))).otherwise(-0.5)
    shared = F.size(F.array_intersect(F.split(F.regexp_replace(predicate, "_", " "), " "), content))
    score = F.when(shared > 0, F.greatest(score, F.least(F.lit(1.0), shared * 0.5))).otherwise(score)
    text = F.lower(F.concat_ws(" ", obj, source))
    hits = F.size(F.filter(content, lambda w: F.contains(text, w)))
    score = F.when((score < 0.4) & (hits >= 2), F.greatest(score, F.lit(0.3))).otherwise(score)
    return F.when(predicate == "stated", 0.0).otherwise(F.greatest(F.lit(0.0), score))


def subject_alignment(query: Column, user: Column, subject: Column, obj: Column, source: Column) -> Column:
    """1.5 for the user's own facts on first-person queries and for a relationship named in the text, 1.2 for a synonym of
    it, 0.6 for two shared content words. Of several relationships the largest boost counts."""
    q = F.lower(query)
    text = F.lower(F.concat_ws(" ", subject, obj, source))
    named = T.contains_any(q, L.QUERY_RELATIONSHIPS)
    own = intents(query)["first_person"] & ~named & (F.length(user) > 0) & (subject == user)
    direct = F.exists(T.ANY_OF(L.QUERY_RELATIONSHIPS), lambda r: F.contains(q, r) & F.contains(text, r))
    synonym = F.lit(False)
    for word, others in L.RELATION_SYNONYMS.items():
        synonym = synonym | F.contains(q, F.lit(word)) & T.contains_any(text, others)
    hits = F.size(F.filter(T.content_words(query), lambda w: F.contains(text, w)))
    return F.when(own, 1.5).when(direct, 1.5).when(synonym, 1.2).when(hits >= 2, 0.6).otherwise(0.0)


def hints(predicate_hint: Column, subject_hint: Column, identity: Identity = PERSONAL) -> Column:
    """A caller's hints boost and never filter: 3 for the predicate as written or canonical, 2 for the subject. Null and blank hints
    do nothing."""
    wanted = F.when(F.trim(predicate_hint) != "", T.norm_predicate(predicate_hint))
    p = F.col("predicate")
    hit = p.isin(wanted) | (identity.canon(p) == wanted) | (p == identity.canon(wanted)) | (identity.canon(p) == identity.canon(wanted))
    return F.when(hit, 3.0).otherwise(1.0) * F.when(F.col("subject") == subject_hint, 2.0).otherwise(1.0)


def entity_boost(query: Column, obj: Column, source: Column) -> Column:
    """0.8 times the share of the query's entities (capitalised, or longer than three letters) found in the text."""
    words = F.transform(F.split(F.trim(query), r"\s+"), lambda w: F.trim(w, F.lit("?.,!\"'")))
    entities = F.array_distinct(F.transform(F.filter(words, lambda w: w.rlike("^[A-Z]") | (F.length(w) > 3)), lambda w: F.lower(w)))
    text = F.lower(F.concat_ws(" ", obj, source))
    return F.when(F.size(entities) > 0, 0.8 * F.size(F.filter(entities, lambda e: F.contains(text, e))) / F.size(entities)).otherwise(0.0)


def pool(queries: DataFrame, facts: DataFrame, as_of: float, top_k: int = 20, vectors: DataFrame | None = None) -> DataFrame:
    """Candidate pool of each query and scope, in order of entry: keyword matches (5k), the nearest vectors, the newest superseded facts
    (k), the facts last read (k, where fewer than k came in so far), the query user's own newest facts (50) and structured ones (2000).

    Superseded facts come in for temporal questions only, all others are live. Vectors take part where ``vectors`` (id, embedding) is
    given and ``queries`` has an ``embedding``; all live facts are compared. Keywords and users are equi-joins; of the newest only k
    rows a scope are left before they meet the queries. Columns of both sides, with ``cand_ord`` as the order of entry.
    """
    flags = intents(F.col("text"))
    temporal = flags["temporal"] | (F.coalesce("past", F.lit(0.0)) > 0.25) if "past" in queries.columns else flags["temporal"]
    asked = queries.withColumn("_past", temporal)
    rows = facts.where("state = 'superseded'").withColumn("_live", F.lit(False)).unionByName(live_rows(facts, as_of).withColumn("_live", F.lit(True)))
    terms = asked.select("query_id", "_past", F.explode(F.array_distinct(expanded_terms(F.col("text")))).alias("term")).where("length(term) >= 2").withColumn("prefix", F.substring("term", 1, 4))
    # Only tokens with a prefix that some term has are worth a posting; there are as many as terms.
    wanted = terms.select("prefix").distinct()
    index = postings(rows, keep=("scope", "_live")).join(wanted, "prefix", "left_semi")
    hits = terms.join(index, "prefix").where(F.startswith(F.col("token"), F.col("term")) & (F.col("_live") | F.col("_past"))).select(*POOL, "id", "seq").distinct()
    ordered = lambda df, *by: df.withColumn("n", F.row_number().over(Window.partitionBy(*POOL).orderBy(*by)))
    branch = lambda df, src: df.select(*POOL, "id", F.lit(src).alias("src"), "n")
    found = branch(ordered(hits, "seq").where(F.col("n") <= 5 * top_k), 0)
    live, past = rows.where("_live"), rows.where("not _live")
    if vectors is not None and "embedding" in queries.columns:
        known = vectors.select("id", F.col("embedding").alias("v")).join(live.select("id", "scope"), "id")
        near = vector_top_k(queries.select("query_id", F.col("embedding").alias("q")), known, max(min(3 * top_k, 25), top_k), ("scope",))
        found = found.unionByName(near.select(*POOL, "id", F.lit(1).alias("src"), F.col("rank").alias("n")))
    by_time = lambda by: (F.col(by).desc(), F.col("seq").desc())
    newest = lambda df, by: df.select("id", "seq", "scope", by, F.row_number().over(Window.partitionBy("scope").orderBy(*by_time(by))).alias("n")).where(F.col("n") <= top_k)
    # k rows a scope, of three scopes.
    found = found.unionByName(branch(asked.where("_past").select("query_id").join(F.broadcast(newest(past, "updated_at")), F.lit(True)), 2))
    recent = queries.select("query_id").join(F.broadcast(newest(live, "last_accessed")), F.lit(True))
    found = found.unionByName(branch(recent, 3))
    own = asked.where(flags["first_person"]).select("query_id", F.col("user_id").alias("_u")).join(live.select("id", "seq", "scope", "subject", "predicate", "updated_at"), F.col("subject") == F.col("_u"))
    for src, of, limit in ((4, own, 50), (5, own.where("predicate <> 'stated'"), 2000)):
        found = found.unionByName(branch(ordered(of, *by_time("updated_at")).where(F.col("n") <= limit), src))
    # Recent facts count where what came in before them falls short; a fact may then stand as one of the user's own.
    entry = F.struct("src", "n")
    first = found.groupBy(*POOL, "id").agg(F.min(entry).alias("any"), F.min(F.when(F.col("src") != 3, entry)).alias("other"))
    before = F.count_if(F.col("any.src") < 3).over(Window.partitionBy(*POOL))
    first = first.withColumn("at", F.when(before < top_k, F.col("any")).otherwise(F.col("other"))).where("at is not null")
    ranked = first.withColumn("cand_ord", F.row_number().over(Window.partitionBy("query_id").orderBy("scope", "at"))).select("query_id", F.col("id").alias("_id"), "cand_ord")
    every = rows.drop("embedding", "_live")
    return ranked.join(every, F.col("_id") == F.col("id")).drop("_id").join(queries.withColumnRenamed("user_id", "asker"), "query_id")


def live_rows(facts: DataFrame, as_of: float) -> DataFrame:
    from .beliefs import believed

    return believed(facts, as_of)


def channel_scores(cands: DataFrame, as_of: float, semantic: Column | None = None) -> DataFrame:
    """Raw channel columns; graph and resonance are joined by the caller where there are edges or traces."""
    per = Window.partitionBy(*POOL)
    return cands.select(
        "*",
        (semantic if semantic is not None else F.lit(0.0)).alias("semantic"),
        keyword_score(T.tokens(F.col("text")), F.col("source_text"), F.col("object_value"), F.col("predicate")).alias("keyword"),
        N.recency(F.col("updated_at"), F.col("valid_until"), as_of).alias("temporal"),
        N.posterior_of().alias("belief"),
        N.frequency(F.col("access_count"), F.max("access_count").over(per)).alias("frequency"),
    )


def fuse(cands: DataFrame, channels: tuple[str, ...] = CHANNELS, weights: dict[str, float] = WEIGHTS, key: tuple[str, ...] = POOL, order: str = "cand_ord") -> DataFrame:
    """Weighted reciprocal-rank fusion: score = sum of w / (20 + rank + 1), rank from 0 among the rows a channel scores
    (those above 0), the number of such rows for the others; plus 0.05 times the semantic score."""
    parts, out = Window.partitionBy(*key), cands
    for c in channels:
        scored = F.col(c) > 0
        n = F.count_if(scored).over(parts)
        rank = F.row_number().over(parts.orderBy(scored.desc(), F.col(c).desc(), F.col(order))) - 1
        out = out.withColumn(f"rank_{c}", F.when(scored, rank).otherwise(n))
    total = sum((F.lit(weights[c]) / (L.RRF_K + F.col(f"rank_{c}") + 1) for c in channels), F.lit(0.0))
    return out.withColumn("score", total + (0.05 * F.col("semantic") if "semantic" in channels else 0.0))


def boosted(cands: DataFrame, identity: Identity = PERSONAL) -> DataFrame:
    """The multiplicative boosts on ``score``. ``negation`` and ``past`` (``with_intents``), ``predicate_hint`` and ``subject_hint``, and
    the facts' ``metadata`` (hedged, reported) take part where the columns are there."""
    flags, have = intents(F.col("text")), set(cands.columns)
    text, pred, obj, src = F.col("text"), F.col("predicate"), F.col("object_value"), F.col("source_text")
    near = lambda name: F.coalesce(F.col(name), F.lit(0.0)) if name in have else F.lit(0.0)
    temporal = flags["temporal"] | (near("past") > 0.25)
    cands = cands.withColumn("_align", predicate_alignment(text, pred, obj, src, identity=identity))
    align = F.col("_align")
    factor = 1.0 + align
    factor = factor * (1.0 + negation_alignment(near("negation"), F.col("is_negation")))
    factor = factor * (1.0 + past_alignment(text, near("past"), F.col("is_negation"), F.col("state")))
    factor = factor * F.when(flags["broad"], 1 + 0.3 * F.least(F.col("evidence_count"), F.lit(5)) / 5).otherwise(1.0)
    factor = factor * F.when(pred == "stated", 0.75).otherwise(1.3)
    factor = factor * F.when(F.col("state") == "superseded", F.when(temporal, 1.5).otherwise(0.1)).otherwise(1.0)
    if "metadata" in have:
        noted = lambda key: F.coalesce(F.get_json_object("metadata", f"$.{key}"), F.lit("")).isin("", "false") == F.lit(False)
        factor = factor * F.when(noted("hypothetical"), 0.4).otherwise(1.0) * F.when(noted("source_speaker"), 0.6).otherwise(1.0)
    factor = factor * (1.0 + subject_alignment(text, F.col("asker"), F.col("subject"), obj, src))
    factor = factor * F.when(pred.isin(list(L.GENERIC_PREDICATES)) & (flags["specific"] | (align > 0)), 0.5).otherwise(1.0)
    factor = factor * (1.0 + entity_boost(text, obj, src))
    factor = factor * F.when(flags["company"] & (F.col("scope") == "shared"), 1.8).otherwise(1.0)
    hint = lambda name: F.col(name) if name in have else F.lit(None).cast("string")
    subject = F.when(F.lower(hint("subject_hint")) == "user", F.col("asker")).otherwise(hint("subject_hint"))
    factor = factor * hints(hint("predicate_hint"), subject, identity)
    return cands.withColumn("score", F.col("score") * factor).drop("_align")


def diversify(ranked: DataFrame, top_k: int, key: tuple[str, ...] = ("query_id",), order: str = "cand_ord") -> DataFrame:
    """One row per subject of single-valued predicates, the third and later rows of a predicate halved, of an object cut to
    0.3; the first ``top_k`` before these penalties stay and are ordered by what is left of their score."""
    by_score = [F.col("score").desc(), F.col(order)]
    same = Window.partitionBy(*key, F.lower("subject"), "predicate").orderBy(*by_score)
    kept = ranked.withColumn("_dup", F.when(F.col("predicate").isin(list(L.INHIBITED)), F.row_number().over(same)).otherwise(1)).where("_dup = 1")
    obj = F.substring(F.trim(F.lower("object_value")), 1, 50)
    kept = kept.withColumn("_p", F.row_number().over(Window.partitionBy(*key, "predicate").orderBy(*by_score))).withColumn("_o", F.row_number().over(Window.partitionBy(*key, obj).orderBy(*by_score)))
    kept = kept.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*by_score))).where(F.col("_r") <= top_k)
    final = F.col("score") * F.when(F.col("_p") > 2, 0.5).otherwise(1.0) * F.when(F.col("_o") > 2, 0.3).otherwise(1.0)
    kept = kept.withColumn("score", final)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("score").desc(), "_r"))).drop("_dup", "_p", "_o", "_r")


def certainty(ranked: DataFrame, threshold: float = 0.15, key: str = "query_id") -> DataFrame:
    """(query, answer id, score, certainty, needs_clarification, alternatives): the margin of the best over the second."""
    top = ranked.where("rank <= 5").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("t"))
    s1, s2 = F.col("t")[0]["score"], F.get("t", F.lit(1))["score"]
    margin = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (s1 - s2) / F.greatest(F.abs(s1), F.lit(1e-6))))
    sure = F.when(s1 < L.MIN_ANSWER_SCORE, 0.0).when(s2.isNull(), 1.0).otherwise(margin)
    unclear = F.when(s1 < L.MIN_ANSWER_SCORE, True).when(s2.isNull(), False).otherwise(margin < threshold)
    return top.select(key, F.col("t")[0]["id"].alias("answer"), s1.alias("score"), sure.alias("certainty"), unclear.alias("needs_clarification"), F.col("t.id").alias("alternatives"))


def recall(queries: DataFrame, facts: DataFrame, as_of: float, top_k: int = 20, edges: DataFrame | None = None, traces: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """The whole of retrieval: pool, channels, fusion, boosts, diversity. ``queries`` (query_id, user_id, text) may have
    hints and intents, see ``boosted``. The graph, resonance and semantic channels are 0 without
    ``edges``, ``traces`` (a, b, n) and ``vectors`` (id, embedding; ``queries`` then has an ``embedding`` too)."""
    cands, semantic = pool(queries, facts, as_of, top_k, vectors), None
    if vectors is not None and "embedding" in queries.columns:
        cands = cands.join(vectors.select(F.col("id").alias("_id"), F.col("embedding").alias("_v")), F.col("id") == F.col("_id"), "left").drop("_id")
        semantic = F.greatest(F.lit(0.0), F.coalesce(N.cosine(F.col("embedding"), F.col("_v")), F.lit(0.0)))
    cands = channel_scores(cands, as_of, semantic).drop("_v")
    if edges is not None:
        from .graph import spread

        seeds = queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("node"))
        act = spread(edges, seeds)
        for side, name in (("subject", "_a"), ("object_value", "_b")):
            cands = cands.join(act.select(F.col("query_id").alias("_q"), F.col("node").alias("_n"), F.col("activation").alias(name)), (F.col("query_id") == F.col("_q")) & (F.lower(side) == F.col("_n")), "left").drop("_q", "_n")
        cands = cands.withColumn("graph", F.least(F.lit(1.0), F.greatest(F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))))).drop("_a", "_b")
    else:
        cands = cands.withColumn("graph", F.lit(0.0))
    if traces is not None:
        from .graph import resonance

        met = resonance(cands, traces).select(F.col("query_id").alias("_q"), F.col("id").alias("_i"), "resonance")
        cands = cands.join(met, (F.col("query_id") == F.col("_q")) & (F.col("id") == F.col("_i")), "left").drop("_q", "_i").withColumn("resonance", F.coalesce("resonance", F.lit(0.0)))
    else:
        cands = cands.withColumn("resonance", F.lit(0.0))
    return diversify(boosted(fuse(cands)), top_k)


def packed_vectors(rows: DataFrame, names: list[str], vector: str, block: int) -> DataFrame:
    """Unit vectors of one length, ``block`` rows of a task as one: dims, matrix (float64, packed), and an array of each of ``names``.
    Null, empty and zero vectors are left out."""
    import numpy as np
    import pandas as pd

    kinds = dict(rows.dtypes)
    schema = "dims int, matrix binary, " + ", ".join(f"{c} array<{kinds[c]}>" for c in names)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sizes = f[vector].map(len)
            for dims in sorted(sizes.unique()):
                same = f[sizes == dims]
                for at in range(0, len(same), block):
                    part = same.iloc[at : at + block]
                    m = np.stack([np.asarray(v, np.float64) for v in part[vector]])
                    length = np.sqrt((m * m).sum(1))
                    ok = length > 0
                    if ok.any():
                        yield pd.DataFrame([{"dims": int(dims), "matrix": (m[ok] / length[ok, None]).tobytes(), **{c: part[c][ok].tolist() for c in names}}])

    return rows.where(F.size(vector) > 0).select(*names, vector).mapInPandas(pack, schema)


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, per: tuple[str, ...] = ()) -> DataFrame:
    """Exact cosine top-k of each query vector (query_id, q) over all vectors (id, v[, per]), similarity above 0 and not of a
    query with itself: (query_id, *per, id, similarity, rank).

    Unit vectors are made once and packed in blocks of some thousand. Each block of queries meets each block of vectors as one
    matrix product, of which the best k of a query are handed on: what is joined is blocks, never pairs of rows.
    """
    import numpy as np
    import pandas as pd

    kinds = dict(vectors.dtypes)
    asked = packed_vectors(queries, ["query_id"], "q", BLOCK).select("dims", F.col("matrix").alias("asked"), "query_id")
    known = packed_vectors(vectors, ["id", *per], "v", BLOCK)
    schema = f"query_id {dict(queries.dtypes)['query_id']}, " + "".join(f"{c} {kinds[c]}, " for c in per) + f"id {kinds['id']}, similarity double"

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for x in f.to_dict("records"):
                sims = np.frombuffer(x["asked"]).reshape(-1, x["dims"]) @ np.frombuffer(x["matrix"]).reshape(-1, x["dims"]).T
                rows = pd.DataFrame({c: list(x[c]) for c in (*per, "id")})
                for q, row in zip(x["query_id"], sims, strict=True):
                    row = np.where(rows["id"].to_numpy() == q, 0.0, row)
                    # Ties at the k-th place all stay; the rank below decides between them.
                    groups = rows.groupby(list(per), sort=False).indices.values() if per else [np.arange(len(row))]
                    for at in groups:
                        mine = row[at]
                        least = np.partition(mine, -k)[-k] if len(mine) > k else 0.0
                        chosen = at[(mine > 0) & (mine >= least)]
                        if len(chosen):
                            yield rows.iloc[chosen].assign(query_id=q, similarity=row[chosen])[["query_id", *per, "id", "similarity"]]

    sims = known.join(asked, "dims").mapInPandas(best, schema)
    order = Window.partitionBy("query_id", *per).orderBy(F.col("similarity").desc(), "id")
    return sims.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
