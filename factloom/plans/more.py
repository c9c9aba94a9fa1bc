"""Further registered queries: smaller operators, set operations, hints and counters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import numeric as N
from ..functions import text as T
from ..operators import beliefs as B
from ..operators import extract as X
from ..operators import graph as G
from ..operators import retrieval as R
from ..schema import PERSONAL, lookup
from .derive import AS_OF, duck, each_question, edges, facts, questions, table, utterances
from .suite import _AXIS, _DIV, _Q, _RANKED, _SYN, _TARGETS, SQL_CANON, SQL_LIVE, SQL_POST, SQL_RECENCY, _kw_sql, query, six, sql_content, sql_tokens, texts

_KEY = "subject, predicate, object_value, is_negation"


@query("w02_access_bump", duck("facts", "SELECT id, access_count + coalesce(n, 0) AS access_count, greatest(last_accessed, coalesce(t, last_accessed)) AS last_accessed FROM facts LEFT JOIN (SELECT concat('f', event_id // 4) AS i, count(*) AS n, max(epoch_us(ts) / 1e6) AS t FROM events GROUP BY 1) ON id = i"))
def _(spark, sf):
    f = facts(spark, sf)
    return B.accessed(f, f.select(F.expr("concat('f', seq div 4)").alias("id"), F.col("updated_at").alias("at")), AS_OF).select("id", "access_count", "last_accessed")


@query("w04_state_fold", duck("facts", "SELECT id, coalesce(s, state) AS state, CASE WHEN s = 'deleted' THEN CAST(q AS DOUBLE) WHEN s IS NOT NULL THEN NULL ELSE deleted_at END AS deleted_at FROM facts LEFT JOIN (SELECT concat('f', event_id // 3) AS i, arg_max(CASE event_id % 3 WHEN 0 THEN 'deleted' WHEN 1 THEN 'archived' ELSE 'active' END, event_id) AS s, max(event_id) AS q FROM events WHERE event_id % 3 < 2 OR event_id % 2 = 0 GROUP BY 1) ON id = i"))
def _(spark, sf):
    change = "CASE seq % 3 WHEN 0 THEN 'deleted' WHEN 1 THEN 'archived' ELSE 'active' END AS state"
    log = facts(spark, sf).where("seq % 3 < 2 or seq % 2 = 0").selectExpr("concat('f', seq div 3) AS id", "seq", change)
    return B.fold_states(facts(spark, sf), log).select("id", "state", "deleted_at")


@query("w11_forget_subject", duck("facts", f"SELECT state, count(*) AS n FROM (SELECT CASE WHEN subject = 'u3' AND predicate = 'likes' THEN 'deleted' ELSE state END AS state FROM facts) GROUP BY 1"))
def _(spark, sf):
    f = facts(spark, sf)
    return B.set_state(f, f.where("subject = 'u3' and predicate = 'likes'").select("id"), "deleted", AS_OF).groupBy("state").agg(F.count("*").alias("n"))


@query("w12_purge_tenant", duck("facts", "SELECT scope, user_id, count(*) AS n FROM facts WHERE NOT (scope = 'private' AND user_id = 'u3') GROUP BY ALL"))
def _(spark, sf):
    return B.purge(facts(spark, sf), "private", "u3").groupBy("scope", "user_id").agg(F.count("*").alias("n"))


@query("w15_llm_facts", duck("facts", "SELECT seq, CASE WHEN s IS NULL OR s = '' OR lower(trim(s)) = 'user' THEN user_id ELSE trim(s) END AS subject, p AS predicate, o AS object_value, coalesce(c, 0.9) AS confidence FROM (SELECT event_id AS seq, concat('u', user_id) AS user_id, CASE event_id % 4 WHEN 0 THEN 'User' WHEN 1 THEN NULL WHEN 2 THEN ' Ana ' ELSE '' END AS s, CASE event_id % 5 WHEN 0 THEN '' ELSE 'works_at' END AS p, CASE event_id % 7 WHEN 0 THEN ' ' ELSE event_type END AS o, CASE WHEN event_id % 3 = 0 THEN 0.5::DOUBLE END AS c FROM events) WHERE p <> '' AND trim(o) <> ''"))
def _(spark, sf):
    from ..session import llm_facts

    e = table(spark, sf, "events").selectExpr(
        "event_id AS seq", "concat('u', user_id) AS user_id", "'words' AS text",
        "array(struct(CASE event_id % 4 WHEN 0 THEN 'User' WHEN 1 THEN NULL WHEN 2 THEN ' Ana ' ELSE '' END AS subject, CASE event_id % 5 WHEN 0 THEN '' ELSE 'Works At' END AS predicate, CASE event_id % 7 WHEN 0 THEN ' ' ELSE event_type END AS object, CASE WHEN event_id % 3 = 0 THEN 0.5D END AS confidence)) AS facts",
    )
    return llm_facts(e).where("predicate <> 'stated'").select("seq", "subject", "predicate", "object_value", "confidence")


@query("w24_provenance", duck("facts", f"SELECT {_KEY}, count(*) AS records FROM facts WHERE seq % 2 = 1 AND predicate = 'stated' GROUP BY {_KEY}, scope, CASE scope WHEN 'private' THEN user_id ELSE org_id END"))
def _(spark, sf):
    from .suite import _written

    kept, log = _written(spark, sf)
    per = log.where("predicate = 'stated'").groupBy("fact_id").agg(F.count("*").alias("records"))
    return per.join(kept, F.col("fact_id") == F.col("id")).select(*_KEY.split(", "), "records")


@query("k11_degree_cap", duck("edges", "SELECT seed, node, rank FROM (SELECT seed, node, row_number() OVER (PARTITION BY seed ORDER BY degree DESC, node) AS rank FROM near JOIN (SELECT src AS n, count(*) AS degree FROM both_ways GROUP BY 1) ON n = node) WHERE rank <= 5", "both_ways AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)), near AS (SELECT DISTINCT seed, node FROM (SELECT b1.src AS seed, b1.dst AS node FROM both_ways b1 UNION ALL SELECT b1.src, b2.dst FROM both_ways b1 JOIN both_ways b2 ON b1.dst = b2.src) WHERE seed IN ('n3', 'r1') AND node <> seed)"))
def _(spark, sf):
    out = G.related(edges(spark, sf), spark.createDataFrame([("n3",), ("r1",)], "seed string"), 5)
    return out.select("seed", "node", F.col("rank").cast("long").alias("rank"))


@query("k13_weak_synapses", duck("facts", "SELECT a, b, n FROM (SELECT *, ntile(10) OVER (ORDER BY n, a, b) AS tenth FROM (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, count(*) AS n FROM ranked x JOIN ranked y ON x.query_id = y.query_id AND x.rank < y.rank GROUP BY ALL)) WHERE tenth > 1", _RANKED))
def _(spark, sf):
    order = Window.partitionBy("user_id").orderBy(F.col("access_count").desc(), "seq")
    ranked = facts(spark, sf).select(F.col("user_id").alias("query_id"), "id", F.row_number().over(order).alias("rank"))
    pairs = G.traces(ranked)
    # The weakest tenth by exact rank, found from counts by weight: no task sorts all pairs but those of the one weight at the cut.
    from ..operators.learning import drop_weakest

    return drop_weakest(pairs, 0.1).select("a", "b", "n")


@query("a05_replay", duck("facts", "SELECT id, CAST(sum(n) AS BIGINT) AS together FROM (SELECT a AS id, n FROM pairs UNION ALL SELECT b, n FROM pairs) GROUP BY 1 HAVING sum(n) >= 3", _RANKED + ", pairs AS (SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, count(*) AS n FROM ranked a JOIN ranked b ON a.query_id = b.query_id AND a.rank < b.rank GROUP BY ALL)"))
def _(spark, sf):
    order = Window.partitionBy("user_id").orderBy(F.col("access_count").desc(), "seq")
    ranked = facts(spark, sf).select(F.col("user_id").alias("query_id"), "id", F.row_number().over(order).alias("rank"))
    pairs = G.traces(ranked)
    return pairs.select(F.explode(F.array("a", "b")).alias("id"), "n").groupBy("id").agg(F.sum("n").alias("together")).where("together >= 3")


@query("a12_write_counters", duck("facts", f"SELECT CASE WHEN n > 1 THEN 'deduplicated' ELSE 'created' END AS action, count(*) AS keys, CAST(sum(n) AS BIGINT) AS writes FROM (SELECT count(*) AS n FROM facts GROUP BY {_KEY}) GROUP BY 1"))
def _(spark, sf):
    per = B.upsert(facts(spark, sf)).select(F.col("evidence_count").alias("n"))
    return per.groupBy(F.when(F.col("n") > 1, "deduplicated").otherwise("created").alias("action")).agg(F.count("*").alias("keys"), F.sum("n").alias("writes"))


@query("j14_id_to_scope", duck("facts", "SELECT id, scope, user_id FROM facts WHERE id IN ('f1', 'f5', 'f10', 'f77', 'nope')"))
def _(spark, sf):
    return facts(spark, sf).where(F.col("id").isin("f1", "f5", "f10", "f77", "nope")).select("id", "scope", "user_id")


@query("j15_keyword_predicates", duck("asks", f"SELECT query_id, unnest({_TARGETS}) AS predicate FROM asks"))
def _(spark, sf):
    return questions(spark).select("query_id", F.explode(R.target_predicates(F.col("text"))).alias("predicate"))


_TEMPORAL = "(" + " OR ".join(f"contains(lower(text), '{k}')" for k in L.TEMPORAL_KEYWORDS) + r" OR regexp_matches(lower(text), '(^|[^a-z0-9_])(my|the|our|their|his|her|a|an)\s+old($|[^a-z0-9_])'))"
_FIRST = "regexp_matches(lower(text), '(^|[^a-z0-9_])(i|my|me|mine|myself)($|[^a-z0-9_])')"
_SYNONYMS = "flatten(list_transform(list_filter(terms, lambda t: t IN (" + texts(L.SYNONYMS) + ")), lambda t: CASE t " + " ".join(f"WHEN '{k}' THEN [{texts(v)}]" for k, v in L.SYNONYMS.items()) + " END))"
_NEWEST = "(SELECT *, row_number() OVER (PARTITION BY scope ORDER BY {by} DESC, seq DESC) AS n FROM r WHERE {of})"
#: The candidate pool with k = 10, branch by branch.
_POOL = f"""{_Q}, q AS (SELECT query_id, user_id AS asker, text, terms, list_filter(list_concat(terms, {_SYNONYMS}), lambda t: length(t) >= 2) AS wanted, {_TEMPORAL} AS temporal, {_FIRST} AS first_person FROM qs),
r AS (SELECT *, {sql_tokens("concat_ws(' ', source_text, object_value, replace(predicate, '_', ' '))")} AS toks FROM (SELECT *, {SQL_LIVE} AND {SQL_POST} > 0.15 AS live FROM facts) WHERE live OR state = 'superseded'),
b0 AS (SELECT query_id, scope, id, row_number() OVER (PARTITION BY query_id, scope ORDER BY seq) AS n FROM q JOIN r ON r.live OR q.temporal WHERE len(list_filter(wanted, lambda t: len(list_filter(toks, lambda d: starts_with(d, t))) > 0)) > 0),
own AS (SELECT query_id, scope, id, predicate, updated_at, seq FROM q JOIN r ON r.live AND q.first_person AND r.subject = q.asker),
b AS (SELECT query_id, scope, id, 0 AS src, n FROM b0 WHERE n <= 50
UNION ALL SELECT query_id, scope, id, 2, n FROM q, {_NEWEST.format(by="updated_at", of="NOT live")} WHERE temporal AND n <= 10
UNION ALL SELECT query_id, scope, id, 3, n FROM q, {_NEWEST.format(by="last_accessed", of="live")} WHERE n <= 10
UNION ALL SELECT query_id, scope, id, 4, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id, scope ORDER BY updated_at DESC, seq DESC) AS n FROM own) WHERE n <= 50
UNION ALL SELECT query_id, scope, id, 5, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id, scope ORDER BY updated_at DESC, seq DESC) AS n FROM own WHERE predicate <> 'stated') WHERE n <= 2000),
e AS (SELECT query_id, scope, id, min(src * 1000000 + n) AS a1, min(CASE WHEN src <> 3 THEN src * 1000000 + n END) AS a2 FROM b GROUP BY ALL),
entered AS (SELECT query_id, scope, id, CASE WHEN early < 10 THEN a1 ELSE a2 END AS place FROM (SELECT *, count(CASE WHEN a1 < 3000000 THEN 1 END) OVER (PARTITION BY query_id, scope) AS early FROM e)),
pool AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY scope, place) AS cand_ord FROM entered WHERE place IS NOT NULL)"""


@query("u01_candidate_pool", duck("facts asks", "SELECT query_id, id, cand_ord FROM pool", _POOL))
def _(spark, sf):
    return R.pool(questions(spark), facts(spark, sf), AS_OF, 10).select("query_id", "id", F.col("cand_ord").cast("long").alias("cand_ord"))


@query("u03_token_sets", f"SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.t, b.t)) AS both, len(list_distinct(list_filter(a.t, lambda x: NOT list_contains(b.t, x)))) AS only_a FROM (SELECT item_id, list_distinct({sql_tokens('text')}) AS t FROM benchmark) a JOIN (SELECT item_id, list_distinct({sql_tokens('text')}) AS t FROM benchmark) b ON b.item_id = a.item_id + 1")
def _(spark, sf):
    t = table(spark, sf, "benchmark").select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("t"))
    both = t.select(F.col("item_id").alias("a"), F.col("t").alias("x")).join(t.select(F.col("item_id").alias("b"), F.col("t").alias("y")), F.col("b") == F.col("a") + 1)
    return both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("both"), F.size(F.array_except("x", "y")).cast("long").alias("only_a"))


@query("f05_clean_token", duck("utter", "SELECT DISTINCT w AS word, lower(trim(w, '.,!?;:\"''()[]{}')) AS clean FROM (SELECT unnest(string_split(text, ' ')) AS w FROM utter)"))
def _(spark, sf):
    return utterances(spark, sf).select(F.explode(F.split("text", " ")).alias("word")).distinct().select("word", T.clean_token(F.col("word")).alias("clean"))


@query("f07_porter_stem")
def _(spark, sf):
    from ..functions.stem import stems

    docs = table(spark, sf, "benchmark").withColumn("t", T.tokens(F.col("text")))
    return docs.select("item_id", F.array_join(stems(F.col("t")), " ").alias("stems"))


@query("f11_relation_predicate", duck("utter", "SELECT seq, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(" + f"s{len(L.RELATION_PREFIXES)}" + ", '\\s+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_'), ''), 'related_to') AS predicate FROM " + f"f{len(L.RELATION_PREFIXES)}", "f0 AS (SELECT seq, lower(trim(text)) AS s0 FROM utter), " + ", ".join(f"f{i + 1} AS (SELECT seq, CASE WHEN starts_with(s{i}, '{p}') THEN s{i}[{len(p) + 1}:] ELSE s{i} END AS s{i + 1} FROM f{i})" for i, p in enumerate(L.RELATION_PREFIXES))))
def _(spark, sf):
    return utterances(spark, sf).select("seq", T.relation_predicate(F.col("text")).alias("predicate"))


@query("f13_repo_id", duck("utter", "SELECT seq, sha256(concat('/srv/', user_id))[1:16] AS repo_id FROM utter"))
def _(spark, sf):
    return utterances(spark, sf).select("seq", T.repo_id(F.concat(F.lit("/srv/"), F.col("user_id"))).alias("repo_id"))


@query("f18_truncate", "SELECT doc_id, length(text[1:500]) AS n, text[1:50] AS head FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(F.substring("text", 1, 500)).cast("long").alias("n"), F.substring("text", 1, 50).alias("head"))


@query("f21_commit_message", duck("utter", "SELECT seq, regexp_matches(text, '^(feat|fix|docs|style|refactor|test|chore|perf|ci|build|revert)\\s*(\\([^)]+\\))?\\s*:') AS is_commit FROM utter"))
def _(spark, sf):
    return utterances(spark, sf).select("seq", F.col("text").rlike(T.COMMIT).alias("is_commit"))


@query("t03_age_days", duck("facts", f"SELECT id, round(({AS_OF} - created_at) / 86400.0, 6) AS age_days FROM facts"))
def _(spark, sf):
    return facts(spark, sf).select("id", six(N.age_days(F.col("created_at"), AS_OF), "age_days"))


@query("m07_fan", duck("edges", "SELECT src, round(1.0 / log2(count(*) + 2.0), 6) AS fan FROM edges GROUP BY 1"))
def _(spark, sf):
    return edges(spark, sf).groupBy("src").agg(F.count("*").alias("n")).select("src", six(N.fan(F.col("n")), "fan"))


@query("m10_linear_map", "SELECT a.vec_id AS id, round(CASE WHEN s >= 0.3 THEN least(1.0, (s - 0.3) / 0.5) ELSE 0.0 END, 6) AS base FROM (SELECT a.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) a")
def _(spark, sf):
    v = table(spark, sf, "embeddings")
    one = v.select((F.col("vec_id") - 1).alias("_id"), F.col("embedding").alias("q"))
    s = v.join(one, F.col("vec_id") == F.col("_id")).select(F.col("vec_id").alias("id"), N.cosine(F.col("embedding"), F.col("q")).alias("s"))
    return s.select("id", six(N.linear_boost(F.col("s")), "base"))


@query("y01_ordered_dedupe", duck("utter", "SELECT seq, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS words FROM (SELECT seq, string_split(lower(text), ' ') AS w FROM utter)"))
def _(spark, sf):
    return utterances(spark, sf).select("seq", F.array_join(F.array_distinct(F.split(F.lower("text"), " ")), " ").alias("words"))


_ENTITIES = f"""list_transform(list_concat(list_filter(regexp_extract_all(text, '(^|[^A-Za-z0-9_])([A-Z][a-zA-Z]*(?:\\s+[A-Z][a-zA-Z]*)*)', 2), lambda x: length(x) > 1 AND lower(x) NOT IN ({texts(L.FIRST_PERSON_CONTRACTED)})), regexp_extract_all(text, '"([^"]+)"', 1), list_filter(regexp_extract_all(text, '\'\'([^\'\']+)\'\'', 1), lambda x: length(x) > 1), regexp_extract_all(text, '(^|[^A-Za-z0-9_])([a-z]+(?:[A-Z][a-z]+)+)', 2), regexp_extract_all(text, '(^|[^A-Za-z0-9_])([a-z]+(?:_[a-z]+)+)', 2)), lambda x: trim(x))"""


@query("y02_entity_pairs", duck("utter", "SELECT seq, e[i] AS a, e[j] AS b FROM (SELECT seq, e, unnest(range(1, len(e) + 1)) AS i FROM (SELECT seq, list_filter(e, lambda x, i: list_position(list_transform(e, lambda y: lower(y)), lower(x)) = i) AS e FROM (SELECT seq, " + _ENTITIES + " AS e FROM utter))), (VALUES (1), (2)) s(k), LATERAL (SELECT i + k AS j) WHERE j <= len(e)"))
def _(spark, sf):
    return utterances(spark, sf).select("seq", F.explode(X.entity_pairs(X.entities(F.col("text")))).alias("p")).select("seq", "p.a", "p.b")


@query("y05_json_tolerant", duck("facts", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"))
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("y06_metadata_merge", duck("facts", "SELECT id, CASE seq % 3 WHEN 0 THEN concat('{\"k\":\"', id, '\",\"hypothetical\":\"true\"}') ELSE '{\"hypothetical\":\"true\"}' END AS metadata FROM facts"))
def _(spark, sf):
    old = F.when(F.col("seq") % 3 == 0, F.concat(F.lit('{"k":"'), F.col("id"), F.lit('","hypothetical":"false"}'))).when(F.col("seq") % 3 == 1, "{bad").otherwise("[1]")
    return facts(spark, sf).select("id", T.merged_metadata(old, F.create_map(F.lit("hypothetical"), F.lit("true"))).alias("metadata"))


@query("r10_r11_past_alignment", duck("facts asks", f"SELECT query_id, id, CASE WHEN NOT (f.is_negation OR f.state = 'superseded') THEN 0.0 WHEN len(list_filter([{texts(R.PAST_KEYWORDS)}], lambda k: contains(lower(q.text), k))) > 0 THEN greatest(1.5, least(2.5, (s - 0.1) * 5)) WHEN s >= 0.2 THEN greatest(0.5, least(2.5, (s - 0.15) * 5)) ELSE 0.0 END::DOUBLE AS past, CASE WHEN f.is_negation AND s >= 0.35 THEN least(2.0, (s - 0.25) * 4) ELSE 0.0 END::DOUBLE AS negation FROM (SELECT *, query_id / 12.0 AS s FROM asks) q, facts f"))
def _(spark, sf):
    # Stands for a similarity to the prototypes.
    near = F.col("query_id") / 12.0
    c = each_question(facts(spark, sf))
    return c.select("query_id", "id", R.past_alignment(F.col("text"), near, F.col("is_negation"), F.col("state")).alias("past"), R.negation_alignment(near, F.col("is_negation")).alias("negation"))


@query("t02_passing_date", duck("utter", f"SELECT seq, CASE WHEN seq % 6 = 0 THEN {AS_OF} - 86400 WHEN seq % 6 = 1 THEN {AS_OF} - 30 * 86400 WHEN seq % 6 = 2 THEN {AS_OF} - 3 * 86400 WHEN seq % 6 = 3 THEN {AS_OF} - 2 * 2592000 WHEN seq % 6 = 4 THEN {AS_OF} - 7 * 86400 END AS at FROM utter"))
def _(spark, sf):
    phrases = F.array(*[F.lit(x) for x in ("I left yesterday", "moved Last  month", "a few days ago we met", "couple months ago", "last friday it rained", "I live in Rome at last")])
    return utterances(spark, sf).select("seq", T.passing_date(phrases[(F.col("seq") % 6).cast("int")], AS_OF).alias("at"))


@query("r15_hints", duck("facts", f"SELECT id, CASE WHEN predicate = 'lives_in' OR {SQL_CANON} = 'lives_in' THEN 3.0 ELSE 1.0 END::DOUBLE * CASE WHEN subject = 'u3' THEN 2.0 ELSE 1.0 END::DOUBLE AS factor FROM facts"))
def _(spark, sf):
    return facts(spark, sf).select("id", R.hints(F.lit("lives_in"), F.lit("u3")).alias("factor"))


@query("r17_stats", duck("facts", f"SELECT scope, context, count(*) AS n, count_if({SQL_LIVE} AND {SQL_POST} > 0.15) AS believed FROM facts GROUP BY ALL"))
def _(spark, sf):
    on = (F.col("state") == "active") & N.unexpired(F.col("valid_until"), AS_OF) & (N.posterior_of() > L.POSTERIOR_FLOOR)
    return facts(spark, sf).groupBy("scope", "context").agg(F.count("*").alias("n"), F.count_if(on).alias("believed"))


@query("l04_graph_build", duck("facts", "SELECT DISTINCT lower(subject) AS src, lower(object_value) AS dst FROM facts WHERE subject <> '' AND object_value <> ''"))
def _(spark, sf):
    return G.edges_of(facts(spark, sf))


@query("x19_corrections", duck("facts", "SELECT id, CASE WHEN predicate = 'likes' AND object_value = 'Item 3' THEN 'prefers' WHEN predicate = 'likes' THEN 'enjoys' ELSE predicate END AS predicate FROM facts"))
def _(spark, sf):
    learned = spark.createDataFrame([("likes", "prefers", "Item 3"), ("likes", "enjoys", None)], "wrong string, right string, object string")
    return X.corrected(facts(spark, sf).select("id", "predicate", F.col("object_value").alias("object")), learned).select("id", "predicate")


@query("x01_x07_grammar")
def _(spark, sf):
    from ..operators.grammar import extract

    return extract(utterances(spark, sf))


@query("b06_presets", duck("facts", f"SELECT predicate, {SQL_CANON} AS canon, count(*) AS n FROM facts GROUP BY ALL"))
def _(spark, sf):
    return facts(spark, sf).groupBy("predicate").agg(F.count("*").alias("n")).select("predicate", F.coalesce(lookup(PERSONAL.aliases, F.col("predicate")), "predicate").alias("canon"), "n")


@query("p14_p18_guards", duck("utter", f"SELECT seq, length(trim(text)) > 0 AS asked, lower(text) IN ({texts(L.GENERIC_PREDICATES)}) AS generic FROM utter"))
def _(spark, sf):
    return utterances(spark, sf).select("seq", (F.length(F.trim("text")) > 0).alias("asked"), F.lower("text").isin(list(L.GENERIC_PREDICATES)).alias("generic"))


# ---- recall as a whole ------------------------------------------------------------------------------------------------
_HOPS = """edges AS (SELECT DISTINCT lower(subject) AS src, lower(object_value) AS dst FROM facts WHERE subject <> '' AND object_value <> ''),
fwd AS (SELECT src, dst, 1.0 / log2(count(*) OVER (PARTITION BY src) + 2.0) AS fan FROM edges),
rev AS (SELECT dst AS src, src AS dst, 1.0 / log2(count(*) OVER (PARTITION BY dst) + 2.0) AS fan FROM edges),
seeds AS (SELECT DISTINCT query_id, unnest(terms) AS seed FROM qs),
h1 AS (SELECT query_id, seed, dst AS node, max(0.5 * fan) AS a FROM seeds JOIN (SELECT * FROM fwd UNION ALL SELECT * FROM rev) ON src = seed GROUP BY ALL),
h2 AS (SELECT query_id, seed, f.dst AS node, max(a * 0.5 * fan) AS a FROM h1 JOIN fwd f ON f.src = node WHERE f.dst <> seed AND a * 0.5 * fan > 0.01 GROUP BY ALL),
h3 AS (SELECT query_id, seed, f.dst AS node, max(a * 0.5 * fan) AS a FROM h2 JOIN fwd f ON f.src = node WHERE f.dst <> seed AND a * 0.5 * fan > 0.005 GROUP BY ALL),
act AS (SELECT query_id, node, max(a) AS a FROM (SELECT query_id, seed AS node, 1.0 AS a FROM seeds UNION ALL SELECT query_id, node, a FROM h1 UNION ALL SELECT query_id, node, a FROM h2 UNION ALL SELECT query_id, node, a FROM h3) GROUP BY ALL)"""
_TEXT = "lower(concat_ws(' ', object_value, source_text))"
_ABOUT = "lower(concat_ws(' ', subject, object_value, source_text))"
_WORDS = r"regexp_split_to_array(trim({0}), '\s+')"
#: Channels of each candidate, then what single boosts ask for.
_CANDS = f"""d AS (SELECT *, list_distinct(list_concat(list_concat(src, objects), {sql_tokens("replace(predicate, '_', ' ')")})) AS every FROM (SELECT *, {sql_tokens("source_text")} AS src, {sql_tokens("object_value")} AS objects FROM facts)),
met AS (SELECT p.cand_ord, q.query_id, q.asker, q.text, lower(q.text) AS lt, q.temporal, q.first_person, q.terms, d.*, coalesce(x.a, 0.0) AS xa, coalesce(y.a, 0.0) AS ya
 FROM pool p JOIN d ON d.id = p.id JOIN q ON q.query_id = p.query_id LEFT JOIN act x ON x.query_id = p.query_id AND x.node = lower(d.subject) LEFT JOIN act y ON y.query_id = p.query_id AND y.node = lower(d.object_value)),
cands AS (SELECT *, {_kw_sql('terms')} AS keyword, {SQL_RECENCY} AS recency, {SQL_POST} AS belief, log2(1.0 + access_count) / log2(1.0 + greatest(max(access_count) OVER (PARTITION BY query_id, scope), 1)) AS frequency,
 least(1.0, greatest(xa, ya)) AS graph, {SQL_CANON} AS canon, {_TARGETS} AS targets, {sql_content('text')} AS content FROM met),
asked AS (SELECT *, len(list_intersect(string_split(replace(predicate, '_', ' '), ' '), content)) AS shared, len(list_filter(content, lambda w: contains({_TEXT}, w))) AS hits, len(list_filter(content, lambda w: contains({_ABOUT}, w))) AS about, {_ABOUT} AS t, lt AS q,
 {_AXIS} AS axis, list_distinct(list_transform(list_filter(list_transform({_WORDS.format('text')}, lambda w: trim(w, '?.,!"''')), lambda w: regexp_matches(w, '^[A-Z]') OR length(w) > 3), lambda w: lower(w))) AS ents,
 len(list_filter({_WORDS.format('lt')}, lambda w: length(w) > 2 AND w NOT IN ({texts(L.INTENT_STOPWORDS)}))) > 0 AS specific, len(list_filter([{texts(L.COMPANY_KEYWORDS)}], lambda k: contains(lt, k))) > 0 AS company, len(list_filter([{texts(("tell me about", "what do you know", "what about", "describe", "summarize"))}], lambda k: contains(lt, k))) > 0 AS broad,
 len(list_filter([{texts(L.QUERY_RELATIONSHIPS)}], lambda r: contains(lt, r))) > 0 AS named, len(list_filter([{texts(R.PAST_KEYWORDS)}], lambda k: contains(lt, k))) > 0 AS past FROM cands),
scored AS (SELECT *, CASE WHEN shared > 0 THEN greatest(axis, least(1.0, 0.5 * shared)) ELSE axis END AS s2 FROM asked),
aligned AS (SELECT *, CASE WHEN predicate = 'stated' THEN 0.0 ELSE greatest(0.0, CASE WHEN s2 < 0.4 AND hits >= 2 THEN greatest(s2, 0.3) ELSE s2 END) END AS align FROM scored)"""


def _rank_sql(channel: str) -> str:
    per = "PARTITION BY query_id, scope"
    return f"CASE WHEN {channel} > 0 THEN row_number() OVER ({per} ORDER BY {channel} > 0 DESC, {channel} DESC, cand_ord) - 1 ELSE count(CASE WHEN {channel} > 0 THEN 1 END) OVER ({per}) END"


_RRF = " + ".join(f"{R.WEIGHTS[c]}::DOUBLE / (20 + {_rank_sql(name) if name else '0'} + 1)" for c, name in zip(R.CHANNELS, ("", "keyword", "recency", "belief", "frequency", "graph", ""), strict=True))
_FACTOR = f"""(1.0 + align) * (1.0 + CASE WHEN past AND (is_negation OR state = 'superseded') THEN 1.5 ELSE 0.0 END) * CASE WHEN broad THEN 1 + 0.3 * least(evidence_count, 5) / 5 ELSE 1.0 END * CASE WHEN predicate = 'stated' THEN 0.75 ELSE 1.3 END
 * CASE WHEN state = 'superseded' THEN CASE WHEN temporal THEN 1.5 ELSE 0.1 END ELSE 1.0 END * (1.0 + CASE WHEN first_person AND NOT named AND length(asker) > 0 AND subject = asker THEN 1.5 WHEN len(list_filter([{texts(L.QUERY_RELATIONSHIPS)}], lambda r: contains(lt, r) AND contains(t, r))) > 0 THEN 1.5 WHEN {_SYN} THEN 1.2 WHEN about >= 2 THEN 0.6 ELSE 0.0 END)
 * CASE WHEN predicate IN ({texts(L.GENERIC_PREDICATES)}) AND (specific OR align > 0) THEN 0.5 ELSE 1.0 END * (1.0 + CASE WHEN len(ents) > 0 THEN 0.8 * len(list_filter(ents, lambda x: contains({_TEXT}, x))) / len(ents) ELSE 0.0 END) * CASE WHEN company AND scope = 'shared' THEN 1.8 ELSE 1.0 END"""


@query("r16_recall", duck("facts asks", "SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(final, 6) AS score FROM ranks", f"{_POOL}, {_HOPS}, {_CANDS}, fused AS (SELECT *, CAST(({_RRF}) * ({_FACTOR}) AS DOUBLE) AS score FROM aligned), {_DIV}"))
def _(spark, sf):
    f = facts(spark, sf)
    return R.recall(questions(spark), f, AS_OF, 10, G.edges_of(f)).select("query_id", "rank", "id", six(F.col("score"), "score"))
