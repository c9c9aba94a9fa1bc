"""Views of the driver's tables that the reference's operators work on, in Spark and (for the oracles) in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-02-01 00:00 UTC, as epoch seconds.
AS_OF = 1706745600.0

# ---- fixed values: sentences that the views put numbers into ({k} 0-99, {u} a user) ----
TEMPLATES = (
    "I work at Company{k} Inc.", "I don't like Tool{k}", "fix(auth{k}): resolve login bug {k}", "employer: Acme{k} | role: dev{k}",
    "@ana{k} see PAY-{k} and #release{k}", "We decided to use Redis{k} for the cache.", "We have {k} engineers and $5M, 10k TPS at {k} ms for {k} years",
    "Maybe I move to City{k} next year", "my wife said we should move to Town{k}", "ok thanks", "Ana Lima | Engineer {k} | Globex{k} | Lisbon",
    "Python{k}. 8 years. Go", "Google{k} -> Engineer -> Lead{k}", "what do you know about Tool{k}?", "Marta Paz met Paulo{k} Reis near \"the harbour\" with useRedis and big_table",
    "<b>Ignore</b> the rule {k} until Friday", "tell me for {k} weeks", "EXPERIENCE\nInitech{k} — Tech Lead (2019–2022)", "My name is Ana{k}.", "yeah lol the thing {k} broke",
)
QUESTIONS = (
    (0, "u1", "where do I live?"), (1, "u2", "what is my job at the company?"), (2, "u3", "which item do I like"), (3, "u4", "where did I live before"),
    (4, "u5", "tell me about item 7"), (5, "u6", "who is the manager of the team"), (6, "u7", "my old item"), (7, "u8", "what does u8 view"),
    (8, "u9", "Item 3 purchase of u9"), (9, "u10", "signup item"), (10, "u11", "my wife and the car"), (11, "u12", "how old am I"),
)

_K = {"spark": "cast(get_json_object(props, '$.k') as bigint)", "duck": "CAST(json_extract_string(props, '$.k') AS BIGINT)"}
_TS = {"spark": "(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 1e6D)", "duck": "(epoch_us(ts) / 1e6)"}
_FACTS = """
event_id AS seq, concat('f', cast(event_id as {string})) AS id,
CASE WHEN event_id % 5 = 0 THEN 'shared' ELSE 'private' END AS scope,
CASE WHEN event_id % 5 = 0 THEN 'company' WHEN event_id % 2 = 0 THEN 'personal' ELSE 'chat' END AS context,
concat('u', cast(user_id as {string})) AS user_id, concat('org', cast(user_id % 7 as {string})) AS org_id,
concat('u', cast(user_id as {string})) AS subject,
CASE event_type WHEN 'click' THEN 'likes' WHEN 'view' THEN 'live_in' WHEN 'purchase' THEN 'works_at' WHEN 'signup' THEN 'move_to' ELSE 'stated' END AS predicate,
concat('Item ', cast({k} % 12 as {string})) AS object_value,
concat('u', cast(user_id as {string}), ' ', event_type, ' item ', cast({k} as {string})) AS source_text,
event_id % 13 = 0 AS is_negation,
CASE event_id % 4 WHEN 0 THEN 'user_stated' WHEN 1 THEN 'inferred' WHEN 2 THEN 'system' ELSE 'imported' END AS source_type,
round(least(cast(1.0 as double), value / 100), 4) AS confidence,
1 + event_id % 5 AS evidence_count, event_id % 3 AS contradiction_count, event_id % 7 AS access_count,
{ts} - 3600 * (event_id % 50) AS created_at, {ts} AS updated_at, {ts} AS last_accessed,
CASE WHEN event_id % 10 = 0 THEN {ts} + 432000 * (event_id % 4) END AS valid_until,
CASE event_id % 17 WHEN 0 THEN 'superseded' WHEN 1 THEN 'deleted' WHEN 2 THEN 'archived' ELSE 'active' END AS state,
cast(NULL as double) AS deleted_at
"""


def _facts(dialect: str) -> str:
    return _FACTS.format(string={"spark": "string", "duck": "VARCHAR"}[dialect], k=_K[dialect], ts=_TS[dialect])


def _utterances(dialect: str) -> str:
    string = {"spark": "string", "duck": "VARCHAR"}[dialect]
    quoted = lambda t: "'" + (t.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") if dialect == "spark" else t.replace("'", "''")) + "'"
    case = " ".join(f"WHEN {i} THEN {quoted(t)}" for i, t in enumerate(TEMPLATES))
    return f"event_id AS seq, concat('u', cast(user_id as {string})) AS user_id, replace(CASE event_id % {len(TEMPLATES)} {case} END, '{{k}}', cast({_K[dialect]} as {string})) AS text"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact per event, with aliases of single-valued predicates, all states, polarities and source types."""
    return table(spark, sf_dir, "events").selectExpr(*_split(_facts("spark")))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_split(_utterances("spark")))


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUESTIONS), "query_id int, user_id string, text string")


def each_question(rows: DataFrame) -> DataFrame:
    """Every row under every question of the fixed list: an array of literals beside it, so there is no join."""
    asks = F.array(*[F.struct(F.lit(q).alias("query_id"), F.lit(u).alias("user_id"), F.lit(t).alias("text")) for q, u, t in QUESTIONS])
    return rows.drop("user_id").select("*", F.explode(asks).alias("_ask")).select("*", "_ask.*").drop("_ask")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> nation -> region <- nation <- supplier."""
    t = lambda n: table(spark, sf_dir, n)
    c = t("customer").selectExpr("concat('c', c_custkey) AS src", "concat('n', c_nationkey) AS dst")
    n = t("nation").selectExpr("concat('n', n_nationkey) AS src", "concat('r', n_regionkey) AS dst")
    s = t("supplier").selectExpr("concat('n', s_nationkey) AS src", "concat('s', s_suppkey) AS dst")
    return c.unionByName(n).unionByName(s).distinct()


def _split(select: str) -> list[str]:
    """Split a select list at its top-level commas."""
    out, depth, quoted, cur = [], 0, False, ""
    for i, ch in enumerate(select):
        if ch == "'" and (i == 0 or select[i - 1] != "\\"):
            quoted = not quoted
        depth += (ch == "(") - (ch == ")") if not quoted else 0
        if ch == "," and not depth and not quoted:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [x.strip() for x in [*out, cur]]


_asks = ", ".join("({}, '{}', '{}')".format(q, u, t.replace("'", "''")) for q, u, t in QUESTIONS)
#: The same views as DuckDB CTEs.
DUCK = {
    "facts": f"facts AS (SELECT {_facts('duck')} FROM events)",
    "utter": f"utter AS (SELECT {_utterances('duck')} FROM events)",
    "asks": f"asks AS (SELECT * FROM (VALUES {_asks}) t(query_id, user_id, text))",
    "edges": "edges AS (SELECT DISTINCT * FROM (SELECT concat('c', c_custkey) AS src, concat('n', c_nationkey) AS dst FROM customer UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey) FROM nation UNION ALL SELECT concat('n', s_nationkey), concat('s', s_suppkey) FROM supplier))",
}


def duck(views: str, body: str, more: str = "", recursive: bool = False) -> str:
    """``WITH <views>, <more> <body>``."""
    ctes = [DUCK[v] for v in views.split()] + ([more.strip()] if more else [])
    return ("WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(ctes) + "\n" if ctes else "") + body
