"""Text to facts without a grammar, as generators on the JVM side: one text in, rows (seq, subject, predicate, object, confidence) out.

Input frames have ``seq``, ``user_id`` and ``text``. All are projections with ``explode``: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import text as T

EDGE, END = r"(^|[^A-Za-z0-9_])", r"($|[^A-Za-z0-9_])"
# ---- fixed values: patterns of numeric facts ----
NUMERIC = (
    ("amount", r"\$[0-9,.]+[BMKbmk]?"),
    ("team_size", r"[0-9]+[kKmMbB]?\s+(?:engineers?|employees?|people|members?)"),
    ("throughput", r"[0-9]+[kKmMbB]?\s+(?:TPS|tps|transactions?\s+per\s+second)"),
    ("latency", r"[0-9]+\s*(?:ms|milliseconds?)"),
    ("duration", r"[0-9]+\s*(?:years?|months?|weeks?)"),
)
# ---- fixed values: patterns of other kinds of text ----
KEY_VALUE = r"^\s*([a-zA-Z_\s]+?)\s*[:=]\s*(.+?)\s*$"
COMMIT_PARTS = r"^([A-Za-z0-9_]+)\s*(?:\(([^)]+)\))?\s*:\s*(.+)"
RESUME_LINE = r"^(.+?)\s*[—–-]\s*(.+?)(?:\s*\(([^()]+)\))?\s*$"
SPAN = r"(?i)^[0-9]+\s*(years?|months?|weeks?|days?)"
SELF = ("i'm", "i am", "i've", "i have", "i")
NO_ITEMS = ("some", "a", "few", "i", "we", "our", "the", "my")


def fact(subject: Column | str, predicate: Column | str, obj: Column, confidence: float) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(as_col(subject).alias("subject"), as_col(predicate).alias("predicate"), obj.alias("object"), F.lit(confidence).alias("confidence"))


def rows(df: DataFrame, facts: Column) -> DataFrame:
    return df.select("seq", F.explode(facts).alias("f")).select("seq", "f.*")


def find_all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def source_type(text: Column) -> Column:
    """What kind of text this is, first rule first."""
    t = F.trim(text)
    words = F.split(t, r"\s+")
    low = F.transform(words, lambda w: F.lower(w))
    n = F.when(F.length(t) == 0, 0).otherwise(F.size(words))
    lines = F.split(t, "\n")
    signed = F.contains(t, F.lit("|")) & (F.size(F.split(lines[0], r"\|")) >= 3) & (F.size(lines) <= 2)
    spoken = (n >= 2) & (n <= 4) & low[0].isin(list(L.SUBJECT_PRONOUNS)) & F.exists(F.slice(low, 2, 3), lambda w: w.isin(list(L.COMMON_VERBS)))
    verbless = (n <= 4) & ~F.exists(low, lambda w: w.isin("is", "am", "are", "was", "were", "have", "has", "had", "do", "does"))
    chat = t.rlike("^[a-z]") & F.exists(low, lambda w: w.isin(list(L.INFORMAL)))
    return (
        F.when(F.size(find_all(t, r"[a-zA-Z_]+\s*[:=]\s*\S+", 0)) >= 2, "kv_pairs")
        .when(signed, "email_signature")
        .when(t.rlike(T.COMMIT), "commit")
        .when(t.rlike("[@#][A-Za-z0-9_]"), "social")
        .when(t.rlike("[→=>-]"), "fragment")
        .when(t.rlike("^[A-Z]{3,}") & (F.contains(t, F.lit("—")) | F.contains(t, F.lit("–"))), "resume")
        .when(spoken, "sentence")
        .when(verbless, "fragment")
        .when(chat, "chat")
        .otherwise("sentence")
    )


def numeric(df: DataFrame) -> DataFrame:
    def found(name: str, pattern: str) -> Column:
        edge = "()" if pattern.startswith(r"\$") else EDGE
        return F.transform(find_all(F.col("text"), f"{edge}({pattern})", 2), lambda v: fact(F.col("user_id"), name, F.trim(v), 0.7))

    return rows(df, F.concat(*[found(n, p) for n, p in NUMERIC]))


def decisions(df: DataFrame) -> DataFrame:
    """What follows the first place of each decision marker, if it has five characters."""
    low = F.lower("text")

    def after(marker: str) -> Column:
        at = F.locate(marker, low)
        rest = F.trim(F.substring(F.col("text"), at + len(marker), F.length("text")))
        rest = F.trim(F.regexp_replace(F.trim(F.regexp_replace(rest, r"^[\s,]*(to\s+)?", "")), r"[.!?,;:]+$", ""))
        return F.when((at > 0) & (F.length(rest) >= 5), F.array(fact(F.col("user_id"), "decided", F.substring(rest, 1, 200), 0.8))).otherwise(F.array().cast("array<struct<subject:string,predicate:string,object:string,confidence:double>>"))

    return rows(df, F.concat(*[after(m) for m in L.DECISION_MARKERS]))


FACT = "array<struct<subject:string,predicate:string,object:string,confidence:double>>"


def key_values(df: DataFrame) -> DataFrame:
    return rows(df, key_value_facts(F.col("text"), F.col("user_id")))


def key_value_facts(text: Column, user: Column) -> Column:
    pattern = KEY_VALUE
    parts = F.filter(F.transform(F.split(text, r"[|\n]+"), lambda p: F.trim(p)), lambda p: p.rlike(pattern))
    key = lambda p: F.regexp_replace(F.lower(F.trim(F.regexp_extract(p, pattern, 1))), " ", "_")
    return F.transform(parts, lambda p: fact(user, key(p), F.regexp_extract(p, pattern, 2), 0.8))


def signature(df: DataFrame) -> DataFrame:
    return rows(df, signature_facts(F.col("text"), F.col("user_id")))


def signature_facts(text: Column, user: Column) -> Column:
    parts = F.transform(F.split(text, r"\|"), lambda p: F.trim(p))
    name = lambda i: F.when(i == 0, "name").when(i == 1, "job_title").when(i == 2, "works_at").otherwise("affiliated_with")
    made = F.transform(parts, lambda p, i: F.struct(user.alias("subject"), name(i).alias("predicate"), p.alias("object"), F.when(i < 3, 0.75).otherwise(0.6).alias("confidence")))
    return F.when(F.size(parts) >= 3, made).otherwise(F.array().cast(FACT))


def commits(df: DataFrame) -> DataFrame:
    return rows(df, commit_facts(F.col("text")))


def commit_facts(text: Column) -> Column:
    pattern = COMMIT_PARTS
    t = F.trim(text)
    part = lambda k: F.regexp_extract(t, pattern, k)
    both = F.array(fact("commit", part(1), F.trim(part(3)), 0.8), fact("commit", "affects", part(2), 0.8))
    return F.when(t.rlike(pattern), F.filter(both, lambda f: F.length(f["object"]) > 0)).otherwise(F.array().cast(FACT))


def social(df: DataFrame) -> DataFrame:
    return rows(df, social_facts(F.col("text"), F.col("user_id")))


def social_facts(t: Column, user: Column) -> Column:
    named = F.transform(find_all(t, "@([A-Za-z0-9_]+)"), lambda m: fact(m, "mentioned", F.substring(t, 1, 100), 0.5))
    tickets = F.transform(find_all(t, "([A-Z]+-[0-9]+)"), lambda m: fact(user, "works_on", m, 0.6))
    tags = F.transform(find_all(t, "#([A-Za-z0-9_]+)"), lambda m: fact(user, "tagged", m, 0.5))
    return F.concat(named, tickets, tags)


def resume(df: DataFrame) -> DataFrame:
    return rows(df, resume_facts(F.col("text"), F.col("user_id")))


def resume_facts(text: Column, u: Column) -> Column:
    """``Company — Role (dates)`` lines; lines in capitals are headings."""
    pattern = RESUME_LINE
    lines = F.filter(F.transform(F.split(F.trim(text), "\n"), lambda x: F.trim(x)), lambda x: x.rlike(pattern) & ~(x == F.upper(x)))

    def line(x: Column) -> Column:
        company, role, dates = (F.trim(F.regexp_extract(x, pattern, k)) for k in (1, 2, 3))
        return F.array(fact(u, "works_at", company, 0.75), fact(u, "job_title", role, 0.75), fact(u, "period", F.when(F.length(dates) > 0, F.concat(company, F.lit(": "), dates)).otherwise(""), 0.6))

    return F.filter(F.flatten(F.transform(lines, line)), lambda f: F.length(f["object"]) > 0)


def fragments(df: DataFrame) -> DataFrame:
    return rows(df, fragment_facts(F.col("text"), F.col("user_id")))


def fragment_facts(text: Column, u: Column) -> Column:
    """Arrow chains, period-separated notes (``Python. 8 years.``), single words."""
    t = F.trim(text)
    chain = F.filter(F.transform(F.split(F.regexp_replace(F.regexp_replace(t, "[→>=-]+>", "->"), "→", "->"), r"\s*->\s*"), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    has = F.transform(F.slice(chain, 2, 1000), lambda p, i: F.struct(F.when(i == 0, chain[0]).otherwise(u).alias("subject"), F.lit("has").alias("predicate"), p.alias("object"), F.lit(0.55).alias("confidence")))
    none = F.array().cast(FACT)
    arrows = F.when(F.size(chain) >= 2, F.concat(F.array(fact(u, "affiliated_with", chain[0], 0.6)), has)).otherwise(none)
    notes = F.filter(F.transform(F.split(t, r"\."), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    later = F.transform(F.slice(notes, 2, 1000), lambda p: F.when(p.rlike(SPAN), fact(u, "experience_with", F.concat(notes[0], F.lit(" ("), p, F.lit(")")), 0.7)).otherwise(fact(u, "related_to", F.concat(notes[0], F.lit(": "), p), 0.5)))
    word = F.trim(t, F.lit(".,;:!?"))
    single = F.when((F.size(F.split(t, r"\s+")) == 1) & (F.length(word) > 1), F.array(fact(u, "mentions", word, 0.4))).otherwise(none)
    return F.when(t.rlike("[→=>-]"), arrows).when(F.size(notes) >= 2, later).otherwise(single)


def entities(text: Column) -> Column:
    """Capitalised runs, quotations, camelCase and snake_case terms, each once by its lower-case form."""
    runs = F.filter(find_all(text, rf"{EDGE}([A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)*)", 2), lambda e: (F.length(e) > 1) & ~F.lower(e).isin(list(L.FIRST_PERSON_CONTRACTED)))
    every = F.concat(runs, find_all(text, '"([^"]+)"'), F.filter(find_all(text, "'([^']+)'"), lambda e: F.length(e) > 1), find_all(text, rf"{EDGE}([a-z]+(?:[A-Z][a-z]+)+)", 2), find_all(text, rf"{EDGE}([a-z]+(?:_[a-z]+)+)", 2))
    trimmed = F.transform(every, lambda e: F.trim(e))
    return F.filter(trimmed, lambda e, i: F.array_position(F.transform(trimmed, lambda x: F.lower(x)), F.lower(e)) == i + 1)


def entity_pairs(found: Column) -> Column:
    """array<struct<a, b>>: each entity with the two after it."""
    return F.flatten(F.transform(found, lambda a, i: F.transform(F.slice(found, i + 2, F.lit(2)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def between(text: Column, a: Column, b: Column) -> Column:
    """The text between the first places of two entities, whichever comes first, without blanks and punctuation at its ends."""
    t = F.lower(text)
    at, bt = F.position(F.lower(a), t), F.position(F.lower(b), t)
    cut = F.when(at < bt, F.substring(text, at + F.length(a), bt - at - F.length(a))).otherwise(F.substring(text, bt + F.length(b), at - bt - F.length(b)))
    return F.trim(F.trim(F.trim(cut), F.lit(".,;:!?-–—")))


def _near(text: Column, found: Column) -> Column:
    """Pairs of entities at most two apart with the text between them, of one to five words, as candidate facts."""
    with_words = F.transform(entity_pairs(found), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), between(text, p["a"], p["b"]).alias("w")))
    some = F.filter(with_words, lambda p: (F.length(p["w"]) > 0) & (F.size(F.split(p["w"], r"\s+")) <= 5))
    return F.transform(some, lambda p: F.struct(p["a"].alias("subject"), T.relation_predicate(p["w"]).alias("predicate"), p["b"].alias("object"), F.lit(0.6).alias("confidence")))


def cooccurrences(df: DataFrame) -> DataFrame:
    """Pairs of entities at most two apart and the text between them, if it has one to five words, as candidate facts."""
    return rows(df.withColumn("_found", entities(F.col("text"))), _near(F.col("text"), F.col("_found")))


def _own(text: Column, user: Column, found: Column) -> Column:
    """What stands between the writer's "I" (or "I am", "I have", ...) and an entity after it, if it is one to four words, as candidate
    facts on the user. "I" counts as a word of its own only."""
    low = F.lower(text)
    word = lambda m: r"(?<![a-z0-9_'])" + m + r"(?![a-z0-9_])"
    marker = F.coalesce(*[F.when(low.rlike(word(m)), F.lit(m)) for m in SELF])
    start = F.coalesce(*[F.when(marker == m, F.regexp_instr(low, F.lit(word(m)))) for m in SELF]) + F.length(marker)
    after = F.transform(found, lambda e: F.struct(e.alias("e"), F.trim(F.trim(F.trim(F.substring(text, start, F.position(F.lower(e), low) - start)), F.lit(".,;:!?-–—"))).alias("w")))
    some = F.filter(after, lambda p: (F.length(p["w"]) > 0) & (F.size(F.split(p["w"], r"\s+")) <= 4))
    facts = F.transform(some, lambda p: F.struct(user.alias("subject"), T.relation_predicate(p["w"]).alias("predicate"), p["e"].alias("object"), F.lit(0.7).alias("confidence")))
    return F.when(marker.isNotNull(), facts).otherwise(F.array().cast(FACT))


def self_references(df: DataFrame) -> DataFrame:
    """Candidate facts of the user about themself."""
    return rows(df.withColumn("_found", entities(F.col("text"))), _own(F.col("text"), F.col("user_id"), F.col("_found")))


def best_candidates(cands: DataFrame, least: float = 0.4, top: int = 10) -> DataFrame:
    """Candidates of some confidence, each fact once by its lower-case form, the surest first."""
    key = [F.lower("subject"), F.lower("predicate"), F.lower("object")]
    order = [F.col("confidence").desc(), F.col("subject"), F.col("predicate"), F.col("object")]
    one = cands.where(F.col("confidence") >= least).withColumn("_n", F.row_number().over(Window.partitionBy("seq", *key).orderBy(*order))).where("_n = 1")
    return one.withColumn("_r", F.row_number().over(Window.partitionBy("seq").orderBy(*order))).where(F.col("_r") <= top).drop("_n", "_r")


def corrected(cands: DataFrame, learned: DataFrame) -> DataFrame:
    """Apply learned corrections (wrong, right, object or null[, at]), in any case: those for the very object first, then those for any.
    Of several the last learned counts; one for an object counts for others too, where none is for any."""
    rules = learned.select(F.lower("wrong").alias("wrong"), F.lower("right").alias("right"), F.nullif(F.lower("object"), F.lit("")).alias("object"), F.col("at") if "at" in learned.columns else F.lit(0.0).alias("at"))
    exact = rules.where("object is not null").groupBy(F.col("wrong").alias("_w"), F.col("object").alias("_o")).agg(F.max_by("right", "at").alias("_x"))
    plain = rules.groupBy(F.col("wrong").alias("_v")).agg(F.coalesce(F.max_by("right", F.when(F.col("object").isNull(), F.col("at"))), F.max_by("right", "at")).alias("_y"))
    both = cands.join(exact, (F.lower("predicate") == F.col("_w")) & (F.lower("object") == F.col("_o")), "left").join(plain, F.lower("predicate") == F.col("_v"), "left")
    return both.withColumn("predicate", F.coalesce("_x", "_y", "predicate")).drop("_w", "_o", "_x", "_v", "_y")


def split_objects(df: DataFrame) -> DataFrame:
    """Lists in the object of multi-valued predicates (``Python, Go and Rust``) as one row an item, confidence times 0.9."""
    obj = F.trim("object")
    parts = F.filter(F.transform(F.split(obj, r",\s*(?:and\s+)?|\s+and\s+"), lambda p: F.trim(F.trim(p), F.lit(".,"))), lambda p: (F.length(p) > 1) & ~F.lower(p).isin(list(NO_ITEMS)))
    words = F.split(obj, r"\s+")
    capital = (F.size(words) >= 2) & F.forall(words, lambda w: w.rlike("^[A-Z]"))
    listed = obj.rlike(", | and ")
    items = F.when(listed & (F.size(parts) >= 2), parts).when(capital, words)
    ok = F.col("predicate").isin(list(L.SPLITTABLE)) | F.startswith("predicate", F.lit("is"))
    return df.where(ok).select(*[c for c in df.columns if c not in ("object", "confidence")], F.explode(items).alias("object"), (F.col("confidence") * 0.9).alias("confidence"))


def grammar_free(df: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """The extractor that a text's kind asks for, entity pairs and self-references of sentences; ``learned`` corrections; ranked.

    One pass: the kind is found once and chooses among arrays of facts, of which a text makes one.
    """
    text, user, kind = F.col("text"), F.col("user_id"), F.col("kind")
    typed = df.select("seq", "user_id", "text", source_type(text).alias("kind"))
    typed = typed.withColumn("found", F.when(kind.isin("sentence", "chat"), entities(text)))
    none = F.array().cast(FACT)
    made = F.when(kind == "kv_pairs", key_value_facts(text, user)).when(kind == "email_signature", signature_facts(text, user)).when(kind == "commit", commit_facts(text)).when(kind == "social", social_facts(text, user))
    made = made.when(kind == "fragment", fragment_facts(text, user)).when(kind == "resume", resume_facts(text, user)).when(kind.isin("sentence", "chat"), F.concat(_near(text, F.col("found")), _own(text, user, F.col("found"))))
    out = rows(typed, F.coalesce(made.cast(FACT), none))
    return best_candidates(corrected(out, learned) if learned is not None else out)
