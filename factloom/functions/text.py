"""String functions of the fact model as JVM-side column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as L
from ..schema import literal, lookup

TOKEN_BREAK = r"[\s\-_/\\.,;:!?'\"()\[\]{}]+"
COMMIT = r"^(feat|fix|docs|style|refactor|test|chore|perf|ci|build|revert)\s*(\([^)]+\))?\s*:"
ANY_OF = lambda words: F.expr(literal(tuple(words)))


def norm_predicate(p: Column, empty: str = "stated") -> Column:
    """Lower case, blanks and hyphens to one underscore, other signs dropped; ``empty`` if nothing is left."""
    p = F.regexp_replace(F.trim(F.lower(p)), r"[-\s]+", "_")
    p = F.regexp_replace(F.regexp_replace(p, "[^a-z0-9_]", ""), "_+", "_")
    return F.coalesce(F.nullif(F.trim(p, F.lit("_")), F.lit("")), F.lit(empty))


def tokens(text: Column, stop: Iterable[str] = L.SEARCH_STOPWORDS) -> Column:
    """Lower-cased tokens of more than one character that are no stop words, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_BREAK), lambda t: (F.length(t) > 1) & ~t.isin(list(stop)))


def content_words(text: Column, stop: Iterable[str] = L.CONTENT_STOPWORDS) -> Column:
    """Distinct words of a query longer than two characters, edge punctuation stripped, without stop words."""
    words = F.transform(F.split(F.trim(F.lower(text)), r"\s+"), lambda w: F.trim(w, F.lit("'?.,!")))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(list(stop))))


def clean_token(word: Column) -> Column:
    return F.lower(F.trim(word, F.lit(".,!?;:\"'()[]{}")))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether any of the words occurs as a substring."""
    return F.exists(ANY_OF(words), lambda w: F.contains(text, w))


def strip_suffixes(obj: Column) -> Column:
    """Company suffixes, each once, in their fixed order (one may uncover the next)."""
    cut = lambda s, x: F.when(F.endswith(s, x), F.trim(F.substring(s, F.lit(1), F.length(s) - F.length(x)))).otherwise(s)
    return F.aggregate(ANY_OF(L.COMPANY_SUFFIXES), F.trim(obj), cut)


def relation_predicate(text: Column) -> Column:
    """The words between two entities as a predicate: leading articles and auxiliaries go, each once in a fixed order."""
    cut = lambda s, x: F.when(F.startswith(s, x), F.substring(s, F.length(x) + 1, F.length(s))).otherwise(s)
    s = F.aggregate(ANY_OF(L.RELATION_PREFIXES), F.lower(F.trim(text)), cut)
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\s+", "_"), "[^a-z0-9_]", ""), "_+", "_")
    return F.coalesce(F.nullif(F.trim(s, F.lit("_")), F.lit("")), F.lit("related_to"))


def lemma(verb: Column) -> Column:
    """Approximate base form of an English verb: irregular forms, then suffix rules."""
    v = F.lower(verb)
    cut = lambda n: F.substring(v, F.lit(1), F.length(v) - n)
    doubled, cvc = r"(.)\1$", r"[^aeiou][aeiou][^aeiou]$"

    def stem(n: int, restore: Column) -> Column:
        s = cut(n)
        return F.when(F.length(s) >= 2, F.when(s.rlike(doubled), F.substring(s, F.lit(1), F.length(s) - 1)).when(s.rlike(cvc), restore).otherwise(s)).otherwise(s)

    n = F.length(v)
    ed = F.when(v.rlike(r"(.)\1ed$"), cut(3)).when(v.rlike("[aeiou]ted$"), cut(1)).when(cut(2).rlike(cvc), cut(1)).otherwise(cut(2))
    return (
        F.when(n <= 2, v)
        .when(lookup(L.IRREGULAR_VERBS, v).isNotNull(), lookup(L.IRREGULAR_VERBS, v))
        .when(v.rlike("ying$"), cut(3))
        .when(v.rlike("ie[ds]$"), F.concat(cut(3), F.lit("y")))
        .when(v.rlike("ing$") & (n >= 5), stem(3, F.concat(cut(3), F.lit("e"))))
        .when(v.rlike("ed$") & (n >= 5), ed)
        .when(v.rlike("es$") & (n >= 4), F.when(v.rlike("ses$"), cut(1)).when(v.rlike("[sxzh]es$"), cut(2)).otherwise(cut(1)))
        .when(v.rlike("s$") & (n >= 4) & ~v.rlike("[su]s$"), cut(1))
        .otherwise(v)
    )


def is_verb_form(word: Column) -> Column:
    """Auxiliaries, -ing in any case, -ed and known -en forms in lower case only."""
    w = F.lower(word)
    return w.isin(list(L.AUXILIARIES)) | (F.length(w) >= 5) & (w.rlike("ing$") | ~word.rlike("^[A-Z]") & (w.rlike("ed$") | w.isin(list(L.PARTICIPLES_EN))))


def is_question(text: Column) -> Column:
    t = F.trim(text)
    starts = "|".join(L.QUESTION_STARTS)
    return (F.length(t) > 0) & (F.endswith(t, F.lit("?")) | F.lower(t).rlike(rf"^({starts})( |$)"))


def is_trivial(text: Column) -> Column:
    """Chat noise that is not worth a raw-text row. Text that is mostly non-ASCII never is."""
    raw = F.trim(text)
    t = F.lower(raw)
    words = F.split(t, r"\s+")
    n = F.when(F.length(t) == 0, 0).otherwise(F.size(words))
    foreign = F.length(F.regexp_replace(raw, r"[^\x00-\x7f]", "")) < 0.5 * F.length(raw)
    proper, digit = raw.rlike(r"(^|\s)[A-Z]"), t.rlike("[0-9]")
    factual = F.exists(words, lambda w: w.isin(list(L.FACTUAL_WORDS)))
    noise = F.lit(False)
    for start in L.NOISE_STARTS:
        rest = F.trim(F.substring(t, F.lit(len(start) + 1), F.length(t)))
        noise = noise | F.startswith(t, F.lit(start)) & (F.when(F.length(rest) == 0, 0).otherwise(F.size(F.split(rest, r"\s+"))) <= 3)
    informative = F.exists(words, lambda w: w.isin(list(L.INFO_VERBS)))
    return F.when(foreign, False).when(n <= 2, ~(factual | proper | digit)).when(noise, True).otherwise((n <= 4) & ~informative & ~proper & ~digit)


def safe_scope_id(x: Column) -> Column:
    """Safe as a folder name, else the first 16 hex digits of its SHA-256. Empty ids are an error."""
    return F.when(F.length(x) == 0, F.raise_error(F.lit("scope id must not be empty"))).when(x.rlike("^[A-Za-z0-9_-]{1,63}$"), x).otherwise(F.substring(F.sha2(x.cast("binary"), 256), 1, 16))


def repo_id(path: Column) -> Column:
    """A repository's id: the first 16 hex digits of its path's SHA-256."""
    return F.substring(F.sha2(path.cast("binary"), 256), 1, 16)


def merged_metadata(metadata: Column, more: Column) -> Column:
    """A JSON object with further keys (a map), which win; what is no JSON object counts as empty."""
    old = F.coalesce(F.from_json(metadata, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(more, k)), more))


def passing_date(text: Column, as_of: Column | float) -> Column:
    """When something happened, by phrases like ``yesterday``, ``last month``, ``a few days ago``; null without one."""
    as_of = F.lit(as_of) if isinstance(as_of, (int, float)) else as_of
    t = F.lower(text)
    word = lambda p: t.rlike(rf"(^|[^a-z0-9_])(?:{p})($|[^a-z0-9_])")
    some = F.regexp_extract(t, r"(?:a\s+)?(few|couple)\s+(day|week|month)s?\s+ago", 1)
    unit = F.regexp_extract(t, r"(?:a\s+)?(few|couple)\s+(day|week|month)s?\s+ago", 2)
    back = F.when(F.length(some) > 0, F.when(some == "few", 3).otherwise(2) * lookup(L.DURATION_SECONDS, unit))
    for phrase, days in L.DAYS_BACK.items():
        back = F.coalesce(back, F.when(word(phrase.replace(" ", r"\s+")), F.lit(days * 86400)))
    return as_of - F.coalesce(back, F.when(word(r"last\s+(?:night|monday|tuesday|wednesday|thursday|friday|saturday|sunday)"), F.lit(7 * 86400)))


def triplet(subject: Column, predicate: Column, obj: Column, negated: Column) -> Column:
    return F.concat(subject, F.lit(" "), F.when(negated, "not ").otherwise(""), predicate, F.lit(" "), obj)


def wrap_untrusted(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.concat(F.lit("<user_stated_untrusted>"), text, F.lit("</user_stated_untrusted>"))).otherwise(text)


def speaker(subject: Column) -> Column:
    """Who is quoted: the tokens before the first reporting verb; null for first person and where there is none."""
    words = F.split(F.trim(subject), r"\s+")
    at = F.array_position(F.transform(words, lambda w: F.lower(w).isin(list(L.ATTRIBUTION_VERBS))), True)
    later = F.array_position(F.transform(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w: F.lower(w).isin(list(L.ATTRIBUTION_VERBS))), True)
    who = F.array_join(F.slice(words, 1, later.cast("int")), " ")
    return F.when((F.size(words) >= 2) & ~F.lower(words[0]).isin("i", "me") & (later > 0) & at.isNotNull(), who)


def valid_until(text: Column, as_of: Column | float) -> Column:
    """When a phrase says that a fact ends: a week for ``until ...``, the span of ``for N units``; else null."""
    as_of = F.lit(as_of) if isinstance(as_of, (int, float)) else as_of
    t = F.lower(text)
    number = F.regexp_extract(t, r"(^|[^a-z0-9_])for\s+(\d+)\s+(day|week|month|year)s?($|[^a-z0-9_])", 2)
    unit = F.regexp_extract(t, r"(^|[^a-z0-9_])for\s+(\d+)\s+(day|week|month|year)s?($|[^a-z0-9_])", 3)
    return F.when(t.rlike(r"(^|[^a-z0-9_])until\s+[a-z0-9_]"), as_of + 604800).when(F.length(number) > 0, as_of + number.cast("double") * lookup(L.DURATION_SECONDS, unit))
