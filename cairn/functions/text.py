"""Scalar text functions: all return Columns of built-in expressions, so they also work on streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The query stop words that results depend on.
QUERY_STOP_WORDS = ("a", "an", "and", "at", "by", "did", "does", "for", "in", "is", "of", "on", "or", "the", "to", "was", "what", "with")
# Token patterns.
BM25_TOKEN = r"[a-z]+(?:-[a-z]+)*|[0-9]+(?:\.[0-9]+)?%?"
LEXICAL_TOKEN = r"[a-z0-9]+"
QUERY_WORD = r"[a-z][a-z0-9]*"
CITATION = r"\[([A-Z0-9][A-Z0-9-]{2,})\]"
NUMERIC_TOKEN = r"(?i)(?<![\p{L}\p{N}_.])(?:[$€£]\s*|(?:usd|eur|gbp)\s+)?(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:[.,][0-9]+)?)(?:%|bn|m|b|x)?(?![\p{L}\p{N}_])"
#: Every character that counts as white space in text; shared with the SQL of the tests.
SPACE = r"[\t-\r \x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def fold(text: Column) -> Column:
    """Caseless form: lower case, and sharp s as two letters."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normalize(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def bm25_tokens(text: Column) -> Column:
    return _all(fold(text), BM25_TOKEN)


def tfidf_tokens(text: Column, stop_words: tuple[str, ...] = QUERY_STOP_WORDS) -> Column:
    return F.filter(_all(F.lower(text), r"[\p{L}\p{N}_]{2,}"), lambda t: ~t.isin(*stop_words))


def lexical_tokens(text: Column) -> Column:
    return F.array_distinct(_all(fold(text), LEXICAL_TOKEN))


def numeric_tokens(text: Column) -> Column:
    return F.array_distinct(F.transform(_all(text, NUMERIC_TOKEN), lambda t: F.replace(fold(t), F.lit(" "), F.lit(""))))


def query_words(text: Column) -> Column:
    """Distinct query words in order, without stop words."""
    return F.array_except(_all(fold(text), QUERY_WORD), F.array(*(F.lit(w) for w in QUERY_STOP_WORDS)))


def coverage(wanted: Column, held: Column, if_empty: float = 0.0) -> Column:
    """Share of ``wanted`` (a set) that ``held`` has."""
    return F.when(F.size(wanted) == 0, F.lit(if_empty)).otherwise(F.size(F.array_intersect(wanted, held)) / F.size(wanted))


def coverage_counted(wanted: Column, held: Column) -> Column:
    """Share of the entries of ``wanted``, repeats counted, whose caseless form ``held`` has; 1 for none wanted."""
    return F.when(F.size(wanted) == 0, F.lit(1.0)).otherwise(F.size(F.filter(wanted, lambda x: F.array_contains(held, fold(x)))) / F.size(wanted))


def phrase(text: Column) -> Column:
    return F.array_join(_all(fold(text), LEXICAL_TOKEN), " ")


def fact_present(fact: Column, answer: Column) -> Column:
    """Whether the words of ``fact`` stand together in ``answer``; a fact without words is not present."""
    own = phrase(fact)
    return (own != "") & F.contains(F.concat(F.lit(" "), phrase(answer), F.lit(" ")), F.concat(F.lit(" "), own, F.lit(" ")))


def citations(answer: Column) -> Column:
    return F.array_distinct(_all(answer, CITATION, 1))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def common_prefix(a: Column, b: Column) -> Column:
    """Characters that two texts share at their start; found by halving, so a long text costs some twenty comparisons."""
    span = F.struct(F.lit(0).alias("lo"), F.least(F.length(a), F.length(b)).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = F.ceil((s["lo"] + s["hi"]) / 2).cast("int")
        same = F.substring(a, F.lit(1), mid) == F.substring(b, F.lit(1), mid)
        return F.struct(F.when(same, mid).otherwise(s["lo"]).alias("lo"), F.when(same, s["hi"]).otherwise(F.greatest(s["lo"], mid - 1)).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(31)), span, step)["lo"]


def displayed_number(text: Column) -> Column:
    """The one integer that a cell shows, thousands parted by commas; null if there is none or more than one ("1,23" shows two)."""
    found = _all(text, r"[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+")
    return F.when(F.size(found) == 1, F.replace(F.get(found, F.lit(0)), F.lit(","), F.lit("")).try_cast("bigint"))


def call_signature(capability: Column, arguments: Column) -> Column:
    """Capability and its JSON arguments with sorted keys; numbers compare by value."""
    return F.concat(capability, F.lit(":"), F.to_json(F.try_parse_json(arguments)))


def judge_score(label: Column) -> Column:
    """A judge's word or number as a score from 0 to 1; null for anything else."""
    own, number = F.lower(F.trim(label)), F.trim(label).try_cast("double")
    return F.when(own.isin("yes", "true", "pass", "passed"), 1.0).when(own.isin("no", "false", "fail", "failed"), 0.0).when(number.between(0, 1), number)


def excerpt(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, back to a space, with an ellipsis if anything is cut."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.left(text, F.lit(limit)), r" [^ ]*\z", ""), F.lit("…")))
