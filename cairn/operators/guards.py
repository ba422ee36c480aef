"""Checks of whole tables: they return the rows that break a rule, never raise on data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Shapes of secrets and of private paths.
SECRET = r"(?i)(api[_-]?key|authorization|bearer\s+[a-z0-9._-]+|sk-[a-z0-9]{12,})"
PERSONAL_PATH = r"(?i)(?:^|[^A-Za-z0-9])/(?:Users|home)/"
WINDOWS_PERSONAL_PATH = r"(?i)(?:^|[^A-Za-z0-9])(?:[A-Za-z]:)?\\+(?:Users|home)(?:\\|$)"
WINDOWS_DRIVE_PATH = r"(?i)(?:^|[^A-Za-z0-9])[A-Za-z]:[\\/]"
WINDOWS_ROOTED_PATH = r"\\(?:[A-Za-z0-9][A-Za-z0-9._ -]*\\+)+[A-Za-z0-9]"
HIDDEN_REASONING = r"(?i)chain[- ]of[- ]thought|hidden reasoning"
URL_USERINFO = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@"
ASSIGNMENT = r"""(?i)\b[a-z0-9_-]*api[_-]?key\s*=\s*(?:"[^"]*"|'[^']*'|[^\s,;]+)"""
HEADER = r"""(?i)\bauthorization\s*:\s*(?:basic|bearer)\s+(?:"[^"]*"|'[^']*'|[^\s,;]+)"""
TOKEN = r"(?i)(bearer\s+[a-z0-9._-]+|sk-[a-z0-9_-]{8,})"
HOME = r"(?i)(?:(?:/Users|/home)/[^\r\n]*|[A-Z]:\\Users\\[^\r\n]*)"


def check_required(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, problem) of required fields that are null or blank, or have outer blanks."""
    problem = lambda c: F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), "missing").when(F.trim(F.col(c).cast("string")) != F.col(c).cast("string"), "untrimmed")
    each = F.array(*(F.struct(F.lit(c).alias("field"), problem(c).alias("problem")) for c in columns))
    return df.select(F.col(key).alias("key"), F.explode(each).alias("p")).select("key", "p.field", "p.problem").where("problem is not null")


def scan(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that a text matches."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), name) for name, p in patterns.items())))


def redact(text: Column) -> Column:
    """Credentials, headers, tokens and private paths by stand-ins, in this order."""
    for pattern, stand_in in ((ASSIGNMENT, "[credential]"), (HEADER, "[header]"), (TOKEN, "[token]"), (HOME, "[path]")):
        text = F.regexp_replace(text, pattern, stand_in)
    return text


def vector_problems(v: Column, dim: int) -> Column:
    """Why a vector can't be indexed; null if it can."""
    return F.when(v.isNull() | (F.size(v) == 0), "empty").when(F.size(v) != dim, "dimension").when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite")


def unsafe_key(key: Column) -> Column:
    """Whether a key is absolute, names a drive or climbs out of its folder."""
    return key.rlike(r"^(/|\\|[A-Za-z]:)") | F.exists(F.split(key, r"[/\\]"), lambda x: x == "..")


def table_hash(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One hash of a table: of the row hashes (fixed width) in the order of the key, a whole number.

    Row hashes are combined by ranges of 4096 keys, those by ranges of as many, and so on, so that no group has more than 4096
    distinct keys, however sparse they are, and the last has eight at most. A null key is of a range of its own, the first.
    """
    return table_hash_by(df, [], key, columns)


def table_hash_by(df: DataFrame, by: list[str], key: str, columns: list[str]) -> DataFrame:
    """``table_hash`` of each group of rows: (by, hash)."""
    row = F.sha2(F.to_json(F.array(*(F.col(c).cast("string") for c in columns))), 256)
    level = df.select(*by, F.col(key).cast("long").alias("k"), row.alias("h"))
    for _ in range(LEVELS):
        level = _joined(level.groupBy(*by, F.floor(F.col("k") / 4096).alias("range"))).select(*by, F.col("range").alias("k"), "h")
    return _joined(level.groupBy(*by)).select(*by, F.col("h").alias("hash"))


#: Ranges of 4096 of ranges, until eight are left of all whole numbers of 64 bits.
LEVELS = 5


def _joined(groups) -> DataFrame:
    return groups.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda s: s["h"]), ""), 256).alias("h"))


#: What a text that is shown to others must not hold, in the order in which it is told.
UNSAFE = {"credential": SECRET, "userinfo": URL_USERINFO, "personal_path": f"(?:{PERSONAL_PATH})|(?:{WINDOWS_PERSONAL_PATH})", "rooted_path": f"(?:{WINDOWS_DRIVE_PATH})|(?:{WINDOWS_ROOTED_PATH})", "hidden_reasoning": HIDDEN_REASONING}


def unsafe_text(text: Column) -> Column:
    """Names of the rules that a public text breaks: ``blank``, or those of UNSAFE. Null breaks none: there is no text."""
    own = F.trim(text)
    return F.when(own == "", F.array(F.lit("blank"))).otherwise(scan(own, UNSAFE))


def audit_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, values, rule, hits): how many texts of each string column were looked at, and how many break each rule of ``unsafe_text``; one pass."""
    columns = columns or [c for c, kind in df.dtypes if kind == "string"]
    each = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("text")) for c in columns))).alias("v")).select("v.*").where("text is not null")
    rules = ["blank", *UNSAFE]
    counts = each.withColumn("broken", unsafe_text(F.col("text"))).groupBy("column").agg(F.count("*").alias("values"), *(F.count_if(F.array_contains("broken", r)).alias(r) for r in rules))
    return counts.unpivot(["column", "values"], rules, "rule", "hits")


def golden_violations(dataset: DataFrame, cases: DataFrame, known: DataFrame) -> DataFrame:
    """(key, rule) of a golden set: ``dataset`` (dataset_version), ``cases`` (case_id, question, expected array, requires_abstention), ``known`` (passage_id).

    Rules: version (blank or none), empty (no cases), case_id and question (blank), duplicate_case (ids equal but for case and outer
    blanks), unknown_evidence, abstention (evidence where none may be expected).
    """
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    whole = dataset.agg(F.coalesce(F.max(~blank("dataset_version")), F.lit(False)).alias("ok")).where("not ok").select(F.lit("dataset").alias("key"), F.lit("version").alias("rule"))
    none = cases.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("dataset").alias("key"), F.lit("empty").alias("rule"))
    flags = F.array_compact(F.array(F.when(blank("case_id"), "case_id"), F.when(blank("question"), "question"), F.when(F.col("requires_abstention") & (F.size("expected") > 0), "abstention")))
    own = cases.select(F.coalesce("case_id", F.lit("")).alias("key"), F.explode(flags).alias("rule"))
    folded = F.lower(F.trim("case_id"))
    twice = cases.groupBy(folded.alias("key")).agg(F.count("*").alias("n")).where("n > 1 and key is not null").select("key", F.lit("duplicate_case").alias("rule"))
    asked = cases.select(F.explode("expected").alias("passage_id")).distinct()
    unknown = asked.join(known.select("passage_id"), "passage_id", "left_anti").select(F.col("passage_id").alias("key"), F.lit("unknown_evidence").alias("rule"))
    return whole.unionByName(none).unionByName(own).unionByName(twice).unionByName(unknown)


def element_violations(elements: DataFrame) -> DataFrame:
    """(element_id, rule) of elements (element_id, element_type, bbox struct<x0,y0,x1,y1>, rows, row_count, column_count); ``rows`` null for no table.

    Rules: area (the box has none), table (present for another type, or absent for a table), row_count, column_count (a row has another width).
    """
    has = F.col("rows").isNotNull()
    rules = F.array_compact(
        F.array(
            F.when(F.col("bbox").isNotNull() & ~F.coalesce((F.col("bbox.x1") > F.col("bbox.x0")) & (F.col("bbox.y1") > F.col("bbox.y0")), F.lit(False)), "area"),
            F.when((F.col("element_type") == "table") != has, "table"),
            F.when(has & ~F.coalesce((F.size("rows") == F.col("row_count")) & (F.col("row_count") > 0), F.lit(False)), "row_count"),
            F.when(has & ~F.coalesce(F.forall("rows", lambda r: F.size(r) == F.col("column_count")) & (F.col("column_count") > 0), F.lit(False)), "column_count"),
        )
    )
    return elements.select("element_id", F.explode(rules).alias("rule"))


def fusion_violations(channels: dict[str, DataFrame], k: int, weights: dict[str, float] | None = None) -> DataFrame:
    """(rule, channel, key) of what a fusion of rankings (query_id, passage_id, rank, content) must not have.

    Rules: k, no_channels, channel_name, unknown_weight and weight (of the parameters); empty, duplicate (an id twice under a question) and
    conflict (an id with different contents, in whatever channels).
    """
    spark = next(iter(channels.values())).sparkSession if channels else SparkSession.active()
    weights = weights or {}
    told = [("k", None, str(k))] * (isinstance(k, bool) or not isinstance(k, int) or k <= 0) + [("no_channels", None, None)] * (not channels)
    told += [("channel_name", c, None) for c in channels if not str(c).strip()] + [("unknown_weight", c, None) for c in weights if c not in channels]
    told += [("weight", c, str(w)) for c, w in weights.items() if c in channels and not 0 <= w < float("inf")]
    out = spark.createDataFrame(told, "rule string, channel string, key string")
    both = None
    for name, hits in channels.items():
        own = hits.select(F.lit(name).alias("channel"), "query_id", "passage_id", "content")
        both = own if both is None else both.unionByName(own)
        out = out.unionByName(own.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("empty").alias("rule"), F.lit(name).alias("channel"), F.lit(None).cast("string").alias("key")))
    if both is None:
        return out
    key = F.concat_ws(":", F.col("query_id").cast("string"), F.col("passage_id").cast("string")).alias("key")
    twice = both.groupBy("channel", "query_id", "passage_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate").alias("rule"), "channel", key)
    least, most = F.min("content"), F.max("content")
    odd = both.groupBy("passage_id").agg(least.alias("a"), most.alias("b")).where("a <> b").select(F.lit("conflict").alias("rule"), F.lit(None).cast("string").alias("channel"), F.col("passage_id").cast("string").alias("key"))
    return out.unionByName(twice).unionByName(odd)
