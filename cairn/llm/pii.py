"""Personal data: patterns propose spans, checksums confirm them, context words move the score. Native functions only.

Defined cases: a null text is empty and has no spans; empty texts have none; repeated rows each give their own row; an
empty table gives an empty table; of clashing extra columns only the id and text columns named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import prefix_sums

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
#: Score of a confirmed span without context, and what a context word within CONTEXT_CHARS before it adds.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
BONUS = 0.15
CONTEXT_CHARS = 40
MIN_SCORE = 0.5
CONTEXT = {
    "email": "mail|contact|write",
    "ip": r"\bip\b|address|server|host",
    "card": "card|visa|amex|credit|debit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social|security|tax",
}

# A stand-in of the same length for a joint inside a match. With it each pattern is a plain run of a character class, so
# the matcher neither recurses nor tries a start twice, however long a run is.
_JOINT = "\x01"


def _prepared(text: Column) -> dict[str, tuple[Column, Column, str]]:
    """kind: (whether the text can hold one at all, the text to search, the pattern)."""
    free = F.translate(text, _JOINT, "\x02")
    digits = F.regexp_replace(free, "(?<=[0-9])[ -](?=[0-9])", _JOINT)
    dots = F.regexp_replace(free, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _JOINT)
    return {
        "email": (F.instr(text, "@") > 0, dots, rf"(?:(?<![A-Za-z0-9._%+{_JOINT}-])|\G)[A-Za-z0-9._%+{_JOINT}-]++@[A-Za-z0-9-]++{_JOINT}[A-Za-z0-9{_JOINT}-]++"),
        "ip": (text.rlike(r"[0-9]\.[0-9]"), text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
        "card": (text.rlike("[0-9](?:[ -]?[0-9]){13}"), digits, rf"(?<![0-9{_JOINT}])[0-9][0-9{_JOINT}]{{13,}}+"),
        "phone": (text.rlike(r"\+[0-9]"), text, r"\+[0-9][ ().0-9-]+[0-9]"),
        "iban": (text.rlike("[A-Z]{2}[0-9]{2}"), text, "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"),
        "ssn": (text.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"), text, "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    }


def luhn_ok(digits: Column) -> Column:
    """The Luhn checksum of a string of digits."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc
        + F.when(i % 2 == 0, (lambda d: d - F.when(d > 9, 9).otherwise(0))(digits.substr(n - i + 1, F.lit(1)).cast("int") * 2)).otherwise(
            digits.substr(n - i + 1, F.lit(1)).cast("int")
        ),
    )
    return total % 10 == 0


def mod97_ok(code: Column) -> Column:
    """The mod-97 checksum of an account code without spaces."""
    moved = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    rest = F.aggregate(
        F.sequence(F.lit(1), F.length(moved)),
        F.lit(0),
        lambda acc, i: F.when(moved.substr(i, F.lit(1)).rlike("[0-9]"), (acc * 10 + moved.substr(i, F.lit(1)).try_cast("int")) % 97).otherwise(
            (acc * 100 + F.ascii(moved.substr(i, F.lit(1))) - 55) % 97
        ),
    )
    return rest == 1


def _confirmed(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"\A(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])\z"))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn_ok(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        code = F.replace(found, F.lit(" "), F.lit(""))
        return F.when(F.length(code).between(15, 34), mod97_ok(code)).otherwise(F.lit(False))
    return F.lit(True)


def _spans_of(kind: str, no: int, body: Column) -> Column:
    """The confirmed spans of one kind, from its matches and their places."""

    def near(start: Column) -> Column:
        return F.lower(body.substr(F.greatest(start - CONTEXT_CHARS, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT_CHARS)))).rlike(CONTEXT[kind])

    def span(found: Column, i: Column) -> Column:
        start = F.get(f"_at_{kind}", 2 * i + 1)
        plain = F.translate(found, _JOINT, " ") if kind == "card" else found
        return F.struct(
            start.alias("start"),
            F.lit(no).alias("kind_no"),
            (start + F.length(found)).alias("end"),
            F.lit(kind).alias("kind"),
            (F.lit(SCORES[kind]) + F.when(near(start), BONUS).otherwise(0.0)).alias("score"),
            _confirmed(kind, plain).alias("ok"),
        )

    spans = F.transform(f"_in_{kind}", span)
    keep = F.filter(spans, lambda s: s["ok"] if kind in BASE_KINDS else s["ok"] & (s["score"] >= MIN_SCORE))
    return F.when(F.size(f"_in_{kind}") > 0, keep).otherwise(F.filter(spans, lambda s: F.lit(False)))


def with_spans(df: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """Adds an array of (start, kind_no, end, kind, score), ordered by start and then by kind; ends are exclusive code points."""
    body = F.coalesce(F.col(text), F.lit(""))
    kinds = _prepared(body)
    none = F.array().cast("array<string>")
    df = df.withColumns({f"_in_{k}": F.when(can, F.regexp_extract_all(at, F.lit(pattern), 0)).otherwise(none) for k, (can, at, pattern) in kinds.items()})
    df = df.withColumns({f"_out_{k}": F.when(F.size(f"_in_{k}") > 0, F.split(at, pattern, -1)).otherwise(none) for k, (_, at, pattern) in kinds.items()})
    # lengths of text and match by turns; the sum before a match is its start
    df = df.withColumns(
        {
            f"_at_{k}": F.when(
                F.size(f"_in_{k}") > 0,
                prefix_sums(F.flatten(F.zip_with(F.slice(f"_out_{k}", F.lit(1), F.size(f"_in_{k}")), f"_in_{k}", lambda a, b: F.array(F.length(a), F.length(b))))),
            ).otherwise(F.array().cast("array<int>"))
            for k in kinds
        }
    )
    each = [_spans_of(kind, no, body) for no, kind in enumerate(KINDS)]
    return df.withColumn(name, F.array_sort(F.concat(*each))).drop(*(f"_{x}_{k}" for x in ("in", "out", "at") for k in kinds))


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, the hash of the base spans, all spans as text, and their scores."""
    base = F.filter("_spans", lambda s: s["kind_no"] < len(BASE_KINDS))
    return with_spans(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "_text", "_spans").select(
        "doc_id",
        *(_count(k) for k in BASE_KINDS),
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("_spans")).alias("spans"),
        F.transform("_spans", lambda s: s["score"]).alias("scores"),
    )


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Puts ``[KIND]`` in place of every span, overlapping spans as one under the first one's kind. Other columns stay; null stays null."""
    df = with_spans(df.withColumn("_body", F.col(text)), "_body", "_spans")
    row = "struct<start:int,end:int,kind:string>"
    merged = F.aggregate(
        "_spans",
        F.array().cast(f"array<{row}>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] < F.element_at(acc, -1)["end"]),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"), F.element_at(acc, -1)["kind"].alias("kind"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))),
    )
    df = df.withColumn("_merged", F.when(F.size("_spans") > 0, merged))
    body = F.col("_body")
    parts = F.transform(
        "_merged",
        lambda s, i: F.concat(
            body.substr(F.when(i == 0, 0).otherwise(F.get("_merged", i - 1)["end"]) + 1, s["start"] - F.when(i == 0, 0).otherwise(F.get("_merged", i - 1)["end"])),
            F.lit("["),
            F.upper(s["kind"]),
            F.lit("]"),
        ),
    )
    clean = F.when(F.col("_merged").isNull(), body).otherwise(F.concat(F.array_join(parts, ""), body.substr(F.element_at("_merged", -1)["end"] + 1, F.length(body))))
    return df.withColumn(text, clean).drop("_body", "_spans", "_merged")
