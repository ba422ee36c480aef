"""What runs show of their evidence: filtered chunks, flattened observations, plan revisions, claims by company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.session import broadcast_if_small

ELEMENT_TYPES = ("heading", "paragraph", "list", "table", "figure_caption", "footnote")
#: Filters are a stated list; up to so many are broadcast.
FILTERS = 10_000
#: Columns of a filter that a chunk has one value for.
EXACT = ("company", "period", "document_type", "element_type", "document_id")


def same(wanted: Column, own: Column) -> Column:
    """Equal without regard to case and outer blanks; no wish is met by anything."""
    return wanted.isNull() | F.coalesce(T.fold(F.trim(wanted)) == T.fold(F.trim(own)), F.lit(False))


def filter_violations(filters: DataFrame, element_types: tuple[str, ...] = ELEMENT_TYPES) -> DataFrame:
    """(filter_id, element_type) of filters that ask for a type of element that there is none of."""
    return filters.where(F.col("element_type").isNotNull() & ~T.fold(F.trim("element_type")).isin(*element_types)).select("filter_id", "element_type")


def filtered(chunks: DataFrame, filters: DataFrame, element_types: tuple[str, ...] = ELEMENT_TYPES) -> DataFrame:
    """(filter_id, chunk_id) of all chunks that meet all wishes of a filter (filter_id, EXACT, segment); null wishes for nothing.

    Chunks have EXACT and ``segments``, of which one must be the wished one. Filters with a violation let nothing pass.
    """
    good = filters.join(filter_violations(filters, element_types).select("filter_id"), "filter_id", "left_anti")
    wish = good.select("filter_id", *(F.col(c).alias(f"_{c}") for c in EXACT), F.col("segment").alias("_segment"))
    meets = F.lit(True)
    for c in EXACT:
        meets = meets & same(F.col(f"_{c}"), F.col(c))
    meets = meets & (F.col("_segment").isNull() | F.coalesce(F.exists("segments", lambda s: same(F.col("_segment"), s)), F.lit(False)))
    return chunks.join(broadcast_if_small(wish, FILTERS), meets).select("filter_id", "chunk_id")


def flattened(observations: DataFrame, result: str = "result") -> DataFrame:
    """``observations`` with evidence_ids (of all hits, in order) and source_references (the payload's own first, then the hits', each once).

    ``result`` is a variant; what is no object, list or text where one is due is passed over.
    """
    text = lambda v, path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    r = F.col(result)
    none = F.array().cast("array<variant>")
    hits = F.coalesce(F.try_variant_get(r, "$.hits", "array<variant>"), none)
    ids = F.array_compact(F.transform(hits, lambda h: text(h, "$.evidence_id")))
    sources = F.array_compact(F.concat(F.array(text(r, "$.source")), F.transform(hits, lambda h: text(h, "$.source"))))
    return observations.withColumns({"evidence_ids": ids, "source_references": F.array_distinct(sources)})


def plan_revisions(trajectory: DataFrame, start: int = 1) -> DataFrame:
    """``trajectory`` (run_id, index, summary, plan_revision) with ``revision``, the plan's revision at each event.

    It is one higher after each event whose summary says replace_remaining, and raised to the revision of an observation. Both are
    running windows: with n replacements so far, it is n plus the greatest of ``start`` and what observations were ahead of theirs.
    """
    own = Window.partitionBy("run_id").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    replaced = F.contains(T.fold(F.coalesce("summary", F.lit(""))), F.lit("replace_remaining")).cast("int")
    rows = trajectory.withColumn("_r", replaced).withColumn("_n", F.sum("_r").over(own))
    ahead = F.max(F.col("plan_revision") - (F.col("_n") - F.col("_r"))).over(own)  # an event's own replacement comes after it is observed
    return rows.withColumn("revision", F.col("_n") + F.greatest(F.lit(start), F.coalesce(ahead, F.lit(start)))).drop("_r", "_n")


def company_claims(facts: DataFrame) -> DataFrame:
    """(run_id, place, company, claims) of facts (run_id, fact_no, company, claim): companies in the order of their first claim; facts without
    company or claim count for nothing."""
    told = facts.where(F.col("company").isNotNull() & F.col("claim").isNotNull())
    claims = told.groupBy("run_id", "company").agg(F.min("fact_no").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("fact_no", "claim"))), lambda s: s["claim"]).alias("claims"))
    return claims.select("run_id", F.row_number().over(Window.partitionBy("run_id").orderBy("first", "company")).alias("place"), "company", "claims")


def open_points(limitations: Column, questions: Column) -> Column:
    """Limitations, then the open questions as such."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(limitations, none), F.transform(F.coalesce(questions, none), lambda q: F.concat(F.lit("Open question: "), q)))
