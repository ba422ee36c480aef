"""Scores of answers and whole cases, for every case of every configuration at once.

``cases`` has (case_id, expected_status, allow_briefing, required_companies, required_evidence_ids, required_fact_kinds,
required_limitations); ``predictions`` (case_id, configuration_id, status, briefing, text, cross_observations, limitations,
source_references), the last four null without a briefing; ``facts`` (case_id, configuration_id, fact_no, kind,
source_references, evidence_ids); ``observations`` (case_id, configuration_id, capability, status, source_references,
evidence_ids, hits array<struct<source,evidence_id>>). Scores are means of named checks, with a rationale that lists them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators.evaluation import LIMITATIONS, limitation_coverage

KEY = ["case_id", "configuration_id"]
# Wordings of the two dimensions of a mission.
DIMENSIONS = {"valuation": ("valuation", "p/e"), "operating growth": ("operating growth", "operating-growth", "revenue growth")}
#: What counts for a release and in a summary.
MEASURES = ("tool_correctness", "tool_efficiency", "answer_relevance", "answer_completeness", "citation_integrity")


def _sorted(keyed: DataFrame) -> DataFrame:
    """A table with a row for each case or key, met by sorted keys: its columns repeat, so files and shuffles are small for rows that a broadcast would unfold whole on the driver."""
    return keyed.hint("merge")


def check(name: str | Column, value: Column) -> Column:
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), F.coalesce(value.cast("double"), F.lit(0.0)).alias("value"))


def mean_of_checks(checks: Column) -> Column:
    """(value, rationale) of an array of checks, within the row; 1 for none."""
    names = lambda keep: F.array_join(F.transform(F.filter(checks, keep), lambda c: c["name"]), ", ")
    told = lambda c: F.when(c == "", "none").otherwise(c)
    value = F.when(F.size(checks) == 0, 1.0).otherwise(F.aggregate(checks, F.lit(0.0), lambda s, c: s + c["value"]) / F.size(checks))
    rationale = F.concat(F.lit("Satisfied: "), told(names(lambda c: c["value"] >= 1)), F.lit(". Missing: "), told(names(lambda c: c["value"] < 1)), F.lit("."))
    return F.struct(F.round(value, 6).alias("value"), rationale.alias("rationale"))


def _named(text: Column) -> Column:
    """The required companies that a text names."""
    return F.filter("required_companies", lambda c: F.contains(text, T.fold(c)))


def _scored(rows: DataFrame, checks: Column) -> DataFrame:
    return rows.withColumn("_checks", checks).select(*KEY, mean_of_checks(F.col("_checks")).alias("s")).select(*KEY, "s.value", "s.rationale")


def answer_relevance(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """(case_id, configuration_id, value, rationale): companies and both dimensions are named; or, where no briefing is allowed, there is none and the status is typed."""
    rows = predictions.join(_sorted(cases), "case_id")
    text = T.fold(F.coalesce("text", F.lit("")))
    companies = F.transform("required_companies", lambda c: F.struct(F.concat(F.lit("company "), c).alias("name"), F.contains(text, T.fold(c)).cast("double").alias("value")))
    dimensions = [check(f"mission dimension {name}", F.greatest(*(F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))) for name, words in DIMENSIONS.items()]
    stopped = F.array(check("expected typed status", F.col("status") == F.col("expected_status")), check("no briefing emitted", ~F.col("briefing")))
    return _scored(rows, F.when(F.col("allow_briefing"), F.concat(companies, F.array(*dimensions))).otherwise(stopped))


def answer_completeness(cases: DataFrame, predictions: DataFrame, facts: DataFrame, synonyms: dict[str, tuple[str, ...]] = LIMITATIONS) -> DataFrame:
    """(case_id, configuration_id, value, rationale): six checks, four of them shares of what is required."""
    none = F.array().cast("array<string>")
    # of a briefing's facts, only required ids and kinds are gathered: as many as are required at most
    wanted = facts.join(_sorted(cases.select("case_id", "required_evidence_ids", "required_fact_kinds")), "case_id")
    held = F.filter("evidence_ids", lambda e: F.array_contains("required_evidence_ids", e))
    ids = wanted.select(*KEY, F.explode(held).alias("e")).groupBy(*KEY).agg(F.collect_set("e").alias("ids"))
    kinds = wanted.where(F.array_contains("required_fact_kinds", F.col("kind"))).groupBy(*KEY).agg(F.collect_set("kind").alias("kinds"))
    rows = predictions.join(_sorted(cases), "case_id").join(_sorted(ids), KEY, "left").join(_sorted(kinds), KEY, "left")
    briefing, text = F.col("briefing"), T.fold(F.coalesce("text", F.lit("")))
    share = lambda required, have: F.when(F.size(required) == 0, 1.0).otherwise(F.size(F.filter(required, lambda x: F.array_contains(F.coalesce(have, none), x))) / F.size(required))
    checks = F.array(
        check("expected final status", F.col("status") == F.col("expected_status")), check("required evidence IDs", share(F.col("required_evidence_ids"), F.col("ids"))), check("required fact kinds", share(F.col("required_fact_kinds"), F.col("kinds"))),
        check("required companies", F.when(F.size("required_companies") == 0, 1.0).otherwise(F.size(_named(text)) / F.size("required_companies"))), check("cross-company comparison", briefing & (F.coalesce("cross_observations", F.lit(0)) > 0)),
        check("required limitations", limitation_coverage(F.col("required_limitations"), F.array_join(F.coalesce("limitations", none), " "), synonyms)),
    )
    return _scored(rows, checks)


def citation_integrity(cases: DataFrame, predictions: DataFrame, facts: DataFrame, observations: DataFrame, *, metric: str = "get_company_metric", document: str = "search_financial_documents") -> DataFrame:
    """(case_id, configuration_id, value, rationale), all or nothing: each fact has what its kind asks for, and the briefing's sources are those of
    its facts in the order of their first use.

    A metric fact has one source, of a successful metric call, and no evidence id; a document fact one source and one id that a
    successful search returned together and declares; a fact of another kind is not backed. Without a briefing: none was allowed and the
    status is the expected one.
    """
    sources, ids = F.col("source_references"), F.col("evidence_ids")
    good = observations.where("status = 'ok'")
    known = good.where(F.col("capability") == metric).select(*KEY, F.explode("source_references").alias("source"), F.lit("").alias("evidence"), F.lit("metric").alias("kind"))
    met = F.filter("hits", lambda h: F.array_contains(sources, h["source"]) & F.array_contains(ids, h["evidence_id"]))
    pairs = good.where(F.col("capability") == document).select(*KEY, F.explode(met).alias("h")).select(*KEY, F.col("h.source").alias("source"), F.col("h.evidence_id").alias("evidence"), F.lit("document").alias("kind"))
    backed = known.unionByName(pairs).distinct().withColumn("_ok", F.lit(True))
    asked = facts.select(*KEY, "fact_no", "kind", F.when(F.size(sources) == 1, F.get(sources, F.lit(0))).alias("source"), F.when((F.col("kind") == "metric") & (F.size(ids) == 0), "").when((F.col("kind") == "document") & (F.size(ids) == 1), F.get(ids, F.lit(0))).alias("evidence"))
    valid = asked.join(_sorted(backed), [*KEY, "kind", "source", "evidence"], "left").groupBy(*KEY).agg(F.bool_and(F.coalesce("_ok", F.lit(False))).alias("valid"))
    used = facts.select(*KEY, "fact_no", F.posexplode("source_references").alias("at", "source")).groupBy(*KEY, "source").agg(F.min(F.struct("fact_no", "at")).alias("first"))
    union = used.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "source"))), lambda s: s["source"]).alias("union"))  # the sources of one briefing
    none = F.array().cast("array<string>")
    rows = predictions.join(_sorted(cases), "case_id").join(_sorted(valid), KEY, "left").join(_sorted(union), KEY, "left")
    held, same = F.coalesce("valid", F.lit(False)), F.coalesce("source_references", none) == F.coalesce("union", none)
    checks = F.when(F.col("briefing"), F.array(check("observation-backed fact provenance", held), check("aggregate source union", same))).otherwise(F.array(check("expected no-briefing stop", ~F.col("allow_briefing") & (F.col("status") == F.col("expected_status")))))
    return _scored(rows, checks).withColumn("value", F.when(F.col("value") == 1, 1.0).otherwise(0.0))


def case_scores(cases: DataFrame, predictions: DataFrame, scores: dict[str, DataFrame], trajectory: DataFrame, observations: DataFrame) -> DataFrame:
    """(case_id, configuration_id, MEASURES, release, calls, latency_ms) from ``scores``, a table (case_id, configuration_id, value) for each measure.

    A case is released if its citations hold and a briefing is allowed or there is none. Latency is the sum over the trajectory, or over
    observations where there is none.
    """
    rows = predictions.select(*KEY, "briefing").join(_sorted(cases.select("case_id", "allow_briefing")), "case_id")
    for name in MEASURES:
        rows = rows.join(_sorted(scores[name].select(*KEY, F.col("value").alias(name))), KEY, "left")
    took = trajectory.groupBy(*KEY).agg(F.sum("duration_ms").alias("_trajectory"))
    called = observations.groupBy(*KEY).agg(F.sum("duration_ms").alias("_observed"), F.count("*").alias("calls"))
    rows = rows.join(_sorted(took), KEY, "left").join(_sorted(called), KEY, "left")
    release = (F.col("citation_integrity") == 1) & (F.col("allow_briefing") | ~F.col("briefing"))
    return rows.select(*KEY, *MEASURES, F.coalesce(release, F.lit(False)).alias("release"), F.coalesce("calls", F.lit(0).cast("long")).alias("calls"), F.round(F.coalesce("_trajectory", "_observed", F.lit(0.0)), 6).alias("latency_ms"))


def summarise(scores: DataFrame) -> DataFrame:
    """(configuration_id, cases, mean and number of passes of each measure, mean calls, mean and greatest latency, released: all are) of ``case_scores``."""
    means = [F.round(F.avg(m), 6).alias(f"{m}_mean") for m in MEASURES] + [F.count_if(F.col(m) == 1).alias(f"{m}_passed") for m in MEASURES]
    return scores.groupBy("configuration_id").agg(F.count("*").alias("cases"), *means, F.round(F.avg("calls"), 6).alias("mean_calls"), F.round(F.avg("latency_ms"), 6).alias("mean_latency_ms"), F.max("latency_ms").alias("max_latency_ms"), F.bool_and("release").alias("released"))
