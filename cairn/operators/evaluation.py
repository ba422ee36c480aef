"""Evaluation of answers and of logged runs, for all cases at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as T


def case_metrics(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Six measures of each case and the first stage that failed.

    ``answers`` has (case_id, question, period, answer, abstained, expected); ``hits`` (query_id, passage_id, rank, period).
    """
    got = hits.groupBy(F.col("query_id").alias("case_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "passage_id"))), lambda s: s["passage_id"]).alias("got"), F.collect_set(F.col("period").alias("p")).alias("periods")
    )
    rows = answers.join(got, "case_id", "left").withColumns({"got": F.coalesce("got", F.array().cast("array<string>")), "periods": F.coalesce("periods", F.array().cast("array<string>")), "cited": T.citations(F.col("answer"))})
    must_abstain = F.size("expected") == 0
    share = lambda a, b: F.size(F.array_intersect(a, b)) / F.size(a)
    first = F.array_min(F.filter(F.transform("got", lambda p, i: F.when(F.array_contains("expected", p), i + 1)), lambda x: x.isNotNull()))
    stayed = F.when(F.col("abstained"), 1.0).otherwise(0.0)
    rows = rows.withColumns(
        {
            "recall": F.when(must_abstain, stayed).otherwise(share(F.col("expected"), F.col("got"))),
            "reciprocal_rank": F.when(must_abstain, stayed).otherwise(F.coalesce(1.0 / first, F.lit(0.0))),
            "filter_correctness": F.when(F.col("period").isNull() | F.forall("periods", lambda p: p == F.col("period")), 1.0).otherwise(0.0),
            "citation_correctness": F.when(must_abstain, F.when(F.size("cited") == 0, 1.0).otherwise(0.0)).when(F.size("cited") == 0, 0.0).otherwise(share(F.col("cited"), F.array_intersect("expected", "got"))),
            "grounding": F.when(must_abstain, 1.0).otherwise(F.when(T.fact_present(F.substring("question", 1, 30), F.col("answer")), 1.0).otherwise(0.0)),
            "abstention": F.when(must_abstain == F.col("abstained"), 1.0).otherwise(0.0),
        }
    )
    stage = F.when(F.col("abstention") < 1, "abstention").when(F.col("recall") < 1, "retrieval").when(F.col("filter_correctness") < 1, "filter").when(F.col("citation_correctness") < 1, "citation").when(F.col("grounding") < 1, "grounding").otherwise("none")
    names = ("recall", "reciprocal_rank", "filter_correctness", "citation_correctness", "grounding", "abstention")
    return rows.select("case_id", *(F.round(n, 6).alias(n) for n in names), stage.alias("failure_stage"))


def score_checks(checks: DataFrame, *keys: str) -> DataFrame:
    """(keys, no, name, value) to a mean and the names that are and aren't satisfied, in order."""
    listed = lambda keep: F.array_join(F.transform(F.filter("c", keep), lambda s: s["name"]), ", ")
    rows = checks.groupBy(*keys).agg(F.avg("value").alias("value"), F.array_sort(F.collect_list(F.struct("no", "name", "value"))).alias("c"))
    name = lambda c: F.when(c == "", "none").otherwise(c)
    rationale = F.concat(F.lit("Satisfied: "), name(listed(lambda s: s["value"] >= 1)), F.lit(". Missing: "), name(listed(lambda s: s["value"] < 1)), F.lit("."))
    return rows.select(*keys, F.round("value", 6).alias("value"), rationale.alias("rationale"))


def after_terminal(trajectory: DataFrame) -> DataFrame:
    """Execution events that come after the first blocked or failed gate or guardrail of their run."""
    ends = F.col("phase").isin("evidence_gate", "guardrail") & F.col("status").isin("blocked", "error")
    before = F.max(ends.cast("int")).over(Window.partitionBy("run_id").orderBy("index").rowsBetween(Window.unboundedPreceding, -1))
    return trajectory.withColumn("_e", before).where((F.col("_e") == 1) & (F.col("phase") == "execution")).drop("_e")


def efficiency(observations: DataFrame, trajectory: DataFrame, budget: int) -> DataFrame:
    """One less penalties over the budget: repeated good calls, calls above budget, calls after the end; not under 0."""
    sign = observations.withColumn("signature", T.call_signature(F.col("capability"), F.col("arguments")))
    repeats = sign.where("status = 'ok'").groupBy("run_id", "signature").agg(F.count("*").alias("n")).groupBy("run_id").agg(F.sum(F.col("n") - 1).alias("redundant"))
    calls = observations.groupBy("run_id").agg(F.count("*").alias("calls"))
    late = after_terminal(trajectory).groupBy("run_id").agg(F.countDistinct("attempt_id").alias("late"))
    rows = calls.join(repeats, "run_id", "left").join(late, "run_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    above = F.greatest(F.lit(0), F.col("calls") - budget)
    value = F.greatest(F.lit(0.0), 1 - (n("redundant") + above + n("late")) / max(1, budget))
    return rows.select("run_id", "calls", n("redundant").alias("redundant"), n("late").alias("late"), F.round(value, 6).alias("value"))


def ordered_before(calls: DataFrame, first: Column, second: Column) -> DataFrame:
    """For each run, whether the first call of one kind comes before the first of another."""
    return calls.groupBy("run_id").agg(F.min(F.when(first, F.col("index"))).alias("a"), F.min(F.when(second, F.col("index"))).alias("b")).select("run_id", F.coalesce(F.col("a") < F.col("b"), F.lit(False)).alias("ordered"))


def guardrail_owner(trajectory: DataFrame) -> DataFrame:
    """Each guardrail event with the last event before it that is none."""
    own = Window.partitionBy("run_id").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    owner = F.last(F.when(F.col("phase") != "guardrail", F.col("index")), ignorenulls=True).over(own)
    return trajectory.withColumn("owner", owner).where("phase = 'guardrail'").select("run_id", "index", "owner")


def call_graph_problems(edges: DataFrame, max_depth: int = 64) -> DataFrame:
    """(case_id, call_id, problem): prerequisites that are unknown, and calls on or behind a cycle.

    Leaves are taken away round by round; what is left after as many rounds as the longest path has calls is cyclic.
    """
    from cairn.session import materialise

    calls = edges.select("case_id", F.col("call_id").alias("needs"))  # only held against: repeated ones do no harm
    needs = edges.where("needs is not null")
    unknown = needs.join(calls, ["case_id", "needs"], "left_anti").select("case_id", "call_id", F.lit("unknown_prerequisite").alias("problem"))
    left = needs.join(calls, ["case_id", "needs"], "left_semi").select("case_id", "call_id", "needs")
    left = materialise(left, "call-edges")
    size = left.count()
    for _ in range(max_depth):
        kept = materialise(left.join(left.select("case_id", F.col("call_id").alias("needs")), ["case_id", "needs"], "left_semi"), "call-edges")
        now = kept.count()
        left = kept
        if now in (0, size):
            break
        size = now
    return unknown.unionByName(left.select("case_id", "call_id").distinct().withColumn("problem", F.lit("cycle")))


# Wordings that count for a required limitation.
LIMITATIONS = {
    "currencies": ("currencies", "currency"),
    "reporting periods": ("reporting periods", "reporting period"),
    "business definitions": ("business definitions", "business definition", "business mixes", "business mix"),
}


def limitation_coverage(required: Column, text: Column, synonyms: dict[str, tuple[str, ...]] = LIMITATIONS) -> Column:
    """Share of required limitations that a text words in one way or another; 1 if none is required."""
    plain = T.fold(text)
    known = F.create_map(*(x for k, v in synonyms.items() for x in (F.lit(k), F.array(*(F.lit(w) for w in v)))))
    ways = lambda p: F.coalesce(F.try_element_at(known, T.fold(p)), F.array(T.fold(p)))
    met = F.filter(required, lambda p: F.exists(ways(p), lambda w: F.contains(plain, w)))
    return F.when(F.size(required) == 0, 1.0).otherwise(F.size(met) / F.size(required))


def citation_integrity(facts: DataFrame, observed: DataFrame) -> DataFrame:
    """All or nothing for each run: every fact's (source, evidence) pair was observed, and the run's list of sources is the
    ordered union of its facts' sources. ``facts`` has (run_id, no, source, evidence, claimed)."""
    pairs = observed.select("source", "evidence").distinct().withColumn("ok", F.lit(True))
    rows = facts.join(pairs, ["source", "evidence"], "left").groupBy("run_id").agg(
        F.bool_and(F.coalesce("ok", F.lit(False))).alias("backed"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("no", "source"))), lambda s: s["source"])).alias("union"), F.first("claimed").alias("claimed")
    )
    return rows.select("run_id", "backed", (F.col("union") == F.col("claimed")).alias("union_holds"), F.when(F.col("backed") & (F.col("union") == F.col("claimed")), 1.0).otherwise(0.0).alias("score"))


def comparison_refusals(scores: DataFrame, parameters: DataFrame) -> DataFrame:
    """(reason) why configurations can't be compared: fewer than two, one twice, several datasets, cases that not all of them have, a case twice.

    ``parameters`` has a row for each configuration (configuration, dataset_version, dataset_hash), ``scores`` (configuration, case_id, ...).
    """
    n = parameters.agg(F.countDistinct("configuration").alias("n"), F.count("*").alias("rows"), F.countDistinct("dataset_version", "dataset_hash").alias("datasets"))
    told = n.select(F.explode(F.array_compact(F.array(F.when(F.col("n") < 2, "fewer than two configurations"), F.when(F.col("rows") > F.col("n"), "a configuration twice"), F.when(F.col("datasets") > 1, "several datasets")))).alias("reason"))
    per_case = scores.groupBy("case_id").agg(F.countDistinct("configuration").alias("in"), F.count("*").alias("rows"))
    flags = per_case.crossJoin(F.broadcast(n.select("n"))).agg(F.max(F.col("in") < F.col("n")).alias("lacking"), F.max(F.col("rows") > F.col("in")).alias("twice"))
    return told.unionByName(flags.select(F.explode(F.array_compact(F.array(F.when(F.col("lacking"), "cases that not all have"), F.when(F.col("twice"), "a case twice")))).alias("reason")))


def compare_configurations(scores: DataFrame, parameters: DataFrame, measures: list[str], *, base: str, latency: str | None = None, calls: str | None = None) -> DataFrame:
    """(kind, configuration, metric, case_id, value): what differs between configurations of one dataset, in long form.

    Kinds: mean and passed (how many cases score 1) of each measure; latency mean and max; calls of each case; delta, the difference of each
    case's measure from that under ``base``, where there is one; failure, a count for each stage. Without ``comparison_refusals`` only.
    """
    long = scores.unpivot(["configuration", "case_id"], measures, "metric", "value").withColumn("value", F.col("value").cast("double"))
    none = F.lit(None).cast(scores.schema["case_id"].dataType)
    row = lambda df, kind, value, metric="metric", case=none: df.select(F.lit(kind).alias("kind"), "configuration", F.col(metric).alias("metric") if isinstance(metric, str) else metric.alias("metric"), case.alias("case_id"), value.cast("double").alias("value"))
    per = long.groupBy("configuration", "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("value") == 1).alias("passed"))
    before = long.where(F.col("configuration") == base).select("case_id", "metric", F.col("value").alias("before"))
    moved = long.where(F.col("configuration") != base).join(before, ["case_id", "metric"]).where("value <> before")
    out = row(per, "mean", F.col("mean")).unionByName(row(per, "passed", F.col("passed"))).unionByName(row(moved, "delta", F.round(F.col("value") - F.col("before"), 6), case=F.col("case_id")))
    stages = scores.where("failure_stage <> 'none'").groupBy("configuration", F.col("failure_stage").alias("metric")).agg(F.count("*").alias("n"))
    out = out.unionByName(row(stages, "failure", F.col("n")))
    if latency:
        took = scores.groupBy("configuration").agg(F.round(F.avg(latency), 6).alias("mean"), F.max(latency).alias("max"))
        out = out.unionByName(row(took, "latency", F.col("mean"), F.lit("mean"))).unionByName(row(took, "latency", F.col("max"), F.lit("max")))
    if calls:
        out = out.unionByName(row(scores, "calls", F.col(calls), F.lit(calls), F.col("case_id")))
    return out
