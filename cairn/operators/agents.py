"""Audits and scores of agents' plans and runs, for all runs at once. Rules return a row for each violation, with its rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.evaluation import score_checks
from cairn.session import materialise


def _blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def _step_rules(steps: DataFrame, catalog: DataFrame, *keys: str) -> DataFrame:
    """Capabilities that the catalog lacks, blank purposes and blank or absent evidence."""
    known = catalog.select("capability").distinct().withColumn("_known", F.lit(True))
    rows = steps.join(F.broadcast(known), "capability", "left")  # the catalog of tools is a stated list
    evidence = F.coalesce(F.size("expected_evidence"), F.lit(0)) <= 0
    rules = F.array(
        F.when(F.col("_known").isNull(), "capability"), F.when(_blank(F.col("purpose")), "purpose"), F.when(evidence | F.exists("expected_evidence", _blank), "evidence")
    )
    return rows.select(*keys, "step_id", F.explode(F.array_compact(rules)).alias("rule"))


def plan_violations(steps: DataFrame, catalog: DataFrame, max_steps: int) -> DataFrame:
    """(run_id, step_id, capability, purpose, expected_evidence, depends_on) to (run_id, step_id, rule).

    Ids run from one without a gap; a plan has ``max_steps`` steps at most; a step depends on earlier steps of its plan only.
    """
    own = Window.partitionBy("run_id")
    rows = steps.withColumns({"_n": F.row_number().over(own.orderBy("step_id")), "_all": F.count("*").over(own)})
    order = F.array_compact(F.array(F.when(F.col("step_id") != F.col("_n"), "step_ids"), F.when((F.col("_all") > max_steps) & (F.col("_n") > max_steps), "step_budget")))
    numbered = rows.select("run_id", "step_id", F.explode(order).alias("rule"))
    needs = steps.select("run_id", "step_id", F.explode("depends_on").alias("needs"))
    known = steps.select("run_id", F.col("step_id").alias("needs")).distinct().withColumn("_known", F.lit(True))
    rule = F.when(F.col("_known").isNull(), "unknown_dependency").when(F.col("needs") >= F.col("step_id"), "later_dependency")
    bad = needs.join(known, ["run_id", "needs"], "left").select("run_id", "step_id", rule.alias("rule")).where("rule is not null").distinct()
    return numbered.unionByName(bad).unionByName(_step_rules(steps, catalog, "run_id"))


def replacement_violations(tail: DataFrame, executed: DataFrame, catalog: DataFrame, max_total: int) -> DataFrame:
    """Replacement steps (with ``place``, their order, and ``signature``) against executed ones (run_id, step_id, ok, signature).

    Ids are new and rise strictly; all steps together are ``max_total`` at most; a step depends on steps that succeeded or on
    earlier ones of the tail; no successful call is repeated.
    """
    before = executed.groupBy("run_id").agg(F.max("step_id").alias("_last"), F.countDistinct("step_id").alias("_done"))
    own = Window.partitionBy("run_id").orderBy("place")
    rows = tail.join(before, "run_id", "left").withColumns({"_n": F.row_number().over(own), "_lag": F.lag("step_id").over(own)})
    last, done = F.coalesce("_last", F.lit(0)), F.coalesce("_done", F.lit(0))
    order = F.array_compact(F.array(F.when((F.col("step_id") <= last) | (F.col("step_id") <= F.coalesce("_lag", F.lit(0))), "step_ids"), F.when(done + F.col("_n") > max_total, "step_budget")))
    numbered = rows.select("run_id", "step_id", F.explode(order).alias("rule"))
    allowed = executed.where("ok").select("run_id", F.col("step_id").alias("needs"), F.lit(-1).cast("long").alias("_at"))
    allowed = allowed.unionByName(tail.select("run_id", F.col("step_id").alias("needs"), F.col("place").cast("long").alias("_at"))).groupBy("run_id", "needs").agg(F.min("_at").alias("_at"))
    needs = tail.select("run_id", "step_id", "place", F.explode("depends_on").alias("needs")).join(allowed, ["run_id", "needs"], "left")
    bad = needs.where("_at is null or _at >= place").select("run_id", "step_id", F.lit("dependency").alias("rule")).distinct()
    again = tail.join(executed.where("ok").select("run_id", "signature").distinct(), ["run_id", "signature"], "left_semi").select("run_id", "step_id", F.lit("repeated_call").alias("rule"))
    return numbered.unionByName(bad).unionByName(again).unionByName(_step_rules(tail, catalog, "run_id"))


def call_checks(cases: DataFrame, expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(case_id, no, name, value): a check for each expected call, typed error, count of replans and prerequisite.

    ``cases`` has (case_id, expected_errors, expected_replans, replans); ``expected`` (case_id, call_id, signature, needs), needs
    an array of call ids; ``observed`` (case_id, position, signature, status, error_code).
    """
    first = observed.groupBy("case_id", "signature").agg(F.min("position").alias("at"))
    # written, so that no task holds these sorts besides those of the checks
    calls = materialise(expected.join(first, ["case_id", "signature"], "left").select("case_id", "call_id", "needs", "at"), "calls")
    named = lambda no, name, value: (F.struct(F.lit(no).alias("kind"), "call_id").alias("no"), name.alias("name"), value.cast("double").alias("value"))
    seen = calls.select("case_id", *named(0, F.concat(F.lit("expected call "), F.col("call_id").cast("string")), F.col("at").isNotNull()))
    errors = observed.where("status = 'error' and error_code is not null").select("case_id", F.col("error_code").alias("code")).distinct().withColumn("_seen", F.lit(True))
    codes = cases.select("case_id", F.posexplode("expected_errors").alias("call_id", "code")).join(errors, ["case_id", "code"], "left")
    typed = codes.select("case_id", *named(1, F.concat(F.lit("typed error "), F.col("code")), F.col("_seen").isNotNull()))
    replans = cases.withColumn("call_id", F.lit(0)).select("case_id", *named(2, F.concat(F.lit("replan count "), F.col("expected_replans").cast("string")), F.col("replans") == F.col("expected_replans")))
    needs = calls.select("case_id", "call_id", "at", F.explode("needs").alias("need")).join(calls.select("case_id", F.col("call_id").alias("need"), F.col("at").alias("before")), ["case_id", "need"], "left")
    ordered = needs.select("case_id", *named(3, F.concat(F.lit("dependency "), F.col("need").cast("string"), F.lit(" before "), F.col("call_id").cast("string")), F.coalesce(F.col("before") < F.col("at"), F.lit(False))))
    long = lambda df: df.withColumn("no", F.struct(F.col("no.kind").alias("kind"), F.col("no.call_id").cast("long").alias("call_id")))
    return long(seen).unionByName(long(typed)).unionByName(long(replans)).unionByName(long(ordered))


def call_correctness(cases: DataFrame, expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(case_id, value, rationale): the mean of a case's checks."""
    return score_checks(call_checks(cases, expected, observed), "case_id")


def failure_owner(cases: DataFrame, expected: DataFrame, planned: DataFrame, observed: DataFrame, scores: DataFrame) -> DataFrame:
    """(case_id, owner): the earliest owner that could have acted on a failure.

    ``cases`` as for ``call_checks``, with (status, expected_status, gate_passed, allow_briefing, has_briefing); ``planned``
    (case_id, signature), steps of the first and the final plan; ``scores`` (case_id, correctness, redundant, citation,
    relevance, completeness). A case without any planned step is the planner's.
    """
    seen = observed.select("case_id", "signature").distinct().withColumn("_seen", F.lit(True))
    plan = planned.select("case_id", "signature").distinct().withColumn("_planned", F.lit(True))
    missing = expected.join(seen, ["case_id", "signature"], "left").where("_seen is null").join(plan, ["case_id", "signature"], "left")
    missing = missing.join(cases.select("case_id", "replans"), "case_id")
    unplanned = F.col("_planned").isNull()
    lost = missing.groupBy("case_id").agg(
        F.max(unplanned & ((F.coalesce(F.size("needs"), F.lit(0)) <= 0) | (F.col("replans") == 0))).alias("_first_plan"), F.max(~unplanned).alias("_tool"), F.max(unplanned).alias("_later_plan")
    )
    codes = observed.where("error_code is not null").groupBy("case_id").agg(F.collect_set("error_code").alias("_codes"))  # a few codes a case
    steps = plan.groupBy("case_id").agg(F.count("*").alias("_steps"))
    rows = cases.join(lost, "case_id", "left").join(codes, "case_id", "left").join(steps, "case_id", "left").join(scores, "case_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    untyped = F.size(F.array_except("expected_errors", F.coalesce("_codes", F.array().cast("array<string>")))) > 0
    stopped = (F.col("expected_status") == "execution_stopped") & (F.col("status") != F.col("expected_status"))
    owner = (
        F.when((F.col("status") == "plan_blocked") | F.col("_steps").isNull(), "planner")
        .when(yes("_first_plan"), "planner")
        .when(yes("_tool"), "tool_boundary")
        .when(yes("_later_plan"), "replanner")
        .when(untyped, "tool_boundary")
        .when((F.coalesce("redundant", F.lit(0)) > 0) | (F.col("replans") != F.col("expected_replans")) | stopped, "replanner")
        .when(F.col("correctness") < 1, "replanner")
        .when((F.col("status") == "insufficient_evidence") | ~F.col("gate_passed") | (~F.col("allow_briefing") & F.col("has_briefing")), "evidence_gate")
        .when((F.col("citation") < 1) | (F.col("relevance") < 1) | (F.col("completeness") < 1), "report_writer")
        .otherwise("none")
    )
    return rows.select("case_id", owner.alias("owner"))
