"""Queries of agents' audits: orders as cases, their lines as calls and steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.operators import agents as A
from cairn.sources.contracts import table

CATALOG = tuple(f"tool{k}" for k in range(6))
MAX_STEPS = 6


def _lines(spark, d):
    tool = F.concat(F.lit("tool"), (F.col("l_partkey") % 7).cast("string"))
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.row_number().over(own).cast("long").alias("n"), F.concat(tool, F.lit(":"), (F.col("l_suppkey") % 3).cast("string")).alias("signature"),
        tool.alias("capability"), F.concat(F.lit("evidence "), F.col("l_suppkey").cast("string")).alias("instruct"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("flag"),
    )


def _catalog(spark):
    return spark.createDataFrame([(c,) for c in CATALOG], "capability string")


def _cases(spark, d):
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("case_id"), F.when(key % 5 == 0, F.array(F.lit("tool_error"))).otherwise(F.array().cast("array<string>")).alias("expected_errors"), (key % 2).alias("expected_replans"),
        F.when(key % 11 == 0, 0).otherwise(key % 2).alias("replans"), F.when(key % 13 == 0, "plan_blocked").when(key % 7 == 0, "insufficient_evidence").otherwise("completed").alias("status"),
        F.when(key % 17 == 0, "execution_stopped").otherwise("completed").alias("expected_status"), (F.col("o_totalprice") > 20000).alias("gate_passed"), (key % 19 != 0).alias("allow_briefing"), (key % 3 != 0).alias("has_briefing"),
    )


def _expected(spark, d):
    needs = F.when(F.col("n") % 2 == 0, F.array(F.col("n") - 1)).otherwise(F.array().cast("array<long>"))
    return _lines(spark, d).where("n <= 3").select("case_id", F.col("n").alias("call_id"), "signature", needs.alias("needs"))


def _observed(spark, d):
    bad = F.col("flag") == "R"
    rows = _lines(spark, d).where("quantity < 46")
    return rows.select("case_id", (F.lit(100) - F.col("quantity").cast("int")).cast("long").alias("position"), "signature", F.when(bad, "error").otherwise("ok").alias("status"), F.when(bad, "tool_error").alias("error_code"))


def _planned(spark, d):
    return _lines(spark, d).where("discount < 0.09").select("case_id", "signature")


def agent_call_checks(spark, d):
    return A.call_correctness(_cases(spark, d), _expected(spark, d), _observed(spark, d))


def agent_failure_owner(spark, d):
    cases, expected, observed = _cases(spark, d), _expected(spark, d), _observed(spark, d)
    good = observed.where("status = 'ok'").groupBy("case_id", "signature").agg(F.count("*").alias("n")).groupBy("case_id").agg(F.sum(F.col("n") - 1).alias("redundant"))
    scores = A.call_correctness(cases, expected, observed).select("case_id", F.col("value").alias("correctness")).join(good, "case_id", "left")
    key = F.col("case_id")
    scores = scores.withColumns({"citation": F.when(key % 23 == 0, 0.0).otherwise(1.0), "relevance": F.when(key % 29 == 0, 0.5).otherwise(1.0), "completeness": F.when(key % 31 == 0, 0.5).otherwise(1.0)})
    return A.failure_owner(cases, expected, _planned(spark, d), observed, scores)


def _steps(spark, d):
    needs = F.when(F.col("n") == 1, F.array().cast("array<long>")).when(F.col("case_id") % 9 == 0, F.array(F.col("n") + 1)).when(F.col("case_id") % 8 == 0, F.array(F.lit(99).cast("long"))).otherwise(F.array(F.col("n") - 1))
    purpose = F.when(F.col("quantity") < 3, " ").otherwise(F.col("instruct"))
    evidence = F.when(F.col("discount") == 0.1, F.array().cast("array<string>")).otherwise(F.array("instruct"))
    step = F.when(F.col("case_id") % 10 == 0, F.col("n") + 1).otherwise(F.col("n"))
    return _lines(spark, d).select(F.col("case_id").alias("run_id"), step.alias("step_id"), F.col("n").alias("place"), "capability", "signature", purpose.alias("purpose"), evidence.alias("expected_evidence"), needs.alias("depends_on"), "flag")


def plan_audit(spark, d):
    return A.plan_violations(_steps(spark, d), _catalog(spark), MAX_STEPS).groupBy("run_id", "rule").agg(F.count("*").alias("n"), F.min("step_id").alias("first"))


def replacement_audit(spark, d):
    """The first two lines of an order have run; the others replace what was left of the plan."""
    s = _steps(spark, d)
    executed = s.where("place <= 2").select("run_id", "step_id", (F.col("flag") != "R").alias("ok"), "signature")
    return A.replacement_violations(s.where("place > 2"), executed, _catalog(spark), MAX_STEPS).groupBy("run_id", "rule").agg(F.count("*").alias("n"), F.min("step_id").alias("first"))


QUERIES = {f.__name__: f for f in (agent_call_checks, agent_failure_owner, plan_audit, replacement_audit)}

_L = """ln AS (SELECT l_orderkey AS case_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, 'tool' || (l_partkey % 7) || ':' || (l_suppkey % 3) AS signature,
  'tool' || (l_partkey % 7) AS capability, 'evidence ' || l_suppkey AS instruct, l_quantity AS quantity, l_discount AS discount, l_returnflag AS flag FROM lineitem)"""
_C = f"""WITH {_L},
cs AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS want_error, o_orderkey % 2 AS expected_replans, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_orderkey % 2 END AS replans,
  CASE WHEN o_orderkey % 13 = 0 THEN 'plan_blocked' WHEN o_orderkey % 7 = 0 THEN 'insufficient_evidence' ELSE 'completed' END AS status, CASE WHEN o_orderkey % 17 = 0 THEN 'execution_stopped' ELSE 'completed' END AS expected_status,
  o_totalprice > 20000 AS gate, o_orderkey % 19 <> 0 AS allow, o_orderkey % 3 <> 0 AS brief FROM orders),
ex AS (SELECT case_id, n AS call_id, signature, CASE WHEN n % 2 = 0 THEN n - 1 END AS need FROM ln WHERE n <= 3),
ob AS (SELECT case_id, 100 - CAST(trunc(quantity) AS BIGINT) AS position, signature, flag = 'R' AS bad FROM ln WHERE quantity < 46),
fi AS (SELECT case_id, signature, min(position) AS at_ FROM ob GROUP BY 1, 2),
ca AS (SELECT ex.*, fi.at_ FROM ex LEFT JOIN fi USING (case_id, signature)),
er AS (SELECT DISTINCT case_id FROM ob WHERE bad),
ck AS (
  SELECT case_id, 0 AS kind, call_id AS pos, 'expected call ' || call_id AS name, at_ IS NOT NULL AS ok FROM ca
  UNION ALL SELECT case_id, 1, 0, 'typed error tool_error', case_id IN (SELECT case_id FROM er) FROM cs WHERE want_error = 1
  UNION ALL SELECT case_id, 2, 0, 'replan count ' || expected_replans, replans = expected_replans FROM cs
  UNION ALL SELECT a.case_id, 3, a.call_id, 'dependency ' || a.need || ' before ' || a.call_id, coalesce(b.at_ < a.at_, false) FROM ca a LEFT JOIN ca b ON b.case_id = a.case_id AND b.call_id = a.need WHERE a.need IS NOT NULL),
sc AS (SELECT case_id, round(avg(ok::INT), 6) AS value, 'Satisfied: ' || coalesce(string_agg(name, ', ' ORDER BY kind, pos) FILTER (ok), 'none') || '. Missing: ' || coalesce(string_agg(name, ', ' ORDER BY kind, pos) FILTER (NOT ok), 'none') || '.' AS rationale FROM ck GROUP BY 1)"""
_S = f"""WITH {_L},
st AS (SELECT case_id AS run_id, n AS place, CASE WHEN case_id % 10 = 0 THEN n + 1 ELSE n END AS step_id, capability, signature, CASE WHEN quantity < 3 THEN ' ' ELSE instruct END AS purpose, discount = 0.1 AS no_evidence, instruct,
  CASE WHEN n = 1 THEN NULL WHEN case_id % 9 = 0 THEN n + 1 WHEN case_id % 8 = 0 THEN 99 ELSE n - 1 END AS need, flag FROM ln)"""


def _rules(source: str) -> str:
    cat = ", ".join(f"'{c}'" for c in CATALOG)
    return f"""SELECT run_id, step_id, 'capability' AS rule FROM {source} WHERE capability NOT IN ({cat}) OR capability IS NULL UNION ALL SELECT run_id, step_id, 'purpose' FROM {source} WHERE trim(coalesce(purpose, '')) = ''
  UNION ALL SELECT run_id, step_id, 'evidence' FROM {source} WHERE no_evidence OR trim(coalesce(instruct, '')) = ''"""


_COUNT = "SELECT run_id, rule, count(*) AS n, min(step_id) AS first FROM v GROUP BY 1, 2"
ORACLES = {
    "agent_call_checks": _C + " SELECT * FROM sc",
    "agent_failure_owner": _C + """,
      pl AS (SELECT DISTINCT case_id, signature FROM ln WHERE discount < 0.09),
      mi AS (SELECT ca.case_id, bool_or(pl.signature IS NULL AND (need IS NULL OR replans = 0)) AS p1, bool_or(pl.signature IS NOT NULL) AS tb, bool_or(pl.signature IS NULL) AS rp FROM ca JOIN cs USING (case_id) LEFT JOIN pl USING (case_id, signature) WHERE at_ IS NULL GROUP BY 1),
      rd AS (SELECT case_id, sum(n - 1) AS redundant FROM (SELECT case_id, signature, count(*) AS n FROM ob WHERE NOT bad GROUP BY 1, 2) GROUP BY 1)
      SELECT cs.case_id, CASE WHEN status = 'plan_blocked' OR cs.case_id NOT IN (SELECT case_id FROM pl) THEN 'planner' WHEN p1 THEN 'planner' WHEN tb THEN 'tool_boundary' WHEN rp THEN 'replanner'
        WHEN want_error = 1 AND cs.case_id NOT IN (SELECT case_id FROM er) THEN 'tool_boundary' WHEN coalesce(redundant, 0) > 0 OR replans <> expected_replans OR (expected_status = 'execution_stopped' AND status <> expected_status) THEN 'replanner'
        WHEN value < 1 THEN 'replanner' WHEN status = 'insufficient_evidence' OR NOT gate OR (NOT allow AND brief) THEN 'evidence_gate' WHEN cs.case_id % 23 = 0 OR cs.case_id % 29 = 0 OR cs.case_id % 31 = 0 THEN 'report_writer' ELSE 'none' END AS owner
      FROM cs LEFT JOIN mi USING (case_id) LEFT JOIN rd USING (case_id) LEFT JOIN sc USING (case_id)""",
    "plan_audit": _S + f""", v AS (
      SELECT run_id, step_id, 'step_ids' AS rule FROM st WHERE step_id <> place UNION ALL SELECT run_id, step_id, 'step_budget' FROM st WHERE place > {MAX_STEPS}
      UNION ALL SELECT a.run_id, a.step_id, CASE WHEN b.run_id IS NULL THEN 'unknown_dependency' ELSE 'later_dependency' END FROM st a LEFT JOIN st b ON b.run_id = a.run_id AND b.step_id = a.need WHERE a.need IS NOT NULL AND (b.run_id IS NULL OR a.need >= a.step_id)
      UNION ALL {_rules("st")}) """ + _COUNT,
    "replacement_audit": _S + f""", tl AS (SELECT * FROM st WHERE place > 2), ex AS (SELECT run_id, step_id, flag <> 'R' AS ok, signature FROM st WHERE place <= 2), bf AS (SELECT run_id, max(step_id) AS last, count(DISTINCT step_id) AS done FROM ex GROUP BY 1),
      nm AS (SELECT tl.*, coalesce(last, 0) AS last, coalesce(done, 0) + row_number() OVER w AS total, lag(step_id) OVER w AS prev FROM tl LEFT JOIN bf USING (run_id) WINDOW w AS (PARTITION BY tl.run_id ORDER BY place)),
      v AS (SELECT run_id, step_id, 'step_ids' AS rule FROM nm WHERE step_id <= last OR step_id <= coalesce(prev, 0) UNION ALL SELECT run_id, step_id, 'step_budget' FROM nm WHERE total > {MAX_STEPS}
      UNION ALL SELECT run_id, step_id, 'dependency' FROM tl WHERE need IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.run_id = tl.run_id AND ex.step_id = tl.need AND ok) AND NOT EXISTS (SELECT 1 FROM tl b WHERE b.run_id = tl.run_id AND b.step_id = tl.need AND b.place < tl.place)
      UNION ALL SELECT run_id, step_id, 'repeated_call' FROM tl WHERE EXISTS (SELECT 1 FROM ex WHERE ex.run_id = tl.run_id AND ex.signature = tl.signature AND ok) UNION ALL {_rules("tl")}) """ + _COUNT,
}
