"""Queries of evaluation: retrieval cases, logged runs, comparisons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import evaluation as E
from cairn.operators import ranking as R
from cairn.plans.ranks import _BM25, TOP
from cairn.session import broadcast_if_small
from cairn.sources.contracts import SQL, answers, gold, observations, passages, questions, table, trajectory

BUDGET = 40


def _hits(spark, d):
    return R.ranked(R.bm25_scores(passages(spark, d), questions(spark, d)), TOP).join(passages(spark, d).select("passage_id", "period"), "passage_id")


def retrieval_recall(spark, d):
    g = gold(spark, d)
    got = g.join(_hits(spark, d).select("query_id", "passage_id", F.lit(1).alias("hit")), ["query_id", "passage_id"], "left")
    missing = F.array_join(F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.col("passage_id")))), ",")
    return got.groupBy("query_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"), missing.alias("missing"))


def case_metrics(spark, d):
    return E.case_metrics(answers(spark, d), _hits(spark, d))


def eval_summary(spark, d):
    m = case_metrics(spark, d)
    names = ("recall", "reciprocal_rank", "filter_correctness", "citation_correctness", "grounding", "abstention")
    return m.groupBy((F.col("case_id") % 2).alias("configuration")).agg(F.count("*").alias("cases"), *(F.round(F.avg(n), 6).alias(n) for n in names))


def failure_counts(spark, d):
    return case_metrics(spark, d).groupBy("failure_stage").agg(F.count("*").alias("n"))


def failure_rows(spark, d):
    return case_metrics(spark, d).where("failure_stage <> 'none'").select("case_id", "failure_stage")


def config_comparison(spark, d):
    m = case_metrics(spark, d).withColumn("configuration", F.when(F.col("case_id") % 2 == 0, "even").otherwise("odd"))
    long = m.unpivot(["configuration", "case_id"], ["recall", "reciprocal_rank", "abstention"], "metric", "value")
    return long.groupBy("configuration", "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.sum((F.col("value") == 1).cast("long")).alias("passed"))


def metric_pivot(spark, d):
    m = case_metrics(spark, d).withColumn("configuration", F.when(F.col("case_id") % 2 == 0, "even").otherwise("odd"))
    long = m.unpivot(["configuration", "case_id"], ["recall", "reciprocal_rank", "abstention"], "metric", "value")
    return long.groupBy("metric").pivot("configuration", ["even", "odd"]).agg(F.round(F.avg("value"), 6))


def tag_coverage(spark, d):
    has = lambda w: F.max(F.contains(F.lower("text"), F.lit(w)).cast("int"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(*(has(w).alias(f"tag_{w}") for w in ("the", "und", "les")))


def pipeline_checks(spark, d):
    h = _hits(spark, d)
    order = F.lag("score").over(Window.partitionBy("query_id").orderBy("rank"))
    h = h.withColumn("before", order).join(broadcast_if_small(questions(spark, d).select("query_id", F.col("period").alias("q_period")), R.QUERY_ROWS), "query_id")
    row = h.agg(
        (F.count("*") > 0).alias("runs_exist"),
        F.bool_and(R.eligible(F.col("q_period"), F.col("period"))).alias("filters_hold"),
        (F.count("*") == F.countDistinct("query_id", "passage_id")).alias("unique"),
        F.bool_and(F.coalesce(F.col("before") >= F.col("score"), F.lit(True))).alias("sorted"),
        F.bool_and(~F.isnan("score")).alias("finite"),
    )
    return row.unpivot([], list(row.columns), "check", "passed")


def grounding_checks(spark, d):
    text = F.lower("text")
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[0-9]+(?:\.[0-9]+)?\b"), 0))
    return table(spark, d, "conversations").select("conv_id", "turn", (F.size(F.array_except(numbers, F.array(F.lit("2026"), F.lit("65")))) == 0).alias("only_allowed"), F.exists(F.array(F.lit("cannot"), F.lit("not provided"), F.lit("insufficient"), F.lit("not ")), lambda m: F.contains(text, m)).alias("limitation"))


def abstention_markers(spark, d):
    return answers(spark, d).select("case_id", F.contains(F.lower("answer"), F.lit("not enough evidence")).alias("marked"), "abstained")


def judge_alignment(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.when(F.col("turn") == 0, (F.length("text") % 11) / 10).alias("score"))
    good = F.col("score").between(0, 1)
    return c.groupBy("conv_id").agg(F.count("score").alias("values"), F.round(F.avg(F.when(good, F.col("score"))), 6).alias("mean")).withColumn("state", F.when(F.col("values") == 1, "aligned").when(F.col("values") == 0, "recorded_or_skipped").otherwise("ambiguous"))


def stage_latency(spark, d):
    return trajectory(spark, d).groupBy("phase").agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 4).alias("mean"), F.max("duration_ms").alias("longest"), F.sum((F.col("status") == "error").cast("long")).alias("errors"))


def coverage_snapshot(spark, d):
    one = lambda c, s: F.array_join(F.sort_array(F.collect_set(c)), ",").alias(s)
    return table(spark, d, "customer").groupBy("c_nationkey").agg(one("c_mktsegment", "segments"), F.count("*").alias("customers"))


def check_scores(spark, d):
    t = trajectory(spark, d).groupBy("run_id").agg(*(F.max((F.col("phase") == p).cast("double")).alias(p) for p in ("planning", "execution", "report")), F.count("*").alias("n"))
    names = F.array(*(F.struct(F.lit(i).alias("no"), F.lit(p).alias("name"), F.col(p).alias("value")) for i, p in enumerate(("planning", "execution", "report"))), F.struct(F.lit(3).alias("no"), F.lit("short").alias("name"), (F.col("n") < 105).cast("double").alias("value")))
    checks = t.select("run_id", F.explode(names).alias("c")).select("run_id", "c.no", "c.name", "c.value")
    return E.score_checks(checks, "run_id")


def tool_efficiency(spark, d):
    return E.efficiency(observations(spark, d), trajectory(spark, d), BUDGET)


def tool_correctness(spark, d):
    """Expected calls seen, errors typed, and the order of the first calls."""
    o = observations(spark, d)
    index = F.row_number().over(Window.partitionBy("run_id").orderBy("attempt_id"))
    own = E.ordered_before(o.withColumn("index", index), F.col("capability") == "get_company_metric", F.col("status") == "error")
    seen = o.groupBy("run_id").agg(F.max((F.col("capability") == "get_company_metric").cast("double")).alias("metric"), F.max((F.col("error_code") == "tool_error").cast("double")).alias("error"))
    rows = own.join(seen, "run_id")
    value = (F.col("metric") + F.coalesce("error", F.lit(0.0)) + F.col("ordered").cast("double")) / 3
    return rows.select("run_id", "ordered", F.round(value, 6).alias("value"))


def post_terminal(spark, d):
    return E.after_terminal(trajectory(spark, d)).groupBy("run_id").agg(F.count("*").alias("late"), F.min("index").alias("first"))


def guardrail_owner(spark, d):
    return E.guardrail_owner(trajectory(spark, d)).select("run_id", "index", "owner")


def plan_revisions(spark, d):
    own = Window.partitionBy("run_id").orderBy("index")
    t = trajectory(spark, d).withColumn("revision", F.sum((F.col("phase") == "replanning").cast("long")).over(own))
    return t.groupBy("run_id").agg(F.max("revision").alias("revisions"), F.sum("revision").alias("total"))


def phase_counts(spark, d):
    t = trajectory(spark, d).groupBy("run_id").pivot("phase", ["execution", "guardrail", "planning", "replanning", "report"]).count()
    return t.na.fill(0)


def trace_spans(spark, d):
    """Spans of emitted phases, and reconstructed ones for required phases that a run lacks."""
    t = trajectory(spark, d).groupBy("run_id", "phase").agg(F.count("*").alias("n"))
    required = F.explode(F.array(*(F.lit(x) for x in ("planning", "plan_gate", "replanning", "evidence_gate", "report")))).alias("phase")
    lost = t.select("run_id").distinct().select("run_id", required).join(t, ["run_id", "phase"], "left_anti")
    kind = F.when(F.col("phase") == "execution", "TOOL").when(F.col("phase") == "guardrail", "GUARD").otherwise("CHAIN")
    return t.select("run_id", "phase", kind.alias("type"), "n", F.lit(False).alias("reconstructed")).unionByName(lost.select("run_id", "phase", F.lit("CHAIN").alias("type"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("reconstructed")))


def call_alignment(spark, d):
    """Expected calls of every run against the observed, by signature."""
    o = observations(spark, d).select("run_id", T.call_signature(F.col("capability"), F.col("arguments")).alias("signature")).distinct()
    expected = o.select("run_id").distinct().select("run_id", F.explode(F.array(*(F.lit(f'get_company_metric:{{"k":{k}}}') for k in (7, 42)))).alias("signature"))
    return expected.join(o.withColumn("seen", F.lit(True)), ["run_id", "signature"], "left").select("run_id", "signature", F.when(F.col("seen"), "observed").otherwise("missing").alias("state"))


def case_alignment(spark, d):
    a = table(spark, d, "labels").select("doc_id", F.lit(1).alias("case"))
    b = table(spark, d, "documents").where("doc_id % 3 <> 0").groupBy("doc_id").agg(F.count("*").alias("predictions"))
    both = a.join(b, "doc_id", "full_outer")
    state = F.when(F.col("case").isNull(), "no_case").when(F.col("predictions").isNull(), "no_prediction").when(F.col("predictions") > 1, "duplicate").otherwise("aligned")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def fact_provenance(spark, d):
    """Claims (source and id of a document) that no observed hit backs."""
    hits = table(spark, d, "documents").select("source", "doc_id").distinct()
    facts = table(spark, d, "labels").select("doc_id", F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("source"))
    return facts.join(hits.withColumn("ok", F.lit(True)), ["source", "doc_id"], "left").select("doc_id", "source", F.coalesce("ok", F.lit(False)).alias("backed"))


def evidence_gate(spark, d):
    """Each customer segment of a nation needs an account in credit and one in debt."""
    c = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.max((F.col("c_acctbal") > 0).cast("int")).alias("credit"), F.max((F.col("c_acctbal") < 0).cast("int")).alias("debt"))
    missing = F.array_compact(F.array(F.when(F.col("credit") == 0, F.concat("c_mktsegment", F.lit(":credit"))), F.when(F.col("debt") == 0, F.concat("c_mktsegment", F.lit(":debt")))))
    return c.groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.flatten(F.collect_list(missing))), ",").alias("missing")).withColumn("passed", F.col("missing") == "")


def agent_case_scores(spark, d):
    eff = tool_efficiency(spark, d).select("run_id", F.col("value").alias("efficiency"))
    cor = tool_correctness(spark, d).select("run_id", F.col("value").alias("correctness"))
    lat = trajectory(spark, d).groupBy("run_id").agg(F.round(F.sum("duration_ms"), 2).alias("latency"))
    return eff.join(cor, "run_id").join(lat, "run_id").withColumn("release", (F.col("efficiency") == 1) & (F.col("correctness") == 1))


def agent_summary(spark, d):
    s = agent_case_scores(spark, d)
    return s.groupBy((F.col("run_id") % 2).alias("configuration")).agg(F.count("*").alias("runs"), F.round(F.avg("efficiency"), 6).alias("efficiency"), F.round(F.avg("correctness"), 6).alias("correctness"), F.bool_and("release").alias("released"), F.round(F.max("latency"), 2).alias("longest"))


def failure_owner(spark, d):
    s = agent_case_scores(spark, d)
    owner = F.when(F.col("correctness") < 0.5, "planner").when(F.col("correctness") < 1, "tool_boundary").when(F.col("efficiency") < 1, "replanner").otherwise("none")
    return s.select("run_id", owner.alias("owner"))


def plan_violations(spark, d):
    """Orders as plans, their lines as steps: numbers must run from one without a gap and stay within six."""
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    li = table(spark, d, "lineitem").where("l_quantity < 48").withColumn("n", F.row_number().over(own))
    rule = F.when(F.col("l_linenumber") != F.col("n"), "step_number").when(F.col("n") > 6, "too_many_steps")
    return li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("step"), rule.alias("rule")).where("rule is not null").groupBy("l_orderkey", "rule").agg(F.count("*").alias("n"), F.min("step").alias("first"))


def replacement_violations(spark, d):
    """Steps of a run that repeat the signature of an earlier successful one."""
    o = observations(spark, d).withColumn("signature", T.call_signature(F.col("capability"), F.col("arguments")))
    own = Window.partitionBy("run_id", "signature").orderBy("attempt_id").rowsBetween(Window.unboundedPreceding, -1)
    return o.withColumn("earlier", F.max((F.col("status") == "ok").cast("int")).over(own)).where("earlier = 1").select("run_id", "attempt_id", "signature")


def argument_violations(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("int")
    rule = F.when(k.isNull(), "required").when(k < 5, "minimum").when(k > 90, "maximum")
    return table(spark, d, "events").select("event_id", rule.alias("rule")).where("rule is not null")


def call_graph_violations(spark, d):
    """Lines of an order as calls that need the line before; in some orders the first needs the last."""
    own = Window.partitionBy("l_orderkey")
    li = table(spark, d, "lineitem").select("l_orderkey", F.row_number().over(own.orderBy("l_linenumber", "l_partkey")).alias("n"), F.count("*").over(own).alias("last"))
    needs = F.when(F.col("n") > 1, F.col("n") - 1).when(F.col("l_orderkey") % 97 == 0, F.col("last")).when(F.col("l_orderkey") % 89 == 0, F.lit(99))
    edges = li.select(F.col("l_orderkey").alias("case_id"), F.col("n").cast("long").alias("call_id"), needs.cast("long").alias("needs"))
    return E.call_graph_problems(edges).groupBy("case_id", "problem").agg(F.count("*").alias("calls"))


def observation_refs(spark, d):
    v = F.try_parse_json("props")
    return table(spark, d, "events").where("event_type = 'click'").select("event_id", F.try_variant_get(v, "$.k", "int").alias("k"))


def cited_facts(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.max("c_acctbal").alias("v"))
    n = table(spark, d, "nation")
    return c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select("n_name", F.concat(F.col("n_name"), F.lit(" highest balance "), F.format_number("v", 2)).alias("claim"))


def company_claims(spark, d):
    t = trajectory(spark, d).where("phase <> 'guardrail'").groupBy("run_id", "phase").agg(F.min("index").alias("first"), F.count("*").alias("n"))
    return t.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "phase"))), lambda s: s["phase"]), ">").alias("order"))


QUERIES = {f.__name__: f for f in (retrieval_recall, case_metrics, eval_summary, failure_counts, failure_rows, config_comparison, metric_pivot, tag_coverage, pipeline_checks, grounding_checks, abstention_markers, judge_alignment, stage_latency, coverage_snapshot, check_scores, tool_efficiency, tool_correctness, post_terminal, guardrail_owner, plan_revisions, phase_counts, trace_spans, call_alignment, case_alignment, fact_provenance, evidence_gate, agent_case_scores, agent_summary, failure_owner, plan_violations, replacement_violations, argument_violations, call_graph_violations, observation_refs, cited_facts, company_claims)}

_W = f"WITH {SQL}, "
_FOLD = "replace(lower({}), 'ß', 'ss')"
_CASES = _BM25 + f""",
h AS (SELECT query_id AS case_id, list(passage_id ORDER BY b.rank) AS got, bool_and(p.period = q.period OR q.period IS NULL) AS fit FROM bm_top b JOIN passages p USING (passage_id) JOIN questions q USING (query_id) WHERE b.rank <= {TOP} GROUP BY 1),
m0 AS (SELECT c.*, coalesce(got, []) AS got, coalesce(fit, true) AS fit, list_distinct(regexp_extract_all(answer, '\\[([A-Z0-9][A-Z0-9-]{{2,}})\\]', 1)) AS cited, len(expected) = 0 AS must,
  array_to_string(regexp_extract_all({_FOLD.format("substr(question, 1, 30)")}, '[a-z0-9]+'), ' ') AS f, array_to_string(regexp_extract_all({_FOLD.format('answer')}, '[a-z0-9]+'), ' ') AS a FROM cases c LEFT JOIN h ON h.case_id = c.case_id),
m1 AS (SELECT case_id, CASE WHEN must THEN abstained::INT::DOUBLE ELSE round(len(list_intersect(expected, got)) / len(expected), 6) END AS recall,
  CASE WHEN must THEN abstained::INT::DOUBLE ELSE coalesce(round(1.0 / list_min(list_filter(list_transform(got, lambda p, i: CASE WHEN list_contains(expected, p) THEN i END), lambda x: x IS NOT NULL)), 6), 0) END AS reciprocal_rank,
  fit::INT::DOUBLE AS filter_correctness,
  CASE WHEN must THEN (len(cited) = 0)::INT::DOUBLE WHEN len(cited) = 0 THEN 0 ELSE round(len(list_intersect(cited, list_intersect(expected, got))) / len(cited), 6) END AS citation_correctness,
  CASE WHEN must THEN 1.0 ELSE (f <> '' AND contains(' ' || a || ' ', ' ' || f || ' '))::INT::DOUBLE END AS grounding, (must = abstained)::INT::DOUBLE AS abstention FROM m0),
cm AS (SELECT *, CASE WHEN abstention < 1 THEN 'abstention' WHEN recall < 1 THEN 'retrieval' WHEN filter_correctness < 1 THEN 'filter' WHEN citation_correctness < 1 THEN 'citation' WHEN grounding < 1 THEN 'grounding' ELSE 'none' END AS failure_stage FROM m1)"""
_LONG = _CASES + ", lg AS (SELECT CASE WHEN case_id % 2 = 0 THEN 'even' ELSE 'odd' END AS configuration, unnest(['recall', 'reciprocal_rank', 'abstention']) AS metric, unnest([recall, reciprocal_rank, abstention]) AS value FROM cm)"
_MEANS = ", ".join(f"round(avg({n}), 6) AS {n}" for n in ("recall", "reciprocal_rank", "filter_correctness", "citation_correctness", "grounding", "abstention"))
_SIG = "capability || ':' || replace(arguments, ' ', '')"
_EFF = f"""late0 AS (SELECT *, max((phase IN ('evidence_gate', 'guardrail') AND status IN ('blocked', 'error'))::INT) OVER (PARTITION BY run_id ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM trajectory),
late AS (SELECT * FROM late0 WHERE e = 1 AND phase = 'execution'),
rep AS (SELECT run_id, sum(n - 1)::BIGINT AS redundant FROM (SELECT run_id, {_SIG} AS s, count(*) AS n FROM observations WHERE status = 'ok' GROUP BY 1, 2) GROUP BY 1),
eff AS (SELECT o.run_id, calls, coalesce(redundant, 0) AS redundant, coalesce(l.late, 0) AS late, round(greatest(0.0, 1 - (greatest(0, calls - {BUDGET}) + coalesce(redundant, 0) + coalesce(l.late, 0)) / {BUDGET}), 6) AS value
  FROM (SELECT run_id, count(*) AS calls FROM observations GROUP BY 1) o LEFT JOIN rep USING (run_id) LEFT JOIN (SELECT run_id, count(DISTINCT attempt_id) AS late FROM late GROUP BY 1) l USING (run_id)),
cor AS (SELECT run_id, coalesce(a < b, false) AS ordered, round((m + coalesce(e, 0) + coalesce(a < b, false)::INT) / 3, 6) AS value FROM (SELECT run_id, min(CASE WHEN capability = 'get_company_metric' THEN attempt_id END) AS a, min(CASE WHEN status = 'error' THEN attempt_id END) AS b,
  max((capability = 'get_company_metric')::INT) AS m, max((error_code = 'tool_error')::INT) AS e FROM observations GROUP BY 1)),
sc AS (SELECT run_id, eff.value AS efficiency, cor.value AS correctness, latency, eff.value = 1 AND cor.value = 1 AS release FROM eff JOIN cor USING (run_id) JOIN (SELECT run_id, round(sum(duration_ms), 2) AS latency FROM trajectory GROUP BY 1) USING (run_id))"""
ORACLES = {
    "retrieval_recall": _W + _BM25 + f" SELECT g.query_id, round(avg((b.rank IS NOT NULL)::INT), 6) AS recall, coalesce(string_agg(CASE WHEN b.rank IS NULL THEN g.passage_id END, ',' ORDER BY g.passage_id), '') AS missing FROM gold g LEFT JOIN (SELECT * FROM bm_top WHERE rank <= {TOP}) b ON g.query_id = b.query_id AND g.passage_id = b.passage_id GROUP BY 1",
    "case_metrics": _W + _CASES + " SELECT * FROM cm",
    "eval_summary": _W + _CASES + f" SELECT case_id % 2 AS configuration, count(*) AS cases, {_MEANS} FROM cm GROUP BY 1",
    "failure_counts": _W + _CASES + " SELECT failure_stage, count(*) AS n FROM cm GROUP BY 1",
    "failure_rows": _W + _CASES + " SELECT case_id, failure_stage FROM cm WHERE failure_stage <> 'none'",
    "config_comparison": _W + _LONG + " SELECT configuration, metric, round(avg(value), 6) AS mean, sum((value = 1)::INT)::BIGINT AS passed FROM lg GROUP BY 1, 2",
    "metric_pivot": _W + _LONG + " SELECT metric, round(avg(value) FILTER (configuration = 'even'), 6) AS even, round(avg(value) FILTER (configuration = 'odd'), 6) AS odd FROM lg GROUP BY 1",
    "tag_coverage": "SELECT conv_id, " + ", ".join(f"max(contains(lower(text), '{w}')::INT) AS tag_{w}" for w in ("the", "und", "les")) + " FROM conversations GROUP BY 1",
    "pipeline_checks": "SELECT unnest(['runs_exist', 'filters_hold', 'unique', 'sorted', 'finite']) AS \"check\", true AS passed",
    "grounding_checks": "SELECT conv_id, turn, len(list_filter(regexp_extract_all(lower(text), '\\b[0-9]+(?:\\.[0-9]+)?\\b'), lambda n: n NOT IN ('2026', '65'))) = 0 AS only_allowed, contains(lower(text), 'cannot') OR contains(lower(text), 'not ') OR contains(lower(text), 'insufficient') AS limitation FROM conversations",
    "abstention_markers": _W.removesuffix(", ") + " SELECT case_id, contains(lower(answer), 'not enough evidence') AS marked, abstained FROM cases",
    "judge_alignment": "SELECT conv_id, count(s) AS values, round(avg(s), 6) AS mean, CASE count(s) WHEN 1 THEN 'aligned' WHEN 0 THEN 'recorded_or_skipped' ELSE 'ambiguous' END AS state FROM (SELECT conv_id, CASE WHEN turn = 0 THEN (length(text) % 11) / 10 END AS s FROM conversations) GROUP BY 1",
    "stage_latency": _W.removesuffix(", ") + " SELECT phase, count(*) AS n, round(avg(duration_ms), 4) AS mean, max(duration_ms) AS longest, sum((status = 'error')::INT)::BIGINT AS errors FROM trajectory GROUP BY 1",
    "coverage_snapshot": "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments, count(*) AS customers FROM customer GROUP BY 1",
    "check_scores": _W + """t AS (SELECT run_id, max((phase = 'planning')::INT) AS a, max((phase = 'execution')::INT) AS b, max((phase = 'report')::INT) AS c, (count(*) < 105)::INT AS s FROM trajectory GROUP BY 1),
      k AS (SELECT run_id, (a + b + c + s) / 4 AS value, concat_ws(', ', CASE WHEN a = 1 THEN 'planning' END, CASE WHEN b = 1 THEN 'execution' END, CASE WHEN c = 1 THEN 'report' END, CASE WHEN s = 1 THEN 'short' END) AS y,
        concat_ws(', ', CASE WHEN a = 0 THEN 'planning' END, CASE WHEN b = 0 THEN 'execution' END, CASE WHEN c = 0 THEN 'report' END, CASE WHEN s = 0 THEN 'short' END) AS n FROM t)
      SELECT run_id, round(value, 6) AS value, 'Satisfied: ' || CASE WHEN y = '' THEN 'none' ELSE y END || '. Missing: ' || CASE WHEN n = '' THEN 'none' ELSE n END || '.' AS rationale FROM k""",
    "tool_efficiency": _W + _EFF + " SELECT * FROM eff",
    "tool_correctness": _W + _EFF + " SELECT * FROM cor",
    "post_terminal": _W + _EFF + " SELECT run_id, count(*) AS late, min(index) AS first FROM late GROUP BY 1",
    "guardrail_owner": _W.removesuffix(", ") + " SELECT run_id, index, owner FROM (SELECT *, last_value(CASE WHEN phase <> 'guardrail' THEN index END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS owner FROM trajectory) WHERE phase = 'guardrail'",
    "plan_revisions": _W.removesuffix(", ") + " SELECT run_id, max(r) AS revisions, sum(r)::BIGINT AS total FROM (SELECT run_id, (sum((phase = 'replanning')::INT) OVER (PARTITION BY run_id ORDER BY index))::BIGINT AS r FROM trajectory) GROUP BY 1",
    "phase_counts": _W.removesuffix(", ") + " SELECT run_id, " + ", ".join(f"count(*) FILTER (phase = '{p}') AS {p}" for p in ("execution", "guardrail", "planning", "replanning", "report")) + " FROM trajectory GROUP BY 1",
    "trace_spans": _W + """t AS (SELECT run_id, phase, count(*) AS n FROM trajectory GROUP BY 1, 2), q AS (SELECT r.run_id, p.phase FROM (SELECT DISTINCT run_id FROM t) r, (SELECT unnest(['planning', 'plan_gate', 'replanning', 'evidence_gate', 'report']) AS phase) p)
      SELECT run_id, phase, CASE phase WHEN 'execution' THEN 'TOOL' WHEN 'guardrail' THEN 'GUARD' ELSE 'CHAIN' END AS type, n, false AS reconstructed FROM t UNION ALL SELECT run_id, phase, 'CHAIN', 0, true FROM q ANTI JOIN t USING (run_id, phase)""",
    "call_alignment": _W + f"""o AS (SELECT DISTINCT run_id, {_SIG} AS signature FROM observations), e AS (SELECT run_id, 'get_company_metric:{{"k":' || k || '}}' AS signature FROM (SELECT DISTINCT run_id FROM o), (SELECT unnest([7, 42]) AS k))
      SELECT e.run_id, e.signature, CASE WHEN o.run_id IS NULL THEN 'missing' ELSE 'observed' END AS state FROM e LEFT JOIN o ON e.run_id = o.run_id AND e.signature = o.signature""",
    "case_alignment": """SELECT CASE WHEN l.doc_id IS NULL THEN 'no_case' WHEN p.doc_id IS NULL THEN 'no_prediction' WHEN n > 1 THEN 'duplicate' ELSE 'aligned' END AS state, count(*) AS n FROM labels l FULL JOIN (SELECT doc_id, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1) p ON l.doc_id = p.doc_id GROUP BY 1""",
    "fact_provenance": "SELECT l.doc_id, l.source, d.doc_id IS NOT NULL AS backed FROM (SELECT doc_id, 'src' || (doc_id % 20) AS source FROM labels) l LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.source = l.source",
    "evidence_gate": """WITH c AS (SELECT c_nationkey, c_mktsegment AS s, max((c_acctbal > 0)::INT) AS a, max((c_acctbal < 0)::INT) AS b FROM customer GROUP BY 1, 2), m AS (SELECT c_nationkey, unnest([CASE WHEN a = 0 THEN s || ':credit' END, CASE WHEN b = 0 THEN s || ':debt' END]) AS x FROM c)
      SELECT c_nationkey, coalesce(string_agg(x, ',' ORDER BY x), '') AS missing, count(x) = 0 AS passed FROM m GROUP BY 1""",
    "agent_case_scores": _W + _EFF + " SELECT * FROM sc",
    "agent_summary": _W + _EFF + " SELECT run_id % 2 AS configuration, count(*) AS runs, round(avg(efficiency), 6) AS efficiency, round(avg(correctness), 6) AS correctness, bool_and(release) AS released, round(max(latency), 2) AS longest FROM sc GROUP BY 1",
    "failure_owner": _W + _EFF + " SELECT run_id, CASE WHEN correctness < 0.5 THEN 'planner' WHEN correctness < 1 THEN 'tool_boundary' WHEN efficiency < 1 THEN 'replanner' ELSE 'none' END AS owner FROM sc",
    "plan_violations": "SELECT l_orderkey, rule, count(*) AS n, min(l_linenumber) AS first FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> n THEN 'step_number' WHEN n > 6 THEN 'too_many_steps' END AS rule FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem WHERE l_quantity < 48)) WHERE rule IS NOT NULL GROUP BY 1, 2",
    "replacement_violations": _W.removesuffix(", ") + f" SELECT run_id, attempt_id, signature FROM (SELECT *, {_SIG} AS signature, max((status = 'ok')::INT) OVER (PARTITION BY run_id, {_SIG} ORDER BY attempt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM observations) WHERE e = 1",
    "argument_violations": "SELECT event_id, CASE WHEN k < 5 THEN 'minimum' ELSE 'maximum' END AS rule FROM (SELECT event_id, (props::JSON->>'k')::INT AS k FROM events) WHERE k < 5 OR k > 90",
    "call_graph_violations": "SELECT l_orderkey AS case_id, CASE WHEN l_orderkey % 97 = 0 THEN 'cycle' ELSE 'unknown_prerequisite' END AS problem, CASE WHEN l_orderkey % 97 = 0 THEN count(*) ELSE 1 END AS calls FROM lineitem WHERE l_orderkey % 97 = 0 OR l_orderkey % 89 = 0 GROUP BY 1",
    "observation_refs": "SELECT event_id, (props::JSON->>'k')::INT AS k FROM events WHERE event_type = 'click'",
    "cited_facts": "SELECT n_name, n_name || ' highest balance ' || format('{:,.2f}', max(c_acctbal)) AS claim FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "company_claims": _W.removesuffix(", ") + " SELECT run_id, string_agg(phase, '>' ORDER BY f) AS \"order\" FROM (SELECT run_id, phase, min(index) AS f FROM trajectory WHERE phase <> 'guardrail' GROUP BY 1, 2) GROUP BY 1",
}
