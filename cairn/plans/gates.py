"""Queries of gates and releases, over orders as runs, their lines as calls, hits and facts, and suppliers as documents; of values in
tables, of configurations side by side and of balanced rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.operators import evaluation as E
from cairn.operators import finance, ranking
from cairn.operators import gates as X
from cairn.operators import scoring
from cairn.session import materialise, spread
from cairn.plans import evals, stores
from cairn.sources.contracts import SQL, questions, table

COMPANIES = ["Return", "Sale"]
PREFIXES = {"R-": "Return", "S-": "Sale"}
STEPS = 3


def _lines(spark, d):
    """Lines with their place in the order; equal ones in any order."""
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return table(spark, d, "lineitem").withColumn("no", F.row_number().over(own))


def _hits(spark, d):
    li = _lines(spark, d)
    kind = F.when(F.col("l_quantity") > 45, "image").when(F.col("l_linestatus") == "F", "table").otherwise("paragraph")
    elements = F.when(F.col("l_quantity") < 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("e1"), F.lit("e2")))
    return li.select(
        F.col("l_orderkey").alias("run_id"), F.col("no").alias("hit_no"), F.when(F.col("l_returnflag") == "R", "Return").otherwise("Sale").alias("company"), F.concat(F.lit("C"), F.col("l_partkey").cast("string")).alias("chunk_id"),
        kind.alias("element_type"), F.when(F.col("l_tax") > 0, "USD millions").alias("unit"), elements.alias("element_ids"), (F.col("l_linenumber") - 1).alias("physical_page"),
        F.concat(F.when(F.col("l_partkey") % 3 == 0, "R-").when(F.col("l_partkey") % 3 == 1, "S-").otherwise("X-"), F.col("l_suppkey").cast("string")).alias("document_id"), F.sha2(F.col("l_suppkey").cast("string"), 256).alias("document_sha256"),
        F.when(F.col("l_discount") > 0, F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).otherwise(" ").alias("source_reference"),
    )


def _suppliers(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 0")
    return s.select(F.sha2(F.col("s_suppkey").cast("string"), 256).alias("document_sha256"), F.when(F.col("s_nationkey") % 2 == 0, "Return").otherwise("Sale").alias("owner"))


def _joined(items):
    return F.array_join(items, ", ")


def evidence_chain(spark, d):
    """The link of each hit's chain that breaks first, for the certified-table gate and for the gate by ownership, counted."""
    hits = _hits(spark, d)
    certified = X.table_chain(hits, _suppliers(spark, d), COMPANIES).select(F.lit("table").alias("gate"), "company", "broken")
    owned = X.ownership_chain(hits, _suppliers(spark, d), PREFIXES).select(F.lit("ownership").alias("gate"), "company", "broken")
    return certified.unionByName(owned).groupBy("gate", "company", F.coalesce("broken", F.lit("whole")).alias("broken")).agg(F.count("*").alias("n"))


def _gates(spark, d, chain, kind):
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"))
    good = chain.where("broken is null").select("run_id", "company", F.lit(kind).alias("kind"))
    return X.gate(runs, good, COMPANIES, [kind])


def certified_table_gate(spark, d):
    g = _gates(spark, d, X.table_chain(_hits(spark, d), _suppliers(spark, d), COMPANIES), "contextual table evidence")
    return g.select("run_id", "passed", _joined("coverage").alias("coverage"), _joined("missing").alias("missing"))


def document_ownership_gate(spark, d):
    g = _gates(spark, d, X.ownership_chain(_hits(spark, d), _suppliers(spark, d), PREFIXES), "document evidence")
    return g.select("run_id", "passed", _joined("coverage").alias("coverage"), _joined("missing").alias("missing"))


def evidence_coverage(spark, d):
    """Metric and document evidence of both companies in each order: lines as observations, their sources and hits."""
    li = _lines(spark, d)
    source = F.when(F.col("l_discount") > 0.01, F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).otherwise("")
    declared = F.when(F.col("l_tax") < 0.07, F.array(source)).otherwise(F.array(source, F.lit("s0")))
    hit = F.struct(F.when(F.col("l_quantity") > 5, source).otherwise("elsewhere").alias("source"), F.concat(F.lit("e"), F.col("l_partkey").cast("string")).alias("evidence_id"))
    obs = li.select(
        F.col("l_orderkey").alias("run_id"), F.when(F.col("no") % 2 == 0, "get_company_metric").otherwise("search_financial_documents").alias("capability"), F.when(F.col("l_quantity") > 48, "error").otherwise("ok").alias("status"),
        F.when(F.col("l_returnflag") == "R", "Return").when(F.col("l_returnflag") == "A", "Sale").alias("company"), declared.alias("source_references"), F.array(F.concat(F.lit("e"), F.col("l_partkey").cast("string"))).alias("evidence_ids"), F.array(hit).alias("hits"),
    )
    g = X.gate(table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id")), X.evidence_kinds(obs), COMPANIES, ["metric", "document"])
    return g.select("run_id", "passed", _joined("coverage").alias("coverage"), _joined("missing").alias("missing"))


def run_evaluation(spark, d):
    """Orders as runs: five measures and the release."""
    o, li, hits, certified = table(spark, d, "orders"), _lines(spark, d), _hits(spark, d), _suppliers(spark, d)
    fact = li.where("l_tax > 0 and l_discount > 0")
    facts = fact.select(
        F.col("l_orderkey").alias("run_id"), F.col("no").alias("fact_no"), F.when(F.col("l_returnflag") == "R", "Return").otherwise("Sale").alias("company"), F.concat(F.lit("C"), F.col("l_partkey").cast("string")).alias("chunk_id"),
        F.array(F.when(F.col("l_quantity") == 17, "e3").otherwise("e1")).alias("element_ids"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_reference"), (F.col("l_linenumber") - F.when(F.col("l_quantity") == 23, 0).otherwise(1)).alias("physical_page"),
    )
    used = facts.groupBy("run_id", "source_reference").agg(F.min("fact_no").alias("at")).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("at", "source_reference"))).alias("u"))
    used = used.select("run_id", F.transform("u", lambda s: s["source_reference"]).alias("u"))
    briefing = F.col("o_totalprice") > 20_000
    when = lambda c: F.when(briefing, c)
    runs = o.join(used, o["o_orderkey"] == used["run_id"], "left").select(
        F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("stopped").alias("status"), F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("replans"), F.lit(6).alias("max_steps"), F.lit(1).alias("max_replans"),
        F.when(F.col("o_orderpriority") == "2-HIGH", "reference").when(F.col("o_orderpriority") != "5-LOW", "growth").alias("intent"), F.lit("growth").alias("label"), briefing.alias("briefing"),
        when(F.when(F.col("o_totalprice") > 100_000, "Operating Growth of both").otherwise("Margins of both")).alias("summary"), when(F.month("o_orderdate") % 6).alias("cross_observations"), when(F.dayofmonth("o_orderdate") % 9).alias("interpretation"), when(F.lit(1)).alias("limitations"),
        when(F.when(F.col("o_custkey") % 5 == 0, F.array(F.lit("Sale"))).otherwise(F.array(F.lit("Sale"), F.lit("Return")))).alias("covered"), when(F.when(F.month("o_orderdate") == 3, F.array_sort("u")).otherwise(F.col("u"))).alias("aggregate_sources"),
    )
    observations = li.select(F.col("l_orderkey").alias("run_id"), F.col("no").alias("position"), F.when(F.col("l_quantity") > 10, F.concat(F.lit("inspect:"), F.col("no").cast("string"))).otherwise("search").alias("signature"), F.when(F.col("l_quantity") == 31, "error").otherwise("ok").alias("status"))
    expected = spark.createDataFrame([(i, f"inspect:{i}") for i in range(1, STEPS + 1)], "position int, signature string")
    g = X.gate(runs, X.ownership_chain(hits, certified, PREFIXES).where("broken is null").select("run_id", "company", F.lit("document").alias("kind")), COMPANIES[1:], ["document"])
    return X.evaluate_runs(runs, observations, expected, facts, hits, g, certified, COMPANIES)


SEGMENTS = ("AUTOMOBILE", "BUILDING", "MACHINERY")


def table_values(spark, d):
    """Values of tables in both layouts: balances of customers by segment, and of suppliers by period, a table for each nation."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    money = lambda x: F.when(x >= 0, F.format_number(F.round(x), 0)).otherwise("-")
    by_segment = lambda f: [money(f(F.when(F.col("c_mktsegment") == g, F.col("c_acctbal")))) for g in SEGMENTS]
    line = lambda name, cells: F.array(F.lit(name), *(F.coalesce(x, F.lit("")) for x in cells))
    header = F.array(F.lit(""), *(F.when(F.count_if(F.col("c_mktsegment") == g) > 1, g).otherwise(" ") for g in SEGMENTS))
    n = F.count("*")
    rows = F.filter(F.array(header, line("Revenue", by_segment(F.sum)), line("Costs", by_segment(F.min)), line("REVENUE", by_segment(F.max)), F.when(n % 7 != 0, line("Revenue", by_segment(F.avg)))), lambda r: r.isNotNull())
    first = c.groupBy("c_nationkey").agg(rows.alias("rows"), F.when(n % 11 != 0, "USD millions").alias("unit"))
    first = first.select(F.concat(F.lit("S"), F.col("c_nationkey").cast("string")).alias("table_id"), F.lit("segments").alias("layout"), "unit", F.lit("FY2025").alias("period"), "rows")
    periods = F.array(F.lit(""), F.lit(""), F.when(n % 3 == 0, "FY2025").otherwise("FY 2024"), F.lit(""), F.lit("FY 2025"))
    metrics = F.array(F.lit(""), F.lit("Revenue (€ millions)"), F.lit("organic"), F.when(n % 5 == 0, "Result").otherwise("Revenue € millions"), F.lit("organic"))
    total = F.when(n % 7 != 0, F.array(F.lit("Total group"), F.format_number(F.round(F.max("s_acctbal")), 0), F.lit("1%"), F.format_number(F.round(F.sum("s_acctbal")), 0), F.concat(n.cast("string"), F.lit("%"))))
    rows = F.filter(F.array(periods, metrics, F.array(F.lit("Part"), F.lit("7"), F.lit("1%"), F.lit("8"), F.lit("2%")), total), lambda r: r.isNotNull())
    second = s.groupBy("s_nationkey").agg(rows.alias("rows")).select(F.concat(F.lit("P"), F.col("s_nationkey").cast("string")).alias("table_id"), F.lit("periods").alias("layout"), F.lit("EUR millions").alias("unit"), F.lit("FY2025").alias("period"), "rows")
    return finance.reported_values(first.unionByName(second))


def configuration_report(spark, d):
    """Both configurations of the run log, case by case; a comparison that is refused lists why instead."""
    cases = stores.configured_cases(spark, d).withColumnRenamed("run_id", "configuration")
    held = cases.agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_set(F.col("case_id").cast("string")))), 256).alias("dataset_hash"))  # a stated set of cases
    parameters = spark.createDataFrame([(c, "v1") for c in stores.CONFIGURATIONS], "configuration string, dataset_version string").crossJoin(F.broadcast(held))
    refused = E.comparison_refusals(cases, parameters).collect()
    if refused:
        return spark.createDataFrame([("refused", r.reason) for r in refused], "kind string, metric string")
    return E.compare_configurations(cases, parameters, list(stores.MEASURES), base="bounded")


COMPANY_LIST = [("en", "tion", 1, ["the", "of"]), ("fr", "elle", 2, ["le", "que"]), ("de", "ung", 3, ["der", "und"]), ("es", "para", 4, ["el", "los"])]


def balanced_chunks(spark, d):
    """Lines of documents as chunks of four companies (languages): six for each question, shared out evenly."""
    docs = spread(table(spark, d, "documents")).select(F.col("lang").alias("company"), "doc_id", F.posexplode_outer(F.split("text", "\n")).alias("at", "text")).where("trim(text) <> ''")
    kind = F.when(F.contains("text", F.lit(" | ")), "table").otherwise("text")
    chunks = docs.select(F.concat_ws(":", F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lpad(F.col("at").cast("string"), 6, "0")).alias("chunk_id"), "company", kind.alias("kind"), (F.floor(F.col("at") / 4) + 1).alias("page"), "text")
    companies = spark.createDataFrame(COMPANY_LIST, "company string, name string, place int, expansion array<string>")
    return ranking.balanced(questions(spark, d).select("query_id", "question"), chunks, companies, 6)


def answer_tables(spark, d):
    """Orders as cases and their briefings, lines as facts and observations."""
    o, li = table(spark, d, "orders"), _lines(spark, d)
    key = (F.col("l_orderkey").alias("case_id"), F.lit("given").alias("configuration_id"))
    allow, mon, dom = F.col("o_orderpriority") != "5-LOW", F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    companies = F.when(F.col("o_custkey") % 17 == 0, F.array().cast("array<string>")).when(F.col("o_custkey") % 4 == 0, F.array(F.lit("Sale"))).otherwise(F.array(F.lit("Return"), F.lit("Sale")))
    cases = o.select(
        F.col("o_orderkey").alias("case_id"), F.when(allow, "completed").otherwise("insufficient_evidence").alias("expected_status"), allow.alias("allow_briefing"), companies.alias("required_companies"),
        F.array(F.lit("e1"), F.lit("e2")).alias("required_evidence_ids"), F.array(F.lit("metric"), F.lit("document")).alias("required_fact_kinds"), F.array(F.lit("Currencies"), F.lit("business definitions")).alias("required_limitations"),
    )
    line = li.where("l_tax > 0")
    source = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    evidence = F.concat(F.lit("e"), (F.col("l_partkey") % 4).cast("string"))
    metric = F.col("l_linestatus") == "F"
    none = F.array().cast("array<string>")
    facts = line.select(
        *key, F.col("no").alias("fact_no"), F.when(F.col("l_quantity") != 13, F.when(metric, "metric").otherwise("document")).alias("kind"), F.when(F.col("l_quantity") == 29, F.array(source, F.lit("s0"))).otherwise(F.array(source)).alias("source_references"),
        F.when(metric & (F.col("l_quantity") != 37), none).otherwise(F.array(evidence)).alias("evidence_ids"),
    )
    observations = li.select(
        *key, F.when(metric, "get_company_metric").otherwise("search_financial_documents").alias("capability"), F.when(F.col("l_quantity") == 41, "error").otherwise("ok").alias("status"), F.array(source).alias("source_references"), F.array(evidence).alias("evidence_ids"),
        F.array(F.struct(F.when(F.col("l_quantity") < 3, "x").otherwise(source).alias("source"), evidence.alias("evidence_id"))).alias("hits"),
    )
    used = facts.select("case_id", "fact_no", F.posexplode("source_references").alias("at", "s")).groupBy("case_id", "s").agg(F.min(F.struct("fact_no", "at")).alias("f"))
    used = used.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "s"))), lambda x: x["s"]).alias("u"))
    briefing = F.col("o_totalprice") > 20_000
    when = lambda c: F.when(briefing, c)
    said = F.concat_ws(" ", F.when(mon % 2 == 0, "RETURN"), F.when(dom % 2 == 0, "and sale"), F.when(mon <= 6, "by valuation"), F.when(dom > 10, "and revenue growth"))
    predictions = o.join(used.hint("merge"), o["o_orderkey"] == used["case_id"], "left").select(
        F.col("o_orderkey").alias("case_id"), F.lit("given").alias("configuration_id"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "insufficient_evidence").otherwise("stopped").alias("status"), briefing.alias("briefing"), when(said).alias("text"),
        when(mon % 3).alias("cross_observations"), when(F.array(F.when(mon > 4, "Currency effects").otherwise("none"), F.when(dom > 20, "the Business Mix").otherwise("none"))).alias("limitations"), when(F.when(mon == 3, F.array_sort("u")).otherwise(F.coalesce("u", none))).alias("source_references"),
    )
    return cases, predictions, facts, observations


def answer_scores(spark, d):
    """Relevance, completeness and citations of every order's briefing, with what is missing."""
    cases, predictions, facts, observations = answer_tables(spark, d)
    cases, predictions = materialise(cases, "cases"), materialise(predictions, "predictions")
    found = {"relevance": scoring.answer_relevance(cases, predictions), "completeness": scoring.answer_completeness(cases, predictions, facts), "citations": scoring.citation_integrity(cases, predictions, facts, observations)}
    out = None
    for name, scored in found.items():
        rows = scored.select("case_id", F.lit(name).alias("measure"), "value", F.regexp_extract("rationale", "Missing: (.*)[.]$", 1).alias("missing"))
        out = rows if out is None else out.unionByName(rows)
    return out


QUERIES = {f.__name__: f for f in (answer_scores, evidence_chain, certified_table_gate, document_ownership_gate, evidence_coverage, run_evaluation, table_values, configuration_report, balanced_chunks)}

_H = """WITH li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS no FROM lineitem),
docs AS (SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'Return' ELSE 'Sale' END AS owner FROM supplier WHERE s_acctbal > 0),
hits AS (SELECT l_orderkey AS run_id, no, CASE WHEN l_returnflag = 'R' THEN 'Return' ELSE 'Sale' END AS company, 'C' || l_partkey AS chunk, CASE WHEN l_quantity > 45 THEN 'image' WHEN l_linestatus = 'F' THEN 'table' ELSE 'paragraph' END AS kind,
  l_tax > 0 AS unit, l_quantity >= 4 AS elements, l_linenumber - 1 AS page, l_discount > 0 AS source, l_suppkey, docs.owner AS hashed, coalesce(docs.owner, CASE l_partkey % 3 WHEN 0 THEN 'Return' WHEN 1 THEN 'Sale' END) AS owner
  FROM li LEFT JOIN docs ON s_suppkey = l_suppkey),
t AS (SELECT *, CASE WHEN kind <> 'table' THEN 'element_type' WHEN NOT unit THEN 'unit' WHEN NOT elements THEN 'elements' WHEN page <= 0 THEN 'page' WHEN hashed IS NULL THEN 'hash' ELSE 'whole' END AS broken FROM hits),
w AS (SELECT *, CASE WHEN kind = 'image' THEN 'element_type' WHEN NOT elements THEN 'elements' WHEN NOT source THEN 'source' WHEN owner IS NULL THEN 'owner' WHEN owner <> company THEN 'claim' WHEN page <= 0 THEN 'page' ELSE 'whole' END AS broken FROM hits)"""


def _gate_sql(chain: str, kind: str) -> str:
    has = lambda c: f"bool_or(coalesce(company = '{c}' AND broken = 'whole', false))"
    listed = lambda yes: "concat_ws(', ', " + ", ".join(f"CASE WHEN {'' if yes else 'NOT '}{c} THEN '{c} {kind}' END" for c in COMPANIES) + ")"
    return f"{_H} SELECT run_id, \"Return\" AND Sale AS passed, {listed(True)} AS coverage, {listed(False)} AS missing FROM (SELECT o_orderkey AS run_id, {has('Return')} AS \"Return\", {has('Sale')} AS Sale FROM orders LEFT JOIN {chain} ON run_id = o_orderkey GROUP BY 1)".replace(" Return ", ' "Return" ').replace("NOT Return", 'NOT "Return"').replace("WHEN Return", 'WHEN "Return"')


ORACLES = {
    "evidence_chain": _H + " SELECT 'table' AS gate, company, broken, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT 'ownership', company, broken, count(*) FROM w GROUP BY ALL",
    "certified_table_gate": _gate_sql("t", "contextual table evidence"),
    "document_ownership_gate": _gate_sql("w", "document evidence"),
    "evidence_coverage": _H + """, ob AS (SELECT l_orderkey AS run_id, CASE l_returnflag WHEN 'R' THEN 'Return' WHEN 'A' THEN 'Sale' END AS company, CASE WHEN no % 2 = 0 AND l_discount > 0.01 THEN 'metric' WHEN no % 2 = 1 AND l_discount > 0.01 AND l_quantity > 5 THEN 'document' END AS kind FROM li WHERE l_quantity <= 48),
      need AS (SELECT * FROM (VALUES (1, 'Return', 'metric'), (2, 'Return', 'document'), (3, 'Sale', 'metric'), (4, 'Sale', 'document')) v(no, company, kind)),
      have AS (SELECT DISTINCT run_id, company, kind FROM ob WHERE kind IS NOT NULL)
      SELECT o_orderkey AS run_id, count(h.run_id) = 4 AS passed, coalesce(string_agg(need.company || ' ' || need.kind, ', ' ORDER BY no) FILTER (h.run_id IS NOT NULL), '') AS coverage, coalesce(string_agg(need.company || ' ' || need.kind, ', ' ORDER BY no) FILTER (h.run_id IS NULL), '') AS missing
      FROM orders CROSS JOIN need LEFT JOIN have h ON h.run_id = o_orderkey AND h.company = need.company AND h.kind = need.kind GROUP BY 1""",
    "run_evaluation": _H + f""", calls AS (SELECT l_orderkey AS run_id, count(*) AS calls, count_if(l_quantity > 10 AND no <= {STEPS}) AS in_order, count_if(l_quantity = 31) AS errors, count_if(l_quantity <> 31) AS good, count(DISTINCT CASE WHEN l_quantity <> 31 THEN CASE WHEN l_quantity > 10 THEN 'i' || no ELSE 'search' END END) AS different FROM li GROUP BY 1),
      f AS (SELECT l_orderkey AS run_id, no, CASE WHEN l_returnflag = 'R' THEN 'Return' ELSE 'Sale' END AS company, 'C' || l_partkey AS chunk, l_quantity = 17 AS other, 's' || l_suppkey AS source, l_linenumber - CASE WHEN l_quantity = 23 THEN 0 ELSE 1 END AS page FROM li WHERE l_tax > 0 AND l_discount > 0),
      lasth AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY run_id, chunk ORDER BY no DESC) = 1),
      held AS (SELECT f.run_id, bool_and(coalesce(NOT other AND h.elements AND f.company = h.company AND h.source AND f.source = 's' || h.l_suppkey AND f.page = h.page AND h.hashed IS NOT NULL, false)) AS held, list_sort(list(DISTINCT f.company)) AS named FROM f LEFT JOIN lasth h ON h.run_id = f.run_id AND h.chunk = f.chunk GROUP BY 1),
      used AS (SELECT run_id, list(source ORDER BY a) AS u FROM (SELECT run_id, source, min(no) AS a FROM f GROUP BY 1, 2) GROUP BY 1),
      gates AS (SELECT run_id, bool_or(company = 'Sale' AND broken = 'whole') AS passed FROM w GROUP BY 1),
      r AS (SELECT o_orderkey AS run_id, o_totalprice > 20000 AS brief, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS replans, coalesce(calls, 0) AS calls, coalesce(in_order, 0) AS in_order, coalesce(errors, 0) AS errors, coalesce(good, 0) AS good, coalesce(different, 0) AS different,
        o_orderstatus, o_orderpriority, o_totalprice, month(o_orderdate) AS mon, day(o_orderdate) AS dom, o_custkey, coalesce(held, false) AS held, named, u, coalesce(passed, false) AS passed
        FROM orders LEFT JOIN calls ON calls.run_id = o_orderkey LEFT JOIN held ON held.run_id = o_orderkey LEFT JOIN used ON used.run_id = o_orderkey LEFT JOIN gates ON gates.run_id = o_orderkey),
      m AS (SELECT run_id, (calls = {STEPS} AND in_order = {STEPS} AND errors = 0 AND replans = 0)::INT AS tool_correctness, (calls <= 6 AND good = different)::INT AS tool_efficiency,
        coalesce(o_orderstatus = 'F' AND brief AND o_orderpriority <> '5-LOW' AND named = ['Return', 'Sale'] AND (o_orderpriority = '2-HIGH' OR o_totalprice > 100000), false)::INT AS answer_relevance,
        (brief AND mon % 6 > 0 AND dom % 9 > 0 AND o_custkey % 5 <> 0)::INT AS answer_completeness, coalesce(brief AND passed AND held AND (mon <> 3 OR list_sort(u) = u), false)::INT AS citation_integrity FROM r)
      SELECT *, tool_correctness + tool_efficiency + answer_relevance + answer_completeness + citation_integrity = 5 AS release FROM m""",
    "table_values": """WITH c AS (SELECT c_nationkey, count(*) AS n, list_transform(['AUTOMOBILE', 'BUILDING', 'MACHINERY'], lambda g: {'g': g, 'n': len(list_filter(list(c_mktsegment), lambda m: m = g)), 's': list_sum(list_transform(list_filter(list({'m': c_mktsegment, 'b': c_acctbal}), lambda x: x.m = g), lambda x: x.b))}) AS seg FROM customer GROUP BY 1),
      a AS (SELECT 'S' || c_nationkey AS table_id, n % 11 = 0 AS bare, n % 7 = 0 AS short, list_transform(seg, lambda x: CASE WHEN x.s >= 0 THEN round(x.s) END) AS v, [x.g FOR x IN seg IF x.n > 1] AS heads, [i FOR x, i IN seg IF x.n > 1] AS at FROM c),
      a2 AS (SELECT *, CASE WHEN bare THEN 'table' WHEN short THEN 'rows' WHEN len(list_filter(v, lambda x: x IS NOT NULL)) <> 3 THEN 'values' WHEN len(heads) <> 3 THEN 'header' END AS error FROM a),
      b AS (SELECT 'P' || s_nationkey AS table_id, count(*) AS n, round(sum(s_acctbal)) AS v FROM supplier GROUP BY 1),
      b2 AS (SELECT *, CASE WHEN n % 7 = 0 THEN NULL END AS x, CASE WHEN n % 3 = 0 THEN 'period' WHEN n % 5 = 0 THEN 'metric' WHEN n % 7 = 0 THEN 'total' END AS error FROM b)
      SELECT table_id, CASE WHEN error IS NULL THEN heads[1] || ' revenue' END AS label, CASE WHEN error IS NULL THEN v[1] END::DOUBLE AS value, CASE WHEN error IS NULL THEN 'USD millions' END AS unit, error FROM a2
      UNION ALL SELECT table_id, CASE WHEN error IS NULL THEN 'Total group revenue' END, CASE WHEN error IS NULL THEN abs(v) END::DOUBLE, CASE WHEN error IS NULL THEN 'EUR millions' END, error FROM b2""",
    "configuration_report": evals._W + evals._BM25 + "".join(stores._cases_of(r.replace("-", "_"), k) for r, k in stores.CONFIGURATIONS.items())
    + ", cm AS (" + " UNION ALL ".join(f"SELECT '{r}' AS configuration, * FROM cm_{r.replace('-', '_')}" for r in stores.CONFIGURATIONS) + ")"
    + ", lg AS (" + " UNION ALL ".join(f"SELECT configuration, case_id, '{m}' AS metric, {m} AS value FROM cm" for m in stores.MEASURES) + ")"
    + """ SELECT 'mean' AS kind, configuration, metric, NULL::BIGINT AS case_id, round(avg(value), 6) AS value FROM lg GROUP BY ALL
      UNION ALL SELECT 'passed', configuration, metric, NULL, count_if(value = 1)::DOUBLE FROM lg GROUP BY ALL
      UNION ALL SELECT 'delta', a.configuration, a.metric, a.case_id, round(a.value - b.value, 6) FROM lg a JOIN lg b ON a.case_id = b.case_id AND a.metric = b.metric AND b.configuration = 'bounded' WHERE a.configuration <> 'bounded' AND a.value <> b.value
      UNION ALL SELECT 'failure', configuration, failure_stage, NULL, count(*)::DOUBLE FROM cm WHERE failure_stage <> 'none' GROUP BY ALL""",
    "balanced_chunks": f"""WITH {SQL}, comp AS (SELECT * FROM (VALUES {", ".join(f"('{c}', '{n}', {p}, {e})" for c, n, p, e in COMPANY_LIST)}) v(company, name, place, expansion)),
      ch AS (SELECT lang AS company, lpad(doc_id::VARCHAR, 12, '0') || ':' || lpad(no::VARCHAR, 6, '0') AS chunk_id, no // 4 + 1 AS page, contains(line, ' | ') AS tab, list_distinct(regexp_extract_all(replace(lower(line), 'ß', 'ss'), '[a-z0-9]+')) AS w
        FROM (SELECT lang, doc_id, unnest(l) AS line, unnest(range(len(l))) AS no FROM (SELECT lang, doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(line) <> ''),
      men AS (SELECT query_id, count_if(contains(replace(lower(question), 'ß', 'ss'), name)) AS n FROM questions, comp GROUP BY 1),
      asked AS (SELECT q.query_id, c.company, c.place, CASE WHEN n = 1 THEN 6 ELSE 1 END AS share, list_distinct(list_concat(list_filter(regexp_extract_all(replace(lower(question), 'ß', 'ss'), '[a-z0-9]+'), lambda w: NOT list_contains({list(ranking.BALANCED_STOP_WORDS)}, w)), expansion)) AS w
        FROM questions q JOIN men USING (query_id), comp c WHERE n <> 1 OR contains(replace(lower(question), 'ß', 'ss'), c.name)),
      sc AS (SELECT query_id, a.company, place, share, chunk_id, page, tab, len(list_intersect(list_filter(ch.w, lambda x: NOT list_contains({list(ranking.BALANCED_STOP_WORDS)}, x)), a.w)) AS score FROM asked a JOIN ch USING (company)),
      r1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, company ORDER BY score DESC, NOT tab, page, chunk_id) AS r FROM sc WHERE score > 0)
      SELECT query_id, company, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY place, r) AS rank FROM r1 WHERE r <= share QUALIFY rank <= 6""",
    "answer_scores": _H + """, c AS (SELECT o_orderkey AS case_id, o_orderpriority <> '5-LOW' AS allow, CASE WHEN o_custkey % 17 = 0 THEN [] WHEN o_custkey % 4 = 0 THEN ['Sale'] ELSE ['Return', 'Sale'] END AS comp, o_totalprice > 20000 AS brief, month(o_orderdate) AS mon, day(o_orderdate) AS dom,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'insufficient_evidence' ELSE 'stopped' END = CASE WHEN o_orderpriority <> '5-LOW' THEN 'completed' ELSE 'insufficient_evidence' END AS typed FROM orders),
      b AS (SELECT *, brief AND mon % 2 = 0 AS ret, brief AND dom % 2 = 0 AS sal, brief AND mon <= 6 AS val, brief AND dom > 10 AS gro FROM c),
      f AS (SELECT l_orderkey AS case_id, no, CASE WHEN l_quantity <> 13 THEN CASE WHEN l_linestatus = 'F' THEN 'metric' ELSE 'document' END END AS kind, 's' || l_suppkey AS s, l_quantity = 29 AS two, CASE WHEN l_linestatus = 'F' AND l_quantity <> 37 THEN '' ELSE 'e' || l_partkey % 4 END AS e FROM li WHERE l_tax > 0),
      ob AS (SELECT DISTINCT l_orderkey AS case_id, CASE WHEN l_linestatus = 'F' THEN 'metric' ELSE 'document' END AS kind, 's' || l_suppkey AS s, CASE WHEN l_linestatus = 'F' THEN '' ELSE 'e' || l_partkey % 4 END AS e FROM li WHERE l_quantity <> 41 AND (l_linestatus = 'F' OR l_quantity >= 3)),
      g AS (SELECT f.case_id, bool_and(coalesce(NOT two AND ob.s IS NOT NULL, false)) AS valid, count(DISTINCT CASE WHEN f.e IN ('e1', 'e2') THEN f.e END) AS ids, count(DISTINCT f.kind) AS kinds, bool_or(f.e = 'e1') AS e1 FROM f LEFT JOIN ob ON ob.case_id = f.case_id AND ob.kind = f.kind AND ob.s = f.s AND ob.e = f.e GROUP BY 1),
      u0 AS (SELECT case_id, no, 0 AS at_, s FROM f UNION ALL SELECT case_id, no, 1, 's0' FROM f WHERE two), u1 AS (SELECT case_id, s, min(no * 2 + at_) AS p FROM u0 GROUP BY 1, 2), u AS (SELECT case_id, list(s ORDER BY p) AS u FROM u1 GROUP BY 1),
      j AS (SELECT b.*, coalesce(valid, false) AS valid, coalesce(ids, 0) AS ids, coalesce(kinds, 0) AS kinds, coalesce(u, []) AS u FROM b LEFT JOIN g USING (case_id) LEFT JOIN u USING (case_id)),
      k AS (SELECT case_id, 'relevance' AS measure, CASE WHEN allow THEN list_concat(list_transform(comp, lambda x: {'n': 'company ' || x, 'v': (CASE WHEN x = 'Return' THEN ret ELSE sal END)::INT::DOUBLE}), [{'n': 'mission dimension valuation', 'v': val::INT::DOUBLE}, {'n': 'mission dimension operating growth', 'v': gro::INT::DOUBLE}])
          ELSE [{'n': 'expected typed status', 'v': typed::INT::DOUBLE}, {'n': 'no briefing emitted', 'v': (NOT brief)::INT::DOUBLE}] END AS q FROM j
        UNION ALL SELECT case_id, 'completeness', [{'n': 'expected final status', 'v': typed::INT::DOUBLE}, {'n': 'required evidence IDs', 'v': ids / 2.0}, {'n': 'required fact kinds', 'v': kinds / 2.0},
          {'n': 'required companies', 'v': CASE WHEN len(comp) = 0 THEN 1.0 ELSE (CASE WHEN list_contains(comp, 'Return') THEN ret::INT ELSE 0 END + sal::INT) / len(comp) END}, {'n': 'cross-company comparison', 'v': (brief AND mon % 3 > 0)::INT::DOUBLE}, {'n': 'required limitations', 'v': ((brief AND mon > 4)::INT + (brief AND dom > 20)::INT) / 2.0}] FROM j
        UNION ALL SELECT case_id, 'citations', CASE WHEN brief THEN [{'n': 'observation-backed fact provenance', 'v': valid::INT::DOUBLE}, {'n': 'aggregate source union', 'v': (mon <> 3 OR (len(u) > 0 AND list_sort(u) = u) OR len(u) = 0)::INT::DOUBLE}] ELSE [{'n': 'expected no-briefing stop', 'v': (NOT allow AND typed)::INT::DOUBLE}] END FROM j),
      m AS (SELECT *, list_sum(list_transform(q, lambda x: x.v)) / len(q) AS v, array_to_string(list_transform(list_filter(q, lambda x: x.v < 1), lambda x: x.n), ', ') AS mi FROM k)
      SELECT case_id, measure, CASE WHEN measure = 'citations' THEN (v = 1)::INT::DOUBLE ELSE round(v, 6) END AS value, CASE WHEN mi = '' THEN 'none' ELSE mi END AS missing FROM m""",
}
