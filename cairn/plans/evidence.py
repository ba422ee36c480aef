"""Queries of filtered chunks, flattened observations, plan revisions and claims."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.operators import evidence as X
from cairn.sources.contracts import SQL, blocks, table

FILTERS = [
    (1, None, None, None, "TABLE ", None, None), (2, " SRC3", None, None, "paragraph", None, None), (3, None, "EN", "Document", None, None, "Er "), (4, None, None, None, None, "doc-00000007", None), (5, None, None, None, None, None, None),
    (6, None, None, None, "image", None, None), (7, "src1", "fr", "report", None, None, None),
]


def filtered_chunks(spark, d):
    """How many lines and documents each of several filters leaves; a filter by a type that there isn't is told as such."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.col("source").alias("company"), F.col("lang").alias("period"))
    b = blocks(spark, d).join(docs, "source_id")
    segments = F.when(F.col("block_type") == "table", F.array(F.get(F.split("text", r" \| "), F.lit(0)))).otherwise(F.array().cast("array<string>"))
    chunks = b.select(F.struct("source_id", "ordinal").alias("chunk_id"), "company", "period", F.lit("document").alias("document_type"), F.col("block_type").alias("element_type"), F.format_string("DOC-%08d", "source_id").alias("document_id"), segments.alias("segments"))
    filters = spark.createDataFrame(FILTERS, "filter_id int, company string, period string, document_type string, element_type string, document_id string, segment string")
    left = X.filtered(chunks, filters).groupBy("filter_id").agg(F.count("*").alias("n"), F.countDistinct("chunk_id.source_id").alias("documents"))
    return left.withColumn("refused", F.lit(None).cast("string")).unionByName(X.filter_violations(filters).select("filter_id", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("documents"), F.col("element_type").alias("refused")))


def observation_evidence(spark, d):
    """Evidence ids and sources of the payloads of events, some of which are of other types than they should be."""
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    hit = F.concat(F.lit('{"source": "s'), k, F.lit('", "evidence_id": "e'), F.col("event_id").cast("string"), F.lit('"}'))
    payload = (
        F.when(kind == "click", F.concat(F.lit('{"source": "top", "hits": ['), hit, F.lit(", "), hit, F.lit(', {"source": "top", "evidence_id": 7}, "x", null]}'))).when(kind == "view", F.concat(F.lit('{"source": "s'), k, F.lit('", "hits": ['), hit, F.lit("]}")))
        .when(kind == "purchase", F.concat(F.lit('{"hits": "'), k, F.lit('", "source": 5}'))).when(kind == "signup", F.concat(F.lit("["), hit, F.lit("]")))
    )
    rows = X.flattened(table(spark, d, "events").select("event_id", F.try_parse_json(payload).alias("result")))
    return rows.select("event_id", F.array_join("evidence_ids", ",").alias("evidence_ids"), F.array_join("source_references", ",").alias("source_references"))


def revisions_of_plans(spark, d):
    """The revision of a user's plan at each event: views with an even figure replace what remains, clicks observe a revision."""
    e, k = table(spark, d, "events"), F.get_json_object("props", "$.k").cast("int")
    rows = e.select(
        F.col("user_id").alias("run_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("index"), "event_id",
        F.when((F.col("event_type") == "view") & (k % 2 == 0), "decision: Replace_Remaining").otherwise("kept").alias("summary"), F.when(F.col("event_type") == "click", k % 30).alias("plan_revision"),
    )
    return X.plan_revisions(rows).select("event_id", F.col("revision").cast("long").alias("revision"))


def claims_by_company(spark, d):
    """Lines of an order as facts: claims of each company in the order of its first."""
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    facts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.row_number().over(own).alias("fact_no"), F.when(F.col("l_tax") > 0, F.col("l_returnflag")).alias("company"), F.when(F.col("l_quantity") > 2, F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).alias("claim"))
    return X.company_claims(facts).select("run_id", F.col("place").cast("long").alias("place"), "company", F.array_join("claims", "; ").alias("claims"))


QUERIES = {f.__name__: f for f in (filtered_chunks, observation_evidence, revisions_of_plans, claims_by_company)}


def _value(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


_SAME = " AND ".join(f"(f.{c} IS NULL OR lower(trim(f.{c})) = lower(trim(c.{c})))" for c in X.EXACT)
ORACLES = {
    "filtered_chunks": f"""WITH {SQL}, f AS (SELECT * FROM (VALUES {", ".join("(" + ", ".join(map(_value, r)) + ")" for r in FILTERS)}) v(filter_id, company, period, document_type, element_type, document_id, segment)),
      c AS (SELECT source_id, source AS company, lang AS period, 'document' AS document_type, block_type AS element_type, 'DOC-' || lpad(source_id::VARCHAR, 8, '0') AS document_id, CASE WHEN block_type = 'table' THEN string_split(b.text, ' | ')[1] END AS segment FROM blocks b JOIN documents ON doc_id = source_id)
      SELECT filter_id, count(*) AS n, count(DISTINCT source_id) AS documents, NULL AS refused FROM f JOIN c ON {_SAME} AND (f.segment IS NULL OR coalesce(lower(trim(f.segment)) = lower(trim(c.segment)), false)) WHERE f.element_type IS NULL OR lower(trim(f.element_type)) IN {X.ELEMENT_TYPES} GROUP BY 1
      UNION ALL SELECT filter_id, 0, 0, element_type FROM f WHERE lower(trim(element_type)) NOT IN {X.ELEMENT_TYPES}""",
    "observation_evidence": """WITH e AS (SELECT event_id, event_type, props->>'$.k' AS k FROM events), j AS (SELECT event_id, CASE event_type WHEN 'click' THEN '{"source": "top", "hits": [{"source": "s' || k || '", "evidence_id": "e' || event_id || '"}, {"source": "s' || k || '", "evidence_id": "e' || event_id || '"}, {"source": "top", "evidence_id": 7}, "x", null]}'
        WHEN 'view' THEN '{"source": "s' || k || '", "hits": [{"source": "s' || k || '", "evidence_id": "e' || event_id || '"}]}' WHEN 'purchase' THEN '{"hits": "' || k || '", "source": 5}' WHEN 'signup' THEN '[{"source": "s' || k || '", "evidence_id": "e' || event_id || '"}]' END::JSON AS r FROM e),
      h AS (SELECT event_id, r, CASE WHEN json_type(r, '$.hits') = 'ARRAY' THEN json_extract(r, '$.hits[*]') ELSE [] END AS hits FROM j)
      SELECT event_id, array_to_string(list_filter(list_transform(hits, lambda x: CASE WHEN json_type(x, '$.evidence_id') = 'VARCHAR' THEN x->>'$.evidence_id' END), lambda y: y IS NOT NULL), ',') AS evidence_ids,
        coalesce((SELECT string_agg(s, ',' ORDER BY i) FROM (SELECT s, min(i) AS i FROM (SELECT unnest(list_concat([CASE WHEN json_type(r, '$.source') = 'VARCHAR' THEN r->>'$.source' END], list_transform(hits, lambda x: CASE WHEN json_type(x, '$.source') = 'VARCHAR' THEN x->>'$.source' END))) AS s, unnest(range(len(hits) + 1)) AS i) WHERE s IS NOT NULL GROUP BY s)), '') AS source_references FROM h""",
    "revisions_of_plans": """WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type = 'view' AND (props->>'$.k')::INT % 2 = 0 AS rep, CASE WHEN event_type = 'click' THEN (props->>'$.k')::INT % 30 END AS seen FROM events),
      r(user_id, pos, event_id, rev) AS (SELECT user_id, pos, event_id, greatest(1, coalesce(seen, 1)) + rep::INT FROM e WHERE pos = 1 UNION ALL SELECT e.user_id, e.pos, e.event_id, greatest(r.rev, coalesce(seen, r.rev)) + rep::INT FROM r JOIN e ON e.user_id = r.user_id AND e.pos = r.pos + 1)
      SELECT event_id, rev::BIGINT AS revision FROM r""",
    "claims_by_company": """WITH f AS (SELECT l_orderkey AS run_id, l_returnflag AS company, 'part ' || l_partkey AS claim, l_tax > 0 AND l_quantity > 2 AS told, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS no FROM lineitem),
      c AS (SELECT run_id, company, min(no) AS first, string_agg(claim, '; ' ORDER BY no) AS claims FROM f WHERE told GROUP BY 1, 2) SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY first) AS place, company, claims FROM c""",
}
