"""Queries of briefings, gates, releases and the remaining chunk forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import chunking as C
from cairn.operators import evaluation as E
from cairn.plans.chunks import _packed, _windows
from cairn.sources.contracts import SQL, blocks, observations, passages, table

LIMITS = {"un": ("une ", "un "), "der": ("der ", "die "), "of": ("of the", "of that")}


def _briefs(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), " ").alias("text"), F.array_sort(F.collect_set("role")).alias("roles"), F.count("*").alias("turns"))


def answer_relevance(spark, d):
    text = T.fold(F.col("text"))
    wanted = (("company the", F.contains(text, F.lit("the "))), ("company und", F.contains(text, F.lit("und "))), ("dimension", F.contains(text, F.lit("tion")) | F.contains(text, F.lit("ung"))))
    checks = F.array(*(F.struct(F.lit(i).alias("no"), F.lit(n).alias("name"), v.cast("double").alias("value")) for i, (n, v) in enumerate(wanted)))
    rows = _briefs(spark, d).select("conv_id", F.explode(checks).alias("c")).select("conv_id", "c.no", "c.name", "c.value")
    return E.score_checks(rows, "conv_id")


def answer_completeness(spark, d):
    b = _briefs(spark, d)
    limits = E.limitation_coverage(F.array(F.lit("un"), F.lit("der"), F.lit("of")), F.col("text"), LIMITS)
    parts = [(F.col("turns") >= 4).cast("double"), T.coverage_counted(F.array(F.lit("User"), F.lit("system")), F.col("roles")), limits]
    return b.select("conv_id", F.round(sum(parts, F.lit(0.0)) / 3, 6).alias("score"))


def citation_integrity(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("run_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("no"), F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("evidence"), "l_quantity")
    claimed = rows.groupBy("run_id").agg(F.when(F.col("run_id") % 5 == 0, F.array(F.min("source"))).otherwise(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("no", "source"))), lambda s: s["source"]))).alias("claimed"))
    return E.citation_integrity(rows.join(claimed, "run_id"), rows.where("l_quantity > 3"))


def run_release(spark, d):
    """Runs within budget whose good calls don't repeat and whose calls alternate in the expected order at the start."""
    o = observations(spark, d).withColumn("signature", T.call_signature(F.col("capability"), F.col("arguments")))
    ok = F.when(F.col("status") == "ok", F.col("signature"))
    first = F.slice(F.array_sort(F.collect_list(F.struct("attempt_id", "capability"))), 1, 2)
    r = o.groupBy("run_id").agg(F.count("*").alias("calls"), (F.count(ok) == F.countDistinct(ok)).alias("no_repeat"), F.array_join(F.transform(first, lambda s: s["capability"]), ",").alias("start"))
    order = F.col("start") == "get_company_metric,search_financial_documents"
    return r.select("run_id", "no_repeat", order.alias("order"), (F.col("calls") <= 40).alias("budget"), (F.col("no_repeat") & order & (F.col("calls") <= 40)).alias("release"))


def config_alignment(spark, d):
    """Rows whose language is not the commonest of their source, nulls compared as values."""
    docs = table(spark, d, "documents")
    n = docs.groupBy("source", "lang").agg(F.count("*").alias("n"))
    most = n.groupBy("source").agg(F.max_by("lang", F.struct("n", "lang")).alias("expected"))
    return docs.join(F.broadcast(most) if most.count() < 10_000 else most, "source").where(~F.col("lang").eqNullSafe(F.col("expected"))).select("doc_id", "lang", "expected")


def finding_violations(spark, d):
    rule = F.when((F.col("quality") == 1) & (F.col("toxic") == 1), "claim_without_excerpt").when(F.col("quality") == 0, "interpretation_without_rationale")
    return table(spark, d, "labels").select("doc_id", rule.alias("rule")).where("rule is not null")


def table_gate(spark, d):
    """Each language needs a table whose source is known; what lacks is named."""
    b = blocks(spark, d).where("block_type = 'table'").select("source_id").distinct()
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    hit = docs.join(b, docs["doc_id"] == b["source_id"], "left").withColumn("owned", F.col("source_id").isNotNull() & F.col("source").isin(*(f"src{i}" for i in range(10))))
    return hit.groupBy("lang").agg(F.sum(F.col("owned").cast("long")).alias("tables"), F.max("owned").alias("passed"))


def ownership_gate(spark, d):
    company = F.when(F.col("source").rlike("^src[0-9]$"), "small").when(F.col("source").rlike("^src1"), "large")
    claimed = F.when(F.col("doc_id") % 2 == 0, "small").otherwise("large")
    return table(spark, d, "documents").select(company.alias("company"), (company == claimed).alias("counts")).groupBy("company", "counts").agg(F.count("*").alias("n"))


def eligible_chunks(spark, d):
    want = F.array(F.lit("TABLE"), F.lit("paragraph "))
    kinds = F.transform(want, lambda k: F.lower(F.trim(k)))
    return blocks(spark, d).where(F.array_contains(kinds, F.col("block_type")) & (F.col("ordinal") < 6)).groupBy("block_type").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("documents"))


def eligible_blocks(spark, d):
    """What each filter leaves of all blocks, wherever they stand: element type, document id, segment (a table row's label)."""
    same = lambda want, own: F.lower(F.trim(F.lit(want))) == F.lower(F.trim(own))
    labels = F.when(F.col("block_type") == "table", F.array(F.get(F.split("text", r" \| "), F.lit(0)))).otherwise(F.array().cast("array<string>"))
    filters = (
        ("table", same("TABLE", F.col("block_type"))),
        ("paragraph", same("paragraph ", F.col("block_type"))),
        ("document", same(" 7 ", F.col("source_id").cast("string"))),
        ("segment", F.exists(labels, lambda s: same("Er ", s))),
    )
    met = F.filter(F.array(*(F.when(own, name) for name, own in filters)), lambda x: x.isNotNull())
    return blocks(spark, d).select("source_id", F.explode(met).alias("filter")).groupBy("filter").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("documents"))


def inspect_evidence(spark, d):
    ids = table(spark, d, "labels").select(F.format_string("DOC-%08d", F.when(F.col("doc_id") % 6 == 0, F.col("doc_id") + 50_000_000).otherwise(F.col("doc_id"))).alias("passage_id"))
    p = passages(spark, d).select("passage_id", "company")
    return ids.join(p, "passage_id", "left").select("passage_id", "company", F.when(F.col("company").isNull(), "unknown_evidence").alias("error_code"))


def chunk_enriched(spark, d):
    ctx = table(spark, d, "labels").select("doc_id", F.concat(F.lit("quality "), F.col("quality")).alias("context"))
    docs = table(spark, d, "documents").select("doc_id", "text").join(ctx, "doc_id", "left")
    return docs.select("doc_id", F.md5(F.concat("context", F.lit("\n\n"), F.col("text"))).alias("md5"), F.col("context").isNull().alias("rejected"))


def chunk_propositions(spark, d):
    raw = F.when(F.col("doc_id") % 4 == 0, F.lit('{"a": 1}')).when(F.col("doc_id") % 4 == 1, F.lit("[]")).otherwise(F.to_json(F.split("text", "\n")))
    rows = table(spark, d, "documents").select("doc_id", F.from_json(raw, "array<string>", {"mode": "PERMISSIVE"}).alias("p"), raw.startswith("[").alias("list"))
    good = F.col("list") & (F.size("p") > 0)
    return rows.select("doc_id", (~good).alias("rejected"), F.when(good, F.size(F.filter("p", lambda x: F.trim(x) != ""))).otherwise(0).cast("long").alias("propositions"))


def chunk_kinds(spark, d):
    text = table(spark, d, "documents").select("doc_id", F.size(C.pack_words(F.col("text"), 1200)).alias("n"))
    tables = blocks(spark, d).where("block_type = 'table'").groupBy(F.col("source_id").alias("doc_id")).agg(F.count("*").alias("n"))
    return text.select("doc_id", F.lit("text").alias("kind"), F.col("n").cast("long").alias("n")).unionByName(tables.select("doc_id", F.lit("table").alias("kind"), "n"))


def chunk_financial(spark, d):
    """Neighbouring blocks of one page are packed up to a budget; tables and headings stand alone."""
    b = blocks(spark, d).withColumn("page", F.floor(F.col("ordinal") / 4))
    own = Window.partitionBy("source_id").orderBy("ordinal")
    alone = F.col("block_type") != "paragraph"
    turn = F.coalesce((F.lag("page").over(own) != F.col("page")) | alone | (F.lag("block_type").over(own) != "paragraph"), F.lit(True))
    rows = b.withColumn("island", F.sum(turn.cast("int")).over(own))
    packed = rows.groupBy("source_id", "island").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda s: s["text"]).alias("t"), F.first("block_type").alias("kind"))
    return packed.select("source_id", "island", "kind", F.size(C.pack(F.col("t"), 3200, "\n")).cast("long").alias("chunks"))


def reported_values(spark, d):
    """The one number in the last cell of each table line; none or several are ambiguous."""
    b = blocks(spark, d).where("block_type = 'table'").withColumn("cell", F.element_at(F.split("text", r" \| "), -1))
    value = T.displayed_number(F.concat("cell", F.lit(" "), (F.col("ordinal") * 1000 + 7).cast("string")))
    return b.select("source_id", "ordinal", value.alias("value"), F.when(value.isNull(), "ambiguous").alias("state"))


def strategy_recall(spark, d):
    """Whether the start of a question stands whole in some chunk, for two window sizes, over all documents."""
    from cairn.sources.contracts import gold, questions

    g = gold(spark, d).join(passages(spark, d).select("passage_id", "text"), "passage_id").join(questions(spark, d).select("query_id", F.left("question", F.lit(80)).alias("literal")), "query_id")
    out = None
    for size in (120, 800):
        hit = F.exists(C.fixed_windows(F.col("text"), size, 20), lambda w: F.contains(w, F.col("literal")))
        row = g.groupBy("query_id").agg(F.max(hit.cast("int")).alias("hit")).agg(F.round(F.avg("hit"), 6).alias("recall")).select(F.lit(f"fixed{size}").alias("strategy"), "recall")
        out = row if out is None else out.unionByName(row)
    return out


def retrieval_lineage(spark, d):
    from cairn.plans.ranks import _bm25, _tfidf
    from cairn.operators import ranking as R

    f = R.fuse({"bm25": _bm25(spark, d), "tfidf": _tfidf(spark, d)})
    return f.groupBy("query_id").agg(F.count("*").alias("candidates"), F.sum((F.col("rank") <= 4).cast("long")).alias("selected"), F.sum(F.contains("channels", F.lit(",")).cast("long")).alias("in_both"))


QUERIES = {f.__name__: f for f in (answer_relevance, answer_completeness, citation_integrity, run_release, config_alignment, finding_violations, table_gate, ownership_gate, eligible_chunks, eligible_blocks, inspect_evidence, chunk_enriched, chunk_propositions, chunk_kinds, chunk_financial, reported_values, strategy_recall, retrieval_lineage)}

_B = f"WITH {SQL} "
_BRIEF = "br AS (SELECT conv_id, replace(lower(string_agg(text, ' ' ORDER BY turn)), 'ß', 'ss') AS t, list_distinct(list(role)) AS roles, count(*) AS turns FROM conversations GROUP BY 1)"


def _retrieval() -> str:
    from cairn.plans.ranks import _BM25, _TFIDF, _W, _fused

    return _W + _BM25 + "," + _TFIDF + ", " + _fused("f", ("bm_top", "bm25", 1.0), ("tf_top", "tfidf", 1.0)) + " SELECT query_id, count(*) AS candidates, sum((rank <= 4)::INT)::BIGINT AS selected, sum(contains(channels, ',')::INT)::BIGINT AS in_both FROM f GROUP BY 1"


ORACLES = {
    "answer_relevance": f"""WITH {_BRIEF}, k AS (SELECT conv_id, contains(t, 'the ') AS a, contains(t, 'und ') AS b, contains(t, 'tion') OR contains(t, 'ung') AS c FROM br),
      n AS (SELECT conv_id, (a::INT + b::INT + c::INT) / 3 AS v, concat_ws(', ', CASE WHEN a THEN 'company the' END, CASE WHEN b THEN 'company und' END, CASE WHEN c THEN 'dimension' END) AS y, concat_ws(', ', CASE WHEN NOT a THEN 'company the' END, CASE WHEN NOT b THEN 'company und' END, CASE WHEN NOT c THEN 'dimension' END) AS m FROM k)
      SELECT conv_id, round(v, 6) AS value, 'Satisfied: ' || CASE WHEN y = '' THEN 'none' ELSE y END || '. Missing: ' || CASE WHEN m = '' THEN 'none' ELSE m END || '.' AS rationale FROM n""",
    "answer_completeness": f"""WITH {_BRIEF} SELECT conv_id, round(((turns >= 4)::INT + (list_contains(roles, 'user')::INT + list_contains(roles, 'system')::INT) / 2
      + ((contains(t, 'une ') OR contains(t, 'un '))::INT + (contains(t, 'der ') OR contains(t, 'die '))::INT + (contains(t, 'of the') OR contains(t, 'of that'))::INT) / 3) / 3, 6) AS score FROM br""",
    "citation_integrity": """WITH o AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_quantity > 3),
      r AS (SELECT l_orderkey AS run_id, bool_and(o.l_suppkey IS NOT NULL) AS backed, list(l.l_suppkey ORDER BY l_linenumber, l.l_partkey, l.l_suppkey) AS s FROM lineitem l LEFT JOIN o ON o.l_suppkey = l.l_suppkey AND o.l_partkey = l.l_partkey GROUP BY 1),
      u AS (SELECT run_id, backed, CASE WHEN run_id % 5 = 0 THEN len(list_distinct(s)) = 1 ELSE true END AS union_holds FROM r) SELECT run_id, backed, union_holds, (backed AND union_holds)::INT::DOUBLE AS score FROM u""",
    "run_release": _B + """, r AS (SELECT run_id, count(*) AS calls, count(CASE WHEN status = 'ok' THEN capability || arguments END) = count(DISTINCT CASE WHEN status = 'ok' THEN capability || arguments END) AS no_repeat,
      array_to_string(list(capability ORDER BY attempt_id)[1:2], ',') = 'get_company_metric,search_financial_documents' AS "order" FROM observations GROUP BY 1) SELECT run_id, no_repeat, "order", calls <= 40 AS budget, no_repeat AND "order" AND calls <= 40 AS release FROM r""",
    "config_alignment": "WITH m AS (SELECT source, arg_max(lang, (n, lang)) AS expected FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1) SELECT doc_id, lang, expected FROM documents JOIN m USING (source) WHERE lang IS DISTINCT FROM expected",
    "finding_violations": "SELECT doc_id, CASE WHEN quality = 0 THEN 'interpretation_without_rationale' ELSE 'claim_without_excerpt' END AS rule FROM labels WHERE quality = 0 OR toxic = 1",
    "table_gate": _B + ", h AS (SELECT lang, doc_id IN (SELECT source_id FROM blocks WHERE block_type = 'table') AND list_contains(['src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9'], source) AS o FROM documents) SELECT lang, sum(o::INT)::BIGINT AS tables, bool_or(o) AS passed FROM h GROUP BY 1",
    "ownership_gate": "SELECT company, company = claimed AS counts, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'small' WHEN regexp_matches(source, '^src1') THEN 'large' END AS company, CASE WHEN doc_id % 2 = 0 THEN 'small' ELSE 'large' END AS claimed FROM documents) GROUP BY 1, 2",
    "eligible_chunks": _B + "SELECT block_type, count(*) AS n, count(DISTINCT source_id) AS documents FROM blocks WHERE block_type IN ('table', 'paragraph') AND ordinal < 6 GROUP BY 1",
    "eligible_blocks": _B + """, m AS (SELECT source_id, unnest([block_type, CASE WHEN source_id = 7 THEN 'document' END, CASE WHEN block_type = 'table' AND lower(trim(string_split(text, ' | ')[1])) = 'er' THEN 'segment' END]) AS filter FROM blocks)
      SELECT filter, count(*) AS n, count(DISTINCT source_id) AS documents FROM m WHERE filter <> 'heading' GROUP BY 1""",
    "inspect_evidence": _B + ", i AS (SELECT 'DOC-' || lpad((CASE WHEN doc_id % 6 = 0 THEN doc_id + 50000000 ELSE doc_id END)::VARCHAR, 8, '0') AS passage_id FROM labels) SELECT i.passage_id, company, CASE WHEN company IS NULL THEN 'unknown_evidence' END AS error_code FROM i LEFT JOIN passages p ON p.passage_id = i.passage_id",
    "chunk_enriched": "SELECT d.doc_id, md5('quality ' || quality || chr(10) || chr(10) || text) AS md5, quality IS NULL AS rejected FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "chunk_propositions": "SELECT doc_id, doc_id % 4 < 2 AS rejected, CASE WHEN doc_id % 4 < 2 THEN 0 ELSE len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) END AS propositions FROM documents",
    "reported_values": _B + ", c AS (SELECT source_id, ordinal, string_split(text, ' | ')[-1] AS cell FROM blocks WHERE block_type = 'table') SELECT source_id, ordinal, CASE WHEN NOT regexp_matches(cell, '[0-9]') THEN ordinal * 1000 + 7 END AS value, CASE WHEN regexp_matches(cell, '[0-9]') THEN 'ambiguous' END AS state FROM c",
    "retrieval_lineage": _retrieval(),
    "chunk_kinds": f"""WITH {SQL}, w AS (SELECT doc_id, {_packed('w', 1199)} AS c FROM (SELECT doc_id, list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '') AS w FROM documents))
      SELECT doc_id, 'text' AS kind, len(c) AS n FROM w UNION ALL SELECT source_id, 'table', count(*) FROM blocks WHERE block_type = 'table' GROUP BY 1""",
    "strategy_recall": f"""WITH {SQL}, g AS (SELECT query_id, left(question, 80) AS literal, text FROM gold JOIN passages USING (passage_id) JOIN questions USING (query_id)),
      r AS (SELECT query_id, bool_or(len(list_filter({_windows(120, 20)}, lambda w: contains(w, literal))) > 0) AS a, bool_or(len(list_filter({_windows(800, 20)}, lambda w: contains(w, literal))) > 0) AS b FROM g GROUP BY 1)
      SELECT 'fixed120' AS strategy, round(avg(a::INT), 6) AS recall FROM r UNION ALL SELECT 'fixed800', round(avg(b::INT), 6) FROM r""",
}
