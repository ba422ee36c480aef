"""Queries of laid-out pages, tables' own labels, and checked joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import chunking as C
from cairn.operators import finance as X
from cairn.operators import layout as L
from cairn.plans.chunks import _windows
from cairn.sources.contracts import SQL, blocks, table

LINES = 10
# Fixed value: what labels a period.
PERIOD = r"(?i)(?:Year Ended|FY\s*\d{4}|H[12]\s*\d{4}|Q[1-4]\s*\d{4})"


def _boxes(spark, d):
    """The lines of documents as boxes, LINES a page: classes by what the line holds, levels by its length, and a footer for each page."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("at", "text"))
    last = F.col("at") % LINES == LINES - 1
    short = F.length("text") < 40
    boxes = lines.select(
        "document_id",
        F.floor(F.col("at") / LINES).alias("page"),
        (F.col("at") % LINES).alias("box"),
        F.when(last, "page-footer").when(F.contains("text", F.lit(" | ")), "table").when(F.col("text").rlike("^[-*] "), "list-item").when(F.col("text").rlike(r"^\(\d+\)"), "footnote").otherwise("text").alias("boxclass"),
        F.when(F.col("at") == 0, 1).when(short & (F.length("text") > 0), 2 + F.length("text") % 2).otherwise(0).alias("header_level"),
        F.lit(0.0).alias("x0"),
        F.col("at").cast("double").alias("y0"),
        F.length("text").cast("double").alias("x1"),
        (F.col("at") + 1).cast("double").alias("y1"),
        F.when(last & (F.col("at") % 3 == 0), F.col("at").cast("string")).otherwise(F.col("text")).alias("text"),
    )
    return boxes.withColumn("markdown", F.when(F.col("boxclass") == "table", F.col("text")))


def elements_from_boxes(spark, d):
    e = L.elements_from_boxes(_boxes(spark, d))
    return e.select("document_id", F.col("ordinal").cast("long").alias("ordinal"), "page", F.col("printed_page").cast("long").alias("printed_page"), "element_type", F.md5("text").alias("md5"), F.md5(F.array_join("heading_path", " > ")).alias("path"))


def page_blocks(spark, d):
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("at", "text"))
    page = lines.groupBy("document_id", F.floor(F.col("at") / LINES).alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda s: s["text"]).alias("lines"))
    grid = F.transform(F.filter("lines", lambda x: F.contains(x, F.lit(" | "))), lambda x: F.split(x, r" \| "))
    rows = page.withColumn("tables", F.filter(F.array(grid), lambda t: F.size(t) > 0))
    return L.page_blocks(rows).select("document_id", "page", F.col("part").cast("long").alias("part"), "block_type", F.md5("text").alias("md5"))


def _tables(spark, d):
    """One table a document: its first line above the lines with bars, so that there is a header."""
    b = blocks(spark, d).where("block_type <> 'paragraph'")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda s: F.transform(F.split(s["text"], r" \| "), lambda c: F.trim(c)))  # F.trim itself would take the index as the characters to strip
    return b.groupBy("source_id").agg(rows.alias("rows"), F.max((F.col("block_type") == "table").cast("int")).alias("any")).where("any = 1").withColumn("path", F.array(F.when(F.col("source_id") % 2 == 0, "Results by business").otherwise("Results")))


def table_labels(spark, d):
    labels = L.table_labels(F.col("rows"), F.col("path"), PERIOD)
    return _tables(spark, d).select("source_id", F.array_join(labels["metric_labels"], ";").alias("metrics"), F.array_join(labels["row_labels"], ";").alias("row_labels"), labels["title"].alias("title"))


def metric_table(spark, d):
    e = table(spark, d, "events")
    calls = e.groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("calls"))
    errors = e.where("event_type = 'error'").groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("errors"))
    return L.join_one_to_one(calls, errors, ["run_id"])


def table_integrity(spark, d):
    """The share of tables that some chunk holds whole; 1 where there is none."""
    tables = blocks(spark, d).where("block_type = 'table'").select("source_id", F.col("ordinal").alias("table_no"), "text")
    out = None
    for name, make in (("fixed", lambda t: C.fixed_windows(t, 400, 80)), ("small", lambda t: C.fixed_windows(t, 60, 10))):
        chunks = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.explode_outer(make(F.col("text"))).alias("text")).where("text is not null")
        card = L.contained(chunks, tables, "source_id").agg(F.round(F.coalesce(F.avg(F.col("kept").cast("int")), F.lit(1.0)), 6).alias("integrity")).select(F.lit(name).alias("strategy"), "integrity")
        out = card if out is None else out.unionByName(card)
    return out


def contextualised_chunks(spark, d):
    """Only documents with a stated basis, audit or scale pass the gate, before any is ranked."""
    text = F.col("text")
    docs = table(spark, d, "documents").withColumns({"basis": X.basis(text), "scale": X.scale(text), "audited": X.audited(text), "figures": text.rlike(r"\d")})
    gate = F.col("figures") & (F.col("basis").isNotNull() | F.col("scale").isNotNull() | F.col("audited").isNotNull() | text.rlike(r"(?i)\b(?:revenue|income|total)\b"))
    return docs.groupBy("source").agg(F.count("*").alias("chunks"), F.sum(gate.cast("int")).alias("contextualised"))


QUERIES = {f.__name__: f for f in (elements_from_boxes, page_blocks, table_labels, metric_table, table_integrity, contextualised_chunks)}

_LINES = "SELECT doc_id AS document_id, unnest(range(len(l))) AS pos, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"
ORACLES = {
    "elements_from_boxes": rf"""WITH lines AS ({_LINES}),
      bx AS (SELECT document_id, pos // {LINES} AS page, pos % {LINES} AS box, pos, length(text) AS wide,
        CASE WHEN pos % {LINES} = {LINES - 1} THEN 'page-footer' WHEN contains(text, ' | ') THEN 'table' WHEN regexp_matches(text, '^[-*] ') THEN 'list-item' WHEN regexp_matches(text, '^\(\d+\)') THEN 'footnote' ELSE 'text' END AS cls,
        CASE WHEN pos = 0 THEN 1 WHEN length(text) BETWEEN 1 AND 39 THEN 2 + length(text) % 2 ELSE 0 END AS lvl,
        CASE WHEN pos % {LINES} = {LINES - 1} AND pos % 3 = 0 THEN pos::VARCHAR ELSE text END AS text FROM lines),
      foot AS (SELECT document_id, page, CASE WHEN regexp_full_match(text, '\s*\d{{1,4}}\s*') THEN trim(text)::BIGINT END AS printed_page FROM bx WHERE cls = 'page-footer'),
      el AS (SELECT *, CASE WHEN cls = 'table' THEN 'table' WHEN lvl > 0 THEN 'heading' WHEN cls = 'list-item' THEN 'list' WHEN cls = 'footnote' THEN 'footnote' ELSE 'paragraph' END AS element_type
        FROM bx WHERE cls <> 'page-footer' AND wide > 0 AND trim(text) <> ''),
      lv AS (SELECT *, CASE WHEN element_type = 'heading' THEN lvl END AS h FROM el),
      -- a heading of level n stands after the last of each lesser length of the path: levels here are 1 to 3
      st AS (SELECT *, list(CASE WHEN h IS NOT NULL THEN {{'l': h, 't': text}} END) OVER w AS seen FROM lv WINDOW w AS (PARTITION BY document_id ORDER BY pos)),
      pa AS (SELECT *, list_reduce(list_prepend([]::VARCHAR[], list_transform(list_filter(seen, lambda x: x IS NOT NULL), lambda x: [x.l::VARCHAR, x.t])), lambda acc, x: list_append(acc[1:x[1]::INT - 1], x[2])) AS path FROM st)
      SELECT pa.document_id, row_number() OVER (PARTITION BY pa.document_id ORDER BY pos) - 1 AS ordinal, pa.page, printed_page, element_type, md5(text) AS md5, md5(array_to_string(path, ' > ')) AS path FROM pa LEFT JOIN foot USING (document_id, page)""",
    "page_blocks": rf"""WITH lines AS ({_LINES}),
      pg AS (SELECT document_id, pos // {LINES} AS page, list_filter(list(trim(regexp_replace(text, '\s+', ' ', 'g')) ORDER BY pos), lambda x: x <> '') AS lines, list_filter(list(text ORDER BY pos), lambda x: contains(x, ' | ')) AS raw FROM lines GROUP BY 1, 2),
      gr AS (SELECT *, list_filter(list_transform(raw, lambda x: list_transform(string_split(x, ' | '), lambda c: trim(regexp_replace(c, '\s+', ' ', 'g')))), lambda r: len(list_filter(r, lambda c: c <> '')) > 0) AS rows FROM pg),
      ce AS (SELECT *, list_distinct(list_filter(flatten(rows), lambda c: c <> '')) AS cells FROM gr),
      le AS (SELECT *, array_to_string(list_filter(lines[2:], lambda x: NOT list_contains(cells, x) AND len(list_filter(cells, lambda c: NOT contains(x, c))) > 0), ' ') AS para FROM ce),
      bl AS (SELECT document_id, page, list_filter([{{'k': 'heading', 't': coalesce(lines[1], 'Page ' || page)}}, {{'k': 'paragraph', 't': para}}, {{'k': 'table', 't': array_to_string(list_transform(rows, lambda r: array_to_string(r, ' | ')), ' ')}}], lambda b: b.k = 'heading' OR (b.k = 'paragraph' AND b.t <> '') OR (b.k = 'table' AND len(rows) > 0)) AS b FROM le)
      SELECT document_id, page, unnest(range(len(b))) AS part, unnest(b).k AS block_type, md5(unnest(b).t) AS md5 FROM bl""",
    "table_labels": rf"""WITH {SQL},
      t AS (SELECT source_id, list(list_transform(string_split(text, ' | '), lambda c: trim(c)) ORDER BY ordinal) AS rows, source_id % 2 = 0 AS business FROM blocks WHERE block_type <> 'paragraph' GROUP BY 1 HAVING bool_or(block_type = 'table')),
      f AS (SELECT *, list_transform(rows, lambda r: r[1] <> '' AND len(list_filter(r[2:], lambda c: regexp_matches(c, '\d'))) > 0) AS data FROM t),
      h AS (SELECT *, CASE WHEN list_contains(data, true) THEN rows[1:list_position(data, true) - 1] ELSE rows END AS head, list_transform(list_filter(list_zip(rows, data), lambda z: z[2]), lambda z: z[1][1]) AS labels FROM f),
      keep AS (SELECT *, list_filter(flatten(list_transform(head, lambda r: r[2:])), lambda c: c <> '' AND NOT regexp_full_match(c, '{PERIOD}')) AS inner_cells, list_filter(flatten(head), lambda c: c <> '' AND NOT regexp_full_match(c, '{PERIOD}')) AS all_cells FROM h),
      once AS (SELECT source_id, business, CASE WHEN business THEN inner_cells ELSE list_filter(labels, lambda c: NOT regexp_matches(c, '{PERIOD}')) END AS m, CASE WHEN business THEN labels ELSE [] END AS r, all_cells AS a FROM keep)
      SELECT source_id, array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i), ';') AS metrics, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), ';') AS row_labels,
        nullif(array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ' | '), '') AS title FROM once""",
    "metric_table": "SELECT user_id AS run_id, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors FROM events WHERE user_id IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') > 0",
    "table_integrity": f"""WITH {SQL}, tb AS (SELECT source_id, ordinal, text FROM blocks WHERE block_type = 'table'),
      ck AS (SELECT 'fixed' AS strategy, doc_id AS source_id, unnest({_windows(400, 80)}) AS t FROM documents WHERE length(text) > 0 UNION ALL SELECT 'small', doc_id, unnest({_windows(60, 10)}) FROM documents WHERE length(text) > 0),
      kp AS (SELECT s.strategy, source_id, ordinal, max(coalesce(contains(t, text), false)::INT) AS kept FROM tb CROSS JOIN (VALUES ('fixed'), ('small')) s(strategy) LEFT JOIN ck USING (source_id, strategy) GROUP BY 1, 2, 3)
      SELECT s.strategy, round(coalesce(avg(kept), 1.0), 6) AS integrity FROM (VALUES ('fixed'), ('small')) s(strategy) LEFT JOIN kp USING (strategy) GROUP BY 1""",
    "contextualised_chunks": r"""SELECT source, count(*) AS chunks, sum((regexp_matches(text, '\d') AND regexp_matches(text, '(?i)\b(GAAP|audited|unaudited|revenue|income|total)\b|(In|€) millions?'))::INT) AS contextualised FROM documents GROUP BY 1""",
}
