"""Queries of figures, market data and page parsing."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.operators import finance as X
from cairn.session import broadcast_if_small
from cairn.sources.contracts import SQL, blocks, table
from cairn.sources.html import html_blocks as page_blocks
from cairn.sources.html import small_batches

BLOCK_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "table", "li")
CURRENCY = ("USD", "EUR", "GBP", "JPY", "CHF")


class _Blocks(HTMLParser):
    """Headings, paragraphs, list items and tables in document order; list items within list items are part of the outer one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open, self.done, self.skip = [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        if tag in BLOCK_TAGS and not (tag == "li" and any(b[0] == "li" for b in self.open)):
            block = [tag, [], len(self.done)]
            self.open.append(block)
            self.done.append(block)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        if not self.skip:
            for block in self.open:
                block[1].append(data)


def html_rows(html: str | None) -> list[tuple[int, str, str]]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    texts = [(tag, " ".join(" ".join(parts).split())) for tag, parts, _ in parser.done]
    return [(i, tag, text) for i, (tag, text) in enumerate((t for t in texts if t[1]))]


def _blocks(spark, d):
    import pyarrow as pa

    def run(batches):
        for batch in (part for whole in batches for part in small_batches(whole, 1)):
            rows = [(p, *r) for p, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in html_rows(h)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.string()))], names=["page_id", "ordinal", "tag", "text"])

    return table(spark, d, "pages").select("page_id", "html").mapInArrow(run, "page_id long, ordinal int, tag string, text string")


def html_blocks(spark, d):
    return _blocks(spark, d).select("page_id", "ordinal", "tag", F.md5("text").alias("md5"))


def heading_paths(spark, d):
    """Every block of the pages with the path of headings that leads to it, none for those before the first: a heading cuts the path at its
    own level and is put at its end, an empty one too; a heading's own path ends with it."""
    b = page_blocks(table(spark, d, "pages"))
    return b.select("page_id", "ordinal", "block_type", "level", F.size("section_path").alias("depth"), F.array_join("section_path", " > ").alias("path"))


def html_h1(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1).alias("h1"))


def html_flatten_stats(spark, d):
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("html", "(?s)<(?:script|style)>.*?</(?:script|style)>", " "), "<[^>]*>", " "), "[ \n\t\r]+", " "))
    return table(spark, d, "pages").select("page_id", F.regexp_count("html", F.lit("<h[1-6]")).alias("headings"), F.regexp_count("html", F.lit("<table")).alias("tables"), F.length(plain).cast("long").alias("chars"), F.md5(plain).alias("md5"))


def empty_page_diagnostics(spark, d):
    plain = F.trim(F.regexp_replace("html", "(?s)<[^>]*>", ""))
    return table(spark, d, "pages").where((plain == "") | (F.length(plain) < 600)).select("page_id", F.lit("ocr_required").alias("code"), F.length(plain).cast("long").alias("chars"))


def anchor_excerpt(spark, d):
    at = F.instr("text", "the ")
    return table(spark, d, "documents").select("doc_id", F.when(at > 0, F.expr("substring(text, instr(text, 'the '), 60)")).alias("excerpt"), F.when(at == 0, "anchor_missing").alias("rejected"))


def table_text(spark, d):
    b = blocks(spark, d).where("block_type = 'table'")
    cells = F.filter(F.transform(F.split("text", r" \| "), lambda c: F.trim(c)), lambda c: c != "")  # F.trim itself would take the index as the characters to strip
    return b.select("source_id", "ordinal", F.size(cells).cast("long").alias("cells"), F.md5(F.array_join(cells, " | ")).alias("md5"))


def table_cells(spark, d):
    rows = blocks(spark, d).where("block_type = 'table'").groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda s: F.split(s["text"], r" \| ")).alias("rows"))
    cells = rows.select("source_id", F.explode_outer(X.melt(F.col("rows"))).alias("c")).select("source_id", "c.row", "c.col", "c.cell")
    return cells.groupBy("source_id").agg(F.count("*").alias("cells"), F.max("col").cast("long").alias("last_col"), F.max("row").cast("long").alias("last_row"))


def element_links(spark, d):
    own = Window.partitionBy("source_id").orderBy("ordinal")
    eid = F.substring(F.sha2(F.concat_ws("|", "source_id", "ordinal", "text"), 256), 1, 16)
    b = blocks(spark, d).withColumn("id", eid)
    return b.select("source_id", "ordinal", "id", F.lag("id").over(own).alias("previous"), F.lead("id").over(own).alias("next"))


def adjacent_elements(spark, d):
    b = blocks(spark, d).withColumn("page", F.floor(F.col("ordinal") / 4))
    a = X.adjacent(b, "source_id", "ordinal", "page", "text")
    return a.select("source_id", "ordinal", F.md5("before").alias("before"), F.md5("after").alias("after"))


def footnotes(spark, d):
    b = blocks(spark, d).withColumn("page", F.floor(F.col("ordinal") / 4)).withColumn("text", F.when(F.col("ordinal") % 3 == 1, F.concat(F.lit("(1) "), F.col("text"))).otherwise(F.col("text")))
    a = X.adjacent(b, "source_id", "ordinal", "page", "text")
    return a.groupBy("source_id").agg(F.sum(F.coalesce(F.col("before").rlike(X.FOOTNOTE).cast("int"), F.lit(0)) + F.coalesce(F.col("after").rlike(X.FOOTNOTE).cast("int"), F.lit(0))).alias("footnotes"))


def financial_metadata(spark, d):
    tags = F.element_at(F.array(F.lit(" unaudited non-GAAP FY 2025"), F.lit(" audited GAAP h2 2025 Q4 2025"), F.lit(" plain")), (F.col("doc_id") % 3 + 1).cast("int"))
    text = F.concat("text", tags)  # the whole text
    return table(spark, d, "documents").select("doc_id", X.basis(text).alias("basis"), X.audited(text).alias("audited"), F.array_join(X.periods(text, F.lit("FY2024")), ",").alias("periods"))


def financial_units(spark, d):
    tags = F.element_at(F.array(F.lit(" In millions"), F.lit(" € million"), F.lit(" plain")), (F.col("doc_id") % 3 + 1).cast("int"))
    text = F.concat("text", tags)
    ticker = F.when(F.col("source") == "src1", "NVDA").otherwise(F.col("source"))
    return table(spark, d, "documents").select("doc_id", X.currency(text, ticker).alias("currency"), X.scale(text).alias("scale"))


def table_chunk_text(spark, d):
    b = blocks(spark, d).where("block_type = 'table'")
    unit = F.when(F.col("source_id") % 2 == 0, F.lit("EUR millions"))
    numeric = F.col("text").rlike("[0-9]")
    return b.select("source_id", "ordinal", F.md5(F.concat_ws("\n\n", unit, "text")).alias("md5"), (unit.isNotNull() | ~numeric).alias("contextualized"))


def metrics_long(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("v"))
    snap = c.groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "v"))).alias("m"))
    return snap.select("c_nationkey", F.explode("m").alias("metric", "value"))


def metric_lookup(spark, d):
    """Each order asks for a nation and a segment; what is unknown gets its own error."""
    m = metrics_long(spark, d)
    asks = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 27).cast("int").alias("c_nationkey"), F.when(F.col("o_orderkey") % 10 == 3, "NOSUCH").otherwise("BUILDING").alias("metric"))
    known = m.select("c_nationkey").distinct().withColumn("k", F.lit(True))
    rows = asks.join(broadcast_if_small(known, 10_000), "c_nationkey", "left").join(broadcast_if_small(m, 100_000), ["c_nationkey", "metric"], "left")
    return rows.select("o_orderkey", "value", F.when(F.col("k").isNull(), "unsupported_ticker").when(F.col("value").isNull(), "unsupported_metric").alias("error_code"))


def _reported(spark, d):
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.round(F.sum("s_acctbal"), 2).alias("value"))
    n = table(spark, d, "nation")
    code = F.get(F.array(*(F.lit(c) for c in CURRENCY)), F.col("n_regionkey").cast("int"))
    return s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_nationkey").alias("nation"), "value", F.concat_ws(" ", code, F.when(F.col("n_nationkey") % 5 == 0, "thousands").otherwise("millions")).alias("unit"))


def compare_values(spark, d):
    r = _reported(spark, d)
    a = r.select(F.col("nation").alias("l"), F.col("value").alias("lv"), F.col("unit").alias("lu"))
    b = r.select(F.col("nation").alias("r"), F.col("value").alias("rv"), F.col("unit").alias("ru"))
    return a.join(b, F.col("r") == F.col("l") + 1).select("l", "r", X.compare(F.col("lv"), F.col("lu"), F.col("rv"), F.col("ru")).alias("c")).select("l", "r", "c.difference", "c.reason")


def fx_convert(spark, d):
    rates = F.create_map(*(F.lit(x) for pair in (("EUR", 1.08), ("GBP", 1.27), ("JPY", 0.0067), ("CHF", 1.12)) for x in pair))
    rows = _reported(spark, d).withColumn("rate", F.try_element_at(rates, F.split_part("unit", F.lit(" "), F.lit(1))))
    error = F.when(F.col("value") <= 0, "invalid_amount").when(F.col("rate").isNull(), "unknown_pair")
    return rows.select("nation", F.when(error.isNull(), F.bround(F.col("value") * F.col("rate"), 4)).alias("converted"), error.alias("error_code"))


def last_close(spark, d):
    e = table(spark, d, "events").select("user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("close"), "ts", "event_id")
    return X.last_close(e, "user_id", "close", "ts", "event_id").select("user_id", "close", "event_id")


def snapshot_violations(spark, d):
    e = table(spark, d, "events").where("event_type <> 'error'").groupBy("user_id").agg(F.max(F.to_date("ts")).alias("day"), F.count("*").alias("n"))
    e = e.withColumn("snapshot", F.col("user_id") % 10)
    newest = e.groupBy(F.col("snapshot").alias("of")).agg(F.max("day").alias("newest"))  # ten rows
    e = e.join(F.broadcast(newest), F.col("of").eqNullSafe(F.col("snapshot")))
    return e.withColumn("days", F.date_diff("newest", "day")).where("days > 0").select("user_id", F.col("days").cast("long").alias("days"))


def fx_inverse(spark, d):
    return table(spark, d, "part").select("p_partkey", X.half_up(F.col("p_retailprice"), 1).alias("price"), X.half_up(1 / F.col("p_retailprice").cast("double"), 6).alias("inverse"))


QUERIES = {f.__name__: f for f in (html_blocks, heading_paths, html_h1, html_flatten_stats, empty_page_diagnostics, anchor_excerpt, table_text, table_cells, element_links, adjacent_elements, footnotes, financial_metadata, financial_units, table_chunk_text, metrics_long, metric_lookup, compare_values, fx_convert, last_close, snapshot_violations, fx_inverse)}
_B = f"WITH {SQL} "
_REP = "rep AS (SELECT n_nationkey AS nation, round(sum(s_acctbal), 2) AS value, (['USD', 'EUR', 'GBP', 'JPY', 'CHF'])[(any_value(n_regionkey) + 1)::INT] AS cur, CASE WHEN n_nationkey % 5 = 0 THEN 'thousands' ELSE 'millions' END AS scale FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_nationkey)"
ORACLES = {
    "html_h1": "SELECT page_id, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1 FROM pages",
    "html_flatten_stats": """SELECT page_id, len(regexp_extract_all(html, '<h[1-6]')) AS headings, len(regexp_extract_all(html, '<table')) AS tables, length(p) AS chars, md5(p) AS md5 FROM (
      SELECT page_id, html, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(?:script|style)>.*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\n\\t\\r]+', ' ', 'g')) AS p FROM pages)""",
    "empty_page_diagnostics": "SELECT page_id, 'ocr_required' AS code, length(p) AS chars FROM (SELECT page_id, trim(regexp_replace(html, '(?s)<[^>]*>', '', 'g')) AS p FROM pages) WHERE length(p) < 600",
    "anchor_excerpt": "SELECT doc_id, CASE WHEN contains(text, 'the ') THEN substr(text, instr(text, 'the '), 60) END AS excerpt, CASE WHEN NOT contains(text, 'the ') THEN 'anchor_missing' END AS rejected FROM documents",
    "table_text": _B + "SELECT source_id, ordinal, len(c) AS cells, md5(array_to_string(c, ' | ')) AS md5 FROM (SELECT source_id, ordinal, list_filter(list_transform(string_split(text, ' | '), lambda x: trim(x)), lambda x: x <> '') AS c FROM blocks WHERE block_type = 'table')",
    "table_cells": _B + "SELECT source_id, sum(w)::BIGINT AS cells, max(w) - 1 AS last_col, count(*) - 1 AS last_row FROM (SELECT source_id, len(string_split(text, ' | ')) AS w FROM blocks WHERE block_type = 'table') GROUP BY 1",
    "element_links": _B + ", e AS (SELECT source_id, ordinal, substr(sha256(source_id || '|' || ordinal || '|' || text), 1, 16) AS id FROM blocks) SELECT source_id, ordinal, id, lag(id) OVER w AS previous, lead(id) OVER w AS next FROM e WINDOW w AS (PARTITION BY source_id ORDER BY ordinal)",
    "adjacent_elements": _B + "SELECT source_id, ordinal, md5(CASE WHEN lag(ordinal // 4) OVER w = ordinal // 4 THEN lag(text) OVER w END) AS before, md5(CASE WHEN lead(ordinal // 4) OVER w = ordinal // 4 THEN lead(text) OVER w END) AS after FROM blocks WINDOW w AS (PARTITION BY source_id ORDER BY ordinal)",
    "footnotes": _B + """, t AS (SELECT source_id, ordinal, regexp_matches(CASE WHEN ordinal % 3 = 1 THEN '(1) ' || text ELSE text END, '^(\\(\\d+\\)|\\d+\\.)') AS f FROM blocks),
      a AS (SELECT source_id, (CASE WHEN lag(ordinal // 4) OVER w = ordinal // 4 AND lag(f) OVER w THEN 1 ELSE 0 END) + (CASE WHEN lead(ordinal // 4) OVER w = ordinal // 4 AND lead(f) OVER w THEN 1 ELSE 0 END) AS n FROM t WINDOW w AS (PARTITION BY source_id ORDER BY ordinal)) SELECT source_id, sum(n)::BIGINT AS footnotes FROM a GROUP BY 1""",
    "financial_metadata": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'non-GAAP' WHEN 1 THEN 'GAAP' END AS basis, CASE doc_id % 3 WHEN 0 THEN false WHEN 1 THEN true END AS audited, CASE doc_id % 3 WHEN 0 THEN 'FY2025' WHEN 1 THEN 'H2 2025,Q4 2025' ELSE 'FY2024' END AS periods FROM documents",
    "financial_units": """SELECT doc_id, CASE WHEN regexp_matches(t, '€ million') THEN 'EUR' WHEN regexp_matches(t, 'In millions') AND source = 'src1' THEN 'USD' END AS currency, CASE WHEN regexp_matches(t, '(?i)(In|€) millions?') THEN 'millions' END AS scale
      FROM (SELECT doc_id, source, text || CASE doc_id % 3 WHEN 0 THEN ' In millions' WHEN 1 THEN ' € million' ELSE ' plain' END AS t FROM documents)""",
    "table_chunk_text": _B + "SELECT source_id, ordinal, md5(concat_ws(chr(10) || chr(10), CASE WHEN source_id % 2 = 0 THEN 'EUR millions' END, text)) AS md5, source_id % 2 = 0 OR NOT regexp_matches(text, '[0-9]') AS contextualized FROM blocks WHERE block_type = 'table'",
    "metrics_long": "SELECT c_nationkey, c_mktsegment AS metric, round(avg(c_acctbal), 4) AS value FROM customer GROUP BY 1, 2",
    "metric_lookup": """WITH m AS (SELECT c_nationkey AS n, c_mktsegment AS s, round(avg(c_acctbal), 4) AS value FROM customer GROUP BY 1, 2), a AS (SELECT o_orderkey, o_orderkey % 27 AS n, CASE WHEN o_orderkey % 10 = 3 THEN 'NOSUCH' ELSE 'BUILDING' END AS s FROM orders)
      SELECT o_orderkey, value, CASE WHEN a.n NOT IN (SELECT n FROM m) THEN 'unsupported_ticker' WHEN value IS NULL THEN 'unsupported_metric' END AS error_code FROM a LEFT JOIN m ON a.n = m.n AND a.s = m.s""",
    "compare_values": f"WITH {_REP} SELECT a.nation AS l, b.nation AS r, CASE WHEN a.cur = b.cur AND a.scale = b.scale THEN round(a.value - b.value, 6) END AS difference, CASE WHEN a.cur <> b.cur THEN 'currency_mismatch' WHEN a.scale <> b.scale THEN 'scale_mismatch' END AS reason FROM rep a JOIN rep b ON b.nation = a.nation + 1",
    "fx_convert": f"WITH {_REP}, r AS (SELECT *, CASE cur WHEN 'EUR' THEN 1.08 WHEN 'GBP' THEN 1.27 WHEN 'JPY' THEN 0.0067 WHEN 'CHF' THEN 1.12 END::DOUBLE AS rate FROM rep) SELECT nation, CASE WHEN value > 0 AND rate IS NOT NULL THEN round_even(value * rate, 4) END AS converted, CASE WHEN value <= 0 THEN 'invalid_amount' WHEN rate IS NULL THEN 'unknown_pair' END AS error_code FROM r",
    "last_close": "SELECT user_id, value AS close, event_id FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "snapshot_violations": "SELECT user_id, days FROM (SELECT user_id, max(day) OVER (PARTITION BY user_id % 10) - day AS days FROM (SELECT user_id, max(ts::DATE) AS day FROM events WHERE event_type <> 'error' GROUP BY 1)) WHERE days > 0",
    "fx_inverse": "SELECT p_partkey, round(p_retailprice::DECIMAL(38,18), 1)::DOUBLE AS price, round((1 / p_retailprice::DOUBLE)::DECIMAL(38,18), 6)::DOUBLE AS inverse FROM part",
}
