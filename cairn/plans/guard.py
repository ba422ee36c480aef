"""Queries of validation, hashing, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import guards as G
from cairn.session import broadcast_if_small, fresh_path
from cairn.sources.contracts import SQL, blocks, passages, table


def required_field_violations(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("source"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" "), F.col("lang"))).otherwise(F.col("lang")).alias("lang"))
    return G.check_required(rows, "doc_id", ["source", "lang"])


def secret_scan(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(G.scan(F.col("text"), {"secret": G.SECRET, "path": G.PERSONAL_PATH}), ",").alias("found")).where("found <> ''")


def path_scan(spark, d):
    p = table(spark, d, "pages")
    user = F.coalesce(F.expr("try_parse_url(url, 'USERINFO')"), F.lit(""))
    return p.select("page_id", (user != "").alias("userinfo"), F.col("html").rlike(G.PERSONAL_PATH).alias("path"))


def redact(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(G.redact(F.concat("text", F.lit(" api_key=abc sk-12345678 /home/me/x")))).alias("md5"))


def privacy_audit(spark, d):
    rows = table(spark, d, "documents").select(F.explode_outer(G.scan(F.col("text"), {"secret": G.SECRET, "path": G.PERSONAL_PATH})).alias("pattern"))
    return rows.groupBy(F.coalesce("pattern", F.lit("clean")).alias("pattern")).agg(F.count("*").alias("n"))


def vector_violations(spark, d):
    e = table(spark, d, "embeddings")
    v = F.when(F.col("vec_id") % 11 == 0, F.slice("embedding", 1, 3)).when(F.col("vec_id") % 13 == 0, F.transform("embedding", lambda x: F.lit(float("nan")))).otherwise(F.col("embedding"))
    return e.select("vec_id", G.vector_problems(v, 64).alias("problem")).where("problem is not null")


def range_violations(spark, d):
    e = table(spark, d, "events")
    rule = F.when(F.col("value") < 1, "below").when(F.col("value") > 100, "above")
    return e.select("event_id", rule.alias("rule")).where("rule is not null")


def asset_key_violations(spark, d):
    key = F.concat(F.element_at(F.array(F.lit("/abs/"), F.lit("a/../b/"), F.lit("C:/x/"), F.lit("ok/")), (F.col("doc_id") % 4 + 1).cast("int")), F.col("source"))
    return table(spark, d, "documents").select("doc_id", key.alias("key")).where(G.unsafe_key(F.col("key")))


def table_violations(spark, d):
    """Tables in documents whose rows differ in their number of cells."""
    rows = table(spark, d, "documents").select("doc_id", F.explode_outer(F.split("text", "\n")).alias("line")).where(F.contains("line", F.lit(" | ")))
    widths = rows.select("doc_id", F.size(F.split("line", r" \| ")).alias("w")).groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("w").cast("long").alias("narrow"), F.max("w").cast("long").alias("wide"))
    return widths.where("narrow <> wide")


def trace_ids(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.substring(F.sha2(F.concat_ws("|", "role", "text"), 256), 1, 12).alias("trace_id"))


def corpus_hash(spark, d):
    return G.table_hash(table(spark, d, "documents"), "doc_id", ["doc_id", "text"])


def content_integrity(spark, d):
    """Bytes and hashes of documents against a manifest that lacks some and is wrong in others."""
    docs = table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("sha"))
    manifest = docs.where("doc_id % 10 <> 0").select("doc_id", F.col("bytes").alias("want"), F.when(F.col("doc_id") % 9 == 0, F.lit("0")).otherwise(F.col("sha")).alias("want_sha"))
    state = F.when(F.col("want").isNull(), "no_record").when((F.col("bytes") != F.col("want")) | (F.col("sha") != F.col("want_sha")), "changed").otherwise("ok")
    return docs.join(manifest, "doc_id", "left").select("doc_id", state.alias("status"))


def manifest_sources(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.octet_length("text")).alias("bytes"), F.countDistinct("lang").alias("languages"))


def manifest_upsert(spark, d):
    """A new version of some keys replaces the old, new keys are added."""
    old = table(spark, d, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("value"), F.lit("old").alias("version"))
    new = table(spark, d, "customer").where("c_custkey % 3 = 0").select((F.col("c_custkey") + F.when(F.col("c_custkey") % 2 == 0, 10_000_000).otherwise(0)).alias("c_custkey"), F.lit(0.0).alias("value"), F.lit("new").alias("version"))
    return old.join(new, "c_custkey", "left_anti").unionByName(new)


def artifact_manifest(spark, d):
    """Writes the passages by language and reads the files back: rows and a sum of content hashes, in any order, of each part."""
    path = fresh_path(spark, "artifact")
    passages(spark, d).withColumn("no", F.substring("passage_id", 5, 20).cast("long")).write.partitionBy("period").parquet(path)
    back = spark.read.parquet(path)
    return back.groupBy("period").agg(F.count("*").alias("rows"), F.sum(F.conv(F.substring(F.sha2(F.concat_ws("|", "passage_id", "text"), 256), 1, 10), 16, 10).cast("long")).alias("checksum"))


def index_version_check(spark, d):
    """Identity of a stored vector index against what the caller expects, field by field."""
    e = table(spark, d, "embeddings")
    stored = e.agg(F.count("*").cast("string").alias("rows"), F.max(F.size("embedding")).cast("string").alias("dimension"), F.max("vec_id").cast("string").alias("last_id"))
    fields = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("stored")) for c in ("rows", "dimension", "last_id"))))
    want = F.when(F.col("field") == "dimension", "64").when(F.col("field") == "last_id", "-1").otherwise(F.col("stored"))
    return stored.select(fields.alias("f")).select("f.field", "f.stored").withColumn("matches", F.col("stored") == want)


def golden_set_violations(spark, d):
    ids = table(spark, d, "benchmark").select((F.col("item_id") % 30).alias("case_id"), F.concat(F.lit("DOC-"), F.lpad((F.col("item_id") * 40).cast("string"), 8, "0")).alias("evidence"))
    twice = ids.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("case_id").cast("string").alias("key"), F.lit("duplicate_case").alias("rule"))
    unknown = ids.join(passages(spark, d).select(F.col("passage_id").alias("evidence")), "evidence", "left_anti").select(F.col("evidence").alias("key"), F.lit("unknown_evidence").alias("rule"))
    return twice.unionByName(unknown)


def agent_dataset_violations(spark, d):
    """Keys of logged arguments that the schema doesn't allow."""
    keys = table(spark, d, "events").select("event_id", F.explode_outer(F.json_object_keys("props")).alias("key"))
    return keys.where("key is not null and key <> 'k'").select("event_id", "key").unionByName(table(spark, d, "events").where(F.get_json_object("props", "$.k").cast("int") > 95).select("event_id", F.lit("k_range").alias("key")))


def company_alias(spark, d):
    alias = {f"src{i}": f"Source {i}" for i in range(0, 16)}
    known = F.create_map(*(F.lit(x) for pair in alias.items() for x in pair))
    name = F.try_element_at(known, F.lower(F.trim("source")))
    return table(spark, d, "documents").select("doc_id", name.alias("company"), F.when(name.isNull(), "unsupported_company").alias("error_code"))


def duplicate_ids(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    several = rows.groupBy("sha").agg(F.count("*").alias("copies")).where("copies > 1")  # partial counts come before the shuffle
    return rows.join(broadcast_if_small(several, 200_000), "sha").select("doc_id", "sha", "copies")


def public_text_audit(spark, d):
    """Texts of three tables that may not be shown as they are: how many were looked at, and how many break each rule."""
    out = None
    for name, columns in (("documents", ["text", "source"]), ("pages", ["url"]), ("conversations", ["text", "role"])):
        rows = G.audit_values(table(spark, d, name).withColumn("url", F.when(F.col("page_id") % 9 == 0, F.replace("url", F.lit("://"), F.lit("://me:pw@"))).otherwise(F.col("url"))) if name == "pages" else table(spark, d, name), columns)
        rows = rows.select(F.lit(name).alias("table"), "column", "values", "rule", "hits")
        out = rows if out is None else out.unionByName(rows)
    return out


def golden_set_audit(spark, d):
    """Questions as a golden set: some share a name but for its case, some expect passages that there are not, or abstain in spite of some."""
    b = table(spark, d, "benchmark")
    name = F.concat(F.when(F.col("item_id") % 2 == 0, "Case-").otherwise(" case-"), F.floor(F.col("item_id") / 3).cast("string"))
    evidence = F.array(F.format_string("DOC-%08d", F.col("item_id") * 17), F.format_string("DOC-%08d", F.col("item_id")))
    cases = b.select(F.when(F.length("text") % 19 > 0, name).otherwise(" ").alias("case_id"), F.when(F.length("text") % 11 > 0, F.col("text")).alias("question"), evidence.alias("expected"), (F.length("text") > 120).alias("requires_abstention"))
    return G.golden_violations(spark.createDataFrame([(" ",)], "dataset_version string"), cases, passages(spark, d))


def element_violations(spark, d):
    """Lines of documents as elements: a line with bars is a table of one row, as many columns as the first such line of its document has."""
    b = blocks(spark, d)
    cells = F.split("text", r" \| ")
    width = b.where("block_type = 'table'").groupBy("source_id").agg(F.min_by(F.size(cells), "ordinal").alias("column_count"))
    box = F.struct(F.lit(0).alias("x0"), (F.col("ordinal") % 7).alias("y0"), F.length("text").alias("x1"), F.lit(6).alias("y1"))
    e = b.join(width, "source_id", "left").select(
        F.concat_ws(":", F.col("source_id").cast("string"), F.col("ordinal").cast("string")).alias("element_id"), F.when(F.col("ordinal") % 13 == 4, "table").otherwise(F.col("block_type")).alias("element_type"), box.alias("bbox"),
        F.when(F.contains("text", F.lit(" | ")), F.array(cells)).alias("rows"), F.when(F.col("ordinal") % 5 == 0, 2).otherwise(1).alias("row_count"), "column_count",
    )
    return G.element_violations(e)


def fusion_audit(spark, d):
    """Two channels of hits of conversations: turns of equal number are told twice, and a turn's text may differ between channels."""
    c = table(spark, d, "conversations")
    hit = lambda text: c.select(F.col("conv_id").alias("query_id"), (F.col("conv_id") * 100 + F.floor(F.col("turn") / 3)).alias("passage_id"), F.col("turn").alias("rank"), text.alias("content"))
    channels = {"first": hit(F.lit("x")), "second": hit(F.when(F.col("turn") > 4, "y").otherwise("x")), "none": hit(F.lit("x")).where(F.lit(False))}
    return G.fusion_violations(channels, 0, {"first": 1.0, "second": -1.0, "third": 1.0})


QUERIES = {f.__name__: f for f in (required_field_violations, secret_scan, path_scan, redact, privacy_audit, vector_violations, range_violations, asset_key_violations, table_violations, trace_ids, corpus_hash, content_integrity, manifest_sources, manifest_upsert, artifact_manifest, index_version_check, golden_set_violations, agent_dataset_violations, company_alias, duplicate_ids, public_text_audit, golden_set_audit, element_violations, fusion_audit)}
def _quoted(text: str) -> str:
    return text.replace("'", "''")


_AUDITED = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {e} AS t FROM {t}" for t, c, e in (("documents", "text", "text"), ("documents", "source", "source"), ("pages", "url", "CASE WHEN page_id % 9 = 0 THEN replace(url, '://', '://me:pw@') ELSE url END"), ("conversations", "text", "text"), ("conversations", "role", "role")))
_RULES = " UNION ALL ".join(["SELECT *, 'blank' AS rule, t = '' AS hit FROM a", *(f"SELECT *, '{name}', t <> '' AND regexp_matches(t, '{_quoted(p)}') FROM a" for name, p in G.UNSAFE.items())])
_LEVEL = "SELECT k // 4096 AS k, sha256(string_agg(h, '' ORDER BY k NULLS FIRST, h)) AS h FROM ({}) GROUP BY k // 4096"
_HASHES = "SELECT doc_id AS k, sha256(to_json([doc_id::VARCHAR, text])) AS h FROM documents"
for _ in range(G.LEVELS):
    _HASHES = _LEVEL.format(_HASHES)
ORACLES = {
    "corpus_hash": f"SELECT sha256(string_agg(h, '' ORDER BY k NULLS FIRST, h)) AS hash FROM ({_HASHES})",
    "artifact_manifest": "SELECT lang AS period, count(*) AS rows, sum(('0x' || substr(sha256('DOC-' || lpad(doc_id::VARCHAR, 8, '0') || '|' || text), 1, 10))::BIGINT)::BIGINT AS checksum FROM documents GROUP BY 1",
    "required_field_violations": """SELECT doc_id AS key, 'source' AS field, 'missing' AS problem FROM documents WHERE doc_id % 7 = 0 OR source IS NULL OR trim(source) = ''
      UNION ALL SELECT doc_id, 'lang', CASE WHEN lang IS NULL OR trim(lang) = '' THEN 'missing' ELSE 'untrimmed' END FROM documents WHERE lang IS NULL OR doc_id % 5 = 0""",
    "secret_scan": f"SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '{G.SECRET}') THEN 'secret' END, CASE WHEN regexp_matches(text, '{G.PERSONAL_PATH}') THEN 'path' END) AS found FROM documents WHERE regexp_matches(text, '{G.SECRET}') OR regexp_matches(text, '{G.PERSONAL_PATH}')",
    "path_scan": f"SELECT page_id, regexp_matches(url, '^[a-z]+://[^/]*@') AS userinfo, regexp_matches(html, '{G.PERSONAL_PATH}') AS path FROM pages",
    "redact": "SELECT conv_id, turn, md5(" + f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || ' api_key=abc sk-12345678 /home/me/x', '{_quoted(G.ASSIGNMENT)}', '[credential]', 'g'), '{_quoted(G.HEADER)}', '[header]', 'g'), '{G.TOKEN}', '[token]', 'g'), '{G.HOME}', '[path]', 'g')" + ") AS md5 FROM conversations",
    "privacy_audit": f"""SELECT pattern, count(*) AS n FROM (SELECT unnest(CASE WHEN len(p) = 0 THEN ['clean'] ELSE p END) AS pattern FROM (SELECT list_filter([CASE WHEN regexp_matches(text, '{G.SECRET}') THEN 'secret' END, CASE WHEN regexp_matches(text, '{G.PERSONAL_PATH}') THEN 'path' END], lambda x: x IS NOT NULL) AS p FROM documents)) GROUP BY 1""",
    "vector_violations": "SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 'dimension' ELSE 'not_finite' END AS problem FROM embeddings WHERE vec_id % 11 = 0 OR vec_id % 13 = 0",
    "range_violations": "SELECT event_id, CASE WHEN value < 1 THEN 'below' ELSE 'above' END AS rule FROM events WHERE value < 1 OR value > 100",
    "asset_key_violations": "SELECT * FROM (SELECT doc_id, (['/abs/', 'a/../b/', 'C:/x/', 'ok/'])[(doc_id % 4 + 1)::INT] || source AS key FROM documents) WHERE doc_id % 4 < 3",
    "table_violations": """SELECT doc_id, count(*) AS rows, min(w) AS narrow, max(w) AS wide FROM (SELECT doc_id, len(string_split(line, ' | ')) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(line, ' | ')) GROUP BY 1 HAVING min(w) <> max(w)""",
    "trace_ids": "SELECT conv_id, turn, substr(sha256(role || '|' || text), 1, 12) AS trace_id FROM conversations",
    "content_integrity": "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'no_record' WHEN doc_id % 9 = 0 THEN 'changed' ELSE 'ok' END AS status FROM documents",
    "manifest_sources": "SELECT source, count(*) AS documents, sum(octet_length(encode(text)))::BIGINT AS bytes, count(DISTINCT lang) AS languages FROM documents GROUP BY 1",
    "manifest_upsert": """WITH n AS (SELECT c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 10000000 ELSE 0 END AS c_custkey, 0.0::DOUBLE AS value, 'new' AS version FROM customer WHERE c_custkey % 3 = 0)
      SELECT c_custkey, round(c_acctbal, 2) AS value, 'old' AS version FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT * FROM n""",
    "index_version_check": """WITH s AS (SELECT count(*)::VARCHAR AS rows, max(len(embedding))::VARCHAR AS dimension, max(vec_id)::VARCHAR AS last_id FROM embeddings)
      SELECT 'rows' AS field, rows AS stored, true AS matches FROM s UNION ALL SELECT 'dimension', dimension, dimension = '64' FROM s UNION ALL SELECT 'last_id', last_id, false FROM s""",
    "golden_set_violations": f"""WITH {SQL}, i AS (SELECT item_id % 30 AS case_id, 'DOC-' || lpad((item_id * 40)::VARCHAR, 8, '0') AS evidence FROM benchmark)
      SELECT case_id::VARCHAR AS key, 'duplicate_case' AS rule FROM i GROUP BY case_id HAVING count(*) > 1 UNION ALL SELECT evidence, 'unknown_evidence' FROM i WHERE evidence NOT IN (SELECT passage_id FROM passages)""",
    "agent_dataset_violations": "SELECT event_id, 'k_range' AS key FROM events WHERE (props::JSON->>'k')::INT > 95",
    "company_alias": "SELECT doc_id, CASE WHEN ltrim(source, 'src')::INT < 16 THEN 'Source ' || ltrim(source, 'src') END AS company, CASE WHEN ltrim(source, 'src')::INT >= 16 THEN 'unsupported_company' END AS error_code FROM documents",
    "duplicate_ids": "SELECT doc_id, sha256(text) AS sha, count(*) OVER (PARTITION BY text) AS copies FROM documents QUALIFY copies > 1",
    "public_text_audit": f"""WITH a AS (SELECT "table", "column", trim(t, ' ') AS t FROM ({_AUDITED}) WHERE t IS NOT NULL) SELECT "table", "column", count(*) AS "values", rule, count_if(hit) AS hits FROM ({_RULES}) GROUP BY ALL""",
    "golden_set_audit": f"""WITH {SQL}, c AS (SELECT CASE WHEN length(text) % 19 > 0 THEN CASE WHEN item_id % 2 = 0 THEN 'Case-' ELSE ' case-' END || item_id // 3 ELSE ' ' END AS id, length(text) % 11 = 0 AS bare, length(text) > 120 AS abstains, item_id FROM benchmark),
      e AS (SELECT DISTINCT unnest(['DOC-' || lpad((item_id * 17)::VARCHAR, 8, '0'), 'DOC-' || lpad(item_id::VARCHAR, 8, '0')]) AS p FROM c)
      SELECT 'dataset' AS key, 'version' AS rule UNION ALL SELECT id, 'case_id' FROM c WHERE trim(id) = '' UNION ALL SELECT id, 'question' FROM c WHERE bare UNION ALL SELECT id, 'abstention' FROM c WHERE abstains
      UNION ALL SELECT lower(trim(id)), 'duplicate_case' FROM c GROUP BY lower(trim(id)) HAVING count(*) > 1 UNION ALL SELECT p, 'unknown_evidence' FROM e WHERE p NOT IN (SELECT passage_id FROM passages)""",
    "element_violations": f"""WITH {SQL}, w AS (SELECT source_id, arg_min(len(string_split(text, ' | ')), ordinal) AS width FROM blocks WHERE block_type = 'table' GROUP BY 1),
      e AS (SELECT b.source_id || ':' || ordinal AS element_id, ordinal, CASE WHEN ordinal % 13 = 4 THEN 'table' ELSE block_type END AS kind, contains(text, ' | ') AS has, len(string_split(text, ' | ')) AS n, width, length(text) AS x1 FROM blocks b LEFT JOIN w USING (source_id))
      SELECT element_id, 'area' AS rule FROM e WHERE NOT (x1 > 0 AND 6 > ordinal % 7) UNION ALL SELECT element_id, 'table' FROM e WHERE (kind = 'table') <> has
      UNION ALL SELECT element_id, 'row_count' FROM e WHERE has AND ordinal % 5 = 0 UNION ALL SELECT element_id, 'column_count' FROM e WHERE has AND n IS DISTINCT FROM width""",
    "fusion_audit": """WITH h AS (SELECT conv_id AS q, conv_id * 100 + turn // 3 AS p, turn FROM conversations), t AS (SELECT q, p FROM h GROUP BY 1, 2 HAVING count(*) > 1)
      SELECT 'k' AS rule, NULL AS channel, '0' AS key UNION ALL SELECT 'weight', 'second', '-1.0' UNION ALL SELECT 'unknown_weight', 'third', NULL UNION ALL SELECT 'empty', 'none', NULL
      UNION ALL SELECT 'duplicate', c, q || ':' || p FROM t, (VALUES ('first'), ('second')) v(c) UNION ALL SELECT 'conflict', NULL, p::VARCHAR FROM h GROUP BY p HAVING bool_or(turn > 4)""",
}
