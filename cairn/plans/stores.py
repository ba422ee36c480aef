"""Queries of sources and sinks: each writes files in the shared folder and reads them back."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from cairn.operators import evaluation as E
from cairn.operators import guards as G
from cairn.operators import ranking as R
from cairn.operators import schemas
from cairn.plans import evals
from cairn.plans.ranks import TOP
from cairn.session import fresh_path, materialise
from cairn.sources import stores
from cairn.sources.contracts import answers, passages, questions, table

MEASURES = ("recall", "reciprocal_rank", "filter_correctness", "citation_correctness", "grounding", "abstention")
#: Two configurations of one retrieval: how many hits a case gets.
CONFIGURATIONS = {"bounded": TOP, "first-only": 1}


def configured_cases(spark, d):
    """Case metrics of the same cases under both configurations, from one ranking."""
    hits = R.ranked(R.bm25_scores(passages(spark, d), questions(spark, d), k=TOP), TOP).join(passages(spark, d).select("passage_id", "period"), "passage_id")
    hits, cases = materialise(hits, "hits"), materialise(answers(spark, d), "answers")
    both = [E.case_metrics(cases, hits.where(F.col("rank") <= k)).withColumn("run_id", F.lit(name)) for name, k in CONFIGURATIONS.items()]
    return materialise(both[0].unionByName(both[1]), "configured-cases")


def run_log(spark, d):
    """Logs two runs, then one of them again, and reads parameters, metrics and failure rows back."""
    root, cases = fresh_path(spark, "run-log"), configured_cases(spark, d)
    runs = spark.createDataFrame([(name, {"final_k": str(k), "dataset_version": "v1"}) for name, k in CONFIGURATIONS.items()], "run_id string, parameters map<string,string>")
    failures = cases.where("failure_stage <> 'none'").select("run_id", "case_id", "failure_stage", *MEASURES)
    stores.log_runs(root, runs, cases, failures, measures=list(MEASURES))
    again = F.col("run_id") == "first-only"
    stores.log_runs(root, runs.where(again), cases.where(again), failures.where(again), measures=list(MEASURES))
    p = stores.read_log(spark, root).select("run_id", F.explode("parameters").alias("name", "text"), F.lit("parameter").alias("kind"), F.lit(None).cast("double").alias("value"))
    m = stores.read_log(spark, root, "run_metrics").select("run_id", F.col("metric").alias("name"), F.lit(None).cast("string").alias("text"), F.lit("metric").alias("kind"), "value")
    f = stores.read_log(spark, root, "failure_rows").select("run_id", F.col("case_id").cast("string").alias("name"), F.col("failure_stage").alias("text"), F.lit("failure").alias("kind"), F.col("recall").alias("value"))
    return p.unionByName(m).unionByName(f)


_EXPECTED = {"provider": "other", "model": "embed-2", "chunking_strategy": "naive", "schema_version": "0", "dimension": "32", "rows": "1", "corpus_hash": "none", "ids_hash": "none"}


def dense_index_store(spark, d):
    """Stores the vectors with their identity, loads them by it, and lists what a load is refused for when a field is expected otherwise."""
    root, e = fresh_path(spark, "index"), table(spark, d, "embeddings")
    own = stores.index_identity(e, e, key="vec_id", vector="embedding", columns=["label"], provider="given", model="embed-1", chunking_strategy="document")
    stores.save_index(e, root, own, key="vec_id", vector="embedding")
    back = stores.load_index(spark, root, own, vector="embedding")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    loaded = back.agg(F.lit("loaded").alias("expecting"), F.lit("rows").alias("field"), F.count("*").cast("string").alias("stored"), F.round(F.max(F.abs(length - 1)), 6).cast("string").alias("expected"))
    refused = []
    for field, other in _EXPECTED.items():
        try:
            stores.load_index(spark, root, own | {field: other}, vector="embedding")
        except stores.Refused:
            refused += [(field, *found) for found in stores.index_mismatches(own, own | {field: other})]
    return loaded.unionByName(spark.createDataFrame(refused, "expecting string, field string, stored string, expected string"))


BUCKET = 4096


def file_integrity(spark, d):
    """A delivery of documents as files, held against the manifest of the one before: files changed, lost, or without a record."""
    docs = table(spark, d, "documents").select("source", F.floor(F.col("doc_id") / BUCKET).alias("bucket"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    first, second = fresh_path(spark, "delivery"), fresh_path(spark, "delivery")

    def write(rows, path):
        rows.repartition("source", "bucket").sortWithinPartitions("source", "bucket", "doc_id", "value").select("source", "bucket", "value").write.partitionBy("source", "bucket").text(path)

    write(docs, first)
    was = stores.file_facts(spark, first)
    manifest = was.where(~F.col("key").startswith("source=src4/")).withColumn("sha256", F.when(~F.col("key").startswith("source=src5/"), F.col("sha256")))
    source = F.col("source")
    write(docs.where("source <> 'src1'").withColumn("value", F.when(source == "src2", F.concat("value", F.lit("!"))).when(source == "src3", F.replace("value", F.lit("e"), F.lit("a"))).otherwise(F.col("value"))), second)
    return stores.verify_files(stores.file_facts(spark, second), manifest)


_SOURCE = "source_id string, company string, documents long, byte_size long"


def _manifest_rules(spark):
    return schemas.rules_of(
        spark, "manifest", ("$", "object", {"closed": True}), ("$.version", "integer", {"required": True, "minimum": 1}), ("$.sources", "array", {"required": True}), ("$.sources[]", "object", {"closed": True}),
        ("$.sources[].source_id", "string", {"required": True}), ("$.sources[].company", "string", {"required": True}), ("$.sources[].documents", "integer", {"required": True, "minimum": 1}), ("$.sources[].byte_size", "integer", {"required": True}),
    )


def manifest_load(spark, d):
    """Manifests of sources as JSON files, one a language, several of them broken: records of whole files, rejects of the others."""
    root = fresh_path(spark, "manifests")
    per = table(spark, d, "documents").where("lang is not null").groupBy("lang", "source").agg(F.count("*").alias("documents"), F.sum(F.octet_length("text")).alias("bytes"))
    fields = [F.col("source").alias("source_id"), F.when(~((F.col("lang") == "fr") & (F.col("source") == "src7")), F.upper("source")).alias("company"), F.col("documents").cast("string").alias("documents"), F.col("bytes").alias("byte_size"), F.when((F.col("lang") == "de") & (F.col("source") == "src2"), "x").alias("note")]
    text = F.to_json(F.struct(*fields))
    text = F.when(F.col("lang") == "es", text).otherwise(F.regexp_replace(text, '"documents":"([0-9]+)"', '"documents":$1'))
    whole = per.select("lang", "source", text.alias("t")).groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "t"))), lambda s: s["t"]), ",").alias("t"))
    whole.select("lang", F.concat(F.lit('{"version":1,"sources":['), "t", F.lit("]}")).alias("value")).write.partitionBy("lang").text(root)
    spark.createDataFrame([("none", '{"version":0}'), ("cut", '{"version":1,"sources":[')], "lang string, value string").write.partitionBy("lang").mode("append").text(root)
    records, rejects = stores.load_json(spark, root, _manifest_rules(spark), items="sources", record=_SOURCE)
    lang = F.regexp_extract("file", r"lang=([^/]*)/", 1)
    good = records.select(lang.alias("lang"), F.col("source_id").alias("place"), F.lit("loaded").alias("rule"), "documents")
    return good.unionByName(rejects.select(lang.alias("lang"), "place", "rule", F.lit(None).cast("long").alias("documents")))


def dataset_screen(spark, d):
    """Conversations as a dataset of JSON lines: keys, types, limits, roles, then names that are there twice."""
    root = fresh_path(spark, "dataset")
    turns = table(spark, d, "conversations").where("conv_id is not null")
    role = F.when(F.col("turn") > 5, "moderator").otherwise(F.col("role"))
    turn = F.struct(F.when((F.col("turn") == 3) & (F.length("text") % 5 == 0), F.lit(-1).cast("long")).otherwise(F.col("turn")).alias("turn"), role.alias("role"), F.when(F.length("text") % 7 != 0, F.md5("text")).alias("digest"))
    cases = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("at"), turn.alias("t")))), lambda s: s["t"]).alias("turns"))
    name = F.concat(F.when(F.col("conv_id") % 2 == 0, "C-").otherwise("c-"), F.floor(F.col("conv_id") / 2).cast("string"))
    cases.select(F.to_json(F.struct(F.array(F.struct(name.alias("case_id"), "turns")).alias("cases"))).alias("value")).write.text(root)
    rules = schemas.rules_of(
        spark, "dataset", ("$", "object", {"closed": True}), ("$.cases", "array", {"required": True}), ("$.cases[]", "object", {"closed": True}), ("$.cases[].case_id", "string", {"required": True}), ("$.cases[].turns", "array", {"required": True}),
        ("$.cases[].turns[]", "object", {"closed": True}), ("$.cases[].turns[].turn", "integer", {"required": True, "minimum": 0}), ("$.cases[].turns[].role", "string", {"required": True, "enum": ["user", "assistant"]}), ("$.cases[].turns[].digest", "string", {"required": True}),
    )
    records, rejects = stores.load_json(spark, root, rules, items="cases", record="case_id string, turns array<struct<turn:long,role:string,digest:string>>", whole_files=False)
    found = rejects.groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("file").alias("cases"))
    loaded = records.agg(F.lit("loaded").alias("rule"), F.coalesce(F.sum(F.size("turns")), F.lit(0)).cast("long").alias("n"), F.count("*").alias("cases"))
    twice = stores.repeated(records, "case_id").agg(F.lit("repeated").alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), F.count("*").alias("cases"))
    return found.unionByName(loaded).unionByName(twice)


def argument_audit(spark, d):
    """Arguments of logged calls against the schemas of their capabilities; some calls are logged with other keys, types or values."""
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    args = (
        F.when(kind == "error", F.concat(F.lit('{"k": '), k, F.lit(', "q": [1, 2]}'))).when(kind == "signup", F.lit('{"mode": "fast"}')).when(kind == "view", F.concat(F.lit('{"k": "'), k, F.lit('", "mode": "exact"}')))
        .when(kind == "purchase", F.concat(F.lit('{"k": '), k, F.lit(', "mode": "slow", "weights": [0.5, '), F.round("value", 2).cast("string"), F.lit("]}"))).otherwise(F.col("props"))
    )
    capability = F.when(F.col("event_id") % 2 == 0, "get_company_metric").otherwise("search_financial_documents")
    rows = table(spark, d, "events").select("event_id", capability.alias("schema"), F.try_parse_json(args).alias("value"))
    strict = schemas.rules_of(spark, "get_company_metric", ("$", "object", {"closed": True}), ("$.k", "integer", {"required": True, "minimum": 5, "maximum": 90}), ("$.mode", "string"))
    loose = schemas.rules_of(spark, "search_financial_documents", ("$", "object"), ("$.k", "integer", {"required": True}), ("$.mode", "string", {"enum": ["fast", "exact"]}), ("$.weights", "array"), ("$.weights[]", "number", {"maximum": 10}))
    return schemas.violations(rows, strict.unionByName(loose), "event_id")


def artifact_store(spark, d):
    """Documents as canonical JSON, an artifact for each language, with a manifest; then one language anew, which leaves the others."""
    root, docs = fresh_path(spark, "artifacts"), table(spark, d, "documents").where("lang is not null")
    rows = docs.select("lang", "doc_id", F.col("doc_id").alias("no"), F.struct(F.col("source").alias("source"), F.col("n_chars").alias("chars"), F.array(F.lit("b"), F.lit("a")).alias("kept")).alias("meta"), F.md5("text").alias("digest"))
    put = lambda r: stores.put_artifacts(r, root, artifact="lang", key="doc_id", columns=["no", "meta", "digest"])
    put(rows)
    put(rows.where("lang = 'fr'").withColumn("digest", F.concat(F.lit("v2:"), "digest")))
    return stores.get(spark, root, "artifacts_manifest").select("artifact", "rows", "bytes", "sha256")


def snapshot_store(spark, d):
    """Market snapshots of datasets (kinds of events), upserted by dataset: the last complete close of each symbol."""
    root, e = fresh_path(spark, "snapshots"), table(spark, d, "events")
    close = F.when(F.col("value") >= 2, F.col("value")).when(F.col("value") >= 1, -F.col("value"))
    rows = e.select(F.col("event_type").alias("dataset_id"), F.col("user_id").alias("symbol"), close.alias("close"), F.to_date("ts").alias("date"))

    def snapshot(kinds, until):
        own = rows.where(F.col("dataset_id").isin(kinds) & (F.col("date") < F.lit(until).cast("date")))
        made = [stores.market_snapshot(own.where(F.col("dataset_id") == k)).withColumn("dataset_id", F.lit(k)) for k in kinds]
        stores.upsert(root, "snapshot", made[0].unionByName(made[1]), by=["dataset_id"], key=["dataset_id", "symbol"])

    snapshot(["click", "view"], "2024-01-10")
    snapshot(["view", "purchase"], "2024-01-20")
    return stores.get(spark, root, "snapshot").select("dataset_id", "symbol", "close", "date", "state")


QUERIES = {f.__name__: f for f in (run_log, dense_index_store, file_integrity, manifest_load, dataset_screen, argument_audit, artifact_store, snapshot_store)}


def _cases_of(run: str, k: int) -> str:
    """The common table expressions of case metrics for ``k`` hits, under names of their own."""
    own = evals._CASES[len(evals._BM25) :].replace(f"b.rank <= {TOP}", f"b.rank <= {k}")
    return re.sub(r"\b(h|m0|m1|cm)\b(?= AS \(|\b)", lambda m: f"{m[1]}_{run}", own)


def _levels(inner: str, by: str = "") -> str:
    group = f"{by}, " if by else ""
    for _ in range(G.LEVELS):
        inner = f"SELECT {group}k // 4096 AS k, sha256(string_agg(h, '' ORDER BY k NULLS FIRST, h)) AS h FROM ({inner}) GROUP BY {group}k // 4096"
    return f"SELECT {group}sha256(string_agg(h, '' ORDER BY k NULLS FIRST, h)) AS hash FROM ({inner})" + (f" GROUP BY {by}" if by else "")


_LINE = """'{"digest":"' || CASE WHEN lang = 'fr' THEN 'v2:' ELSE '' END || md5(text) || '","meta":{"chars":' || n_chars || ',"kept":["b","a"],"source":"' || source || '"},"no":' || doc_id || '}'"""
_SNAPSHOT = """SELECT '{kind}' AS dataset_id, symbol, CASE WHEN low = hi THEN hi END AS close, date, CASE WHEN date IS NULL THEN 'incomplete' WHEN low <> hi THEN 'ambiguous' ELSE 'ok' END AS state FROM (
  SELECT symbol, max(date) FILTER (good) AS date, max(close) FILTER (good AND date = last) AS hi, min(close) FILTER (good AND date = last) AS low FROM (
    SELECT *, max(date) FILTER (good) OVER (PARTITION BY symbol) AS last FROM (SELECT user_id AS symbol, ts::DATE AS date, round(value, 4) AS close, value >= 2 AS good FROM events WHERE event_type = '{kind}' AND ts::DATE < DATE '{until}')) GROUP BY symbol)"""
ORACLES = {
    "run_log": evals._W + evals._BM25 + "".join(_cases_of(r.replace("-", "_"), k) for r, k in CONFIGURATIONS.items())
    + ", cm AS (" + " UNION ALL ".join(f"SELECT '{r}' AS run_id, * FROM cm_{r.replace('-', '_')}" for r in CONFIGURATIONS) + ")"
    + " SELECT run_id, name, text, 'parameter' AS kind, NULL::DOUBLE AS value FROM (VALUES " + ", ".join(f"('{r}', 'final_k', '{k}'), ('{r}', 'dataset_version', 'v1')" for r, k in CONFIGURATIONS.items()) + ") t(run_id, name, text)"
    + "".join(f" UNION ALL SELECT run_id, '{m}', NULL, 'metric', round(avg({m}), 6) FROM cm GROUP BY run_id" for m in MEASURES)
    + " UNION ALL SELECT run_id, case_id::VARCHAR, failure_stage, 'failure', recall FROM cm WHERE failure_stage <> 'none'",
    "dense_index_store": f"""WITH s AS (SELECT count(*)::VARCHAR AS rows, max(len(embedding))::VARCHAR AS dimension FROM embeddings),
      c AS ({_levels("SELECT vec_id AS k, sha256(to_json([vec_id::VARCHAR, label::VARCHAR])) AS h FROM embeddings")}), i AS ({_levels("SELECT vec_id AS k, sha256(to_json([vec_id::VARCHAR])) AS h FROM embeddings")})
      SELECT 'loaded' AS expecting, 'rows' AS field, rows AS stored, '0.0' AS expected FROM s
      UNION ALL SELECT f, f, CASE f WHEN 'provider' THEN 'given' WHEN 'model' THEN 'embed-1' WHEN 'chunking_strategy' THEN 'document' WHEN 'schema_version' THEN '1' WHEN 'dimension' THEN dimension WHEN 'rows' THEN rows WHEN 'corpus_hash' THEN c.hash ELSE i.hash END, e
      FROM s, c, i, (VALUES {", ".join(f"('{f}', '{e}')" for f, e in _EXPECTED.items())}) v(f, e)""",
    "file_integrity": f"""WITH d AS (SELECT source, doc_id // {BUCKET} AS bucket, doc_id, coalesce(text, '') AS t FROM documents),
      v2 AS (SELECT source, bucket, doc_id, CASE source WHEN 'src2' THEN t || '!' WHEN 'src3' THEN replace(t, 'e', 'a') ELSE t END AS t FROM d WHERE source <> 'src1'),
      a AS (SELECT source, bucket, string_agg(t || chr(10), '' ORDER BY doc_id, t) AS c FROM d GROUP BY 1, 2), b AS (SELECT source, bucket, string_agg(t || chr(10), '' ORDER BY doc_id, t) AS c FROM v2 GROUP BY 1, 2)
      SELECT 'source=' || source || '/bucket=' || bucket AS key, CASE WHEN source = 'src4' THEN 'no_record' WHEN b.c IS NULL THEN 'no_file' WHEN source = 'src5' THEN 'no_hash' WHEN octet_length(encode(a.c)) <> octet_length(encode(b.c)) THEN 'size' WHEN sha256(a.c) <> sha256(b.c) THEN 'sha256' ELSE 'ok' END AS status
      FROM a LEFT JOIN b USING (source, bucket)""",
    "manifest_load": """WITH per AS (SELECT lang, source, count(*) AS documents, sum(octet_length(encode(text)))::BIGINT AS bytes, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS no FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2),
      j AS (SELECT *, ('{"source_id":"' || source || '"' || CASE WHEN lang = 'fr' AND source = 'src7' THEN '' ELSE ',"company":"' || upper(source) || '"' END || ',"documents":' || CASE WHEN lang = 'es' THEN '"' || documents || '"' ELSE documents::VARCHAR END || ',"byte_size":' || bytes || CASE WHEN lang = 'de' AND source = 'src2' THEN ',"note":"x"' ELSE '' END || '}')::JSON AS o FROM per),
      bad AS (
        SELECT lang, '$.sources[' || no || ']' AS place, 'required:' || k AS rule FROM j, unnest(['source_id', 'company', 'documents', 'byte_size']) u(k) WHERE NOT list_contains(json_keys(o), k)
        UNION ALL SELECT lang, '$.sources[' || no || ']', 'additional:' || k FROM (SELECT lang, no, unnest(json_keys(o)) AS k FROM j) WHERE k NOT IN ('source_id', 'company', 'documents', 'byte_size')
        UNION ALL SELECT lang, '$.sources[' || no || '].documents', 'type' FROM j WHERE json_type(o, '$.documents') NOT IN ('UBIGINT', 'BIGINT')
        UNION ALL SELECT * FROM (VALUES ('none', '$', 'required:sources'), ('none', '$.version', 'minimum'), ('cut', '$', 'not_json')) t)
      SELECT lang, place, rule, NULL::BIGINT AS documents FROM bad UNION ALL SELECT lang, source, 'loaded', documents FROM per WHERE lang NOT IN (SELECT lang FROM bad)""",
    "dataset_screen": """WITH t AS (SELECT conv_id, CASE WHEN turn > 5 THEN 'moderator' ELSE role END AS role, CASE WHEN turn = 3 AND length(text) % 5 = 0 THEN -1 ELSE turn END AS turn, length(text) % 7 = 0 AS bare FROM conversations WHERE conv_id IS NOT NULL),
      bad AS (SELECT conv_id, 'enum' AS rule FROM t WHERE role NOT IN ('user', 'assistant') UNION ALL SELECT conv_id, 'minimum' FROM t WHERE turn < 0 UNION ALL SELECT conv_id, 'required:digest' FROM t WHERE bare),
      good AS (SELECT * FROM t WHERE conv_id NOT IN (SELECT conv_id FROM bad)), named AS (SELECT DISTINCT conv_id, conv_id // 2 AS name FROM good), twice AS (SELECT name, count(*) AS n FROM named GROUP BY 1 HAVING count(*) > 1)
      SELECT rule, count(*) AS n, count(DISTINCT conv_id) AS cases FROM bad GROUP BY rule UNION ALL SELECT 'loaded', count(*), count(DISTINCT conv_id) FROM good UNION ALL SELECT 'repeated', coalesce(sum(n), 0)::BIGINT, count(*) FROM twice""",
    "argument_audit": """WITH e AS (SELECT event_id, event_id % 2 = 0 AS strict, event_type, props->>'$.k' AS k, value, props FROM events),
      a AS (SELECT event_id, strict, (CASE event_type WHEN 'error' THEN '{"k": ' || k || ', "q": [1, 2]}' WHEN 'signup' THEN '{"mode": "fast"}' WHEN 'view' THEN '{"k": "' || k || '", "mode": "exact"}'
        WHEN 'purchase' THEN '{"k": ' || k || ', "mode": "slow", "weights": [0.5, ' || round(value, 2) || ']}' ELSE props END)::JSON AS o FROM e)
      SELECT event_id, '$' AS place, 'required:k' AS rule FROM a WHERE NOT json_exists(o, '$.k')
      UNION ALL SELECT event_id, '$', 'additional:' || x FROM (SELECT event_id, strict, unnest(json_keys(o)) AS x FROM a) WHERE strict AND x NOT IN ('k', 'mode')
      UNION ALL SELECT event_id, '$.k', 'type' FROM a WHERE json_type(o, '$.k') NOT IN ('UBIGINT', 'BIGINT')
      UNION ALL SELECT event_id, '$.k', 'minimum' FROM a WHERE strict AND json_type(o, '$.k') = 'UBIGINT' AND (o->>'$.k')::BIGINT < 5
      UNION ALL SELECT event_id, '$.k', 'maximum' FROM a WHERE strict AND json_type(o, '$.k') = 'UBIGINT' AND (o->>'$.k')::BIGINT > 90
      UNION ALL SELECT event_id, '$.mode', 'enum' FROM a WHERE NOT strict AND o->>'$.mode' NOT IN ('fast', 'exact')
      UNION ALL SELECT event_id, '$.weights[1]', 'maximum' FROM a WHERE NOT strict AND (o->>'$.weights[1]')::DOUBLE > 10""",
    "artifact_store": f"""WITH l AS (SELECT lang, doc_id, {_LINE} AS line FROM documents WHERE lang IS NOT NULL), h AS ({_levels("SELECT lang, doc_id AS k, sha256(to_json([line])) AS h FROM l", "lang")})
      SELECT lang AS artifact, rows, bytes, hash AS sha256 FROM (SELECT lang, count(*) AS rows, sum(octet_length(encode(line)))::BIGINT AS bytes FROM l GROUP BY 1) JOIN h USING (lang)""",
    "snapshot_store": " UNION ALL ".join(_SNAPSHOT.format(kind=k, until=u) for k, u in (("click", "2024-01-10"), ("view", "2024-01-20"), ("purchase", "2024-01-20"))),
}
