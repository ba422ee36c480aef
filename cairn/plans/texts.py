"""Queries of the scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions import vectors as V
from cairn.functions.binding import let
from cairn.sources.contracts import SQL, answers, observations, questions, table

FOLD = "replace(lower({}), 'ß', 'ss')"
SPACE = T.SPACE
STOP = "[" + ", ".join(f"'{w}'" for w in T.QUERY_STOP_WORDS) + "]"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def normalize_text(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(T.normalize(F.col("text")), 256).alias("sha"), F.length(T.normalize(F.col("text"))).cast("long").alias("n"))


def _tokens(make):
    def query(spark, d):
        return _docs(spark, d).select("doc_id", make(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))

    return query


def token_coverage(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("question"))
    pair = _docs(spark, d).join(F.broadcast(q), "doc_id") if q.count() < 100_000 else _docs(spark, d).join(q, "doc_id")
    own, held = T.query_words(F.col("question")), T.query_words(F.col("text"))
    return pair.select("doc_id", F.round(T.coverage(own, held), 6).alias("coverage"), F.round(T.coverage_counted(F.split("question", " "), held), 6).alias("counted"))


def fact_present(spark, d):
    return answers(spark, d).select("case_id", T.fact_present(F.substring("question", 1, 30), F.col("answer")).alias("present"), T.fact_present(F.lit(" !"), F.col("answer")).alias("blank"))


def citations(spark, d):
    return answers(spark, d).select("case_id", F.array_join(T.citations(F.col("answer")), ",").alias("cited"))


def token_estimate(spark, d):
    return _docs(spark, d).select("doc_id", T.token_estimate(F.col("text")).cast("long").alias("tokens"), F.floor(F.length("text") / 4).cast("long").alias("tokens_floor"))


def common_prefix(spark, d):
    from pyspark.sql import Window

    from cairn.session import materialise

    # ranges of item ids; the first row of a range follows the last one of the range before it
    b = materialise(table(spark, d, "benchmark").select("item_id", "text").repartitionByRange("item_id").withColumn("part", F.spark_partition_id()), "item-ranges")
    lasts = b.groupBy("part").agg(F.max_by("text", "item_id").alias("last"))
    parts = lasts.select("part")
    follows = parts.join(parts.select(F.col("part").alias("earlier")), F.col("earlier") < F.col("part")).groupBy("part").agg(F.max("earlier").alias("earlier"))
    carried = follows.join(lasts.withColumnRenamed("part", "earlier"), "earlier").select("part", "last")
    own = Window.partitionBy("part").orderBy("item_id")
    rows = b.select("item_id", "text", "part", F.lag("text").over(own).alias("own"), (F.row_number().over(own) == 1).alias("first")).join(carried, "part", "left")
    before = F.when(F.col("first"), F.col("last")).otherwise(F.col("own"))
    return rows.select("item_id", "text", before.alias("before")).where("before is not null").select("item_id", T.common_prefix(F.col("text"), F.col("before")).cast("long").alias("shared"))


def vector_normalize(spark, d):
    v = V.normalize(F.transform("embedding", lambda x: x.cast("double") * 3.0))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.get(v, F.lit(0)), 6).alias("first"), F.round(let(v, lambda u: V.cosine(u, u)), 6).alias("self"))


def concept_vectors(spark, d):
    words = (("the",), ("und", "der"), ("les",), ("tion", "ing"))
    v = V.normalize(V.concept_flags(F.col("text"), words))
    return _docs(spark, d).select("doc_id", *(F.round(F.get(v, F.lit(k)), 6).alias(f"c{k}") for k in range(4)))


def compact_labels(spark, d):
    from pyspark.sql import Window

    ids = table(spark, d, "documents").select(F.format_string("DOC-%s-PART-%04d", "source", F.col("doc_id") % 700).alias("short_id"), "doc_id", "lang", "source")
    ids = ids.withColumn("passage_id", F.concat("short_id", F.lit("-"), F.lpad((F.col("doc_id") % 97).cast("string"), 3, "0")))
    parts = F.split("passage_id", "-")
    short = F.when((F.length("passage_id") <= 20) | (F.size(parts) < 2), F.col("passage_id")).otherwise(F.concat(F.get(parts, F.lit(0)), F.lit("…"), F.element_at(parts, -1)))
    label = lambda x: F.concat_ws(" · ", "source", "lang", x)
    ids = ids.withColumn("label", label(short))
    clash = F.count("*").over(Window.partitionBy("label")) > 1
    return ids.select("doc_id", F.when(clash, label(F.col("passage_id"))).otherwise(F.col("label")).alias("label"))


def parse_displayed_number(spark, d):
    cell = F.when(F.col("o_orderkey") % 3 == 0, F.format_number("o_totalprice", 0)).when(F.col("o_orderkey") % 3 == 1, F.concat_ws(" ", F.format_number("o_totalprice", 0), F.col("o_custkey"))).otherwise("n/a")
    return table(spark, d, "orders").select("o_orderkey", T.displayed_number(cell).alias("shown"))


def call_signature(spark, d):
    return observations(spark, d).select("attempt_id", T.call_signature(F.col("capability"), F.col("arguments")).alias("signature"))


def token_usage(spark, d):
    o = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 10, F.col("l_quantity").cast("long")).alias("i"), F.col("l_linenumber").cast("long").alias("o"))
    o = o.withColumn("t", F.when(F.col("l_orderkey") % 2 == 0, F.col("i") + F.col("o")).otherwise(F.col("i")))
    have = F.col("i").isNotNull() & F.col("o").isNotNull() & F.col("t").isNotNull()
    return o.groupBy(F.when(~have, "missing").when(F.col("i") + F.col("o") == F.col("t"), "valid").otherwise("mismatch").alias("usage")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(have, F.col("t"))), F.lit(0)).alias("total"))


def judge_scores(spark, d):
    words = F.array(*(F.lit(x) for x in (" Yes ", "FAIL", "0.25", "1.5", "maybe", "passed", "nan")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.get(words, ((F.col("conv_id") + F.col("turn")) % 7).cast("int")).alias("label")).select("conv_id", "turn", T.judge_score(F.col("label")).alias("score"))


def excerpts(spark, d):
    return _docs(spark, d).select("doc_id", T.excerpt(F.col("text"), 220).alias("excerpt"))


def context_route(spark, d):
    t = T.token_estimate(F.col("text"))
    fits = t <= 1000 - 200
    return _docs(spark, d).select("doc_id", F.when(fits, "cag").otherwise("rag").alias("route"), F.format_string("%d of %d tokens", t, F.lit(800).cast("long")).alias("reason"))


def question_intent(spark, d):
    text = F.concat(F.lit(" "), T.fold(F.col("text")), F.lit(" "))
    has = lambda *words: F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(text, w))
    intent = F.when(has(" buy ", " sell ", "recommend", "price target", "target price", "forecast", "predict"), None).when(has("revenue growth", "revenue evidence", "the "), "revenue_growth")
    intent = intent.when(has("operating-growth", "operating growth", "growth evidence", " und "), "operating_growth").when(has("valuation", "p/e", "price-to-earnings", "multiple", " les "), "valuation")
    return table(spark, d, "conversations").select("conv_id", "turn", intent.alias("intent"))


QUERIES = {
    "normalize_text": normalize_text,
    "bm25_tokens": _tokens(T.bm25_tokens),
    "tfidf_tokens": _tokens(T.tfidf_tokens),
    "lexical_tokens": _tokens(T.lexical_tokens),
    "numeric_tokens": _tokens(T.numeric_tokens),
    "query_words": _tokens(T.query_words),
    "token_coverage": token_coverage,
    "fact_present": fact_present,
    "citations": citations,
    "token_estimate": token_estimate,
    "common_prefix": common_prefix,
    "vector_normalize": vector_normalize,
    "concept_vectors": concept_vectors,
    "compact_labels": compact_labels,
    "parse_displayed_number": parse_displayed_number,
    "call_signature": call_signature,
    "token_usage": token_usage,
    "judge_scores": judge_scores,
    "excerpts": excerpts,
    "context_route": context_route,
    "question_intent": question_intent,
}


def _distinct(x: str) -> str:
    """Distinct entries in order of first appearance."""
    return f"list_filter({x}, lambda w, i: list_position({x}, w) = i)"


def _token_sql(expression: str) -> str:
    return f"SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {expression} AS t FROM (SELECT doc_id, {FOLD.format('text')} AS f, text FROM documents))"


def _hits(words: tuple[str, ...], text: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_QW = f"list_filter(regexp_extract_all(f, '{T.QUERY_WORD}'), lambda w: NOT list_contains({STOP}, w))"
ORACLES = {
    "normalize_text": f"SELECT doc_id, sha256(n) AS sha, length(n)::BIGINT AS n FROM (SELECT doc_id, trim(regexp_replace(text, '{SPACE}+', ' ', 'g')) AS n FROM documents)",
    "bm25_tokens": _token_sql(f"regexp_extract_all(f, '{T.BM25_TOKEN}')"),
    "tfidf_tokens": _token_sql(f"list_filter(regexp_extract_all(lower(text), '[\\pL\\pN_]{{2,}}'), lambda w: NOT list_contains({STOP}, w))"),
    "lexical_tokens": _token_sql("(SELECT list(w ORDER BY i) FROM (SELECT w, min(i) AS i FROM (SELECT unnest(regexp_extract_all(f, '[a-z0-9]+')) AS w, generate_subscripts(regexp_extract_all(f, '[a-z0-9]+'), 1) AS i) GROUP BY w))").replace("len(t)", "coalesce(len(t), 0)").replace("array_to_string(t, ' ')", "coalesce(array_to_string(t, ' '), '')"),
    "numeric_tokens": _token_sql(
        "(SELECT list(w ORDER BY i) FROM (SELECT w, min(i) AS i FROM (SELECT replace(lower(unnest(x)), ' ', '') AS w, generate_subscripts(x, 1) AS i FROM (SELECT regexp_extract_all(regexp_replace(text, '[\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{24F}]', '_', 'g'), "
        "'(?i)(?:^|[^\\pL\\pN_.])((?:[$€£]\\s*|(?:usd|eur|gbp)\\s+)?(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\\.[0-9]+)?|[0-9]+(?:[.,][0-9]+)?)(?:%\\B|(?:bn|m|b|x)?\\b))', 1) AS x)) GROUP BY w))"
    ).replace("len(t)", "coalesce(len(t), 0)").replace("array_to_string(t, ' ')", "coalesce(array_to_string(t, ' '), '')"),
    "query_words": _token_sql(f"(SELECT list(w ORDER BY i) FROM (SELECT w, min(i) AS i FROM (SELECT unnest({_QW}) AS w, generate_subscripts({_QW}, 1) AS i) GROUP BY w))").replace("len(t)", "coalesce(len(t), 0)").replace("array_to_string(t, ' ')", "coalesce(array_to_string(t, ' '), '')"),
    "token_coverage": f"""
      WITH x AS (SELECT d.doc_id, {FOLD.format('b.text')} AS q, {FOLD.format('d.text')} AS h, string_split(b.text, ' ') AS raw FROM documents d JOIN benchmark b ON b.item_id = d.doc_id),
      s AS (SELECT doc_id, raw, list_distinct(list_filter(regexp_extract_all(q, '{T.QUERY_WORD}'), lambda w: NOT list_contains({STOP}, w))) AS a, list_distinct(list_filter(regexp_extract_all(h, '{T.QUERY_WORD}'), lambda w: NOT list_contains({STOP}, w))) AS b FROM x)
      SELECT doc_id, CASE WHEN len(a) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / len(a), 6) END AS coverage, round(len(list_filter(raw, lambda r: list_contains(b, {FOLD.format('r')}))) / len(raw), 6) AS counted FROM s""",
    "fact_present": f"""WITH {SQL} SELECT case_id, p <> '' AND contains(' ' || a || ' ', ' ' || p || ' ') AS present, false AS blank FROM (
      SELECT case_id, array_to_string(regexp_extract_all({FOLD.format("substr(question, 1, 30)")}, '[a-z0-9]+'), ' ') AS p, array_to_string(regexp_extract_all({FOLD.format('answer')}, '[a-z0-9]+'), ' ') AS a FROM cases)""",
    "citations": f"WITH {SQL} SELECT case_id, array_to_string({_distinct('c')}, ',') AS cited FROM (SELECT case_id, regexp_extract_all(answer, '\\[([A-Z0-9][A-Z0-9-]{{2,}})\\]', 1) AS c FROM cases)",
    "token_estimate": "SELECT doc_id, ceil(length(text) / 4)::BIGINT AS tokens, (length(text) // 4)::BIGINT AS tokens_floor FROM documents",
    "common_prefix": """SELECT item_id, len(list_filter(range(1, least(length(text), length(before)) + 1), lambda i: left(text, i::INT) = left(before, i::INT)))::BIGINT AS shared
      FROM (SELECT item_id, text, lag(text) OVER (ORDER BY item_id) AS before FROM benchmark) WHERE before IS NOT NULL""",
    "vector_normalize": "SELECT vec_id, round(embedding[1]::DOUBLE / n, 6) AS first, 1.0::DOUBLE AS self FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)",
    "concept_vectors": f"""SELECT doc_id, {', '.join(f'CASE WHEN c0+c1+c2+c3 = 0 THEN 0.0 ELSE round(c{k} / sqrt(c0+c1+c2+c3), 6) END AS c{k}' for k in range(4))} FROM (
      SELECT doc_id, {', '.join(f'{_hits(w, "t")}::INT::DOUBLE AS c{k}' for k, w in enumerate((("the",), ("und", "der"), ("les",), ("tion", "ing"))))} FROM (SELECT doc_id, replace(lower(text), '-', ' ') AS t FROM documents))""",
    "compact_labels": """WITH i AS (SELECT doc_id, lang, source, 'DOC-' || source || '-PART-' || lpad((doc_id % 700)::VARCHAR, 4, '0') || '-' || lpad((doc_id % 97)::VARCHAR, 3, '0') AS p FROM documents),
      l AS (SELECT *, concat_ws(' · ', source, lang, CASE WHEN length(p) <= 20 THEN p ELSE 'DOC…' || string_split(p, '-')[-1] END) AS label FROM i)
      SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY label) > 1 THEN concat_ws(' · ', source, lang, p) ELSE label END AS label FROM l""",
    "parse_displayed_number": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN round_even(o_totalprice, 0)::BIGINT END AS shown FROM orders",
    "call_signature": f"WITH {SQL} SELECT attempt_id, capability || ':' || replace(arguments, ' ', '') AS signature FROM observations",
    "token_usage": """SELECT CASE WHEN i IS NULL OR o IS NULL THEN 'missing' WHEN k % 2 = 0 OR o = 0 THEN 'valid' ELSE 'mismatch' END AS usage, count(*) AS n, coalesce(sum(CASE WHEN i IS NOT NULL THEN CASE WHEN k % 2 = 0 THEN i + o ELSE i END END), 0)::BIGINT AS total
      FROM (SELECT l_orderkey AS k, CASE WHEN l_quantity > 10 THEN floor(l_quantity)::BIGINT END AS i, l_linenumber AS o FROM lineitem) GROUP BY 1""",
    "judge_scores": "SELECT conv_id, turn, ([1.0, 0.0, 0.25, NULL, NULL, 1.0, NULL])[((conv_id + turn) % 7 + 1)::INT]::DOUBLE AS score FROM conversations",
    "excerpts": "SELECT doc_id, CASE WHEN length(text) <= 220 THEN text ELSE regexp_replace(left(text, 220), ' [^ ]*\\z', '') || '…' END AS excerpt FROM documents",
    "context_route": "SELECT doc_id, CASE WHEN ceil(length(text) / 4) <= 800 THEN 'cag' ELSE 'rag' END AS route, ceil(length(text) / 4)::BIGINT || ' of 800 tokens' AS reason FROM documents",
    "question_intent": f"""SELECT conv_id, turn, CASE WHEN {_hits((' buy ', ' sell ', 'recommend', 'price target', 'target price', 'forecast', 'predict'), 't')} THEN NULL
      WHEN {_hits(('revenue growth', 'revenue evidence', 'the '), 't')} THEN 'revenue_growth' WHEN {_hits(('operating-growth', 'operating growth', 'growth evidence', ' und '), 't')} THEN 'operating_growth'
      WHEN {_hits(('valuation', 'p/e', 'price-to-earnings', 'multiple', ' les '), 't')} THEN 'valuation' END AS intent FROM (SELECT conv_id, turn, ' ' || {FOLD.format('text')} || ' ' AS t FROM conversations)""",
}
