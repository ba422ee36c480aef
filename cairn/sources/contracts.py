"""The tables at hand, seen as the contracts that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.binding import let
from cairn.session import broadcast_if_small, materialise, spread

GOLD_CHARS = 80
#: Questions are a stated set, broadcast up to so many.
QUESTIONS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """passage_id, company, period, section, document_type, text, source_url, of documents."""
    docs = spread(table(spark, sf_dir, "documents"))
    pid = F.format_string("DOC-%08d", "doc_id")
    return docs.select(pid.alias("passage_id"), F.col("source").alias("company"), F.col("lang").alias("period"), F.lit("body").alias("section"), F.lit("document").alias("document_type"), "text", F.concat(F.lit("doc:"), pid).alias("source_url"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, question, and the period that it is limited to (every other question)."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.when(F.col("item_id") % 2 == 0, "en").alias("period"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, passage_id): passages that hold the start of a question.

    The second to fourth word of a start stand whole in every text that holds it, so texts and starts meet on these three and
    only then is the text searched. Starts of fewer than five words have no such key: they are held against every text.
    """
    cut = lambda text: F.split(text, " ")
    key = lambda w, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    q = questions(spark, sf_dir).select("query_id", F.left("question", F.lit(GOLD_CHARS)).alias("_start")).where("_start is not null")
    q = q.withColumn("_key", F.when(F.size(cut(F.col("_start"))) >= 5, key(cut(F.col("_start")), 1)))
    keyed, others = broadcast_if_small(q.where("_key is not null"), QUESTIONS), q.where("_key is null")
    p = passages(spark, sf_dir).select("passage_id", "text")
    keys = let(cut(F.col("text")), lambda w: F.when(F.size(w) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: key(w, i)))))
    met = p.select("passage_id", F.explode_outer(keys).alias("_key")).join(keyed, "_key").select("passage_id", "query_id", "_start")
    met = p.join(broadcast_if_small(materialise(met, "key-matches"), QUESTIONS), "passage_id").where(F.contains("text", "_start"))
    short = p.join(broadcast_if_small(others, QUESTIONS), F.contains("text", "_start"))
    return met.select("query_id", "passage_id").unionByName(short.select("query_id", "passage_id"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, answer, abstained, expected: by turns cited, uncited, wrongly cited and abstaining answers to the questions."""
    known = gold(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list("passage_id")).alias("expected"))
    q = questions(spark, sf_dir).join(known, "query_id", "left").withColumn("expected", F.coalesce("expected", F.array().cast("array<string>")))
    turn = F.col("query_id") % 4
    cite = F.array_join(F.transform("expected", lambda p: F.concat(F.lit("["), p, F.lit("]"))), " ")
    answer = F.when(turn == 0, F.concat_ws(" ", "question", cite)).when(turn == 1, F.col("question")).when(turn == 2, F.concat("question", F.lit(" [DOC-99999999]"))).otherwise("Not enough evidence.")
    return q.select(F.col("query_id").alias("case_id"), "question", "period", answer.alias("answer"), (turn == 3).alias("abstained"), "expected")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, ordinal, block_type, text: documents by line; the first line is the heading, a line with a bar a table."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    kind = F.when(F.col("ordinal") == 0, "heading").when(F.contains("text", F.lit(" | ")), "table").otherwise("paragraph")
    return docs.where(F.trim("text") != "").select("source_id", "ordinal", kind.alias("block_type"), "text")


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, index, phase, status, attempt_id, duration_ms: events in order of time for each user."""
    from pyspark.sql import Window

    phase = F.create_map(*(F.lit(x) for x in ("signup", "planning", "click", "execution", "view", "replanning", "purchase", "report", "error", "guardrail")))
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("run_id"),
        (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("index"),
        F.get(F.array(phase[F.col("event_type")]), F.lit(0)).alias("phase"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        F.col("event_id").alias("attempt_id"),
        F.col("value").alias("duration_ms"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, attempt_id, capability, arguments, status, error_code: clicks and errors as calls."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "error"))
    bad = F.col("event_type") == "error"
    return e.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("attempt_id"),
        F.when(F.col("event_id") % 2 == 0, "get_company_metric").otherwise("search_financial_documents").alias("capability"),
        F.col("props").alias("arguments"),
        F.when(bad, "error").otherwise("ok").alias("status"),
        F.when(bad, "tool_error").alias("error_code"),
        F.col("value").alias("duration_ms"),
    )


#: The same contracts in SQL, for the queries' counterparts.
SQL = f"""
passages AS (SELECT 'DOC-' || lpad(doc_id::VARCHAR, 8, '0') AS passage_id, source AS company, lang AS period, 'body' AS section, text FROM documents),
questions AS (SELECT item_id AS query_id, text AS question, CASE WHEN item_id % 2 = 0 THEN 'en' END AS period FROM benchmark),
gold AS (SELECT query_id, passage_id FROM passages JOIN questions ON contains(text, left(question, {GOLD_CHARS}))),
cases AS (
  SELECT q.query_id AS case_id, question, period, coalesce(expected, []) AS expected, q.query_id % 4 = 3 AS abstained,
    CASE q.query_id % 4 WHEN 0 THEN concat_ws(' ', question, array_to_string(list_transform(coalesce(expected, []), lambda p: '[' || p || ']'), ' ')) WHEN 1 THEN question
      WHEN 2 THEN question || ' [DOC-99999999]' ELSE 'Not enough evidence.' END AS answer
  FROM questions q LEFT JOIN (SELECT query_id, list_sort(list(passage_id)) AS expected FROM gold GROUP BY query_id) g ON g.query_id = q.query_id),
blocks AS (
  SELECT source_id, ordinal, CASE WHEN ordinal = 0 THEN 'heading' WHEN contains(text, ' | ') THEN 'table' ELSE 'paragraph' END AS block_type, text
  FROM (SELECT doc_id AS source_id, unnest(range(len(l))) AS ordinal, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(text) <> ''),
trajectory AS (
  SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS index,
    CASE event_type WHEN 'signup' THEN 'planning' WHEN 'click' THEN 'execution' WHEN 'view' THEN 'replanning' WHEN 'purchase' THEN 'report' WHEN 'error' THEN 'guardrail' END AS phase,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, event_id AS attempt_id, value AS duration_ms FROM events),
observations AS (
  SELECT user_id AS run_id, event_id AS attempt_id, CASE WHEN event_id % 2 = 0 THEN 'get_company_metric' ELSE 'search_financial_documents' END AS capability, props AS arguments,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, CASE WHEN event_type = 'error' THEN 'tool_error' END AS error_code, value AS duration_ms
  FROM events WHERE event_type IN ('click', 'error'))
"""
