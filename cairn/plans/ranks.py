"""Queries of ranking, fusion, reranking and their evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import ranking as R
from cairn.operators.finance import contextualised
from cairn.session import broadcast_if_small, materialise
from cairn.sources.contracts import SQL, gold, passages, questions, table

TOP = 4
CANDIDATES = 20
#: What figures are of, in the corpus at hand.
TOTALS = ("eau", "heit", "that")


def _vectors(spark, d):
    e = table(spark, d, "embeddings").select(F.format_string("DOC-%08d", "vec_id").alias("passage_id"), F.col("embedding").cast("array<double>").alias("v"))
    return passages(spark, d).select("passage_id", "period").join(e, "passage_id")


def _asked(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("v"))
    return questions(spark, d).join(e, "query_id").select("query_id", "period", "v")


def _bm25(spark, d, k=CANDIDATES):
    return R.ranked(R.bm25_scores(passages(spark, d), questions(spark, d), k=k), k)


def _tfidf(spark, d, k=CANDIDATES):
    return R.ranked(R.tfidf_scores(passages(spark, d), questions(spark, d), k=k), k)


def _dense(spark, d, k=CANDIDATES):
    return R.dense_ranked(_vectors(spark, d), _asked(spark, d), k)


_ROW = ("query_id", "passage_id", "score", "rank")


def bm25_topk(spark, d):
    return _bm25(spark, d, TOP).select(*_ROW)


def bm25_topk_norm(spark, d):
    p, q = passages(spark, d), questions(spark, d)
    return R.ranked(R.over_best(R.fill_zero(R.bm25_scores(p, q, k=TOP), p, q, TOP)), TOP).select(*_ROW)


def bm25_topk_scoped(spark, d):
    return R.ranked(R.bm25_scores(passages(spark, d), questions(spark, d), "eligible", TOP), TOP).select(*_ROW)


def tfidf_weights(spark, d):
    w = R.tfidf_weights(passages(spark, d))
    return w.groupBy("passage_id").agg(F.count("*").alias("terms"), F.round(F.sum("w"), 6).alias("total"), F.round(F.max("w"), 6).alias("top"))


def tfidf_topk(spark, d):
    p, q = passages(spark, d), questions(spark, d)
    return R.ranked(R.fill_zero(R.tfidf_scores(p, q, k=TOP), p, q, TOP), TOP).select(*_ROW)


def dense_topk(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    own = e.select(F.col("vec_id").alias("passage_id"), F.lit(None).cast("string").alias("period"), "v")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.lit(None).cast("string").alias("period"), "v")
    return R.dense_ranked(own, asked, 5).select("query_id", "passage_id", F.round((F.col("score") + 1) / 2, 7).alias("score"), "rank")  # half of six digits has seven


def overlap_topk(spark, d, prefix: str = "trace-"):
    p = passages(spark, d).select("passage_id", "period", F.explode_outer(T.lexical_tokens(F.col("text"))).alias("term")).where("term is not null")
    q = questions(spark, d).where("period is not null").select("query_id", F.col("period").alias("q_period"), F.explode_outer(T.lexical_tokens(F.col("question"))).alias("term"))
    pairs = p.withColumnRenamed("period", "q_period").join(broadcast_if_small(q, R.QUERY_ROWS), ["term", "q_period"])
    scored = pairs.groupBy("query_id", "passage_id").agg(F.count("*").cast("double").alias("score"))
    return R.ranked(scored, 2).withColumn("trace_id", F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", "query_id", "passage_id"), 256), 1, 12))).select(*_ROW, "trace_id")


def rrf_fusion(spark, d):
    return R.fuse({"bm25": _bm25(spark, d), "tfidf": _tfidf(spark, d)}).where(F.col("rank") <= 10).select(*_ROW, "channels")


def rrf_violations(spark, d):
    rows = _bm25(spark, d).select("query_id", "passage_id", F.lit("bm25").alias("channel")).unionByName(_tfidf(spark, d).select("query_id", "passage_id", F.lit("tfidf").alias("channel")))
    twice = rows.groupBy("channel", "query_id", "passage_id").agg(F.count("*").alias("n")).where("n > 1").groupBy("channel").agg(F.count("*").alias("bad"))
    return rows.groupBy("channel").agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("queries")).join(twice, "channel", "left").select("channel", "n", "queries", F.coalesce("bad", F.lit(0)).alias("duplicates"))


def _hybrid(spark, d):
    p, q = passages(spark, d), questions(spark, d)
    fused = R.fuse({"bm25": _bm25(spark, d), "dense": _dense(spark, d)}).where(F.col("rank") <= CANDIDATES)
    return R.rerank(fused, p, q, TOP)


def rerank(spark, d):
    p, q = passages(spark, d), questions(spark, d)
    fused = R.fuse({"bm25": _bm25(spark, d)}).where(F.col("rank") <= CANDIDATES)
    return R.rerank(fused, p, q, TOP).select(*_ROW, "lexical", "numeric", "section", "fusion")


def hybrid_search(spark, d):
    """Filters before ranking, two channels, fusion, reranking, and a row with the reason for questions left without passages."""
    out = _hybrid(spark, d).select("query_id", "passage_id", "score", F.col("rank").cast("long").alias("rank"), F.lit(None).cast("string").alias("reason"))
    gone = R.abstentions(passages(spark, d), questions(spark, d))
    return out.unionByName(gone.select("query_id", F.lit(None).cast("string").alias("passage_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("rank"), "reason"))


def certified_search(spark, d):
    """All eligible passages are candidates of both channels; the fused order is final."""
    return R.certified(passages(spark, d), questions(spark, d), _vectors(spark, d), _asked(spark, d), {"bm25": 10.0, "dense": 1.0}, 3).select(*_ROW)


def contextual_search(spark, d):
    """A search of two channels, the 20 best of each, behind a gate: only passages whose figures have a context are in the index, and statistics are theirs."""
    gate = contextualised(F.col("text"), TOTALS)
    p, q = passages(spark, d).where(gate), questions(spark, d)
    vectors = _vectors(spark, d).join(p.select("passage_id"), "passage_id", "left_semi")
    dense = R.dense_ranked(vectors, _asked(spark, d), CANDIDATES)
    return R.fuse({"bm25": R.ranked(R.bm25_scores(p, q, "eligible", CANDIDATES), CANDIDATES), "dense": dense}, {"bm25": 10.0, "dense": 1.0}).where(F.col("rank") <= 3).select(*_ROW)


def stage_matrix(spark, d):
    """Recall of the first hit at each stage of the hybrid search."""
    p, q = passages(spark, d), questions(spark, d)
    bm25, dense = materialise(_bm25(spark, d), "bm25"), materialise(_dense(spark, d), "dense")
    fused = materialise(R.fuse({"bm25": bm25, "dense": dense}).where(F.col("rank") <= CANDIDATES), "fused")
    return R.stage_recall({"bm25": bm25, "dense": dense, "fused": fused, "reranked": R.rerank(fused, p, q, TOP)}, gold(spark, d))


def rank_movement(spark, d):
    a, b = materialise(_bm25(spark, d), "bm25"), materialise(_tfidf(spark, d), "tfidf")  # each is fused twice
    one = R.fuse({"bm25": a, "tfidf": b}).select("query_id", "passage_id", F.col("rank").alias("before"))
    two = R.fuse({"bm25": a, "tfidf": b}, {"bm25": 1.0, "tfidf": 3.0}).select("query_id", "passage_id", F.col("rank").alias("after"))
    return one.join(two, ["query_id", "passage_id"]).select("query_id", "passage_id", "before", "after", (F.col("before") - F.col("after")).alias("moved"))


def literal_rank(spark, d):
    q = questions(spark, d).select("query_id", F.left("question", F.lit(40)).alias("literal"))
    hits = _bm25(spark, d).join(passages(spark, d).select("passage_id", "text"), "passage_id").join(broadcast_if_small(q, R.QUERY_ROWS), "query_id")
    return hits.groupBy("query_id").agg(F.min(F.when(F.contains("text", "literal"), F.col("rank"))).alias("first_rank"))


def abstentions(spark, d):
    return R.abstentions(passages(spark, d).where("period <> 'en'"), questions(spark, d))


def eligible_passages(spark, d):
    p, q = passages(spark, d), questions(spark, d).withColumnRenamed("period", "q_period")
    counts = p.groupBy("period").agg(F.count("*").alias("n"))
    return q.join(counts, R.eligible(F.col("q_period"), F.col("period"))).groupBy("query_id").agg(F.sum("n").alias("n_eligible"))


def missing_evidence(spark, d):
    return gold(spark, d).join(_bm25(spark, d, TOP), ["query_id", "passage_id"], "left_anti")


def stage_recall(spark, d):
    g = gold(spark, d)
    out = None
    for name, hits in (("bm25", _bm25(spark, d, 1)), ("tfidf", _tfidf(spark, d, 1))):
        got = g.join(hits.select("query_id", "passage_id", F.lit(1).alias("hit")), ["query_id", "passage_id"], "left").groupBy("query_id").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
        row = got.agg(F.round(F.avg("hit"), 6).alias("recall")).select(F.lit(name).alias("stage"), "recall")
        out = row if out is None else out.unionByName(row)
    return out.groupBy().pivot("stage", ["bm25", "tfidf"]).agg(F.first("recall"))


def rag_prompts(spark, d):
    hits = _bm25(spark, d, TOP).join(passages(spark, d).select("passage_id", "text"), "passage_id")
    block = F.concat(F.lit("["), F.col("passage_id"), F.lit("]\n"), T.excerpt(F.col("text"), 220))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda s: s["b"]), "\n\n")
    return hits.groupBy("query_id").agg(body.alias("evidence")).join(questions(spark, d), "query_id").select("query_id", F.sha2(F.concat("question", F.lit("\n\n"), "evidence"), 256).alias("prompt_sha"))


def balanced_topk(spark, d):
    p = passages(spark, d).select("passage_id", "company", F.explode_outer(T.query_words(F.col("text"))).alias("term")).where("term is not null")
    q = questions(spark, d).select("query_id", F.explode_outer(T.query_words(F.col("question"))).alias("term"))
    scored = p.join(broadcast_if_small(q, R.QUERY_ROWS), "term").groupBy("query_id", "company", "passage_id").agg(F.count("*").cast("double").alias("score"))
    each = R.ranked(scored, 1, "query_id", "company").drop("rank")
    return R.ranked(each, 5).select("query_id", "company", "passage_id", "score", "rank")


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_topk_norm, bm25_topk_scoped, tfidf_weights, tfidf_topk, dense_topk, overlap_topk, rrf_fusion, rrf_violations, rerank, hybrid_search, certified_search, contextual_search, stage_matrix, rank_movement, literal_rank, abstentions, eligible_passages, missing_evidence, stage_recall, rag_prompts, balanced_topk)}

_FOLD = "replace(lower({}), 'ß', 'ss')"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.QUERY_STOP_WORDS) + "]"
_NUM = ("list_distinct(list_transform(regexp_extract_all(regexp_replace({0}, '[\\x{{C0}}-\\x{{D6}}\\x{{D8}}-\\x{{F6}}\\x{{F8}}-\\x{{24F}}]', '_', 'g'), "
        "'(?i)(?:^|[^\\pL\\pN_.])((?:[$€£]\\s*|(?:usd|eur|gbp)\\s+)?(?:[0-9]{{1,3}}(?:,[0-9]{{3}})+(?:\\.[0-9]+)?|[0-9]+(?:[.,][0-9]+)?)(?:%\\B|(?:bn|m|b|x)?\\b))', 1), lambda t: replace(lower(t), ' ', '')))")
_QW = "list_distinct(list_filter(regexp_extract_all(" + _FOLD + f", '{T.QUERY_WORD}'), lambda w: NOT list_contains({_STOP}, w)))"
_BM25 = f"""
dtok AS (SELECT passage_id, period, regexp_extract_all({_FOLD.format('text')}, '{T.BM25_TOKEN}') AS t FROM passages),
post AS (SELECT passage_id, period, dl, term, count(*) AS tf FROM (SELECT passage_id, period, len(t) AS dl, unnest(t) AS term FROM dtok) GROUP BY ALL),
qt AS (SELECT DISTINCT query_id, period AS q_period, unnest(regexp_extract_all({_FOLD.format('question')}, '{T.BM25_TOKEN}')) AS term FROM questions),
stat AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM dtok),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (SELECT query_id, passage_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM post JOIN qt USING (term) JOIN dfs USING (term), stat WHERE q_period IS NULL OR q_period = period GROUP BY 1, 2),
bm_top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM bm QUALIFY rank <= {CANDIDATES})"""
_TFIDF = f"""
wtok AS (SELECT passage_id, period, list_filter(regexp_extract_all(lower(text), '[\\pL\\pN_]{{2,}}'), lambda w: NOT list_contains({_STOP}, w)) AS t FROM passages),
wpost AS (SELECT passage_id, period, term, count(*) AS tf FROM (SELECT passage_id, period, unnest(t) AS term FROM wtok) GROUP BY ALL),
wdf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM passages)) / (1 + count(*))) + 1 AS idf FROM wpost GROUP BY term),
wraw AS (SELECT passage_id, period, term, tf * idf AS w FROM wpost JOIN wdf USING (term)),
wts AS (SELECT passage_id, period, term, w / sqrt(sum(w * w) OVER (PARTITION BY passage_id)) AS w FROM wraw),
wq0 AS (SELECT query_id, q_period, term, count(*) AS qtf FROM (SELECT query_id, period AS q_period, unnest(list_filter(regexp_extract_all(lower(question), '[\\pL\\pN_]{{2,}}'), lambda w: NOT list_contains({_STOP}, w))) AS term FROM questions) GROUP BY ALL),
wq1 AS (SELECT query_id, q_period, term, qtf * idf AS qw FROM wq0 JOIN wdf USING (term)),
wq AS (SELECT query_id, q_period, term, qw / sqrt(sum(qw * qw) OVER (PARTITION BY query_id)) AS qw FROM wq1),
tf AS (SELECT query_id, passage_id, round(sum(w * qw), 6) AS score FROM wts JOIN wq USING (term) WHERE q_period IS NULL OR q_period = period GROUP BY 1, 2),
tf_top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM tf QUALIFY rank <= {CANDIDATES})"""
_DENSE = f"""
dv AS (SELECT passage_id, period, embedding AS v FROM passages JOIN embeddings ON passage_id = 'DOC-' || lpad(vec_id::VARCHAR, 8, '0')),
qv AS (SELECT query_id, period AS q_period, embedding AS q FROM questions JOIN embeddings ON vec_id = query_id),
de AS (SELECT query_id, passage_id, round(list_cosine_similarity(v::DOUBLE[], q::DOUBLE[]), 6) AS score FROM dv, qv WHERE q_period IS NULL OR q_period = period),
de_top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM de QUALIFY rank <= {CANDIDATES})"""


def _fused(name: str, *channels: tuple[str, str, float]) -> str:
    rows = " UNION ALL ".join(f"SELECT query_id, passage_id, rank, '{c}' AS channel, {w} AS w FROM {t}" for t, c, w in channels)
    return f"""{name}_u AS ({rows}),
{name}_s AS (SELECT query_id, passage_id, round(sum(w / (60 + rank)), 9) AS score, string_agg(channel || '=' || rank, ',' ORDER BY channel) AS channels FROM {name}_u GROUP BY 1, 2),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM {name}_s)"""


def _reranked(source: str) -> str:
    return f"""rr0 AS (SELECT f.query_id, f.passage_id, f.score AS rrf, {_QW.format('question')} AS q, {_NUM.format('question')} AS n, {_QW.format('p.text')} AS w, {_NUM.format('p.text')} AS m, max(f.score) OVER (PARTITION BY f.query_id) AS top
  FROM (SELECT * FROM {source} WHERE rank <= {CANDIDATES}) f JOIN passages p USING (passage_id) JOIN questions USING (query_id)),
rr1 AS (SELECT *, CASE WHEN len(q) = 0 THEN 0 ELSE round(len(list_intersect(q, w)) / len(q), 6) END AS lexical, CASE WHEN len(n) = 0 THEN 0 ELSE round(len(list_intersect(n, m)) / len(n), 6) END AS numeric,
  CASE WHEN len(q) = 0 THEN 0 ELSE round(len(list_intersect(q, ['body'])) / len(q), 6) END AS section, round(rrf / top, 6) AS fusion FROM rr0),
rr AS (SELECT *, round(lexical * 0.25 + numeric * 0.45 + section * 0.1 + 0.1 + fusion * 0.1, 8) AS score FROM rr1),
rr_top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rrf DESC, passage_id) AS rank FROM rr QUALIFY rank <= {TOP})"""


def _filled(scores: str, normal: bool) -> str:
    score = "CASE WHEN max(s) OVER (PARTITION BY query_id) > 0 THEN round(s / max(s) OVER (PARTITION BY query_id), 6) ELSE 0 END" if normal else "s"
    return f"""ful AS (SELECT q.query_id, p.passage_id, coalesce(score, 0) AS s FROM questions q JOIN passages p ON q.period IS NULL OR q.period = p.period LEFT JOIN {scores} b ON b.query_id = q.query_id AND b.passage_id = p.passage_id),
nrm AS (SELECT query_id, passage_id, {score} AS score FROM ful)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM nrm QUALIFY rank <= {TOP}"""


_SCOPED = _BM25 + f""",
lim AS (SELECT DISTINCT q_period FROM qt),
sdf AS (SELECT q_period, term, count(*) AS df FROM post JOIN lim ON q_period IS NULL OR q_period = period GROUP BY 1, 2),
sst AS (SELECT q_period, count(*) AS n, avg(len(t)) AS avgdl FROM dtok JOIN lim ON q_period IS NULL OR q_period = period GROUP BY 1),
sbm AS (SELECT query_id, passage_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM post JOIN qt USING (term) JOIN sdf ON sdf.term = post.term AND sdf.q_period IS NOT DISTINCT FROM qt.q_period JOIN sst ON sst.q_period IS NOT DISTINCT FROM qt.q_period
  WHERE qt.q_period IS NULL OR qt.q_period = period GROUP BY 1, 2),
sbm_top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM sbm QUALIFY rank <= {CANDIDATES})"""
_FINITE = "{0} IS NOT NULL AND len(list_filter({0}, lambda x: isfinite(x))) = len({0})"
_W = f"WITH {SQL}, "
ORACLES = {
    "bm25_topk": _W + _BM25 + f" SELECT * FROM bm_top WHERE rank <= {TOP}",
    "bm25_topk_norm": _W + _BM25 + ", " + _filled("bm", True),
    "bm25_topk_scoped": _W + _SCOPED + f" SELECT * FROM sbm_top WHERE rank <= {TOP}",
    "tfidf_weights": _W + _TFIDF + " SELECT passage_id, count(*) AS terms, round(sum(w), 6) AS total, round(max(w), 6) AS top FROM wts GROUP BY 1",
    "tfidf_topk": _W + _TFIDF + ", " + _filled("tf", False),
    "dense_topk": """SELECT query_id, passage_id, round((s + 1) / 2, 7) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, passage_id) AS rank FROM (
      SELECT q.vec_id AS query_id, e.vec_id AS passage_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS s FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) QUALIFY rank <= 5""",
    "overlap_topk": _W + f"""x AS (SELECT query_id, passage_id, len(list_intersect(list_distinct(regexp_extract_all({_FOLD.format('question')}, '[a-z0-9]+')), regexp_extract_all({_FOLD.format('text')}, '[a-z0-9]+')))::DOUBLE AS score FROM questions q JOIN passages p ON q.period = p.period)
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank, 'trace-' || substr(sha256(query_id || '|' || passage_id), 1, 12) AS trace_id FROM x WHERE score > 0 QUALIFY rank <= 2""",
    "rrf_fusion": _W + _BM25 + "," + _TFIDF + ", " + _fused("f", ("bm_top", "bm25", 1.0), ("tf_top", "tfidf", 1.0)) + " SELECT query_id, passage_id, score, rank, channels FROM f WHERE rank <= 10",
    "rrf_violations": _W + _BM25 + "," + _TFIDF + " SELECT 'bm25' AS channel, count(*) AS n, count(DISTINCT query_id) AS queries, 0 AS duplicates FROM bm_top UNION ALL SELECT 'tfidf', count(*), count(DISTINCT query_id), 0 FROM tf_top",
    "rerank": _W + _BM25 + ", " + _fused("f", ("bm_top", "bm25", 1.0)) + ", " + _reranked("f") + " SELECT query_id, passage_id, score, rank, lexical::DOUBLE AS lexical, numeric::DOUBLE AS numeric, section::DOUBLE AS section, fusion FROM rr_top",
    "hybrid_search": _W + _BM25 + "," + _DENSE + ", " + _fused("f", ("bm_top", "bm25", 1.0), ("de_top", "dense", 1.0)) + ", " + _reranked("f") + """
      SELECT query_id, passage_id, score, rank, NULL::VARCHAR AS reason FROM rr_top UNION ALL SELECT query_id, NULL, NULL, NULL, 'no_eligible_passage' FROM questions WHERE period IS NOT NULL AND period NOT IN (SELECT period FROM passages)""",
    "certified_search": _W + _SCOPED + "," + _DENSE + f""",
      cbm AS (SELECT query_id, passage_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, passage_id) AS rank
        FROM (SELECT query_id, passage_id FROM questions q JOIN passages p ON q.period IS NULL OR q.period = p.period) LEFT JOIN sbm USING (query_id, passage_id)),
      cde AS (SELECT query_id, passage_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN isnan(score) THEN 0 ELSE score END DESC, passage_id) AS rank FROM de -- a zero vector's cosine is 0, others that have none are left out
        WHERE passage_id IN (SELECT passage_id FROM dv WHERE {_FINITE.format('v')}) AND query_id IN (SELECT query_id FROM qv WHERE {_FINITE.format('q')})),
      """ + _fused("f", ("cbm", "bm25", 10.0), ("cde", "dense", 1.0)) + " SELECT query_id, passage_id, score, rank FROM f WHERE rank <= 3",
    "contextual_search": (_W + _SCOPED + "," + _DENSE).replace("FROM documents)", "FROM documents WHERE regexp_matches(text, '[0-9]') AND regexp_matches(text, '(?i)(?:^|[^\\pL\\pN_])(GAAP|audited|unaudited|" + "|".join(TOTALS) + ")(?:[^\\pL\\pN_]|$)|(In|€) millions?'))", 1)
    + ", " + _fused("f", ("sbm_top", "bm25", 10.0), ("de_top", "dense", 1.0)) + " SELECT query_id, passage_id, score, rank FROM f WHERE rank <= 3",
    "stage_matrix": _W + _BM25 + "," + _DENSE + ", " + _fused("f", ("bm_top", "bm25", 1.0), ("de_top", "dense", 1.0)) + ", " + _reranked("f")
    + f", st AS (SELECT 'bm25' AS stage, query_id, passage_id, rank FROM bm_top UNION ALL SELECT 'dense', query_id, passage_id, rank FROM de_top UNION ALL SELECT 'fused', query_id, passage_id, rank FROM f WHERE rank <= {CANDIDATES} UNION ALL SELECT 'reranked', query_id, passage_id, rank FROM rr_top)"
    + " SELECT s.stage, count(*) AS questions, round(avg((h.query_id IS NOT NULL)::INT), 6) AS recall FROM (SELECT DISTINCT query_id FROM gold) g CROSS JOIN (SELECT DISTINCT stage FROM st) s LEFT JOIN (SELECT DISTINCT stage, query_id FROM st SEMI JOIN gold USING (query_id, passage_id) WHERE rank = 1) h ON h.stage = s.stage AND h.query_id = g.query_id GROUP BY 1",
    "rank_movement": _W + _BM25 + "," + _TFIDF + ", " + _fused("f", ("bm_top", "bm25", 1.0), ("tf_top", "tfidf", 1.0)) + ", " + _fused("g", ("bm_top", "bm25", 1.0), ("tf_top", "tfidf", 3.0)) + " SELECT query_id, passage_id, f.rank AS before, g.rank AS after, f.rank - g.rank AS moved FROM f JOIN g USING (query_id, passage_id)",
    "literal_rank": _W + _BM25 + " SELECT query_id, min(CASE WHEN contains(text, left(question, 40)) THEN rank END) AS first_rank FROM bm_top JOIN passages USING (passage_id) JOIN questions USING (query_id) GROUP BY 1",
    "abstentions": _W.removesuffix(", ") + " SELECT query_id, 'no_eligible_passage' AS reason FROM questions WHERE period IS NOT NULL AND period NOT IN (SELECT period FROM passages WHERE period <> 'en')",
    "eligible_passages": _W.removesuffix(", ") + " SELECT query_id, count(*) AS n_eligible FROM questions q JOIN passages p ON q.period IS NULL OR q.period = p.period GROUP BY 1",
    "missing_evidence": _W + _BM25 + f" SELECT query_id, passage_id FROM gold ANTI JOIN (SELECT * FROM bm_top WHERE rank <= {TOP}) USING (query_id, passage_id)",
    "stage_recall": _W + _BM25 + "," + _TFIDF + """ SELECT (SELECT round(avg(h), 6) FROM (SELECT query_id, max((t.rank IS NOT NULL)::INT) AS h FROM gold LEFT JOIN (SELECT * FROM bm_top WHERE rank = 1) t USING (query_id, passage_id) GROUP BY 1)) AS bm25,
      (SELECT round(avg(h), 6) FROM (SELECT query_id, max((t.rank IS NOT NULL)::INT) AS h FROM gold LEFT JOIN (SELECT * FROM tf_top WHERE rank = 1) t USING (query_id, passage_id) GROUP BY 1)) AS tfidf""",
    "rag_prompts": _W + _BM25 + f""", ex AS (SELECT query_id, rank, '[' || passage_id || ']' || chr(10) || CASE WHEN length(text) <= 220 THEN text ELSE regexp_replace(left(text, 220), ' [^ ]*\\z', '') || '…' END AS b FROM bm_top JOIN passages USING (passage_id) WHERE rank <= {TOP})
      SELECT query_id, sha256(any_value(question) || chr(10) || chr(10) || string_agg(b, chr(10) || chr(10) ORDER BY rank)) AS prompt_sha FROM ex JOIN questions USING (query_id) GROUP BY 1""",
    "balanced_topk": _W + f"""x AS (SELECT query_id, company, passage_id, len(list_intersect({_QW.format('question')}, {_QW.format('text')}))::DOUBLE AS score FROM questions, passages),
      y AS (SELECT * FROM x WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id, company ORDER BY score DESC, passage_id) = 1)
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM y QUALIFY rank <= 5""",
}
