"""Queries of chunking over whole documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import chunking as C
from cairn.session import spread
from cairn.sources.contracts import SQL, blocks, passages, table


def _docs(spark, d):
    return table(spark, d, "documents")


def _listed(make):
    """Number, hash and longest of each document's chunks."""

    def query(spark, d):
        rows = _docs(spark, d).select("doc_id", make(F.col("text")).alias("c"))
        return rows.select("doc_id", F.size("c").cast("long").alias("n"), F.md5(F.array_join("c", "|")).alias("md5"), F.coalesce(F.array_max(F.transform("c", F.length)), F.lit(0)).cast("long").alias("longest"))

    return query


def chunk_fixed(spark, d):
    rows = _docs(spark, d).select("doc_id", F.posexplode_outer(C.fixed_windows(F.col("text"), 400, 80)).alias("i", "text")).where("text is not null")
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("n"), F.md5("text").alias("md5"))


def chunk_naive(spark, d):
    prefix = F.concat(F.split_part("source", F.lit("-"), F.lit(1)), F.lit("."), F.col("doc_id").cast("string"))
    rows = _docs(spark, d).select("doc_id", F.explode_outer(C.numbered(C.fixed_windows(F.col("text"), 1600, 200), prefix)).alias("c")).where("c is not null")
    return rows.select("doc_id", F.col("c.id").alias("chunk_id"), F.md5("c.text").alias("md5"))


def chunk_structure(spark, d):
    return C.structure_aware(blocks(spark, d), 600).select("source_id", "n", "kind", F.md5("text").alias("md5"))


def chunk_structure_counts(spark, d):
    return C.structure_aware(blocks(spark, d), 600).where("kind = 'table'").groupBy("source_id").agg(F.count("*").alias("tables"))


def chunk_hierarchical(spark, d):
    b = blocks(spark, d)
    section = F.when(F.col("ordinal") < 5, "Opening").otherwise("Body")
    units = b.select("source_id", "ordinal", section.alias("section"), C.pack(C.sentence_units(F.col("text"), 300), 300).alias("c"))
    parents = units.groupBy("source_id", "section").agg(F.min("ordinal").alias("first"), F.sum(F.size("c")).alias("children"))
    before = F.sum(F.col("children") + 1).over(Window.partitionBy("source_id").orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    return parents.select("source_id", "section", (F.coalesce(before, F.lit(0)) + 1).alias("parent_no"), "children")


def parent_expansion(spark, d):
    rows = _docs(spark, d).select("doc_id", F.posexplode_outer(C.fixed_windows(F.col("text"), 400, 80)).alias("i", "text")).where("text is not null")
    parent = rows.groupBy("doc_id", F.floor(F.col("i") / 4).alias("parent")).agg(F.count("*").alias("children"), F.sum(F.length("text")).alias("chars"))
    return rows.select("doc_id", "i", F.floor(F.col("i") / 4).alias("parent")).join(parent, ["doc_id", "parent"]).select("doc_id", F.col("i").cast("long").alias("i"), "parent", "children", "chars")


def chunk_contextual(spark, d):
    head = F.concat_ws(" | ", "company", "period", "document_type", F.concat(F.lit("Section: "), F.col("section")))
    return passages(spark, d).select("passage_id", F.sha2(F.concat(head, F.lit("\n"), F.col("text")), 256).alias("sha"), F.replace("passage_id", F.lit("DOC"), F.lit("CONTEXTUAL")).alias("chunk_id"))


def chunk_hash_ids(spark, d):
    return _docs(spark, d).select("doc_id", F.concat(F.lit("chunk-"), F.substring(F.sha2("text", 256), 1, 20)).alias("chunk_id"))


def chunk_scorecard(spark, d):
    out = None
    for name, make in (("fixed", lambda t: C.fixed_windows(t, 400, 80)), ("recursive", lambda t: C.pack(C.sentence_units(t, 300), 300))):
        rows = _docs(spark, d).select(F.explode_outer(make(F.col("text"))).alias("t")).where("t is not null")
        card = rows.agg(F.count("*").alias("n"), F.round(F.avg(F.length("t")), 6).alias("mean"), F.max(F.length("t")).cast("long").alias("longest")).select(F.lit(name).alias("strategy"), "n", "mean", "longest")
        out = card if out is None else out.unionByName(card)
    return out


def token_inflation(spark, d):
    count = lambda c: F.sum(F.size(F.filter(F.split(c, " "), lambda w: w != "")))
    whole = _docs(spark, d).agg(count(F.replace("text", F.lit("\n"), F.lit(" "))).alias("plain"))
    cut = _docs(spark, d).select(F.explode_outer(C.fixed_windows(F.col("text"), 400, 80)).alias("t")).agg(count(F.replace("t", F.lit("\n"), F.lit(" "))).alias("chunked"))
    return cut.crossJoin(whole).select("plain", "chunked", F.round(F.col("chunked") / F.col("plain"), 6).alias("ratio"))  # one row each


def _profile(spark, d):
    e = table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return C.similarity_profile(e, "label", "vec_id", "v")


def embedding_similarity(spark, d):
    return _profile(spark, d).select("label", "vec_id", "similarity")


def chunk_semantic(spark, d):
    g = C.semantic_groups(_profile(spark, d), "label", "vec_id", 0.0)
    return g.groupBy("label", "group").agg(F.count("*").alias("rows"), F.min("vec_id").alias("first"))


def sentence_similarity(spark, d):
    """TF-IDF cosine of each sentence with the one before it, term statistics per document."""
    return C.sentence_profile(spread(_docs(spark, d))).select("doc_id", "pairs", F.round("total", 4).alias("total"))


def passages_query(spark, d):
    return passages(spark, d).select("passage_id", "company", "period", "section", F.md5("text").alias("text_md5"))


QUERIES = {
    "chunk_fixed": chunk_fixed,
    "chunk_naive": chunk_naive,
    "hard_split": _listed(lambda t: C.hard_split(t, 180)),
    "sentence_units": _listed(lambda t: C.sentence_units(t, 180)),
    "chunk_recursive": _listed(lambda t: C.pack(C.sentence_units(t, 300), 300)),
    "chunk_words": _listed(lambda t: C.pack_words(t, 1200)),
    "chunk_structure": chunk_structure,
    "chunk_structure_counts": chunk_structure_counts,
    "chunk_hierarchical": chunk_hierarchical,
    "parent_expansion": parent_expansion,
    "chunk_contextual": chunk_contextual,
    "chunk_hash_ids": chunk_hash_ids,
    "chunk_scorecard": chunk_scorecard,
    "token_inflation": token_inflation,
    "embedding_similarity": embedding_similarity,
    "chunk_semantic": chunk_semantic,
    "sentence_similarity": sentence_similarity,
    "passages": passages_query,
}


def _windows(size: int, overlap: int) -> str:
    step = size - overlap
    count = f"(CASE WHEN length(text) <= {size} THEN 1 ELSE ceil((length(text) - {size}) / {step})::INT + 1 END)"
    return f"list_filter(list_transform(range({count}), lambda i: trim(substr(text, i * {step} + 1, {size}))), lambda w: w <> '')"


def _hard(text: str, limit: int) -> str:
    """A regular expression without look-ahead: a blank after each piece is taken with it, unless the piece is cut."""
    return f"list_transform(regexp_extract_all({text} || ' ', '(?s)(.{{1,{limit}}}) |(.{{{limit}}})', 0), lambda h: CASE WHEN length(h) > {limit} OR (ends_with(h, ' ')) THEN left(h, length(h) - 1) ELSE h END)"


def _units(limit: int) -> str:
    split = "string_split_regex(regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1))"
    return f"flatten(list_transform(list_filter(list_transform({split}, lambda s: trim(s)), lambda s: s <> ''), lambda s: {_hard('s', limit)}))"


def _packed(units: str, limit: int) -> str:
    return f"""(CASE WHEN len({units}) = 0 THEN [] ELSE list_reduce(list_transform({units}, lambda u: [u]), lambda a, u:
      CASE WHEN length(a[-1]) + 1 + length(u[1]) <= {limit} THEN list_concat(a[:-2], [a[-1] || ' ' || u[1]]) ELSE list_concat(a, u) END) END)"""


def _list_sql(c: str) -> str:
    return f"SELECT doc_id, len(c)::BIGINT AS n, md5(array_to_string(c, '|')) AS md5, coalesce(list_max(list_transform(c, lambda x: length(x))), 0)::BIGINT AS longest FROM (SELECT doc_id, {c} AS c FROM documents)"


_PROFILE = """p AS (SELECT label, vec_id, CASE WHEN lag(vec_id) OVER w IS NOT NULL THEN round(list_cosine_similarity(embedding::DOUBLE[], (lag(embedding) OVER w)::DOUBLE[]), 6) END AS similarity
  FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id))"""
_STOP = "[" + ", ".join(f"'{w}'" for w in T.QUERY_STOP_WORDS) + "]"
ORACLES = {
    "chunk_fixed": f"SELECT doc_id, n, md5(t) AS md5 FROM (SELECT doc_id, unnest(c) AS t, unnest(range(1, len(c) + 1)) AS n FROM (SELECT doc_id, {_windows(400, 80)} AS c FROM documents WHERE length(text) > 0))",
    "chunk_naive": f"SELECT doc_id, source || '.' || doc_id || '-C' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0') AS chunk_id, md5(t) AS md5 FROM (SELECT doc_id, source, unnest(c) AS t, unnest(range(1, len(c) + 1)) AS n FROM (SELECT doc_id, source, {_windows(1600, 200)} AS c FROM documents WHERE length(text) > 0))",
    "hard_split": _list_sql(_hard("text", 180)),
    "sentence_units": _list_sql(_units(180)),
    "chunk_recursive": _list_sql(_packed("u", 300)).replace("FROM documents", f"FROM (SELECT doc_id, {_units(300)} AS u FROM documents)"),
    "chunk_structure_counts": f"WITH {SQL} SELECT source_id, count(*) AS tables FROM blocks WHERE block_type = 'table' GROUP BY 1",
    "chunk_words": _list_sql(_packed("w", 1199)).replace("FROM documents", "FROM (SELECT doc_id, list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '') AS w FROM documents)"),
    "parent_expansion": f"""WITH c AS (SELECT doc_id, unnest(c) AS t, unnest(range(len(c))) AS i FROM (SELECT doc_id, {_windows(400, 80)} AS c FROM documents WHERE length(text) > 0))
      SELECT doc_id, i, i // 4 AS parent, count(*) OVER w AS children, (sum(length(t)) OVER w)::BIGINT AS chars FROM c WINDOW w AS (PARTITION BY doc_id, i // 4)""",
    "chunk_contextual": f"WITH {SQL} SELECT passage_id, sha256(concat_ws(' | ', company, period, 'document', 'Section: body') || chr(10) || text) AS sha, replace(passage_id, 'DOC', 'CONTEXTUAL') AS chunk_id FROM passages",
    "chunk_hash_ids": "SELECT doc_id, 'chunk-' || substr(sha256(text), 1, 20) AS chunk_id FROM documents",
    "chunk_scorecard": f"""SELECT 'fixed' AS strategy, count(*) AS n, round(avg(length(t)), 6) AS mean, max(length(t)) AS longest FROM (SELECT unnest({_windows(400, 80)}) AS t FROM documents WHERE length(text) > 0)
      UNION ALL SELECT 'recursive', count(*), round(avg(length(t)), 6), max(length(t)) FROM (SELECT unnest({_packed('u', 300)}) AS t FROM (SELECT {_units(300)} AS u FROM documents))""",
    "token_inflation": f"""WITH a AS (SELECT sum(len(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda w: w <> '')))::BIGINT AS plain FROM documents),
      b AS (SELECT sum(len(list_filter(string_split(replace(t, chr(10), ' '), ' '), lambda w: w <> '')))::BIGINT AS chunked FROM (SELECT unnest({_windows(400, 80)}) AS t FROM documents WHERE length(text) > 0))
      SELECT plain, chunked, round(chunked / plain, 6) AS ratio FROM a, b""",
    "embedding_similarity": f"WITH {_PROFILE} SELECT * FROM p",
    "chunk_semantic": f"WITH {_PROFILE} SELECT label, g AS \"group\", count(*) AS rows, min(vec_id) AS first FROM (SELECT label, vec_id, (sum(CASE WHEN similarity < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id))::BIGINT AS g FROM p) GROUP BY 1, 2",
    "sentence_similarity": f"""WITH s AS (SELECT doc_id, unnest(u) AS s, unnest(range(len(u))) AS i FROM (SELECT doc_id, {_units(10000).replace(_hard('s', 10000), '[s]')} AS u FROM documents)),
      n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
      tf AS (SELECT doc_id, i, term, count(*) AS tf FROM (SELECT doc_id, i, unnest(list_filter(regexp_extract_all(lower(s), '[\\pL\\pN_]{{2,}}'), lambda w: NOT list_contains({_STOP}, w))) AS term FROM s) GROUP BY ALL),
      w0 AS (SELECT doc_id, i, term, tf * (ln((1.0 + n) / (1 + count(*) OVER (PARTITION BY doc_id, term))) + 1) AS w FROM tf JOIN n USING (doc_id)),
      w AS (SELECT doc_id, i, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, i)) AS w FROM w0),
      p AS (SELECT a.doc_id, a.i, sum(a.w * b.w) AS s FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.term = b.term AND a.i = b.i + 1 GROUP BY 1, 2)
      SELECT doc_id, count(*) AS pairs, round(sum(s), 4) AS total FROM p GROUP BY 1""",
    "passages": f"WITH {SQL} SELECT passage_id, company, period, section, md5(text) AS text_md5 FROM passages",
    "chunk_structure": f"""WITH {SQL}, r AS (SELECT *, block_type = 'table' OR length(text) > 600 AS alone, sum(CASE WHEN block_type IN ('heading', 'table') OR length(text) > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY ordinal) AS island FROM blocks),
      g AS (SELECT source_id, min(ordinal) AS ordinal, list(text ORDER BY ordinal) AS u FROM r WHERE NOT alone AND block_type <> 'heading' GROUP BY source_id, island),
      c AS (SELECT source_id, ordinal, 'text' AS kind, {_packed('u', 600).replace("' '", 'chr(10)')} AS c FROM g UNION ALL SELECT source_id, ordinal, 'table', [text] FROM r WHERE block_type = 'table'
        UNION ALL SELECT source_id, ordinal, 'long', {_packed('u', 600)} FROM (SELECT source_id, ordinal, {_units(600)} AS u FROM r WHERE alone AND block_type NOT IN ('table', 'heading')))
      SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY ordinal, part) AS n, kind, md5(t) AS md5 FROM (SELECT source_id, ordinal, kind, unnest(c) AS t, unnest(range(len(c))) AS part FROM c)""",
}
