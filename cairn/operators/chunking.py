"""Chunking: windows, hard splits, packing, sections. Column expressions where order within a text decides, windows elsewhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions.binding import let
from cairn.functions.vectors import dot, normalize
from cairn.session import broadcast_if_small

#: Tokens of the documents whose sentences are compared at a time, some 50 MB; a longer document is compared alone.
PROFILE_TOKENS = 250_000
#: Ids of more than one row are broadcast up to so many.
REPEATED_IDS = 200_000


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters, each ``overlap`` before the end of the last; the first to reach the end is the last."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    step = size - overlap
    count = F.when(F.length(text) <= size, 1).otherwise(F.ceil((F.length(text) - size) / step) + 1).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.trim(F.substring(text, i * step + 1, F.lit(size))))
    return F.when(F.length(text) > 0, F.filter(cut, lambda w: w != "")).otherwise(F.array().cast("array<string>"))


def hard_split(text: Column, limit: int) -> Column:
    """Pieces of at most ``limit`` characters: up to the last blank where there is one, else cut."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(.{{1,{limit}}}(?= |\z)|.{{{limit}}}) ?"), 1)


def sentence_units(text: Column, limit: int | None = None) -> Column:
    """Sentences and lines, trimmed, and cut to ``limit`` if there is one."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")  # F.trim itself would take the index as the characters to strip
    return F.flatten(F.transform(parts, lambda s: hard_split(s, limit))) if limit else parts


def pack(units: Column, limit: int, joint: str = " ") -> Column:
    """Greedy packing: a unit joins the last chunk while both and the joint fit."""
    fits = lambda acc, u: (F.size(acc) > 0) & (F.length(F.element_at(acc, -1)) + len(joint) + F.length(u) <= limit)
    return F.aggregate(
        units,
        F.array().cast("array<string>"),
        lambda acc, u: F.when(fits(acc, u), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(joint), u)))).otherwise(F.concat(acc, F.array(u))),
    )


def pack_words(text: Column, limit: int) -> Column:
    """Words packed while the sum of their lengths, each with one blank, stays within ``limit``; a longer word stands alone."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("size"))

    def step(acc: Column, w: Column) -> Column:
        n = F.length(w) + 1
        join = (F.size(acc["out"]) > 0) & (acc["size"] + n <= limit)
        longer = F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(F.concat(F.element_at(acc["out"], -1), F.lit(" "), w)))
        return F.struct(F.when(join, longer).otherwise(F.concat(acc["out"], F.array(w))).alias("out"), F.when(join, acc["size"] + n).otherwise(n).alias("size"))

    return F.aggregate(words, start, step)["out"]


def structure_aware(blocks: DataFrame, limit: int) -> DataFrame:
    """(source_id, ordinal, block_type, text) to (source_id, n, kind, text): headings end a run and vanish, tables and over-long
    blocks stand alone (the latter packed by sentence), other blocks are packed by line. Runs are islands between such blocks."""
    own = Window.partitionBy("source_id").orderBy("ordinal")
    alone = (F.col("block_type") == "table") | (F.length("text") > limit)
    cut = (F.col("block_type") == "heading") | alone
    rows = blocks.withColumn("island", F.sum(F.when(cut, 1).otherwise(0)).over(own)).withColumn("alone", alone).where("block_type <> 'heading'")
    packed = rows.where("not alone").groupBy("source_id", "island").agg(F.min("ordinal").alias("ordinal"), F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda s: s["text"]).alias("t"))
    loose = packed.select("source_id", "ordinal", F.lit("text").alias("kind"), F.posexplode_outer(pack(F.col("t"), limit, "\n")).alias("part", "text"))
    tables = rows.where("block_type = 'table'").select("source_id", "ordinal", F.lit("table").alias("kind"), F.lit(0).alias("part"), "text")
    long = rows.where("alone and block_type <> 'table'").select("source_id", "ordinal", F.lit("long").alias("kind"), F.posexplode_outer(pack(sentence_units(F.col("text"), limit), limit)).alias("part", "text"))
    every = loose.unionByName(tables).unionByName(long).where("text is not null")
    return every.select("source_id", F.row_number().over(Window.partitionBy("source_id").orderBy("ordinal", "part")).alias("n"), "kind", "text")


def similarity_profile(rows: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """Cosine of each row's vector with that of the row before it; null for the first. Zero vectors stay zero."""
    v = rows.withColumn("_v", normalize(F.col(vector)))
    before = F.lag("_v").over(Window.partitionBy(key).orderBy(order))
    return v.withColumn("_b", before).withColumn("similarity", F.round(F.when(F.col("_b").isNotNull(), dot(F.col("_v"), F.col("_b"))), 6)).drop("_v", "_b")


def _neighbours(units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, total) of each document, a list of its sentences (i, t): the place and the tokens."""
    rows, doc_of, flat = len(units), pc.list_parent_indices(units).to_numpy(), pc.list_flatten(units)
    i, tokens = pc.struct_field(flat, "i").to_numpy(), pc.struct_field(flat, "t")
    of, terms = pc.list_parent_indices(tokens).to_numpy(), pc.list_flatten(tokens).dictionary_encode()
    if not len(terms):
        return np.zeros(rows, np.int64), np.zeros(rows)
    kinds, width = len(terms.dictionary), int(i.max()) + 2  # no sentence has the place before the first one
    at = doc_of.astype(np.int64) * width + i + 1
    places, place = np.unique(at[of], return_inverse=True)
    key, tf = np.unique(place * kinds + terms.indices.to_numpy(), return_counts=True)  # a term of a sentence
    place, term = np.divmod(key, kinds)
    doc = places[place] // width
    _, kind, df = np.unique(doc * kinds + term, return_inverse=True, return_counts=True)
    w = tf * (np.log((1 + np.bincount(doc_of, minlength=rows)[doc]) / (1 + df[kind])) + 1)
    w /= np.sqrt(np.bincount(place, w * w))[place]
    before = np.searchsorted(places, places - 1)
    before = np.where(places[before] == places - 1, before, -1)[place]
    other = before * kinds + term
    found = np.minimum(np.searchsorted(key, other), len(key) - 1)
    common = (before >= 0) & (key[found] == other)
    met = np.unique(place[common])
    return np.bincount(places[met] // width, minlength=rows), np.bincount(doc[common], w[common] * w[found[common]], minlength=rows)


def sentence_profile(docs: DataFrame) -> DataFrame:
    """(doc_id, pairs, total) of (doc_id, text): the pairs of neighbouring sentences with a term in common, and the sum of their TF-IDF
    cosines, term statistics being those of the document. Documents without such a pair have no row.

    A document is compared within its row, so neither texts nor terms are shuffled. Rows that share an id are one document,
    in which sentences of equal place are one; only their texts move.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            every = batch.column(1)
            sizes = pc.list_value_length(pc.struct_field(pc.list_flatten(every), "t")).to_numpy()
            ends = np.cumsum(np.bincount(pc.list_parent_indices(every).to_numpy(), sizes, batch.num_rows))
            cuts = np.flatnonzero(np.diff(ends // PROFILE_TOKENS, prepend=0))
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                pairs, total = _neighbours(every.slice(lo, hi - lo))
                some = np.flatnonzero(pairs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(some)), pa.array(pairs[some], pa.int64()), pa.array(total[some], pa.float64())], names=["doc_id", "pairs", "total"])

    docs = docs.select("doc_id", "text").where("doc_id is not null")
    repeated = broadcast_if_small(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), REPEATED_IDS)
    texts = docs.join(repeated, "doc_id", "left_anti").select("doc_id", F.array("text").alias("texts"))
    texts = texts.unionByName(docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list("text").alias("texts")))
    sentences = F.transform("texts", lambda text: F.transform(sentence_units(text), lambda s, i: F.struct(i.alias("i"), T.tfidf_tokens(s).alias("t"))))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", F.flatten(sentences).alias("units")).mapInArrow(run, f"doc_id {kind}, pairs long, total double")


def semantic_groups(rows: DataFrame, key: str, order: str, threshold: float) -> DataFrame:
    """Numbers groups of neighbouring rows: a similarity below the threshold begins a new one."""
    new = F.when(F.col("similarity") < threshold, 1).otherwise(0)
    return rows.withColumn("group", F.sum(new).over(Window.partitionBy(key).orderBy(order)))


def numbered(chunks: Column, prefix: Column) -> Column:
    """(id, text) of each chunk, numbered from one in three digits or more."""
    return let(chunks, lambda c: F.transform(c, lambda t, i: F.struct(F.concat(prefix, F.format_string("-C%03d", i + 1)).alias("id"), t.alias("text"))))
