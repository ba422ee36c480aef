"""Benchmark decontamination: a prefix-filtered set join of item windows against documents. Native functions only.

A window is ``window`` consecutive words of an item, or the whole item if it is shorter. Its set of shingles must all be in
a document that holds it, so one of them is prefix enough: the rarest in the documents. Documents meet windows on that
shingle alone; the window's place and length must fit into the document; then its words are compared one by one.

Each text is split into words once: that pass keeps how many there are and those shingles that an item has. Only documents
with a candidate are split again, to be compared.

Defined cases: null texts have no words; items without words have no windows; items of equal text count each by its own id,
an item without an id by none, though its windows hit; equal windows are looked for once; repeated rows of documents each
get their row; empty tables give zero hits; of clashing extra columns only the id and text columns named are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.binding import let
from cairn.llm.common import row_keys
from cairn.session import broadcast_if_small, discard, materialise

WINDOW = 13
SHINGLE = 4
#: Up to so many rows of 16 to 30 bytes a side is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LETTERS = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"


def words(text: Column) -> Column:
    """The words, A to Z in lower case: ``lower`` where a word is ASCII alone, else ``translate``, which is many times slower."""
    plain = lambda w: F.octet_length(w) == F.char_length(w)
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_LETTERS), 1), lambda w: F.when(plain(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER)))


def _shingles(hashes: Column, size: int) -> Column:
    """A hash for every ``size`` consecutive words, from the words' own hashes."""
    n = F.size(hashes)
    each = lambda i: F.xxhash64(F.lit(size), *(F.get(hashes, i + k) for k in range(size)))
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), each)).otherwise(F.array().cast("array<bigint>"))


def _grams(found: Column, sizes: list[int]) -> Column:
    """(n, h): the number of words, and the shingles of all sizes, one size after the other."""
    hashed = lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.struct(F.size(h).alias("n"), F.concat(*(_shingles(h, s) for s in sizes)).alias("h")))
    return let(found, hashed)


def _before(n: Column, size: Column, sizes: list[int]) -> Column:
    """How many shingles of lesser sizes stand before those of ``size``."""
    each = [F.when(size > s, F.greatest(n - s + 1, F.lit(0))).otherwise(0) for s in sizes]
    return reduce(lambda a, b: a + b, each)


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words) to (item_id, win, m): every window of every item."""
    n = F.size("words")
    cut = F.when(n >= window, F.transform(F.sequence(F.lit(0), n - window), lambda i: F.slice("words", i + 1, window))).when(n > 0, F.array("words")).otherwise(F.array().cast("array<array<string>>"))
    return items.select("item_id", F.explode_outer(cut).alias("win")).where(F.col("win").isNotNull()).select("item_id", F.array_join("win", " ").alias("win"), F.size("win").alias("m")).distinct()


def _exploded(rows: DataFrame, found: Column, sizes: list[int], *keep: str) -> DataFrame:
    """A row for each shingle, or one with nulls: (keep, n, at, h), ``at`` its place among those of all sizes.

    The outer form, and a filter after it: for the plain form the optimiser would add a filter on the array's size and, in
    pushing it down, put the word list's regular expression inside the loop over its own words.
    """
    return rows.select(*keep, _grams(found, sizes).alias("g")).select(*keep, F.col("g.n").alias("n"), F.posexplode_outer("g.h").alias("at", "h"))


def hits(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """((doc_id, _k1, _k2, n_words) of all documents; (_k1, _k2, n_hit, items) of documents that hold windows)."""
    docs = row_keys(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "doc_id", "_text")
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), words(F.col(item_text)).alias("words"))
    wins = materialise(windows(items, window), "item-windows")
    unique = materialise(wins.select("win", "m").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    sizes = sorted(r[0] for r in unique.select(F.least("m", F.lit(shingle)).alias("s")).distinct().collect()) or [shingle]  # at most ``shingle`` rows
    # 1. which of the items' shingles the documents hold, and where
    size = F.least("m", F.lit(shingle))
    each = _exploded(unique, F.split("win", " "), sizes, "wid", "m").where("h is not null").withColumn("pos", F.col("at") - _before(F.col("n"), size, sizes))
    each = materialise(each.where((F.col("pos") >= 0) & (F.col("pos") <= F.col("m") - size)).select("wid", "m", "pos", "h", size.alias("size")), "item-shingles")
    wanted = broadcast_if_small(each.select("h", "size").distinct(), broadcast_rows)
    # a document's first row stays, whatever its shingle, for its number of words
    seen = _exploded(docs, words(F.col("_text")), sizes, "doc_id", "_k1", "_k2").join(wanted, "h", "left").where("size is not null or at is null or at = 0")
    seen = materialise(seen.select("doc_id", "_k1", "_k2", "n", (F.col("at").isNull() | (F.col("at") == 0)).alias("first"), (F.col("at") - _before(F.col("n"), F.col("size"), sizes)).alias("pos"), "size", F.when(F.col("size").isNotNull(), F.col("h")).alias("h")), "shingle-matches")
    matches = seen.where("h is not null").select("_k1", "_k2", "n", "pos", "h")
    # 2. rarity: the rarest shingle of a window stands for it; a window with one that no document holds can't occur
    counts = matches.groupBy("h").agg(F.count("*").alias("c"))
    prefix = each.join(counts, "h", "left").groupBy("wid", "m").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "pos", "h")).alias("p")).where(F.col("p.c") > 0)
    prefix = materialise(prefix.select("wid", "m", F.col("p.pos").alias("off"), F.col("p.h").alias("h")), "item-prefixes")
    # 3. candidates within the bounds of place and length
    start = F.col("pos") - F.col("off")
    cands = matches.join(broadcast_if_small(prefix, broadcast_rows // 4), "h").where((start >= 0) & (start + F.col("m") <= F.col("n")))
    cands = materialise(cands.groupBy("_k1", "_k2").agg(F.collect_set(F.struct(start.alias("start"), "m", "wid")).alias("cands")), "window-candidates")  # within one document
    # 4. exact containment: the words at each place, held against the window's
    near = docs.join(broadcast_if_small(cands.select("_k1", "_k2"), broadcast_rows), ["_k1", "_k2"], "left_semi").join(cands, ["_k1", "_k2"])
    held = let(words(F.col("_text")), lambda w: F.transform("cands", lambda c: F.struct(c["start"].alias("start"), c["m"].alias("m"), c["wid"].alias("wid"), F.array_join(F.slice(w, c["start"] + 1, c["m"]), " ").alias("win"))))
    placed = near.select("_k1", "_k2", F.explode_outer(held).alias("c")).select("_k1", "_k2", "c.start", "c.m", "c.wid", "c.win")
    sure = materialise(placed.join(broadcast_if_small(unique.select("wid", "win"), broadcast_rows // 8), ["wid", "win"]).select("_k1", "_k2", "start", "m", "wid"), "window-hits")
    cover = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, c: F.struct(F.greatest(a["end"], c["start"] + c["m"]).alias("end"), (a["n"] + F.greatest(F.lit(0), c["start"] + c["m"] - F.greatest(a["end"], c["start"]))).alias("n")),
    )["n"]
    hit = sure.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("start", "m")).alias("spans")).select("_k1", "_k2", cover.cast("long").alias("n_hit"))
    of_items = sure.select("_k1", "_k2", "wid").distinct().join(unique.select("wid", "win"), "wid").join(wins.select("item_id", "win"), "win").groupBy("_k1", "_k2").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = materialise(hit.join(of_items, ["_k1", "_k2"], "left").select("_k1", "_k2", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items")), "documents-hit")
    discard(each, prefix, cands, sure, unique, wins)
    return seen.where("first").select("doc_id", "_k1", "_k2", F.col("n").cast("long").alias("n_words")), found


def contamination(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """One row per document: words, hit words, items with occurring windows, and the verdict (a twentieth of its words hit)."""
    rows, found = hits(docs, benchmark, **names)
    found = found.select("_k1", "_k2", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    out = rows.join(broadcast_if_small(found, BROADCAST_ROWS // 2), ["_k1", "_k2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **names) -> DataFrame:
    """The documents that are not contaminated, with the columns they had."""
    rows, found = hits(docs, benchmark, doc_id=doc_id, text=text, **names)
    bad = rows.join(broadcast_if_small(found.select("_k1", "_k2", "n_hit"), BROADCAST_ROWS), ["_k1", "_k2"]).where("n_hit > 0 and n_hit * 20 >= n_words").select("_k1", "_k2").distinct()
    own = docs.select(F.struct("*").alias("_row"), F.xxhash64(F.col(doc_id), F.col(text)).alias("_k1"), F.xxhash64(F.lit(1), F.col(doc_id), F.col(text)).alias("_k2"))
    return own.join(broadcast_if_small(materialise(bad, "contaminated"), BROADCAST_ROWS), ["_k1", "_k2"], "left_anti").select("_row.*")


ORACLE = rf"""
WITH it AS (SELECT item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - {WINDOW}, 0) + 2), lambda i: array_to_string(w[i:i + {WINDOW} - 1], ' '))) AS win, least(len(w), {WINDOW}) AS m FROM it WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
lens AS (SELECT DISTINCT m FROM win),
pos AS (SELECT r, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM d, lens WHERE len(w) >= m),
occ AS (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS win FROM pos),
hit AS (SELECT o.r, o.i, o.m, w.item_id FROM occ o JOIN win w ON o.win = w.win),
per AS (
  SELECT r, len(list_distinct(flatten(list(range(i, i + m))))) AS n_hit, count(DISTINCT item_id) AS n_items,
    sha256(array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',')) AS items_sha256 FROM hit GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN per USING (r)
"""
