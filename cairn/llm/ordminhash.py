"""Near-duplicates by order MinHash, verified by banded alignment.

Words are runs of letters and digits in lower case. A text's shingles are its runs of SHINGLE words, each labelled with how
many equal ones came before it. A sketch takes the PICKS labelled shingles that a random order puts first, and keeps them
in the order of the text: texts of equal shingles in another order differ. Two texts of similarity s share a sketch with
probability of about s ** PICKS, so of SKETCHES sketches a pair at 0.8 shares fewer than MIN_SHARED with probability 1e-5.

Similarity is that of an alignment of the two sequences of labelled shingles: matches in order, over all. A similarity of
0.8 leaves at most a ninth of both texts unmatched, which bounds how far a match may lie off the diagonal: the band.

Texts of the same words (by a 128-bit cryptographic digest of them) are one node. A bucket (the nodes of one sketch) is never paired out: in each round each bucket has a
leader, and each node whose class is not the leader's meets the leaders of all its buckets, save those with which it shares
fewer than LIKELY of all sketches: such a pair is seldom a link, and is left to the join below. Leaders are drawn by node in the first round, so that a group has few of them, and by
bucket in the others; every second round prefers nodes with most links in the round before, so an original meets all copies
that are alike only through it. Links move classes to lesser ones that they are linked with, and buckets of one class are done
with. Rounds go on while one links a share of the open nodes (WORTH) or more, ROUNDS at most.

Rounds only spare work; what they leave is settled exactly. All nodes that still have MIN_SHARED buckets of several classes
are joined by prefixes: of n shingles in the order of their rarity, one of the first n - 0.8 n + 1 is in any text alike. Pairs
of two classes that the bounds of length, place and rank allow are verified, whatever buckets they share. So two linked nodes
come into one class whenever they share MIN_SHARED sketches. The classes returned are the components of all links found.
Before that join, nodes are put into the components of the links that the rounds found, so it meets no pair of one class; the
FIRST likeliest pairs of two classes are verified first, and then all pairs that are of two classes still.

Leaders of many nodes are joined in SALTS parts, and classes of many nodes and texts of many copies are broadcast (there are
few such, see ``join_facts``), so no task has to hold a hot one.

Defined cases: null texts and texts without any character are each a class of their own; texts without words are compared
as they are; texts of fewer than SHINGLE words are one shingle; repeated rows are copies; a class is named by its least id
(null only if all its ids are); an empty table gives an empty one; only the id and text columns named are read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import HOT_SHARE, PLAIN, batches_of, chunks, gram_hashes, join_facts, mix64, powers, row_keys, utf8, word_hashes
from cairn.session import broadcast_if_small, discard, materialise

SHINGLE = 5
PICKS = 3
SKETCHES = 20
MIN_SHARED = 2
#: Sketches that a pair shares before a round compares it; the others are left to the join that settles what is open.
LIKELY = 6
SIMILARITY = 0.8
#: A round is followed by another if it has linked a thirtieth of the nodes in open buckets.
ROUNDS, WORTH = 10, 30
#: Parts of the nodes that meet a leader of many.
SALTS = 32
#: Pairs of two classes that are compared before all the others.
FIRST = 8
#: Texts, or pairs of texts, that a Python worker is handed at once.
BATCH = 1000
#: Links of which the facts by node are broadcast; more of them are joined by a shuffle.
FEW = 100_000
#: Texts with one shingle in their prefixes meet in blocks of about so many.
BLOCK = 256
_ORDERS = mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def labelled_shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(labelled shingle hashes, offsets of each text's, word hashes, offsets of each text's words)."""
    words, bounds = word_hashes(data, at, PLAIN)
    n_words = np.diff(bounds)
    count = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, (n_words > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(count)])
    grams = gram_hashes(words, SHINGLE)
    text = np.repeat(np.arange(len(count)), count)
    start = bounds[:-1][text] + np.arange(len(text)) - offsets[:-1][text]
    out = np.zeros(len(text), np.uint64)
    long = n_words[text] >= SHINGLE
    out[long] = grams[start[long]]
    for t in np.flatnonzero((n_words > 0) & (n_words < SHINGLE)):
        own = words[bounds[t] : bounds[t + 1]]
        out[offsets[t]] = mix64(np.array([np.sum(own * powers(len(own)))], np.uint64) + np.uint64(len(own)))[0]
    order = np.lexsort((out, text))
    same = np.zeros(len(out), bool)
    same[1:] = (out[order][1:] == out[order][:-1]) & (text[order][1:] == text[order][:-1])
    run = np.arange(len(out)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(out)))) if len(out) else np.zeros(0, np.int64)
    label = np.empty(len(out), np.int64)
    label[order] = run
    return mix64(out + label.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), offsets, words, bounds


def sketches(labelled: np.ndarray) -> np.ndarray:
    """One hash for each sketch of one text."""
    n = len(labelled)
    picks = min(PICKS, n)
    step = max(1, (1 << 21) // max(1, n))
    out = np.empty(SKETCHES, np.uint64)
    for i in range(0, SKETCHES, step):
        own = labelled[:, None] * _ORDERS[None, i : i + step]
        own ^= own >> np.uint64(29)
        first = np.argpartition(own, picks - 1, axis=0)[:picks] if n > picks else np.repeat(np.arange(n)[:, None], own.shape[1], axis=1)
        first.sort(axis=0)  # in the order of the text
        kept = labelled[first]
        code = np.zeros(own.shape[1], np.uint64)
        for k in range(picks):
            code = mix64(code + kept[k])
        out[i : i + step] = mix64(code + np.arange(i, i + own.shape[1], dtype=np.uint64))
    return out


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned matches over all labelled shingles; 0 where it is sure to be under ``least``."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    need = least / (1 + least) * (n + m)  # matches that ``least`` takes
    order = np.argsort(b, kind="stable")
    at = np.searchsorted(b[order], a)
    at[at == m] = 0
    place = order[at]
    i = np.flatnonzero(b[place] == a)
    j = place[i]
    band = n + m - 2 * need
    keep = np.abs(i - j) <= band
    j = j[keep]
    if len(j) < need - 1e-9:
        return 0.0
    if len(j) and not (np.diff(j) > 0).all():
        tails: list[int] = []
        for x in j.tolist():  # labelled shingles match once, so the alignment is a longest rising run
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        matched = len(tails)
    else:
        matched = len(j)
    return matched / (n + m - matched)


def folded_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of several texts as bytes, each word ended by one 0, and the offsets of each text's: texts of the same words are equal here."""
    base = int(at[0])
    own = PLAIN[data[base : int(at[-1])]]
    solid = own > 0
    last = solid.copy()  # the last byte of a word, or of a text within one
    last[:-1] &= ~solid[1:]
    edges = at[1:] - base - 1
    edges = edges[edges >= 0]
    last[edges] = solid[edges]
    inside = np.flatnonzero(solid)
    width = 1 + last[inside].astype(np.int64)
    to = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    out[to] = own[inside]
    return out, np.append(to, len(out))[np.searchsorted(inside, at - base)]


def scan(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, _k1, _k2, node, n, sketches), n the number of shingles: node is null for texts that have no copies by definition."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            data, at = utf8(batch.column(3))
            for i, j in chunks(at):
                labelled, offsets, _, bounds = labelled_shingles(data, at[i : j + 1])
                nodes, lists = [], []
                folded, ends = folded_words(data, at[i : j + 1])
                for t in range(j - i):
                    raw = data[at[i + t] : at[i + t + 1]]
                    if bounds[t] < bounds[t + 1]:
                        nodes.append(hashlib.blake2b(folded[ends[t] : ends[t + 1]].tobytes(), digest_size=16, person=b"words").digest())
                        lists.append(sketches(labelled[offsets[t] : offsets[t + 1]]).view(np.int64))
                    else:
                        nodes.append(hashlib.blake2b(raw.tobytes(), digest_size=16, person=b"text").digest() if len(raw) else None)
                        lists.append(np.zeros(0, np.int64))
                lens = [len(x) for x in lists]
                values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *lists])))
                own = [*(batch.column(k).slice(i, j - i) for k in range(3)), pa.array(nodes, pa.binary()), pa.array(np.diff(offsets), pa.int32()), values]
                yield pa.RecordBatch.from_arrays(own, names=["doc_id", "_k1", "_k2", "node", "n", "sketches"])

    rows = row_keys(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "doc_id", "_text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "_k1", "_k2", "_text").mapInArrow(run, f"doc_id {kind}, _k1 long, _k2 long, node binary, n int, sketches array<long>")


def _hot(pairs: DataFrame) -> DataFrame | None:
    """(b, parts): each ``b`` of very many pairs, fewer than HOT_SHARE by their share; None if there is none. ``pairs`` is a written table."""
    hot = pairs.groupBy("b").agg(F.count("*").alias("c")).where(F.col("c") * HOT_SHARE > max(pairs.count(), HOT_SHARE * SALTS)).select("b", F.lit(SALTS).alias("parts"))
    few = hot.collect()
    return pairs.sparkSession.createDataFrame(few, hot.schema) if few else None


def _salted(pairs: DataFrame, texts: DataFrame, hot: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``pairs`` with a salt, and ``texts`` as (b, salt, ...): a ``b`` of very many pairs is joined in SALTS parts."""
    if hot is None:
        return pairs.withColumn("salt", F.lit(0)), texts.withColumn("salt", F.lit(0))
    parts = F.coalesce("parts", F.lit(1))
    pairs = pairs.join(F.broadcast(hot), "b", "left").withColumn("salt", F.pmod(F.xxhash64("a"), parts).cast("int")).drop("parts")
    more = texts.join(F.broadcast(hot), "b").withColumn("salt", F.explode(F.sequence(F.lit(1), F.col("parts") - 1))).drop("parts")
    return pairs, texts.withColumn("salt", F.lit(0)).unionByName(more)


def _likely(pairs: DataFrame, texts: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Those of the pairs that share LIKELY sketches or more and whose lengths allow a link."""
    pairs, two = _salted(pairs, texts.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketches").alias("sb")), hot)
    one = texts.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketches").alias("sa"))
    lengths = F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb") - 1e-9
    both = pairs.join(one, "a").join(two, ["b", "salt"])
    return both.where(lengths & (F.size(F.array_intersect("sa", "sb")) >= LIKELY)).select("a", "b", "ca", "cb")


def _verified(pairs: DataFrame, texts: DataFrame, hot: DataFrame | None) -> DataFrame:
    """(a, b, one, two): classes and nodes of the pairs of nodes that align to SIMILARITY or more.

    ``pairs`` is (a, b, ca, cb); ``hot`` tells which ``b`` are the same node in very many pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            left, right = utf8(batch.column(4)), utf8(batch.column(5))
            both = left[1] + right[1]
            keep = np.zeros(batch.num_rows, bool)
            for i, j in chunks(both):
                (x, xo, _, _), (y, yo, _, _) = labelled_shingles(left[0], left[1][i : j + 1]), labelled_shingles(right[0], right[1][i : j + 1])
                for t in range(j - i):
                    keep[i + t] = similarity(x[xo[t] : xo[t + 1]], y[yo[t] : yo[t + 1]]) >= SIMILARITY - 1e-12
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in range(4)], names=["a", "b", "one", "two"])

    pairs, two = _salted(pairs, texts.select(F.col("node").alias("b"), F.col("_text").alias("tb")), hot)
    both = pairs.join(two, ["b", "salt"]).join(texts.select(F.col("node").alias("a"), F.col("_text").alias("ta")), "a")
    return both.select("ca", "cb", "a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary, one binary, two binary")


def connected(edges: DataFrame) -> DataFrame:
    """(node, class): the least node of each connected component, itself included, by alternating large and small stars; no list of neighbours is gathered."""

    def star(links: DataFrame, large: bool) -> DataFrame:
        sides = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = sides.join(F.broadcast(least) if few else least, "u")
        if large:  # greater neighbours to the least of the neighbourhood, a row a link
            rows = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            return rows if few else rows.distinct()
        lesser = joined.where("v < u")
        return lesser.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lesser.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    few = links.count() <= FEW  # stars make no more links than there were
    links = links if few else links.distinct()
    while True:
        before, links = links, materialise(star(star(links, True), False), "stars")
        discard(before)
        # done when each node has one link, to a node that has none
        ends = links.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(links.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        if not ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out > 0 and into > 0)").count():
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("class")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("class")).distinct())


def _hooked(links: DataFrame, few: bool) -> DataFrame:
    """(class, to): each linked class to the least one next to it, and from there once more. Components take some rounds of this. ``few`` links are broadcast."""
    sides = links.select(F.col("a").alias("class"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("class"), F.col("a").alias("v")))
    least = sides.groupBy("class").agg(F.min("v").alias("v")).select("class", F.least("class", "v").alias("to"))
    onward = least.select(F.col("class").alias("to"), F.col("to").alias("on"))
    hooked = least.join(F.broadcast(onward) if few else onward, "to").select("class", F.col("on").alias("to"))
    return F.broadcast(hooked) if few else hooked


def _meetings(members: DataFrame, step: int, links: DataFrame | None) -> DataFrame:
    """(a, b, ca, cb): nodes, the leaders of their buckets in this round, and the classes of both. ``links`` are the last round's."""
    rank = [F.xxhash64(F.lit(step), "s", "node") if step else F.xxhash64("node"), F.col("node")]
    if links is not None and step % 2:
        n = links.select(F.explode(F.array("one", "two")).alias("node")).groupBy("node").agg(F.count("*").alias("linked"))
        members = members.join(n, "node", "left")
        rank.insert(0, -F.coalesce("linked", F.lit(0)))
    first = F.min_by(F.struct("node", "class"), F.struct(*rank))
    lead = members.groupBy("s").agg(first.alias("lead"), F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("s", "lead")
    met = members.join(lead, "s").where(F.col("class") != F.col("lead.class"))
    return met.select(F.col("node").alias("a"), F.col("lead.node").alias("b"), F.col("class").alias("ca"), F.col("lead.class").alias("cb")).distinct()


def _open(members: DataFrame) -> DataFrame:
    """Members of buckets of more than one class."""
    several = members.groupBy("s").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("s")
    return members.join(several, "s", "left_semi")


def _unsettled(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, ca, cb, shared): every pair of nodes of two classes, in MIN_SHARED open buckets each, that may align to SIMILARITY or
    more, and how many shingles of their prefixes they share."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            data, at = utf8(batch.column(2))
            for i, j in chunks(at):
                labelled, offsets, _, _ = labelled_shingles(data, at[i : j + 1])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(labelled.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), lists], names=["node", "class", "shingles"])

    own = members.groupBy("node").agg(F.first("class").alias("class"), F.count("*").alias("k")).where(F.col("k") >= MIN_SHARED)
    rows = materialise(texts.join(own, "node").select("node", "class", "_text").mapInArrow(run, "node binary, class binary, shingles array<long>"), "open-shingles")
    each = rows.select("node", F.size("shingles").alias("n"), F.posexplode("shingles").alias("at", "h"))
    # shingles of one text alone come first in its order and meet nothing; the others follow by rarity
    common = materialise(each.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "common-shingles")
    text = Window.partitionBy("node")  # a row for each shingle of one text
    rank = F.col("n") - F.count("*").over(text) + F.row_number().over(text.orderBy("c", "h")) - 1
    prefix = F.col("n") - F.ceil(F.col("n") * SIMILARITY - 1e-6) + 1
    placed = each.join(common, "h").withColumn("rank", rank).where(F.col("rank") < prefix).drop("c")
    placed = materialise(placed.join(rows.select("node", "class"), "node"), "shingle-prefixes")
    several = placed.groupBy("h").agg(F.count("*").alias("m"), F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi")
    blocks = several.select("h", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    sides = placed.join(blocks, "h").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    sides = sides.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.struct("node", "class", "n", "at", "rank")
    low, high = F.least("own", "other"), F.greatest("own", "other")
    left = sides.where("own <= other").select("h", low.alias("i"), high.alias("j"), side.alias("x"))
    right = sides.where("own >= other").select("h", low.alias("i"), high.alias("j"), side.alias("y"))
    need = SIMILARITY / (1 + SIMILARITY) * (F.col("x.n") + F.col("y.n"))
    fits = (F.least("x.n", "y.n") >= SIMILARITY * F.greatest("x.n", "y.n") - 1e-9) & (F.abs(F.col("x.at") - F.col("y.at")) <= F.col("x.n") + F.col("y.n") - 2 * need + 1e-6)
    # the first shingle that two texts share leaves room for all matches that are needed
    fits = fits & (F.least(F.col("x.n") - F.col("x.rank"), F.col("y.n") - F.col("y.rank")) >= need - 1e-6)
    once = (F.col("i") < F.col("j")) | (F.col("x.node") < F.col("y.node"))
    met = left.join(right, ["h", "i", "j"]).where((F.col("x.class") != F.col("y.class")) & once & fits).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    met = met.groupBy("x.node", "x.class", "x.n", F.col("y.node").alias("b"), F.col("y.class").alias("cb"), F.col("y.n").alias("nb")).agg(F.count("*").alias("shared"))
    return met.select(F.col("node").alias("a"), "b", F.col("class").alias("ca"), "cb", "shared")


def _uncompared(pairs: DataFrame, compared: list[DataFrame]) -> DataFrame:
    """The pairs that no earlier step has compared, either way round."""
    if not compared:
        return pairs
    x, y = F.least("a", "b"), F.greatest("a", "b")
    seen = reduce(DataFrame.unionByName, (c.select(x.alias("_x"), y.alias("_y")) for c in compared))
    return pairs.withColumns({"_x": x, "_y": y}).join(seen, ["_x", "_y"], "left_anti").drop("_x", "_y")


def _relabelled(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that are still of two classes, ``classes`` (node, class) telling what has become of the old ones."""
    for side in ("ca", "cb"):
        pairs = pairs.join(classes.select(F.col("node").alias(side), F.col("class").alias("_to")), side, "left").withColumn(side, F.coalesce("_to", side)).drop("_to")
    return pairs.where("ca <> cb").select("a", "b", "ca", "cb")


def classify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, _k1, _k2, class_key, class_id, class_size, is_head) of every document. ``class_key`` is null for a class of its own."""
    with batches_of(docs.sparkSession, BATCH):
        return _classify(docs, doc_id, text)


def _classify(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    scanned = materialise(scan(docs, doc_id, text), "sketched")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "_k1", "_k2")).alias("head")
    nodes = scanned.where("node is not null").groupBy("node").agg(head, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketches").alias("sketches"))
    nodes = materialise(nodes, "nodes")
    members = materialise(_open(nodes.select("node", F.col("node").alias("class"), F.explode("sketches").alias("s"))), "bucket-members")
    # texts of the nodes that share buckets with others
    met = members.groupBy("node").agg(F.count("*").alias("k")).where(F.col("k") >= MIN_SHARED).select("node").join(nodes.select("node", "head._k1", "head._k2", "n", "sketches"), "node")
    texts = row_keys(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "doc_id", "_text").join(met, ["_k1", "_k2"]).select("node", "n", "sketches", "_text").dropDuplicates(["node"])
    texts = materialise(texts, "bucket-texts")
    links, met, compared, new, open_nodes = [], [], [], None, texts.count()
    for step in range(ROUNDS):
        pairs = materialise(_uncompared(_meetings(members, step, new), met), "meetings")
        met.append(pairs)
        hot = _hot(pairs)
        compared.append(materialise(_likely(pairs, texts, hot), "likely"))
        new = materialise(_verified(compared[-1], texts, hot), "links")
        links.append(new)
        linked = new.count()
        moved = members.join(_hooked(new, linked <= FEW), "class", "left").select("node", F.coalesce("to", "class").alias("class"), "s")
        before, members = members, materialise(_open(moved), "bucket-members")
        discard(before)
        if linked * WORTH < open_nodes:
            break
    # rounds move classes a step at a time: what is left open is told by the components of the links so far
    none = nodes.where(F.lit(False)).select(F.col("node").alias("a"), F.col("node").alias("b"))
    classes = materialise(connected(reduce(DataFrame.unionByName, (x.select("a", "b") for x in links), none)), "components")
    moved = members.select("node", "s").join(classes, "node", "left").select("node", F.coalesce("class", "node").alias("class"), "s")
    before, members = members, materialise(_open(moved), "bucket-members")
    pairs = materialise(_uncompared(_unsettled(members, texts), compared), "unsettled")
    # of two classes the likeliest pairs first: where one is a link, the others needn't be compared
    likeliest = F.row_number().over(Window.partitionBy("ca", "cb").orderBy(F.desc("shared"), "a", "b"))
    some = materialise(pairs.withColumn("_r", likeliest).where(F.col("_r") <= FIRST).select("a", "b", "ca", "cb"), "likeliest")
    for step, left in enumerate((some, None)):
        left = materialise(_uncompared(_relabelled(pairs, classes), [some]), "unlinked") if step else left
        more = materialise(_verified(left, texts, _hot(left)), "links")
        if not more.isEmpty():
            joined = classes.select(F.col("node").alias("a"), F.col("class").alias("b")).unionByName(more.select("one", "two").toDF("a", "b"))
            classes = materialise(connected(joined), "components")
    discard(before, members, pairs, texts, some, *met, *compared)
    # facts of the classes of several documents, by node, then beside every document
    several = nodes.select("node", "head", "copies").join(classes, "node", "left").where("class is not null or copies > 1")
    several = materialise(several.select("node", F.coalesce("class", "node").alias("class_key"), "head", "copies"), "nodes-of-several")
    sizes = several.groupBy("class_key").agg(F.min("head").alias("first"), F.sum("copies").alias("class_size"), F.count("*").alias("nodes"))
    facts = materialise(join_facts(several.select("node", "class_key", "copies"), sizes, "class_key", "nodes", several.count()), "classes")
    out = join_facts(scanned.select("doc_id", "_k1", "_k2", "node"), facts, "node", "copies", scanned.count())
    alone = F.col("first").isNull()
    return out.select(
        "doc_id",
        "_k1",
        "_k2",
        F.coalesce("class_key", "node").alias("class_key"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        (alone | ((F.col("first._k1") == F.col("_k1")) & (F.col("first._k2") == F.col("_k2")))).alias("is_head"),
    )


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """The documents that name their class (its least id), with the columns they had; of equal rows that do, one."""
    rows = materialise(classify(docs, doc_id=doc_id, text=text).where("class_size > 1").select("_k1", "_k2", "is_head"), "classes-of-many")
    keyed = docs.withColumns({"_k1": F.xxhash64(F.col(doc_id), F.col(text)), "_k2": F.xxhash64(F.lit(1), F.col(doc_id), F.col(text))})
    gone = broadcast_if_small(rows.where("not is_head").select("_k1", "_k2"), broadcast_rows)
    twice = rows.where("is_head").groupBy("_k1", "_k2").agg(F.count("*").alias("n")).where("n > 1").select("_k1", "_k2")
    twice = broadcast_if_small(materialise(twice, "equal-heads"), broadcast_rows)
    kept = keyed.join(gone, ["_k1", "_k2"], "left_anti")
    single = kept.join(twice, ["_k1", "_k2"], "left_anti")
    return single.unionByName(kept.join(twice, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])).select(*docs.columns)
