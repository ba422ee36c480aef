"""Repeated passages of a whole corpus, sharded by content: what the two passage operators share.

A passage is a run of ``window`` units (words or bytes) that starts at two places or more. Each window names as its anchor
the gram of least hash in it (the leftmost of equals), so equal windows name equal anchors wherever they stand:

1. every document lists the anchors of its windows (one scan, no text is shuffled);
2. anchors that occur once are dropped; the others go back to their documents, which find a *piece* for each: the run of
   windows that name it. Of a piece only its place and 128 bits of hash are kept;
3. equal pieces become one *kind* with a count and one place, by partial sums before the shuffle;
4. the text of that one place is cut out, and kinds meet by anchor in *shards* of bounded size. All kinds that hold a
   window meet in one shard, so what a shard finds about its windows holds for the corpus. The operator's own index
   (suffix automaton, suffix array) searches the shard, every kind included, with its count;
5. an anchor with more than HOT_PIECES kinds is not gathered at all: its windows are counted one by one;
6. what was found for a kind goes to all its places; kinds of very many places are broadcast, see ``join_facts``.

Nothing here is dropped, capped or sampled, and no step gathers more than a shard, a document or HOT_PIECES pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import anchors, byte_values, chunks, gram_hashes, join_facts, mix64, powers, utf8, word_hashes
from cairn.session import broadcast_if_small, discard, materialise

HOT_PIECES = 2000

#: Takes pieces (as lists of words or as bytes) and how often each occurs; gives, for each, which of its windows occur twice or more.
Searcher = Callable[[list, list[int], int], list[np.ndarray]]


@dataclass(frozen=True)
class Plan:
    unit: str  # "words" or "bytes"
    window: int
    gram: int
    shard: int  # units of text in a shard, about

    def units(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.unit == "words":
            return word_hashes(data, at)
        return byte_values(data[int(at[0]) : int(at[-1])]), at - at[0]

    def anchors(self, values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor hash, text, first window, last window) of every run of windows, windows counted within their text; and the units of each text."""
        n = len(values) - self.window + 1
        if n < 1:
            none = np.zeros(0, np.int64)
            return none, none, none, none, np.diff(bounds)
        grams = gram_hashes(values, self.gram)
        ends = np.repeat(bounds[1:], np.diff(bounds))[:n]
        place, first, last = anchors(grams, self.window - self.gram + 1, np.arange(n) + self.window <= ends)
        text = np.searchsorted(bounds, first, side="right") - 1
        # a run goes on over the end of a text only across windows that are not valid, so it lies in one text
        return grams[place].view(np.int64), text, first - bounds[text], last - bounds[text], np.diff(bounds)

    def hashes(self, values: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each run of units."""
        out = []
        for salt in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93):
            total = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(mix64(values ^ np.uint64(salt)) * powers(len(values)), out=total[1:])
            own = (total[start + size] - total[start]) * powers(len(values) + 1, down=True)[start]
            out.append(mix64(own + size.astype(np.uint64)).view(np.int64))
        return out[0], out[1]

    def split(self, text: bytes) -> list[bytes] | bytes:
        return text.split() if self.unit == "words" else text

    def cut(self, parts: list[bytes] | bytes, start: int, size: int) -> bytes:
        own = parts[start : start + size]
        return b" ".join(own) if self.unit == "words" else own


def scan(df: DataFrame, plan: Plan, digest: Callable[[bytes], bytes]) -> DataFrame:
    """(_k1, _k2, _text, doc_id) to (doc_id, _k1, _k2, n, sha, a): units, hash of the whole, and all anchors, twice those that the text repeats."""

    def run(batches: Iterator[pa.RecordBatch]):
        import hashlib

        for batch in batches:
            data, at = utf8(batch.column(3))
            for i, j in chunks(at):
                a, text, _, _, n = plan.anchors(*plan.units(data, at[i : j + 1]))
                order = np.lexsort((a, text))
                a, text = a[order], text[order]
                same = np.zeros((2, len(a)), bool)
                same[:, 1:] = (a[1:] == a[:-1]) & (text[1:] == text[:-1])
                same[1, 2:] &= same[0, 1:-1]
                same[1, :2] = False
                a, text = a[~same[1]], text[~same[1]]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(j - i + 1)), pa.int32()), pa.array(a, pa.int64()))
                sha = [hashlib.sha256(digest(data[s:e].tobytes())).hexdigest() for s, e in zip(at[i:j], at[i + 1 : j + 1], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(3)), pa.array(n, pa.int64()), pa.array(sha, pa.string()), lists], names=["doc_id", "_k1", "_k2", "n", "sha", "a"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "_k1", "_k2", "_text").mapInArrow(run, f"doc_id {kind}, _k1 long, _k2 long, n long, sha string, a array<long>")


def pieces_of(df: DataFrame, wanted: DataFrame, plan: Plan) -> DataFrame:
    """Finds the pieces of the anchors that each document has been sent: (_k1, _k2, a, start, size, p1, p2)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            data, at = utf8(batch.column(2))
            k1, k2, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            flat, where = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for i, j in chunks(at):
                values, bounds = plan.units(data, at[i : j + 1])
                a, text, first, last, _ = plan.anchors(values, bounds)
                edges = np.searchsorted(text, np.arange(j - i + 1))
                keep = np.zeros(len(a), bool)
                for t in range(j - i):
                    own = slice(edges[t], edges[t + 1])
                    keep[own] = np.isin(a[own], flat[where[i + t] : where[i + t + 1]])
                a, text, first, size = a[keep], text[keep], first[keep], (last - first)[keep] + plan.window
                p1, p2 = plan.hashes(values, bounds[text] + first, size)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (k1[i + text], k2[i + text], a, first, size, p1, p2)], names=["_k1", "_k2", "a", "start", "size", "p1", "p2"])

    names = "_k1 long, _k2 long, a long, start long, size long, p1 long, p2 long"
    return df.join(wanted, "_k1").select("_k1", "_k2", "_text", "wanted").mapInArrow(run, names)


def texts_of(df: DataFrame, kinds: DataFrame, plan: Plan) -> DataFrame:
    """Cuts out the text of one place of each kind: (a, p1, p2, n, piece). Repeated rows of ``df`` give it again."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            data, at = utf8(batch.column(0))
            asked = batch.column(1)
            flat, where = asked.flatten(), asked.offsets.to_numpy() - asked.offsets[0].as_py()
            start, size, *keys = (flat.field(k) for k in range(6))
            start, size = start.to_pylist(), size.to_pylist()
            for i, j in chunks(at):
                pieces = []
                for t in range(i, j):
                    parts = plan.split(data[at[t] : at[t + 1]].tobytes())
                    pieces += [plan.cut(parts, start[k], size[k]) for k in range(where[t], where[t + 1])]
                yield pa.RecordBatch.from_arrays([*(c.slice(where[i], where[j] - where[i]) for c in keys), pa.array(pieces, pa.binary())], names=["a", "p1", "p2", "n", "piece"])

    asked = kinds.groupBy("at._k1").agg(F.collect_list(F.struct("at.start", "size", "a", "p1", "p2", "n")).alias("asked"))  # within one document
    return df.join(asked, "_k1").select("_text", "asked").mapInArrow(run, "a long, p1 long, p2 long, n long, piece binary")


def _runs(covered: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def search_shards(texts: DataFrame, plan: Plan, search: Searcher) -> DataFrame:
    """(a, p1, p2, n, piece) to (p1, p2, n, runs): runs of windows of each piece that occur twice or more. One anchor's pieces are never parted."""

    def run(batches: Iterator[pa.RecordBatch]):
        schema = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("n", pa.int64()), ("runs", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))])

        def flush(held: list) -> pa.RecordBatch:
            found = search([plan.split(h[4]) for h in held], [h[3] for h in held], plan.window)
            rows = [(h, r) for h, c in zip(held, found, strict=True) if (r := _runs(c))]
            return pa.RecordBatch.from_pylist([{"p1": h[1], "p2": h[2], "n": h[3], "runs": [{"lo": lo, "hi": hi} for lo, hi in r]} for h, r in rows], schema=schema)

        held, size, last = [], 0, (None, None, None)
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if row[:3] == last:
                    continue
                if row[0] != last[0] and size >= plan.shard:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += row[4].count(b" ") + 1 if plan.unit == "words" else len(row[4])
                last = row[:3]
        if held:
            yield flush(held)

    ordered = texts.repartition("a").sortWithinPartitions("a", "p1", "p2")
    return ordered.mapInArrow(run, "p1 long, p2 long, n long, runs array<struct<lo:long,hi:long>>")


def _single_windows(hot: DataFrame, plan: Plan) -> DataFrame:
    """The other way for hot anchors: every window by itself, counted by its text."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for p1, p2, n, piece in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                parts = plan.split(piece)
                k = len(parts) - plan.window + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p1] * k, pa.int64()), pa.array([p2] * k, pa.int64()), pa.array([n] * k, pa.int64()), pa.array(range(k), pa.int64()), pa.array([plan.cut(parts, o, plan.window) for o in range(k)], pa.binary())],
                    names=["p1", "p2", "n", "off", "win"],
                )

    wins = hot.select("p1", "p2", "n", "piece").mapInArrow(run, "p1 long, p2 long, n long, off long, win binary")
    keyed = materialise(wins.select("p1", "p2", "n", "off", F.xxhash64("win").alias("w1"), F.xxhash64(F.lit(1), "win").alias("w2")).dropDuplicates(["p1", "p2", "off"]), "hot-windows")
    often = keyed.groupBy("w1", "w2").agg(F.sum("n").alias("_sum")).where("_sum > 1").select("w1", "w2")
    found = keyed.join(often, ["w1", "w2"], "left_semi")
    return found.groupBy("p1", "p2", "n").agg(F.collect_list(F.struct(F.col("off").alias("lo"), (F.col("off") + 1).alias("hi"))).alias("runs"))  # within one piece


def find(df: DataFrame, plan: Plan, search: Searcher, digest: Callable[[bytes], bytes]) -> tuple[DataFrame, DataFrame]:
    """(scan of all documents; (_k1, _k2, spans): merged [start, end) units of all windows that occur twice or more)."""
    scanned = materialise(scan(df, plan, digest), "anchors")
    each = scanned.select("_k1", F.explode("a").alias("a"))
    often = each.groupBy("a").agg(F.count("*").alias("_n")).where("_n > 1").select("a")
    wanted = each.join(often, "a", "left_semi").groupBy("_k1").agg(F.collect_set("a").alias("wanted"))  # within one document
    pieces = materialise(pieces_of(df, wanted, plan), "pieces")
    place = F.min(F.struct("_k1", "start")).alias("at")
    kinds = materialise(pieces.groupBy("a", "p1", "p2", "size").agg(F.count("*").alias("n"), place), "kinds")
    hot = materialise(kinds.groupBy("a").agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_PIECES).select("a"), "hot-anchors")
    texts = texts_of(df, kinds, plan)
    if hot.isEmpty():
        found = search_shards(texts, plan, search)
    else:
        few, texts = broadcast_if_small(hot, 100_000), materialise(texts, "kind-texts")
        found = search_shards(texts.join(few, "a", "left_anti"), plan, search).unionByName(_single_windows(texts.join(few, "a", "left_semi"), plan))
    found = materialise(found, "kind-repeats")
    discard(kinds)
    spans = join_facts(pieces.select("_k1", "_k2", "start", "p1", "p2"), found, ["p1", "p2"], "n", pieces.count()).where("runs is not null")
    spans = spans.select("_k1", "_k2", F.explode(F.transform("runs", lambda r: F.struct((F.col("start") + r["lo"]).alias("s"), (F.col("start") + r["hi"] + plan.window - 1).alias("e")))).alias("r"))
    return scanned, spans.groupBy("_k1", "_k2").agg(F.collect_list("r").alias("spans"))  # within one document


def without_spans(df: DataFrame, spans: DataFrame, plan: Plan, measure: Callable[[bytes, list[tuple[int, int]]], tuple]) -> DataFrame:
    """Applies ``measure`` to the text and merged spans of each document that has any: (_k1, _k2, n_removed, n_spans, kept_sha256)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            data, at = utf8(batch.column(2))
            lists, rows = batch.column(3), []
            for t in range(batch.num_rows):
                own = sorted((r["s"], r["e"]) for r in lists[t].as_py())
                merged = [list(own[0])]
                for s, e in own[1:]:
                    if s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                rows.append((sum(e - s for s, e in merged), len(merged), measure(data[at[t] : at[t + 1]].tobytes(), merged)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string())))], names=["_k1", "_k2", "n_removed", "n_spans", "kept_sha256"])

    # rows that repeat have equal results: one of them is enough
    return df.join(spans, ["_k1", "_k2"]).select("_k1", "_k2", "_text", "spans").mapInArrow(run, "_k1 long, _k2 long, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["_k1", "_k2"])
