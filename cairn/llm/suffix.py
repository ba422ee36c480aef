"""Suffix-array dedup over bytes, by external induced sorting.

A shard's text is sorted without comparing suffixes. The suffixes that start a rise after a fall (the *seeds*) are sorted
first, as a shorter text over names of what lies between them, by recursion. From them two sweeps induce the rest: in
ascending order each suffix hands the one that starts a byte earlier to the queue of that byte, then in descending order
again. A queue is read in the order in which it was filled once the sweep comes to its byte, so the queues of all bytes
together are a priority queue on (byte, arrival). They hold tuples of a suffix and the length of the prefix that it shares
with the tuple before it, keep a bounded number of tuples in memory and the others in files.

The shared prefix of two suffixes handed to one queue is one more than the least shared prefix between the two that handed
them on, so it comes with the sweep, without reading the text. Prefixes are counted up to ``cap`` bytes only: that is as
much order as the operator needs, and suffixes that share so much may stand in any order among themselves.

A text that doesn't fit into memory is a mapped file, as are the arrays of its length; names that don't fit are spelt
in two digits and sorted by the same sweeps (``BASE_ROWS`` sets when).

Defined cases: a null text is empty; texts shorter than the window lose nothing; equal rows are two documents, so their
windows repeat; matches don't cross documents; an empty table gives an empty one; only the columns named are read.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import repeats
from cairn.llm.common import mix64, powers, row_keys

WINDOW = 200
PLAN = repeats.Plan("bytes", WINDOW, gram=32, shard=2_500_000)
#: Tuples that the queues of one sweep keep in memory.
QUEUE_ROWS = 1 << 18
#: Tuples that one step handles.
BLOCK = 1 << 15
#: Names sorted in memory at most; more of them are sorted by recursion.
BASE_ROWS = 1 << 24
_DIGIT = 4096

Tuples = tuple[np.ndarray, np.ndarray]


class Queues:
    """First-in first-out queues of (suffix, shared prefix), one for each byte; beyond a number of rows they are in files."""

    def __init__(self, folder: str, name: str, rows: int | None = None) -> None:
        self.path, self.rows, self.held = os.path.join(folder, name), QUEUE_ROWS if rows is None else rows, 0
        self.memory: dict[int, list[Tuples]] = {}
        self.files: dict[int, int] = {}  # rows written of each queue

    def push(self, key: int, at: np.ndarray, shared: np.ndarray) -> None:
        self.memory.setdefault(key, []).append((at, shared))
        self.held += len(at)
        if self.held > self.rows:
            small, kept = self.rows // (2 * len(self.memory)), {}  # a file for a few rows costs more than it frees; all that stay are half of the bound
            for k, parts in self.memory.items():
                if sum(len(x) for x, _ in parts) <= small:
                    kept[k] = parts
                    continue
                with open(f"{self.path}-{k}.at", "ab") as a, open(f"{self.path}-{k}.shared", "ab") as b:
                    np.concatenate([x for x, _ in parts]).tofile(a)
                    np.concatenate([y for _, y in parts]).tofile(b)
                self.files[k] = self.files.get(k, 0) + sum(len(x) for x, _ in parts)
            self.memory, self.held = kept, sum(len(x) for parts in kept.values() for x, _ in parts)

    def _blocks(self, name: str, rows: int, backward: bool) -> Iterator[Tuples]:
        starts = range(0, rows, BLOCK)
        with open(f"{name}.at", "rb") as a, open(f"{name}.shared", "rb") as b:
            for i in reversed(starts) if backward else starts:
                a.seek(i * 8)
                b.seek(i * 2)
                yield np.fromfile(a, np.int64, min(BLOCK, rows - i)), np.fromfile(b, np.int16, min(BLOCK, rows - i))

    def take(self, key: int) -> Iterator[Tuples]:
        """What has arrived, in that order; it is gone then. What arrives meanwhile waits for the next call."""
        rows, parts = self.files.pop(key, 0), self.memory.pop(key, [])
        self.held -= sum(len(x) for x, _ in parts)
        if rows:
            name = f"{self.path}-{key}"
            for kind in ("at", "shared"):  # what arrives meanwhile gets a file of its own
                os.rename(f"{name}.{kind}", f"{name}-taken.{kind}")
            yield from self._blocks(f"{name}-taken", rows, False)
            for kind in ("at", "shared"):
                os.remove(f"{name}-taken.{kind}")
        if parts:
            at, shared = (np.concatenate(x) for x in zip(*parts, strict=True))
            for i in range(0, len(at), BLOCK):
                yield at[i : i + BLOCK], shared[i : i + BLOCK]

    def backward(self, key: int) -> Iterator[Tuples]:
        """What has arrived, last first."""
        if parts := self.memory.get(key, []):
            at, shared = (np.concatenate(x)[::-1] for x in zip(*parts, strict=True))
            for i in range(0, len(at), BLOCK):
                yield at[i : i + BLOCK], shared[i : i + BLOCK]
        if key in self.files:
            for at, shared in self._blocks(f"{self.path}-{key}", self.files[key], True):
                yield at[::-1], shared[::-1]


class Sweep:
    """Hands suffixes on to the queues of the bytes before them, with what they share (nothing, if ``cap`` is 0)."""

    def __init__(self, text: np.ndarray, rises: np.ndarray, to_rises: bool, sigma: int, cap: int, queues: Queues) -> None:
        self.text, self.rises, self.to_rises, self.cap, self.queues = text, rises, to_rises, cap, queues
        self.least = np.zeros(sigma, np.int16)  # least shared prefix since each queue's last arrival

    def feed(self, at: np.ndarray, shared: np.ndarray) -> None:
        m = len(at)
        before = at - 1
        pick = np.flatnonzero((before >= 0) & (self.rises[before] == self.to_rises))
        if not len(pick):
            if self.cap:
                np.minimum(self.least, shared.min(), out=self.least)
            return
        byte = self.text[before[pick]]
        order = np.argsort(byte, kind="stable")
        pick, byte = pick[order], byte[order]
        head = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
        target = before[pick]
        if not self.cap:  # only the order is asked for
            value = np.zeros(len(pick), np.int16)
            for h, t in zip(head.tolist(), [*head[1:].tolist(), len(pick)], strict=True):
                self.queues.push(int(byte[h]), target[h:t], value[h:t])
            return
        tail = np.append(head[1:], len(pick)) - 1
        low = np.minimum.accumulate(shared)
        value = np.empty(len(pick), np.int16)
        value[head] = np.minimum(self.least[byte[head]], low[pick[head]])
        rest = np.ones(len(pick), bool)
        rest[head] = False
        rest = np.flatnonzero(rest)
        if len(rest):
            value[rest] = _range_min(shared, pick[rest - 1] + 1, pick[rest])
        np.minimum(value + 1, self.cap, out=value)
        np.minimum(self.least, low[-1], out=self.least)
        after = np.append(np.minimum.accumulate(shared[::-1])[::-1], np.int16(self.cap))
        self.least[byte[tail]] = after[np.minimum(pick[tail] + 1, m)]
        for h, t in zip(head.tolist(), (tail + 1).tolist(), strict=True):
            self.queues.push(int(byte[h]), target[h:t], value[h:t])


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo..hi], both ends included, for many ranges, by a table of the minima of powers of two."""
    level = np.frexp(hi - lo + 1)[1] - 1
    out = np.empty(len(lo), values.dtype)
    row, have = values, 0
    for k in range(int(level.max()) + 1):
        if k > have:
            row, have = np.minimum(row[: -(1 << have)], row[1 << have :]), k
        own = np.flatnonzero(level == k)
        if len(own):
            out[own] = np.minimum(row[lo[own]], row[hi[own] - (1 << k) + 1])
    return out


def _array(folder: str, name: str, kind, n: int) -> np.ndarray:
    return np.memmap(os.path.join(folder, name), kind, "w+", shape=(n,)) if n > BASE_ROWS else np.zeros(n, kind)


def _rises(text: np.ndarray, folder: str) -> np.ndarray:
    """Whether each suffix is less than the one after it; the last, a byte less than all others, counts as one that is."""
    n = len(text)
    out = _array(folder, "rises", bool, n)
    out[n - 1] = True
    hi = n - 1
    while hi > 0:
        lo = max(0, hi - (1 << 20))
        step = text[lo + 1 : hi + 1].astype(np.int32) - text[lo:hi]
        same = np.arange(hi - lo)
        same[step == 0] = hi - lo
        nearest = np.minimum.accumulate(same[::-1])[::-1]
        value = np.append(step > 0, out[hi])
        out[lo:hi] = value[nearest]
        hi = lo
    return out


def _run(text: np.ndarray, at: int, cap: int) -> int:
    own = text[at : at + max(1, cap)]
    other = np.flatnonzero(own != own[0])
    return int(other[0]) if len(other) else len(own)


def _induce(text: np.ndarray, rises: np.ndarray, seeds: np.ndarray, seed_shared: np.ndarray, sigma: int, cap: int, folder: str, name: str) -> Iterator[Tuples]:
    """Sorted seeds to all suffixes, in blocks of (suffix, prefix shared with the one before), greatest first."""
    falls, done = Queues(folder, f"{name}-falls"), Queues(folder, f"{name}-done")
    up = Sweep(text, rises, False, sigma, cap, falls)
    first_byte = text[seeds]
    edge = np.searchsorted(first_byte, np.arange(sigma + 1))
    for c in range(sigma):
        last, fresh = -1, True
        while True:
            got = False
            for at, shared in falls.take(c):
                got = True
                if fresh:
                    shared = shared.copy()
                    shared[0], fresh = 0, False
                up.feed(at, shared)
                done.push(c, at, shared)
                last = int(at[-1])
            if not got:
                break
        for i in range(edge[c], edge[c + 1], BLOCK):
            at, shared = seeds[i : min(i + BLOCK, edge[c + 1])], seed_shared[i : min(i + BLOCK, edge[c + 1])].copy()
            if i == edge[c]:
                shared[0] = min(_run(text, last, cap), _run(text, int(at[0]), cap)) if last >= 0 else 0
            up.feed(at, shared)
    rest = Queues(folder, f"{name}-rises")
    down = Sweep(text, rises, True, sigma, cap, rest)
    for c in range(sigma - 1, -1, -1):
        last, fresh = -1, True
        if c == int(text[-1]):  # the least suffix of all, which no other hands on
            tail = (np.array([len(text) - 1]), np.zeros(1, np.int16))
            down.feed(*tail)
            yield tail
            continue
        while True:
            got = False
            for at, shared in rest.take(c):
                got = True
                if fresh:
                    shared = shared.copy()
                    shared[0], fresh = 0, False
                down.feed(at, shared)
                yield at, shared
                last = int(at[-1])
            if not got:
                break
        carry = None
        for at, shared in done.backward(c):
            own = np.empty_like(shared)
            own[1:] = shared[:-1]
            own[0] = carry if carry is not None else min(_run(text, last, cap), _run(text, int(at[0]), cap)) if last >= 0 else 0
            carry = shared[-1]
            at = np.ascontiguousarray(at)
            down.feed(at, own)
            yield at, own


def _shared_prefixes(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """For each suffix of a sorted list, the bytes that it shares with the one before, ``cap`` at most; read from the text."""
    out = np.zeros(len(order), np.int16)
    size = text.itemsize
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers(len(text)), out=total[1:])
    down = powers(len(text) + 1, down=True)
    padded = np.concatenate([text, np.zeros(16 // size, text.dtype)])
    words = np.ndarray((len(text),), np.uint64, padded, strides=(size,))  # eight bytes from each place
    for i in range(1, len(order), BLOCK):
        a, b = order[i - 1 : i - 1 + BLOCK][: len(order) - i], order[i : i + BLOCK]
        # those that share ``cap`` are told by a hash; the text ends in a symbol of its own, so none of them is cut by its end
        ends = [np.minimum(x + cap, len(text)) for x in (a, b)]
        whole = ((total[ends[0]] - total[a]) * down[a] == (total[ends[1]] - total[b]) * down[b]) & (np.maximum(a, b) + cap <= len(text))
        have = np.where(whole, cap, 0)
        open_ = np.flatnonzero(~whole)
        while len(open_):
            # the last symbol is like no other, so two places differ before either runs out
            differ = words[a[open_] + have[open_]] ^ words[b[open_] + have[open_]]
            ended = differ != 0
            lowest = differ[ended] & (~differ[ended] + np.uint64(1))
            have[open_[ended]] += (np.frexp(lowest.astype(np.float64))[1] - 1) // (8 * size)
            open_ = open_[~ended]
            have[open_] += 8 // size
            open_ = open_[have[open_] < cap]
        out[i : i + len(b)] = np.minimum(have, cap)
    return out


def _sort_names(names: np.ndarray, cap: int, folder: str, depth: int) -> np.ndarray:
    """Places of a sequence of names in the order of what follows them, as far as ``cap`` names tell."""
    n, top = len(names), int(names.max()) + 1
    if top == n:
        out = np.empty(n, np.int64)
        out[names] = np.arange(n)
        return out
    if n > BASE_ROWS and top < _DIGIT * _DIGIT:
        digits = np.empty(2 * n + 1, np.uint16)
        digits[0:-1:2], digits[1:-1:2], digits[-1] = names // _DIGIT + 1, names % _DIGIT + 1, 0
        order = np.concatenate([at for at, _ in suffixes(digits, _DIGIT + 2, 2 * cap, folder, depth + 1)])[::-1]
        order = order[(order % 2 == 0) & (order < 2 * n)] // 2
        return order
    rank, h = names.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - h] = rank[h:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key)
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank, h = new, 2 * h
        if int(rank[order[-1]]) == n - 1 or h >= min(n, cap):
            return order


def suffixes(text: np.ndarray, sigma: int, cap: int, folder: str, depth: int = 0) -> Iterator[Tuples]:
    """All suffixes, greatest first, with the prefix each shares with the one before. The text ends in its only 0."""
    folder = os.path.join(folder, f"level{depth}")
    os.makedirs(folder)
    rises = _rises(text, folder)
    seeds = np.flatnonzero(rises[1:] & ~rises[:-1]) + 1
    if len(seeds) > 1:
        # names: sort the stretches between seeds by one round of the sweeps, then compare neighbours
        rough = seeds[np.argsort(text[seeds], kind="stable")]
        is_seed = _array(folder, "seeds", bool, len(text))
        is_seed[seeds] = True
        parts = [at[is_seed[at]] for at, _ in _induce(text, rises, rough, np.zeros(len(rough), np.int16), sigma, 0, folder, "names")]
        order = np.concatenate(parts)[::-1]
        place = np.searchsorted(seeds, order)
        length = np.append(np.diff(seeds), 0) + 1
        hashes = _stretch_hashes(text, seeds, length)
        differs = np.append(False, (length[place][1:] != length[place][:-1]) | (hashes[place][1:] != hashes[place][:-1]))
        names = np.empty(len(seeds), np.int64)
        names[place] = np.cumsum(differs)
        seeds = seeds[_sort_names(names, cap // 2 + 1, folder, depth)]  # a name takes up two symbols at least
    yield from _induce(text, rises, seeds, _shared_prefixes(text, seeds, cap), sigma, cap, folder, "all")


def _stretch_hashes(text: np.ndarray, seeds: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches from each seed up to the next."""
    out = np.empty(len(seeds), np.uint64)
    for i in range(0, len(seeds), 1 << 18):
        s, n = seeds[i : i + (1 << 18)], length[i : i + (1 << 18)]
        lo, hi = int(s[0]), int(s[-1] + n[-1])
        values = mix64(text[lo:hi].astype(np.uint64) + np.uint64(1))
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(len(values)), out=total[1:])
        out[i : i + len(s)] = (total[np.minimum(s + n, hi) - lo] - total[s - lo]) * powers(len(values) + 1, down=True)[s - lo]
    return out


def repeated_starts(text: np.ndarray, sigma: int, window: int, often: np.ndarray) -> np.ndarray:
    """Whether the ``window`` symbols from each place also start elsewhere: neighbours in the order that share so much.

    ``often`` marks the places of pieces that stand for several. Files lie in the executor's own scratch folder, as spilled
    rows do, and are gone with the call.
    """
    out = np.zeros(len(text), bool)
    last = -1
    with tempfile.TemporaryDirectory(prefix="suffix-", dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as folder:
        for at, shared in suffixes(text, sigma, window, folder):
            hit = shared >= window
            out[at] |= often[at]
            out[at[hit]] = True
            before = np.append(last, at[:-1])
            out[before[hit]] = True
            last = int(at[-1])
    return out


def search(pieces: list[bytes], counts: list[int], window: int) -> list[np.ndarray]:
    """The windows of each piece that occur twice or more in the shard. Pieces are parted by a symbol that no byte has."""
    whole = b"".join(pieces)
    lens = np.array([len(p) for p in pieces])
    starts = np.concatenate([[0], np.cumsum(lens + 1)[:-1]]).astype(np.int64)
    raw = np.frombuffer(whole, np.uint8)
    kind = np.uint8 if len(raw) and raw.max() < 254 else np.uint16  # UTF-8 has no byte beyond 244
    text = np.ones(len(whole) + len(pieces) + 1, kind)
    text[np.arange(len(whole)) + np.repeat(np.arange(len(pieces)), lens)] = raw.astype(kind) + kind(2)
    text[-1] = 0
    often = np.zeros(len(text), bool)
    often[: len(text) - 1] = np.repeat(np.array(counts) > 1, lens + 1)
    flags = repeated_starts(text, 258, window, often)
    return [flags[s : s + n - window + 1] for s, n in zip(starts.tolist(), lens.tolist(), strict=True)]


def _kept(text: bytes, spans: list) -> str:
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:s])
        at = e
    return hashlib.sha256(b"".join([*out, text[at:]])).hexdigest()


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", plan: repeats.Plan = PLAN) -> DataFrame:
    """One row per document: bytes, bytes removed as repeats of the corpus, removed runs, and the hash of what is kept."""
    rows = row_keys(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "doc_id", "_text")
    scanned, spans = repeats.find(rows, plan, search, bytes)
    removed = repeats.without_spans(rows, spans, plan, _kept)
    none = F.lit(0).cast("long")
    return scanned.join(removed, ["_k1", "_k2"], "left").select(
        "doc_id", F.col("n").alias("n_bytes"), F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")
    )




ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, i, md5(substr(h, 2 * i - 1, {2 * WINDOW})) AS m FROM (SELECT r, h, unnest(range(1, length(h) // 2 - {WINDOW} + 2)) AS i FROM d WHERE length(h) >= {2 * WINDOW})),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY m) AS n FROM p) WHERE n > 1),
isl AS (SELECT r, i, CASE WHEN i - lag(i) OVER w <= {WINDOW} THEN 0 ELSE 1 END AS new FROM rep WINDOW w AS (PARTITION BY r ORDER BY i)),
num AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM isl),
runs AS (SELECT r, g, min(i) AS s, max(i) + {WINDOW} AS e FROM num GROUP BY r, g),
gaps AS (SELECT r, g, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY g), 1) AS prev FROM runs),
per AS (SELECT gaps.r, sum(e - s) AS n, count(*) AS k, string_agg(substr(h, 2 * prev - 1, 2 * (s - prev)), '' ORDER BY g) || substr(any_value(h), 2 * max(e) - 1) AS kept FROM gaps JOIN d USING (r) GROUP BY gaps.r)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(per.n, 0)::BIGINT AS n_removed, coalesce(per.k, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(per.kept, d.h))) AS kept_sha256
FROM d LEFT JOIN per USING (r)
"""
