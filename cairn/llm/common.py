"""What the operators share: row keys, native word lists, prefix sums, and numpy views of Arrow text."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.binding import let

#: Bytes of text that one numpy step holds at a time; bounds a task's memory whatever an Arrow batch holds.
CHUNK_BYTES = 1 << 20


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside hands Python batches of so many rows at most: what a batch of long texts takes, twice in the JVM and twice in Python, is bounded by it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def row_keys(df: DataFrame, *cols: str) -> DataFrame:
    """Adds ``_k1`` and ``_k2``: 128 bits that name a row by its content, so null or repeated ids do no harm."""
    args = [F.col(c) for c in cols]
    return df.withColumns({"_k1": F.xxhash64(*args), "_k2": F.xxhash64(F.lit(1), *args)})


#: A key with more than one in so many of all rows is hot; there are fewer hot keys than this.
HOT_SHARE = 1000


def join_facts(rows: DataFrame, facts: DataFrame, key: str | list[str], count: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``facts`` (one row a key), null where there is none. Hot keys don't meet in one task.

    ``count`` of ``facts`` says how many of the ``total`` rows have the key, so hot keys, by number fewer than HOT_SHARE,
    are broadcast; rows of hot keys, and of null ones, are spread over the shuffle that joins the others.
    """
    hot = F.col(count) * HOT_SHARE > total
    keys = [key] if isinstance(key, str) else key
    own = [c for c in facts.columns if c not in (*keys, count)]
    few = facts.where(hot).select(*keys, F.struct(*own).alias("_hot"))
    many = facts.where(~hot).select(*keys, F.lit(0).cast("long").alias("_salt"), F.struct(*own).alias("_cold"))
    out = rows.join(F.broadcast(few), keys, "left")
    absent = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    spread = F.when(F.col("_hot").isNotNull() | absent, F.xxhash64(*(F.col(c) for c in rows.columns if c not in keys)).bitwiseOR(F.lit(1).cast("long"))).otherwise(F.lit(0).cast("long"))
    out = out.withColumn("_salt", spread).join(many, [*keys, "_salt"], "left")
    return out.select(*rows.columns, *(F.coalesce(f"_hot.{c}", f"_cold.{c}").alias(c) for c in own))


def prefix_sums(lens: Column, block: int = 128) -> Column:
    """Sums of all elements before each one, native; about ``block`` steps for each element, at any length."""
    zero = F.lit(0)

    def total(a: Column, start: Column, n: Column) -> Column:
        return F.aggregate(F.slice(a, start + 1, n), zero, lambda s, x: s + x)

    def sums(own: Column, blocks: Column) -> Column:
        return F.transform(own, lambda _, i: total(blocks, zero, F.floor(i / block).cast("int")) + total(own, F.floor(i / block).cast("int") * block, i % block))

    def blocks(own: Column) -> Column:
        return F.transform(F.sequence(zero, F.floor(F.size(own) / block).cast("int")), lambda b: total(own, b * block, F.lit(block)))

    return let(lens, lambda own: let(blocks(own), lambda b: sums(own, b)))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def chunks(at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes together; a larger row stands alone."""
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int, down: bool = False) -> np.ndarray:
    """Powers of the odd hash base modulo 2**64, or of its inverse."""
    name = "down" if down else "up"
    if len(_powers[name]) < n:
        base = np.uint64(pow(int(_BASE), -1, 1 << 64)) if down else _BASE
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[name] = np.multiply.accumulate(have)
    return _powers[name][:n]


#: Letters and digits in lower case, other ASCII as the end of a word, bytes beyond ASCII as they are.
PLAIN = np.zeros(256, np.uint8)
PLAIN[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = list(b"0123456789abcdefghijklmnopqrstuvwxyz")
PLAIN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = list(b"abcdefghijklmnopqrstuvwxyz")
PLAIN[128:] = np.arange(128, 256)


def word_hashes(data: np.ndarray, at: np.ndarray, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of several texts, and the offsets of each text's words.

    Words are runs without ASCII whitespace, or, with ``fold``, runs of bytes that it doesn't map to 0, mapped by it.
    """
    base = int(at[0])
    data = data[base : int(at[-1])]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    if fold is None:
        solid = ~_SPACE[data]
    else:
        data = fold[data]
        solid = data > 0
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = at[:-1] - base
    edges = edges[edges < len(data)]
    first[edges] = solid[edges]
    starts = np.flatnonzero(first)
    bounds = np.searchsorted(starts, at - base)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    inside = np.flatnonzero(solid)
    begin = np.searchsorted(inside, starts)
    lens = np.diff(np.append(begin, len(inside)))
    within = np.arange(len(inside)) - np.repeat(begin, lens)
    value = _BYTES[data[inside]] * powers(int(lens.max()))[within]
    return mix64(np.add.reduceat(value, begin) + lens.astype(np.uint64)), bounds


def gram_hashes(values: np.ndarray, q: int) -> np.ndarray:
    """A hash of every ``q`` consecutive values."""
    n = len(values)
    if n < q:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(n), out=total[1:])
    return mix64((total[q:] - total[: n - q + 1]) * powers(n - q + 1, down=True))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTES[data]


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """The least of every ``w`` consecutive values, by doubling."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def anchors(grams: np.ndarray, w: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of ``w`` grams that is valid, the leftmost gram of least hash; as (gram, first window, last window) runs.

    Equal windows choose the gram at the same place in them, wherever they stand, so equal windows share their anchor's hash.
    """
    none = np.zeros(0, np.int64)
    if len(grams) < w or not valid.any():
        return none, none, none
    n = len(grams)
    if n < 1 << 24:
        low = np.uint64((1 << 24) - 1)
        place = (sliding_min((grams & ~low) | np.arange(n, dtype=np.uint64), w) & low).astype(np.int64)
    else:  # the same order, where places need more than 24 bits
        order = np.argsort(grams >> np.uint64(24), kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        place = order[sliding_min(rank, w)]
    ok = valid[: len(place)]
    change = np.ones(len(place), bool)
    change[1:] = (place[1:] != place[:-1]) | (ok[1:] != ok[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(place)) - 1
    keep = ok[first]
    first, last = first[keep], last[keep]
    return place[first], first, last
