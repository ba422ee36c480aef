"""Approximate nearest neighbours with a hash-prefix forest.

Each vector gets TREES strings of BITS bits, the sides of random planes on which it lies; they are made once and kept beside
it. The index is cut into blocks of about BLOCK_ROWS different vectors; each block holds a forest: for each tree the sorted
array of its strings. A query descends in each array to the rows that share the longest prefix with its own string, until it
has k of them, and scores them, exactly and in double precision. Then all trees ascend together, to the depth at which a row
as near as the query's k-th best so far would have been met with probability 1 - MISS: two vectors at an angle t share a
prefix of d bits with probability (1 - t / pi) ** d, and there are TREES chances. So how many rows are scored follows the
data: few where neighbours are close (clusters), about half of a block where they are not (independent directions in 64
dimensions, whose 20th neighbour lies at 65 degrees or more). The rule is the same at every size.

For inner products of vectors of different lengths, index vectors get one more component that makes all lengths equal, and
queries get a zero: then the largest inner product is the least angle.

The query set is cut into groups of QUERY_ROWS, so a task holds one block and one group, whatever the sizes; the best of all
blocks are merged. Vectors that are equal are one in the index, with their k + 1 smallest ids: more can't be among k nearest
with ties to the smaller id. So a vector that a third of all rows hold is one row. ``exact`` is the search without a forest.

Defined cases: vectors that are null, empty, all zero, or hold a null or non-finite component take no part, nor do rows
without an id; rows of equal id and vector are one; vectors of different lengths are not compared; an empty table gives an
empty one; only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.session import materialise

K = 20
TREES, BITS = 128, 64
BLOCK_ROWS, QUERY_ROWS = 16384, 1024
#: Probability that a row as near as the k-th best is not met.
MISS = 0.1


def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng([dim, TREES, BITS]).normal(size=(dim + 1, TREES * BITS)).astype(np.float32)


def strings(x: np.ndarray, length: float) -> np.ndarray:
    """(rows, TREES) strings of BITS bits as numbers, first bit highest, of index vectors with a component added that makes their length ``length``; 0 for queries."""
    planes = _planes(x.shape[1])
    own = np.linalg.norm(x, axis=1)
    unit = x / (length if length else own[:, None])
    more = np.sqrt(np.maximum(0.0, 1.0 - (own / length) ** 2)) if length else np.zeros(len(x))
    out = np.empty((len(x), TREES), np.uint64)
    for i in range(0, len(x), 256):
        side = np.column_stack([unit[i : i + 256], more[i : i + 256]]).astype(np.float32) @ planes > 0
        out[i : i + 256] = np.packbits(side, axis=1).view(">u8").reshape(-1, TREES)
    return out


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many first bits two strings have in common."""
    differ, out = a ^ b, np.full(a.shape, BITS, np.int64)
    some = differ > 0
    high = np.zeros(a.shape, np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        more = differ >> np.uint64(step) > 0
        differ = np.where(more, differ >> np.uint64(step), differ)
        high += step * more
    out[some] = BITS - 1 - high[some]
    return out


class Forest:
    """Sorted arrays of the strings of one block."""

    def __init__(self, x: np.ndarray, own: np.ndarray, length: float) -> None:
        self.x, self.length = x, length
        order = np.ascontiguousarray(np.argsort(own, axis=0, kind="stable").T)
        self.sorted, self.order = np.take_along_axis(own.T, order, axis=1), order.astype(np.int32).ravel()  # tree by tree

    def longest(self, own: np.ndarray) -> np.ndarray:
        """For each query and tree, the length of the longest prefix that a row shares with it: found beside its place in the sorted array."""
        out = np.empty(own.shape, np.int64)
        last = self.sorted.shape[1] - 1
        for t in range(TREES):
            at = np.searchsorted(self.sorted[t], own[:, t])
            out[:, t] = np.maximum(shared_bits(self.sorted[t][np.minimum(at, last)], own[:, t]), shared_bits(self.sorted[t][np.maximum(at - 1, 0)], own[:, t]))
        return out

    def ranges(self, own: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query and tree, the places of the rows that share ``depth`` bits with it."""
        if not depth:
            return np.zeros(own.shape, np.int64), np.full(own.shape, self.sorted.shape[1], np.int64)
        rest = np.uint64((1 << (BITS - depth)) - 1)
        low, high = own & ~rest, own | rest
        return tuple(np.stack([np.searchsorted(self.sorted[t], edge[:, t], side) for t in range(TREES)], axis=1) for edge, side in ((low, "left"), (high, "right")))

    def met(self, lo: np.ndarray, hi: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The rows of one query's ranges that it hasn't met ``before``, which then marks them too."""
        size = hi - lo
        at = np.repeat(lo + np.arange(TREES) * len(self.x) - np.cumsum(size) + size, size) + np.arange(size.sum())
        old = before.copy()
        before[self.order[at]] = True
        return np.flatnonzero(before ^ old)

    def candidates(self, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, rows, scores) of every query."""
        n = len(self.x)
        k = min(k, n)
        lengths = np.linalg.norm(queries, axis=1) * self.length
        before = np.zeros((len(queries), n), bool)
        best = np.full((len(queries), k), -np.inf)  # of each query so far, the k-th first
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in queries]
        sure = np.log1p(-(MISS ** (1 / TREES)))
        # each query descends to the longest prefix that any tree has for it; from there all trees ascend together
        top = self.longest(own).max(axis=1)
        held, open_ = np.zeros(len(queries), np.int64), np.ones(len(queries), bool)
        for depth in range(int(top.max(initial=0)), -1, -1):
            asking = np.flatnonzero(open_ & (top >= depth))
            if not len(asking):
                continue
            lo, hi = self.ranges(own[asking], depth)
            size = (hi - lo).sum(axis=1)
            for i, q in enumerate(asking.tolist()):
                if size[i] > held[q]:
                    held[q] = size[i]
                    rows = self.met(lo[i], hi[i], before[q])
                    score = self.x.take(rows, axis=0) @ queries[q]
                    found[q].append((rows, score))
                    every = np.concatenate([best[q], score])
                    best[q] = np.partition(every, len(every) - k)[len(every) - k :]
                if np.isinf(best[q, 0]) and depth:
                    continue
                angle = np.arccos(np.clip(best[q, 0] / lengths[q], -1.0, 1.0))
                if not depth or angle == 0 or (angle < np.pi and depth <= sure / np.log1p(-angle / np.pi)):
                    open_[q] = False
                    yield q, *(np.concatenate(c) for c in zip(*found[q], strict=True))
                    found[q] = []


def _valid(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def _length(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))


def _with_strings(df: DataFrame, length: float) -> DataFrame:
    """Adds ``code``, the strings of ``v``."""
    schema = T.StructType([*df.schema.fields, T.StructField("code", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            at, dims = batch.schema.get_field_index("v"), batch.column(batch.schema.get_field_index("dim")).to_numpy()
            vectors, code = batch.column(at), np.zeros((batch.num_rows, TREES), np.uint64)
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                code[own] = strings(np.array(vectors.take(pa.array(own)).flatten()).reshape(-1, d), length)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * TREES, pa.int32()), pa.array(code.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "code"])

    return df.mapInArrow(run, schema)


def search(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 20, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best found for every row whose id ``every`` divides, by inner product."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & _valid(F.col("v")))
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    index = first.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.array_sort(F.collect_set("vec_id")).alias("ids"))
    index = index.withColumn("dim", F.size("v"))
    longest = rows.agg(F.max(_length(F.col("v")))).first()[0] or 1.0
    index = materialise(_with_strings(index, longest), "vectors")
    asked = materialise(rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct(), "asked")
    mine = index.select("h1", "h2", "v", "dim").join(asked.select("h1", "h2"), ["h1", "h2"], "left_semi")
    queries = materialise(_with_strings(mine, 0.0), "queries").select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("v").alias("qv"), F.col("dim").alias("qdim"), F.col("code").alias("qcode"))
    blocks = max(1, -(-index.count() // BLOCK_ROWS))
    groups = max(1, -(-queries.count() // QUERY_ROWS))
    held = index.withColumn("block", F.pmod(F.xxhash64("h1"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asking = queries.withColumn("qpart", F.pmod(F.xxhash64("q2"), F.lit(groups)).cast("int")).withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["h1", "h2", "vec_id", "score"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], x) for x in kinds], names=names)
        x, q = (np.array(c.combine_chunks().flatten()).reshape(len(c), -1) for c in (left["v"], right["qv"]))
        own, asking = (np.array(c.combine_chunks().flatten()).view(np.uint64).reshape(-1, TREES) for c in (left["code"], right["qcode"]))
        ids = left["ids"].combine_chunks()
        flat, offsets = ids.flatten().to_numpy(), ids.offsets.to_numpy() - ids.offsets[0].as_py()
        h1, h2 = right["q1"].to_numpy(), right["q2"].to_numpy()
        out: list[list] = [[], [], [], []]
        for i, met, score in Forest(x, own, longest).candidates(q, asking, k + 1):
            if len(met) > k + 1:
                edge = np.partition(score, len(met) - k - 1)[len(met) - k - 1]
                keep = score >= edge  # ties at the edge stay, for their ids
                met, score = met[keep], score[keep]
            lens = offsets[met + 1] - offsets[met]
            own = np.concatenate([flat[offsets[m] : offsets[m + 1]] for m in met])
            score = np.repeat(score, lens)
            best = np.lexsort((own, -score))[: k + 1]
            for c, values in zip(out, (np.full(len(best), h1[i]), np.full(len(best), h2[i]), own[best], score[best]), strict=True):
                c.append(values)
        return pa.table([pa.array(np.concatenate(c), x) for c, x in zip(out, kinds, strict=True)], names=names)

    found = held.groupBy("dim", "block", "part").cogroup(asking.groupBy("qdim", "qblock", "qpart")).applyInArrow(run, "h1 long, h2 long, vec_id long, score double")
    top = found.withColumn("_r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id"))).where(F.col("_r") <= k + 1)
    lists = top.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("best"))
    lists = materialise(lists, "neighbours")
    mine = asked.join(lists, ["h1", "h2"]).select("query_id", F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    return mine.select("query_id", F.posexplode("best").alias("_p", "b")).select("query_id", (F.col("_p") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def exact(vectors: DataFrame, queries: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) without a forest, for a bounded set of ``queries`` (query_id) that is broadcast: to measure recall."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where(_valid(F.col("v")))
    one = F.broadcast(rows.join(F.broadcast(queries.select(F.col("query_id").alias("vec_id"))), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")))
    score = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    true = rows.join(one, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", score.alias("score"))
    return true.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def recall(found: DataFrame, vectors: DataFrame, queries: int = 200, **names) -> float:
    """Share of the true nearest among those found, by brute force for a bounded number of queries."""
    asked = found.select("query_id").distinct().orderBy(F.xxhash64("query_id")).limit(queries)
    hit = exact(vectors, asked, **names).join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
