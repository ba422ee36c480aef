"""Near-duplicate vectors by cross-polytope hashing: fast Hadamard rotations, multiprobe buckets, verified pairs.

A vector is padded to a power of two and rotated by three rounds of random signs and a fast Hadamard transform; the hash is the
axis nearest to the result, with its side. A bucket of a table is a label and AXES such hashes. Each vector is at *home* in its own
bucket of each of TABLES tables, and a *guest* in PROBES further ones, those whose axes are next nearest. Vectors meet where at
least one of them is at home. In 64 dimensions two vectors at the threshold (0.98) meet in a table with probability 0.81, so all
TABLES tables miss them with probability 2e-6; nearer ones are missed less.

Whoever meets is verified by the exact cosine in double precision. A link is counted where it is met first (least table; home with
home, then the lesser one's home), told from the two vectors alone, so links are counted without being listed: a bucket gives each
member its count and one neighbour to its component of the bucket. Buckets are cut into blocks of BLOCK vectors, and each pair of
blocks is a task's step of bounded size, whatever a bucket holds. Only hashes are dealt at first; vectors follow to buckets
where somebody can be met.

Equal vectors of a label are one node with a count, so copies cost nothing; components are those of all links (``connected``).
Different vectors of one dense group are compared block by block, which is what a number of links for each of them takes.

Defined cases: vectors that are null, empty, all zero, or hold a null or non-finite component, and rows without a label or an id,
link with nothing: no links, their own id as component, kept. Vectors of a label with different lengths don't link. Rows with equal
ids are rows of their own; repeated rows link with each other. A component is named by its least id. An empty table gives an
empty one; of clashing extra columns only the three named are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import join_facts, mix64
from cairn.llm.ordminhash import connected
from cairn.session import discard, materialise

COSINE = 0.98
TABLES, AXES, PROBES = 8, 3, 3
#: Of each rotation so many of the nearest axes are tried.
RANKS = 3
#: Vectors in a block of a bucket.
BLOCK = 1024
SEED = 20


def signs(size: int) -> np.ndarray:
    """Random signs for every table, axis and round, the same everywhere."""
    return np.random.Generator(np.random.PCG64(SEED)).choice([-1.0, 1.0], (TABLES, AXES, 3, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row, of a power of two."""
    n, size = x.shape
    half = 1
    while half < size:
        x = x.reshape(n, size // (2 * half), 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, size)
        half *= 2
    return x / np.sqrt(size)


def buckets(vectors: np.ndarray) -> np.ndarray:
    """(vectors, TABLES, 1 + PROBES) numbers of buckets: home first, then those of the nearest other axes."""
    n, dims = vectors.shape
    size = max(2, 1 << (dims - 1).bit_length())
    own = np.zeros((n, size))
    own[:, :dims] = vectors / np.abs(vectors).max(axis=1)[:, None]  # lengths don't matter, and only sums and differences follow
    flips, ranks = signs(size), min(RANKS, size)
    combos = [c for c in product(range(ranks), repeat=AXES)]
    out = np.empty((n, TABLES, 1 + PROBES), np.int64)
    rows = np.arange(n)[:, None]
    for t in range(TABLES):
        code = np.zeros((n, len(combos)), np.uint64)
        lost = np.zeros((n, len(combos)))
        for a in range(AXES):
            x = own
            for r in range(3):
                x = hadamard(x * flips[t, a, r])
            size_of = np.abs(x)
            near = np.argsort(-size_of, axis=1, kind="stable")[:, :ranks]
            side = (x[rows, near] < 0).astype(np.uint64)
            gap = size_of[rows, near[:, :1]] - size_of[rows, near]
            pick = [c[a] for c in combos]
            code = mix64(code + (near.astype(np.uint64) * np.uint64(2) + side + np.uint64(1))[:, pick])
            lost += gap[:, pick]
        order = np.argsort(lost, axis=1, kind="stable")[:, : 1 + PROBES]
        out[:, t] = code[rows, order].view(np.int64)
    return out


def _met_first(x: np.ndarray, y: np.ndarray, lesser: np.ndarray, table: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Which of the pairs (buckets ``x`` and ``y``, one row each) are met for the first time in a bucket of ``table``.

    ``both`` are at home there; otherwise the first is, and the second is a guest. ``lesser``: the first is the lesser one.
    """
    together = x[:, :, 0] == y[:, :, 0]
    y_visits = (y[:, :, 1:] == x[:, :, :1]).any(axis=2)
    x_visits = (x[:, :, 1:] == y[:, :, :1]).any(axis=2)
    rows = np.arange(len(x))
    first = np.argmax(together | y_visits | x_visits, axis=1) == table
    return first & (both | (~together[rows, table] & (lesser | ~x_visits[rows, table])))


def _near(vectors: np.ndarray, at_home: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) places of the pairs of ``left`` and ``right`` (the same places, or none in common) that link, one of them, ``i``, at home."""
    i, j = np.nonzero(vectors[left] @ vectors[right].T >= COSINE - 1e-6)  # fast, then exact
    i, j = left[i], right[j]
    keep = at_home[i] | at_home[j]
    if left is right:
        keep &= i < j
    i, j = i[keep], j[keep]
    keep = np.empty(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        own = slice(k, k + (1 << 16))
        keep[own] = (vectors[i[own]] * vectors[j[own]]).sum(axis=1) >= COSINE
    i, j = i[keep], j[keep]
    swap = ~at_home[i]
    return np.where(swap, j, i), np.where(swap, i, j)


def _to_count(raw: np.ndarray, node: np.ndarray, at_home: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the links (i, j), met in the tables of ``i``, are met there first."""
    if not len(i):
        return np.zeros(0, bool)
    some, where = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = where[: len(i)], where[len(i) :]
    hashes = np.concatenate([buckets(raw[some[k : k + 2048]]) for k in range(0, len(some), 2048)])
    out = np.empty(len(i), bool)
    for k in range(0, len(i), 1 << 14):
        own = slice(k, k + (1 << 14))
        out[own] = _met_first(hashes[a[own]], hashes[b[own]], node[i[own]] < node[j[own]], table[i[own]], at_home[j[own]])
    return out


def _spanning(i: np.ndarray, j: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, least place of its component) of all places that the pairs link."""
    label = np.arange(size)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(size))
    return moved, label[moved]


def _unit(values: np.ndarray) -> np.ndarray:
    scaled = values / np.abs(values).max(axis=1)[:, None]
    return scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, v, ok): ``v`` in double precision; ``ok`` tells who can link."""
    v = F.col(embedding).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    ok = F.col(label).isNotNull() & F.col(vec_id).isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False))
    return vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), v.alias("v"), ok.alias("ok"))


def _hashed(nodes: DataFrame) -> DataFrame:
    """(bucket, table, node, home) of every node: its own bucket of each table, and those that it visits."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            node, group = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lens = np.diff(batch.column(2).offsets.to_numpy())
            for dims in np.unique(lens):
                rows = np.flatnonzero(lens == dims)
                for k in range(0, len(rows), 2048):
                    own = rows[k : k + 2048]
                    found = buckets(_matrix(batch.column(2).take(pa.array(own))))
                    home = np.zeros(found.shape, bool)
                    home[:, :, 0] = True
                    table = np.broadcast_to(np.arange(TABLES)[None, :, None], found.shape)
                    keys = mix64(found.view(np.uint64) + mix64(group[own].view(np.uint64)[:, None, None] + table.astype(np.uint64)))
                    flat = lambda x: np.ascontiguousarray(x).reshape(-1)
                    yield pa.RecordBatch.from_arrays([pa.array(flat(keys).view(np.int64)), pa.array(flat(table).astype(np.int32)), pa.array(np.repeat(node[own], TABLES * (1 + PROBES))), pa.array(flat(home))], names=["bucket", "table", "node", "home"])

    return nodes.select("node", F.xxhash64("label", F.size("v")).alias("g"), "v").mapInArrow(run, "bucket long, table int, node long, home boolean")


def _step_links(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """(node, links, to) of whole steps: what they add to a node's links, and the least node of its component of them."""
    table = table.combine_chunks()
    node, at_home, own, copies, in_table, low, high, bucket = (table.column(c).to_numpy() for c in ("node", "home", "own", "copies", "table", "i", "j", "bucket"))
    lists = table.column("v").combine_chunks()
    flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    new = np.zeros(len(node), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    starts = np.append(0, np.append(np.flatnonzero(new), len(node)))
    for dims in np.unique(np.diff(at)):  # vectors of a bucket are of one length
        some = np.flatnonzero(np.diff(at) == dims)
        place = np.zeros(len(node), np.int64)
        place[some] = np.arange(len(some))
        raw = flat[(at[some][:, None] + np.arange(dims)[None, :])]
        unit, home, names = _unit(raw), at_home[some], node[some]
        found, pending = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            i, j = (np.concatenate(x) for x in zip(*found, strict=True))
            keep = _to_count(raw, names, home, in_table[some], i, j)
            i, j = i[keep], j[keep]
            if not len(i):
                return
            ids, where = np.unique(names[np.concatenate([i, j])], return_inverse=True)
            a, b = where[: len(i)], where[len(i) :]
            links = np.bincount(a, copies[some][j], len(ids)) + np.bincount(b, copies[some][i], len(ids))
            to = np.full(len(ids), -1, np.int64)
            moved, label = _spanning(a, b, len(ids))
            to[moved] = ids[label]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links.astype(np.int64)), pa.array(to, mask=to < 0)], names=["node", "links", "to"])

        for a, b in zip(starts, starts[1:]):
            if at[a + 1] - at[a] != dims:
                continue
            here = place[a:b]
            if low[a] == high[a]:
                i, j = _near(unit, home, here, here)
            else:
                i, j = _near(unit, home, here[own[a:b] == low[a]], here[own[a:b] == high[a]])
            if len(i):
                found.append((i, j))
                pending += len(i)
            if pending > 1 << 18:
                yield from flush()
                found, pending = [], 0
        if found:
            yield from flush()


def _compared(steps: DataFrame) -> DataFrame:
    """Sorted steps to (node, links, to). The last step of a batch waits for the next batch; it holds two blocks at most."""

    def run(batches: Iterator[pa.RecordBatch]):
        waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([batch])])
            same = np.ones(table.num_rows, bool)
            for c in ("bucket", "i", "j"):
                own = table.column(c).to_numpy()
                same &= own == own[-1]
            cut = 0 if same.all() else len(same) - int(np.argmin(same[::-1]))
            if cut:
                yield from _step_links(table.slice(0, cut))
            waiting = table.slice(cut)
        if waiting is not None:
            yield from _step_links(waiting)

    return steps.select("bucket", "i", "j", "table", "own", "node", "home", "copies", "v").mapInArrow(run, "node long, links long, to long")


def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``."""
    rows = usable(vectors, vec_id, embedding, label).withColumn("content", F.xxhash64("label", "v"))
    nodes = rows.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("content").alias("content"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    places = materialise(_hashed(nodes), "bucket-places")
    met = places.groupBy("bucket").agg(F.count("*").alias("m"), F.max("home").alias("some")).where("some and m > 1").select("bucket", "m")
    met = materialise(met.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")), "buckets")
    known = join_facts(places, met, "bucket", "m", places.count()).where("blocks is not null")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    known = known.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    known = known.select("bucket", "table", "node", "home", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    steps = known.join(nodes.select("node", "copies", "v"), "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    links = materialise(_compared(steps), "vector-links")
    discard(places, met)
    components = materialise(connected(links.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b"))), "components")
    counts = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    own = nodes.select("node", "label", "v", "content", "least", "copies").join(counts, "node", "left").join(components, "node", "left").withColumn("class", F.coalesce("class", "node"))
    own = materialise(own.select("label", "v", "content", "least", "copies", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "class"), "linked-vectors")
    sizes = own.groupBy("class").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"))
    facts = materialise(join_facts(own, sizes, "class", "nodes", own.count()).select("label", "v", "content", "n_links", "component_id", "copies"), "components-of-vectors")
    plain = rows.where("ok").select("vec_id", "content", "label", "v")
    found = join_facts(plain, facts, ["content", "label", "v"], "copies", plain.count()).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = f"""
WITH RECURSIVE rows_of AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
fine AS (
  SELECT r, vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM rows_of
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
),
links AS (SELECT a.r, b.r AS other, b.vec_id FROM fine a JOIN fine b ON a.label = b.label AND a.r <> b.r AND len(a.u) = len(b.u) AND list_inner_product(a.u, b.u) >= {COSINE}),
reach(r, other) AS (SELECT r, other FROM links UNION SELECT reach.r, links.other FROM reach JOIN links ON links.r = reach.other),
counted AS (SELECT r, count(*) AS n FROM links GROUP BY r),
least AS (SELECT reach.r, min(rows_of.vec_id) AS least FROM reach JOIN rows_of ON rows_of.r = reach.other GROUP BY reach.r),
named AS (SELECT rows_of.vec_id, coalesce(counted.n, 0)::BIGINT AS n_links, least(coalesce(least.least, rows_of.vec_id), rows_of.vec_id) AS component_id FROM rows_of LEFT JOIN counted USING (r) LEFT JOIN least USING (r))
SELECT vec_id, n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM named
"""
