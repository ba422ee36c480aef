"""The prefix trie of all conversations: how many share each opening, and what keeping it once would save.

1. Turns are dictionary-encoded: each distinct (role, text) gets a number, in the order of role and text. Texts are moved for
   that alone; a turn that very many conversations have is broadcast, see ``join_facts``.
2. Conversations become sequences of numbers and are dealt by range of (sequence, id) into *shards*. Conversations with a common
   opening are neighbours in that order, and equal ones may be spread over several shards.
3. A shard inserts its distinct sequences into a ternary search tree, the median first, then the medians of both halves, so
   the tree is balanced. A ternary node stands for one trie node (what leads to it and its own number). Going over the nodes
   from last to first adds members, leaves and savings up into parents, without recursion.
4. Only nodes on the paths of a shard's first and last sequence can be in other shards too: the *boundary nodes*. All others
   are finished. Boundary nodes of FAN neighbouring shards are merged by their digests; what lies off the first and last path
   of the whole group is finished then. Rounds go on until one group is left. So a step holds FAN times two paths, whatever
   the input. A node whose parent is a boundary node learns the parent's name in the end by a join.
5. The ids that end at a boundary node come from its shards as text, in order, and one stream hashes the pieces.

One conversation's numbers (16 bytes a turn) are held by one task; its texts are not.

Defined cases: null roles and texts are empty; turns of a null ``conv_id`` belong to no conversation and are left out; null turns
come first, equal ones go by role and text; repeated rows are repeated turns; texts of any length are moved only to be numbered;
an empty table gives an empty trie, without a root; of clashing extra columns only the four named are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import join_facts
from cairn.session import discard, materialise

#: Original turns of the conversation that starts a group of five; up to HEADS - 1 of them open its others.
GROUP, HEADS = 5, 9
#: Turns and conversations in a shard, about.
SHARD = 1 << 16
#: Neighbouring shards whose boundary nodes are merged at once.
FAN = 32
_NODE = "final boolean, shard int, depth int, key binary, parent_key binary, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, bytes long, first boolean, last boolean, ends string"
_NAMES = [c.split()[0] for c in _NODE.split(", ")]
_TYPES = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
_SCHEMA = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in _NODE.split(", ")])
ROOT = b"root"


def encode(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, ids, bytes): the numbers of each conversation's turns in their order, and the bytes of their texts."""
    c = F.col
    rows = conversations.where(c(conv_id).isNotNull()).select(c(conv_id).cast("long").alias("conv_id"), c(turn).alias("turn"), F.coalesce(c(role), F.lit("")).alias("role"), F.coalesce(c(text), F.lit("")).alias("text"))
    digest = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    kinds = rows.groupBy("role", "text").agg(F.count("*").alias("n")).repartitionByRange("role", "text").sortWithinPartitions("role", "text")
    kinds = materialise(kinds.select(digest.alias("_t"), F.monotonically_increasing_id().alias("id"), F.octet_length("text").cast("long").alias("bytes"), "n"), "turn-dictionary")
    turns = rows.select("conv_id", "turn", digest.alias("_t"))
    turns = join_facts(turns, kinds, "_t", "n", kinds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "bytes"))).alias("t"))
    return listed.select("conv_id", F.col("t.id").alias("ids"), F.col("t.bytes").alias("bytes"))


def rebuild(encoded: DataFrame) -> DataFrame:
    """Each conversation with its opening replaced by that of the first of its group of five, for as many turns as its id says."""
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = encoded.select(F.col("conv_id").alias("base"), F.slice("ids", 1, HEADS - 1).alias("head_ids"), F.slice("bytes", 1, HEADS - 1).alias("head_bytes"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    rows = encoded.withColumns({"base": base, "h": h}).join(heads, "base", "left")
    none = F.array().cast("array<bigint>")
    opened = lambda head, own: F.concat(F.slice(F.coalesce(head, none), F.lit(1), F.col("h")), F.slice(own, F.col("h") + 1, F.greatest(F.size(own), F.lit(1))))
    return rows.select("conv_id", opened("head_ids", "ids").alias("ids"), opened("head_bytes", "bytes").alias("bytes"))


def _child(key: bytes, number: int) -> bytes:
    return hashlib.blake2b(key + number.to_bytes(8, "big"), digest_size=16).digest()


class Tree:
    """A ternary search tree of sequences. Node 0 is the trie's root; the others are in the order of their making, parents first."""

    def __init__(self) -> None:
        self.split, self.lo, self.eq, self.hi, self.up, self.depth = [-1], [0], [0], [0], [-1], [0]
        self.bytes, self.n, self.conv, self.ends = [0], [0], [None], [None]

    def _new(self, number: int, size: int, up: int) -> int:
        for column, value in zip((self.split, self.lo, self.eq, self.hi, self.up, self.depth, self.bytes, self.n, self.conv, self.ends), (number, 0, 0, 0, up, self.depth[up] + 1, size, 0, None, None), strict=True):
            column.append(value)
        return len(self.split) - 1

    def _join(self, at: int, convs: list[int]) -> None:
        self.n[at] += len(convs)
        self.conv[at] = convs[0] if self.conv[at] is None else min(self.conv[at], convs[0])

    def insert(self, ids: list[int], sizes: list[int], convs: list[int]) -> None:
        """``convs``, ascending, are all conversations of this sequence."""
        split, lo, hi, eq = self.split, self.lo, self.hi, self.eq
        at = 0
        self._join(0, convs)
        for number, size in zip(ids, sizes, strict=True):
            side, from_, below = eq, at, eq[at]
            while below and split[below] != number:
                side, from_ = (lo, below) if number < split[below] else (hi, below)
                below = side[below]
            if not below:
                below = side[from_] = self._new(number, size, at)
            at = below
            self._join(at, convs)
        self.ends[at] = convs

    def insert_medians(self, sequences: list[tuple[list[int], list[int], list[int]]]) -> None:
        """Sorted distinct sequences, the median first, then those of both halves."""
        todo = [(0, len(sequences))]
        while todo:
            low, high = todo.pop()
            if low < high:
                mid = (low + high) // 2
                self.insert(*sequences[mid])
                todo += [(low, mid), (mid + 1, high)]

    def path(self, ids: list[int]) -> list[int]:
        """Nodes from the root to the end of an inserted sequence."""
        out = [0]
        for number in ids:
            below = self.eq[out[-1]]
            while self.split[below] != number:
                below = self.lo[below] if number < self.split[below] else self.hi[below]
            out.append(below)
        return out

    def totals(self, held: set[int]) -> tuple[list[int], list[int], list[int]]:
        """(children, leaves, savings) of every node's subtree. Nodes of ``held`` count only what lies below them and isn't held."""
        size = len(self.split)
        children, leaves, saved = [0] * size, [0] * size, [0] * size
        for at in range(size - 1, -1, -1):
            if at in held:
                continue
            leaves[at] = leaves[at] or 1
            saved[at] += (self.n[at] - 1) * self.bytes[at]
            up = self.up[at]
            if up >= 0:
                children[up] += 1
                leaves[up] += leaves[at]
                saved[up] += saved[at]
        return children, leaves, saved


def _hash(convs: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, convs)).encode()).hexdigest()


def _batches(rows: Iterator[tuple], size: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    block = []
    for row in rows:
        block.append(row)
        if len(block) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)
            block = []
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _shard_nodes(sequences: list[tuple[list[int], list[int], list[int]]], shard: int) -> Iterator[tuple]:
    """The finished and the boundary nodes of one shard, as rows of _NODE. ``key`` is given for boundary nodes, ``parent_key`` for their children."""
    tree = Tree()
    tree.insert_medians(sequences)
    first, last = tree.path(sequences[0][0]), tree.path(sequences[-1][0])
    keys = {0: ROOT}
    for path in (first, last):
        for up, at in zip(path, path[1:]):
            keys[at] = _child(keys[up], tree.split[at])
    on_first, on_last = set(first), set(last)
    children, leaves, saved = tree.totals(keys.keys())
    for at in range(len(tree.split)):
        up = tree.up[at]
        own = (children[at], leaves[at], saved[at], tree.bytes[at])
        ends = tree.ends[at] or []
        if at in keys:
            yield (False, shard, tree.depth[at], keys[at], keys.get(up), tree.conv[at], None, tree.n[at], *own, at in on_first, at in on_last, ",".join(map(str, ends)) if ends else None)
        else:
            yield (True, shard, tree.depth[at], None, keys.get(up), tree.conv[at], None if up in keys else tree.conv[up], tree.n[at], *own, False, False, _hash(ends))


def _shards(rows: DataFrame) -> DataFrame:
    """Sorted and dealt (conv_id, ids, bytes) to the nodes of every shard."""

    def run(batches: Iterator[pa.RecordBatch]):
        sequences = []
        for batch in batches:
            for conv, ids, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sequences and sequences[-1][0] == ids:
                    sequences[-1][2].append(conv)
                else:
                    sequences.append((ids, sizes, [conv]))
        if sequences:
            yield from _batches(_shard_nodes(sequences, TaskContext.get().partitionId()))

    return rows.select("conv_id", "ids", "bytes").mapInArrow(run, _NODE)


def _merged(rows: list[dict], group: int, closing: bool) -> Iterator[tuple]:
    """Boundary nodes of neighbouring shards as one: nodes off the first and last path of the group are finished, with ``closing`` all."""
    low, high = min(r["shard"] for r in rows), max(r["shard"] for r in rows)
    nodes: dict[bytes, dict] = {}
    for r in rows:
        r["first"], r["last"] = r["first"] and r["shard"] == low, r["last"] and r["shard"] == high
        have = nodes.setdefault(r["key"], r)
        if have is not r:
            for k in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                have[k] += r[k]
            have["conv_id"] = min(have["conv_id"], r["conv_id"])
            have["first"] |= r["first"]
            have["last"] |= r["last"]
    for r in sorted(nodes.values(), key=lambda r: -r["depth"]):
        r["final"] = closing or not (r["first"] or r["last"])
        r["shard"] = group
        if r["final"]:
            r["n_leaves"] = r["n_leaves"] or 1
            r["saved_tokens"] += (r["n_convs"] - 1) * r["bytes"]
            if r["parent_key"] is not None:
                up = nodes[r["parent_key"]]
                up["n_children"] += 1
                up["n_leaves"] += r["n_leaves"]
                up["saved_tokens"] += r["saved_tokens"]
        yield tuple(r[k] for k in _NAMES)


def _merge(rows: DataFrame, closing: bool) -> DataFrame:
    fan = FAN

    def run(table: pa.Table) -> pa.Table:
        own = table.to_pylist()
        return pa.Table.from_batches(_batches(_merged(own, own[0]["shard"] // fan, closing)), _SCHEMA)

    return rows.groupBy(F.floor(F.col("shard") / fan).alias("group")).applyInArrow(run, _NODE)


def _hashed(pieces: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 of each node's ids from (key, shard, ends), a shard's ids being one text and shards in their order."""

    def run(batches: Iterator[pa.RecordBatch]):
        key, state = None, None
        for batch in batches:
            out = []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != key:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = own, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["key", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends"])

    return pieces.repartition("key").sortWithinPartitions("key", "shard").select("key", "ends").mapInArrow(run, "key binary, ends string")


def trie(sequences: DataFrame, *, shard: int = SHARD) -> DataFrame:
    """The nodes of the trie of (conv_id, ids, bytes): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    sequences = materialise(sequences.select("conv_id", "ids", "bytes"), "sequences")
    units = sequences.agg(F.coalesce(F.sum(F.size("ids") + 1), F.lit(0))).first()[0]
    dealt = sequences.repartitionByRange(max(1, -(-units // shard)), "ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    nodes = materialise(_shards(dealt), "shard-nodes")
    boundary, done = nodes.where("not final").drop("ends").withColumn("ends", F.lit(None).cast("string")), []
    groups = (boundary.agg(F.max("shard")).first()[0] or 0) + 1
    while True:
        closing = groups <= FAN
        merged = materialise(_merge(boundary, closing), "boundary-nodes")
        done.append(merged)
        if closing:
            break
        boundary, groups = merged.where("not final"), -(-groups // FAN)
    finished = done[0].where("final")
    for more in done[1:]:
        finished = finished.unionByName(more.where("final"))
    pieces = nodes.where("not final and ends is not null").select("key", "shard", "ends")
    finished = materialise(finished.drop("ends").join(_hashed(pieces), "key", "left").withColumn("ends", F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest()))), "finished-nodes")
    facts = finished.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_name"), F.col("n_children").alias("_n"))
    columns = ["conv_id", "depth", "parent_key", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")]
    inner = nodes.where("final").select(*columns)
    named = join_facts(inner.where("parent_key is not null").unionByName(finished.select(*columns)), facts, "parent_key", "_n", nodes.count())
    out = named.withColumn("parent_conv_id", F.col("_name")).drop("_name").unionByName(inner.where("parent_key is null"))
    discard(*done)
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(rebuild(encode(conversations)))


#: CRC-32 of a text of ASCII letters, digits, signs and colons, in SQL: bytes as numbers, a table of 256 by eight steps.
_CRC = """
crc_table AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b::BIGINT] || range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) r(b)
  )
)"""

ORACLE = f"""
WITH RECURSIVE {_CRC.strip()},
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, role, text) AS s FROM turns GROUP BY conv_id),
coded AS (
  SELECT conv_id, s, conv_id - conv_id % 5 AS base,
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM own, crc_table
),
rebuilt AS (
  SELECT a.conv_id, list_concat(CASE WHEN b.s IS NULL THEN [] ELSE b.s[1:a.h] END, a.s[a.h + 1:]) AS s FROM coded a LEFT JOIN own b ON b.conv_id = a.base
),
named AS (SELECT conv_id, len(s) AS n, list_transform(s, lambda x: md5(x.r) || md5(x.t)) AS k, s FROM rebuilt),
steps AS (SELECT conv_id, n, d, md5(array_to_string(k[1:d], '')) AS key, CASE WHEN d > 0 THEN md5(array_to_string(k[1:d - 1], '')) END AS up, CASE WHEN d > 0 THEN octet_length(encode(s[d].t)) ELSE 0 END AS bytes FROM named, unnest(range(n + 1)) u(d)),
nodes AS (
  SELECT d, key, any_value(up) AS up, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends
  FROM steps GROUP BY d, key
),
kids AS (SELECT d - 1 AS d, up AS key, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
full_nodes AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.d = nodes.d AND kids.key = nodes.key),
heads AS (SELECT DISTINCT a.d, a.key, b.d AS d2, b.key AS key2 FROM steps a JOIN steps b ON a.conv_id = b.conv_id AND b.d <= a.d),
below AS (
  SELECT h.d2 AS d, h.key2 AS key, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved
  FROM heads h JOIN full_nodes f ON f.d = h.d AND f.key = h.key GROUP BY 1, 2
)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM full_nodes f JOIN below b ON b.d = f.d AND b.key = f.key LEFT JOIN nodes p ON p.d = f.d - 1 AND p.key = f.up
"""
