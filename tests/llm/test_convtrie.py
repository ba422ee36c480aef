"""The conversation trie against a plain one, with small shards too; defined cases."""

import hashlib
import random
import zlib
from collections import defaultdict

from cairn.llm import convtrie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    nodes = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            nodes[whole[:d]].append((c, len(whole) == d))
    kids = defaultdict(list)
    for path in nodes:
        if path:
            kids[path[:-1]].append(path)
    below = {}
    for path in sorted(nodes, key=len, reverse=True):
        leaves = sum(below[k][0] for k in kids[path]) or 1
        saved = sum(below[k][1] for k in kids[path]) + (len(nodes[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
        below[path] = (leaves, saved)
    name = lambda path: min(c for c, _ in nodes[path])
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c, end in sorted(members) if end)
        out.append((name(path), len(path), name(path[:-1]) if path else None, len(members), len(kids[path]), *below[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(-7, n):
        for turn in range(rng.randrange(1, 7)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "é€"]) * rng.randrange(3)))
    hot = [(c, t, "user", "same") for c in range(1000, 1100) for t in range(10)]
    return rows + hot


def test_trie_is_the_plain_one_whatever_the_shards(spark, monkeypatch):
    rows = conversations(1, 150)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = plain(rows)
    assert got(convtrie.prefix_trie(df)) == want
    sequences = convtrie.rebuild(convtrie.encode(df))
    monkeypatch.setattr(convtrie, "FAN", 3)
    assert got(convtrie.trie(sequences, shard=60)) == want  # a conversation of a hundred copies spans shards


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [
        (None, 1, "user", "lost"),
        (0, None, "user", "first"),
        (0, 3, None, None),
        (0, 3, "b", "x"),
        (0, 3, "a", "y"),
        (0, 3, "a", "y"),
        (0, -1, "", "z" * 300_000),
        (3, 1, "user", "own"),
        (7, 1, None, "base is absent"),
        (8, 0, "", ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as ids", "2 as bytes", "'k' as key", "3 as _t", "4 as n", "5 as h", "6 as base")
    assert got(convtrie.prefix_trie(df)) == plain(rows)
    assert convtrie.prefix_trie(df.limit(0)).count() == 0


def test_median_insertion_keeps_the_tree_shallow():
    tree = convtrie.Tree()
    tree.insert_medians([([i], [1], [i]) for i in range(1023)])

    def height(at):
        todo, most = [(at, 1)], 0
        while todo:
            at, h = todo.pop()
            if at:
                most = max(most, h)
                todo += [(tree.lo[at], h + 1), (tree.hi[at], h + 1)]
        return most

    assert height(tree.eq[0]) == 10 and tree.n[0] == 1023


def test_a_conversation_of_very_many_turns(spark):
    rows = [(1, t, "user", str(t % 7)) for t in range(3000)] + [(2, t, "user", str(t % 7)) for t in range(2500)]
    out = got(convtrie.prefix_trie(spark.createDataFrame(rows, SCHEMA)))
    assert out == plain_chain(rows)


def plain_chain(rows):
    """As ``plain``, without slicing whole paths."""
    own = defaultdict(list)
    for c, _, role, text in rows:
        own[c].append((role, text))
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    whole = {c: turns[h[c] :] for c, turns in own.items()}  # conversation 0 is absent
    nodes = defaultdict(list)
    for c, turns in whole.items():
        at = ""
        nodes[(0, at)].append((c, not turns, 0, None))
        for d, turn in enumerate(turns, 1):
            up, at = (d - 1, at), hashlib.md5((at + repr(turn)).encode()).hexdigest()
            nodes[(d, at)].append((c, len(turns) == d, len(turn[1].encode()), up))
    total = {k: [0, 0, 0] for k in nodes}  # children, leaves, saved
    for k in sorted(nodes, reverse=True):
        total[k][1] = total[k][1] or 1
        total[k][2] += (len(nodes[k]) - 1) * nodes[k][0][2]
        if (up := nodes[k][0][3]) is not None:
            total[up] = [total[up][0] + 1, total[up][1] + total[k][1], total[up][2] + total[k][2]]
    out = []
    for k, members in nodes.items():
        up = members[0][3]
        ends = ",".join(str(c) for c, end, _, _ in sorted(members) if end)
        out.append((min(members)[0], k[0], min(nodes[up])[0] if up else None, len(members), *total[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)
