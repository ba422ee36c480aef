"""Cross-polytope near-duplicates against all pairs; recall at the threshold; defined cases."""

import random

import numpy as np

from cairn.llm import crosspoly

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    unit = {}
    for k, (vec_id, v, label) in enumerate(rows):
        if vec_id is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(np.float64)
            unit[k] = (label, x / np.sqrt((x * x).sum()))
    up, links = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in unit:
        for b in unit:
            if a < b and unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= 0.98:
                links[a] += 1
                links[b] += 1
                up[top(a)] = top(b)
    least = {}
    for k in unit:
        least[top(k)] = min(least.get(top(k), rows[k][0]), rows[k][0])
    return sorted(((r[0], links[k], least[top(k)] if k in unit else r[0], r[0] == (least[top(k)] if k in unit else r[0])) for k, r in enumerate(rows)), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def clusters(seed, dims=64):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(12):
        center = rng.normal(size=dims)
        center /= np.linalg.norm(center)
        for spread in rng.uniform(0.02, 0.35, rng.integers(2, 25)):
            z = rng.normal(size=dims)
            rows.append((center + spread * z / np.linalg.norm(z), int(c % 3)))
    rows += [(rng.normal(size=dims), int(rng.integers(3))) for _ in range(60)]
    rows += [rows[5], rows[5], rows[5], (rows[5][0] * 3.5, rows[5][1]), (-rows[5][0], rows[5][1]), (rows[5][0], 2 - rows[5][1])]
    out = [(k, v.astype(np.float32).tolist(), label) for k, (v, label) in enumerate(rows)]
    random.Random(seed).shuffle(out)
    return out


def test_links_and_components_are_those_of_all_pairs(spark, monkeypatch):
    rows = clusters(1)
    want = plain(rows)
    assert sum(r[1] for r in want) > 400 and any(not r[3] for r in want)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(crosspoly.near_duplicates(df)) == want
    monkeypatch.setattr(crosspoly, "BLOCK", 4)  # buckets are compared block by block
    assert got(crosspoly.near_duplicates(df)) == want


def test_pairs_at_the_threshold_are_met():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    a, b = crosspoly.buckets(x), crosspoly.buckets(0.98 * x + np.sqrt(1 - 0.98**2) * z)
    met = ((a == b[:, :, :1]).any(axis=2) | (b == a[:, :, :1]).any(axis=2)).mean(axis=0)
    assert met.min() > 0.79
    assert ((1 - met).prod()) < 5e-6
    far = (a == np.roll(b, 1, axis=0)[:, :, :1]).any(axis=2)
    assert far.mean() < 1e-4


def test_hadamard_is_its_matrix():
    h = np.array([[1.0]])
    for _ in range(4):
        h = np.block([[h, h], [h, -h]])
    x = np.random.default_rng(3).normal(size=(5, 16))
    assert np.allclose(crosspoly.hadamard(x), x @ h / 4)


def test_a_dense_group_counts_each_link_once():
    rng = np.random.default_rng(4)
    center = rng.normal(size=64)
    raw = center / np.linalg.norm(center) + 0.01 * rng.normal(size=(300, 64))
    unit = raw / np.linalg.norm(raw, axis=1)[:, None]
    found = crosspoly.buckets(raw)
    members = {}
    for n in range(300):
        for t in range(crosspoly.TABLES):
            for p in range(1 + crosspoly.PROBES):
                members.setdefault((t, found[n, t, p]), []).append((n, p == 0))
    links = np.zeros((300, 300), int)
    for (t, _), own in members.items():
        node, home, here = np.array([m[0] for m in own]), np.array([m[1] for m in own]), np.arange(len(own))
        i, j = crosspoly._near(unit[node], home, here, here)
        keep = crosspoly._to_count(raw[node], node, home, np.full(len(own), t), i, j)
        np.add.at(links, (node[i[keep]], node[j[keep]]), 1)
    assert (links + links.T == (unit @ unit.T >= 0.98) & ~np.eye(300, dtype=bool)).all()


def test_unusable_rows_ties_and_clashing_columns(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (1, v, 0), (2, [2.0, 4.0, 6.0], 0), (2, [3.0, -1.0, 0.5], 0), (3, None, 0), (4, [], 0), (5, [0.0, 0.0, 0.0], 0)]
    rows += [(6, [1.0, None, 3.0], 0), (7, [1.0, float("nan"), 3.0], 0), (8, [float("inf"), 2.0, 3.0], 0), (9, v, None), (None, v, 0), (10, v[:2], 0), (11, [5.0], 1), (12, [6.0], 1), (13, [-6.0], 1), (14, [1e-30, 2e-30, 3e-30], 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as node", "2 as bucket", "3 as v", "4 as ok", "5 as copies")
    assert got(crosspoly.near_duplicates(df)) == plain(rows)
    assert crosspoly.near_duplicates(df.limit(0)).count() == 0
