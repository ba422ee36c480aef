"""The forest against brute force."""

import math

import numpy as np

from cairn.llm import lshforest


def brute(rows, every, k):
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out = {}
    for i, v in good:
        if i % every == 0:
            near = sorted({(-float(np.dot(np.float64(v), np.float64(w))), j) for j, w in good if j != i and len(w) == len(v)})[:k]
            out.setdefault(i, [j for _, j in near])
    return out


def test_defined_cases_and_recall_on_a_small_table(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(120)]
    same = rng.normal(size=4).tolist()
    rows += [(1000 + i, same) for i in range(60)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 4), (2003, [1.0, None, 1.0, 1.0]), (2004, [float("nan")] * 4), (2005, [float("inf"), 1.0, 1.0, 1.0]), (None, same), rows[20], (2010, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as v", "2 as h1", "3 as block")
    got, vectors = {}, {i: np.array(v) for i, v in rows if v and i is not None}
    for r in sorted(lshforest.search(df, every=10, k=5).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - float(vectors[r.query_id] @ vectors[r.vec_id])) < 1e-12 and r["rank"] == len(got[r.query_id])
    want = {q: n for q, n in brute(rows, 10, 5).items() if n}
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))
    same_score = [q for q in got if q >= 1000 and q < 1060]
    assert all(got[q] == sorted(got[q], key=lambda j: (-float(vectors[q] @ vectors[j]), j)) for q in same_score)
    assert lshforest.search(df.limit(0)).count() == 0


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_recall_with_the_shipped_constants(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit(rng.normal(size=(9000, 64))))], "vec_id long, embedding array<float>").repartition(4)
    found = lshforest.search(df, every=60).cache()
    assert found.count() == 150 * 20
    assert lshforest.recall(found, df) >= 0.9


def test_blocks_and_groups_of_vectors_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(lshforest, "QUERY_ROWS", 40)
    monkeypatch.setattr(lshforest, "BLOCK_ROWS", 700)
    rng = np.random.default_rng(5)
    x = unit(rng.normal(size=(2000, 12))) * rng.uniform(0.5, 4.0, size=(2000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = lshforest.search(df).cache()
    assert found.count() == 100 * 20
    assert lshforest.recall(found, df) >= 0.9


def test_few_rows_are_scored_in_clusters():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(200, 64))
    x = unit(centres[np.arange(10000) % 200] + 0.15 * rng.normal(size=(10000, 64)))
    forest, own = lshforest.Forest(x, lshforest.strings(x, 1.0), 1.0), lshforest.strings(x[:50], 0.0)
    scored, hits = 0, 0
    for q, met, score in forest.candidates(x[:50], own, 21):
        assert np.allclose(score, x[met] @ x[q])
        scored += len(met)
        hits += len(np.intersect1d(np.argsort(-(x @ x[q]))[:21], met))
    assert scored < 50 * 1000 and hits >= 0.9 * 50 * 21


def test_trees_descend_to_the_longest_prefix_whatever_the_size():
    """Clusters of 100 near rows: 20 neighbours are found by scoring fewer than one row in fifty."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(160, 64))
    x = unit(centres[np.arange(16000) % 160] + 0.05 * rng.normal(size=(16000, 64)))
    forest, own = lshforest.Forest(x, lshforest.strings(x, 1.0), 1.0), lshforest.strings(x[:40], 0.0)
    longest = forest.longest(own)
    for t in (0, 50):
        shared = [[64 - (int(a) ^ int(b)).bit_length() for b in lshforest.strings(x, 1.0)[:, t]] for a in own[:5, t]]
        assert longest[:5, t].tolist() == [max(s) for s in shared]
    scored, hits = 0, 0
    for q, met, score in forest.candidates(x[:40], own, 21):
        scored += len(met)
        hits += len(np.intersect1d(np.argsort(-(x @ x[q]))[:21], met))
    assert scored < 0.02 * 40 * len(x) and hits >= 0.9 * 40 * 21


def test_shared_bits():
    a = np.array([0, 1, 2**63, 2**64 - 1, 5], np.uint64)
    b = np.array([0, 0, 0, 2**64 - 1, 4 + 2**40], np.uint64)
    assert lshforest.shared_bits(a, b).tolist() == [64, 63, 0, 64, 23]
