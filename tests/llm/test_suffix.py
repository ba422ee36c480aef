"""External induced sorting against plain sorting, and the operator against brute force."""

import hashlib
import random
import tempfile
from collections import Counter

import numpy as np
import pytest

from cairn.llm import repeats, suffix


@pytest.mark.parametrize(("block", "rows", "base", "rounds"), [(1 << 15, 10**6, 1 << 24, 120), (3, 5, 1 << 24, 80), (4, 7, 3, 25)])
def test_order_and_shared_prefixes(monkeypatch, block, rows, base, rounds):
    """With queues in files, tiny blocks, and recursion instead of sorting in memory."""
    monkeypatch.setattr(suffix, "BLOCK", block)
    monkeypatch.setattr(suffix, "QUEUE_ROWS", rows)
    monkeypatch.setattr(suffix, "BASE_ROWS", base)
    rng = random.Random(block)
    for _ in range(rounds):
        k, cap = rng.choice([1, 2, 3, 8]), rng.choice([3, 10, 200])
        own = [rng.randrange(1, k + 1) for _ in range(rng.randrange(50))] * rng.choice([1, 1, 3])
        text = np.array([*own, 0], np.uint16)
        with tempfile.TemporaryDirectory() as folder:
            got = list(suffix.suffixes(text, k + 1, cap, folder))
        at, shared = (np.concatenate(x) for x in zip(*got, strict=True))
        assert sorted(at.tolist()) == list(range(len(text)))
        tails = [text[i:].tolist() for i in at]
        assert all(a[:cap] >= b[:cap] for a, b in zip(tails, tails[1:], strict=False))
        for a, b, n in zip(tails, tails[1:], shared[1:].tolist(), strict=False):
            same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert n == min(same, cap)


def brute(rows, window):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + window] for b in texts for i in range(len(b) - window + 1))
    out = []
    for (doc_id, _), b in zip(rows, texts, strict=True):
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i + 1 : i + 1 + window] = True
        kept = bytes(x for k, x in enumerate(b) if not gone[k + 1])
        out.append((str(doc_id), len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [10**6, 3])
def test_removes_what_brute_force_removes(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_PIECES", hot)
    rng = random.Random(hot)
    rows = [(i, "".join(rng.choice("ab" if rng.random() < 0.3 else "abcdéfg") for _ in range(rng.randrange(150)))) for i in range(40)]
    shared = "".join(rng.choice("xyzé") for _ in range(60))
    rows += [(100 + i, f"{rng.random()}{shared}{rng.random()}") for i in range(30)]
    rows += [(200, "-" * 400), (201, None), (202, ""), (None, shared), (100, rows[40][1]), (100, rows[40][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _k1", "2 as a", "3 as spans")
    got = suffix.remove_repeats(df, plan=repeats.Plan("bytes", 16, gram=7, shard=700)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows, 16)


def test_empty_table(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_queues_write_no_file_for_a_few_rows(tmp_path):
    q, one = suffix.Queues(str(tmp_path), "q", 100), np.zeros(1, np.int16)
    for i in range(20):
        q.push(i % 10, np.array([i]), one)
    q.push(10, np.arange(100, 190), np.zeros(90, np.int16))
    assert set(q.files) == {10} and q.held == 20
    q.push(10, np.array([190]), one)
    assert [x for at, _ in q.take(3) for x in at.tolist()] == [3, 13]
    assert [x for at, _ in q.backward(10) for x in at.tolist()] == list(range(190, 99, -1))
    assert [x for at, _ in q.take(10) for x in at.tolist()] == list(range(100, 191))
