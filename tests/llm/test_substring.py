"""Substring dedup against brute force, with small windows and little variety, so that all ways are taken."""

import hashlib
import random
from collections import Counter

import pytest

from cairn.llm import repeats, substring


def brute(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = {k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(doc_id), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("ab" if rng.random() < 0.3 else "abcdefgh") for _ in range(rng.randrange(60)))) for i in range(40)]
    shared = " ".join(rng.choice("xyz") + rng.choice("pq") for _ in range(25))
    rows += [(100 + i, f"{rng.random()} {shared} {rng.random()}") for i in range(30)]
    rows += [(200, "The " * 300), (201, None), (202, ""), (None, shared), (203, "é ü\tx\x0b\x0cy\x1cz  " * 9), (100, rows[40][1]), (100, rows[40][1])]
    return rows


@pytest.mark.parametrize("hot", [10**6, 3])
def test_removes_what_brute_force_removes(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_PIECES", hot)
    rows = corpus(hot)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _k1", "2 as a", "3 as spans")
    plan = repeats.Plan("words", 7, gram=4, shard=150)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(df, plan=plan).collect())
    assert got == brute(rows, 7)


def test_empty_table(spark):
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_automaton_counts_like_a_scan():
    rng = random.Random(3)
    for _ in range(60):
        texts = [[rng.choice("abc").encode() for _ in range(rng.randrange(1, 25))] for _ in range(4)]
        weights = [rng.randrange(1, 3) for _ in texts]
        held = substring.SuffixAutomaton()
        for t, w in zip(texts, weights, strict=True):
            held.add(t, w)
        held.finish()
        for n in (1, 3, 5):
            seen = Counter()
            for t, w in zip(texts, weights, strict=True):
                for i in range(len(t) - n + 1):
                    seen[tuple(t[i : i + n])] += w
            for t in texts:
                want = [seen[tuple(t[i : i + n])] > 1 for i in range(len(t) - n + 1)]
                assert held.repeated(t, n).tolist() == want


def test_reference_spans_are_removed(spark):
    licence = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, f"a b {licence} c"), (2, "w1  w2 w3"), (3, None), (4, licence[:150])], "doc_id long, text string")
    got = {r.doc_id: r.text for r in substring.remove_reference(docs, spark.createDataFrame([(licence,), (None,)], "text string")).collect()}
    assert got == {1: "a b c", 2: "w1  w2 w3", 3: None, 4: ""}
    with pytest.raises(ValueError):
        substring.remove_reference(docs, spark.createDataFrame([("x " * 7_000_000,)], "text string"))
