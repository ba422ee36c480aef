"""Mixing: deviation, wholeness, given weights, defined cases."""

from collections import Counter

import pytest

from cairn.llm import mixing


def test_given_weights_hold_at_every_slot(spark):
    rows = [(i, "a" if i % 3 else "b", i) for i in range(900)] + [(None, None, 1), (None, None, 1), (5, "a", 2)]
    df = spark.createDataFrame(rows, "doc_id long, source string, block long")
    weights = spark.createDataFrame([("a", 0.2), ("b", 0.75), ("zzz", 0.05)], "source string, weight double")
    got = mixing.interleave(df, weights, block_rows=3, cycle=40).orderBy("mix_pos").collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((a, b) for a, b, _ in rows)
    assert len({r.mix_pos for r in got}) == len(rows)
    slots = sorted({(r.slot, r.source or "") for r in got if r.on_target})
    share = {"a": 8, "b": 30, "": 1}
    done = Counter()
    assert slots and [s for s, _ in slots] == list(range(len(slots)))
    for t, (_, s) in enumerate(slots):
        done[s] += 1
        assert all(abs(done[k] - (t + 1) * w / 39) < 1 for k, w in share.items())
    order = [r.doc_id for r in got if r.source == "b"]
    assert order == sorted(order)


def test_empty_table(spark):
    assert mixing.interleave(spark.createDataFrame([], "doc_id long, source string")).count() == 0


def test_odd_weights_and_orders(spark):
    rows = [(f"id{i % 40:03d}", "abcde"[i % 5]) for i in range(200)] + [(None, "a"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id string, source string").selectExpr("*", "1 as _key", "2 as _id", "3 as _range")
    weights = spark.createDataFrame([("a", 2.0), ("a", 1.0), ("b", 2.0), ("c", None), ("d", 0.0), ("e", -3.0), ("e", 1.0), (None, 1.0)], "source string, weight double")
    share = {r._key: r.share for r in mixing.shares(weights).collect()}
    assert share == {"sa": 3, "sb": 2, "se": 1, "n": 1}  # whole numbers are the shares; null, zero and negative ones count as none
    got = mixing.interleave(df, weights, block_rows=2).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter(rows) and len({r.mix_pos for r in got}) == len(rows)
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.mix_pos) if r.source == "a"]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or ""))
    cycle = 3 + 2 + 1 + 1 + 1 + 1
    first = Counter(r.source for r in got if r.slot < cycle)
    assert first == {"a": 6, "b": 4, "e": 2, None: 1, "c": 2, "d": 2}


def test_rounded_weights_fill_the_cycle(spark):
    weights = spark.createDataFrame([(str(i), w) for i, w in enumerate((0.3333, 0.3333, 0.3334, 1e-9))], "source string, weight double")
    assert sorted(r.share for r in mixing.shares(weights, 100).collect()) == [1, 33, 33, 34]


def test_more_sources_than_slots_are_refused(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(12)], "doc_id long, source string")
    with pytest.raises(ValueError):
        mixing.interleave(df, cycle=11)
    assert mixing.interleave(df, cycle=12).count() == 12


def test_a_hot_source_with_sparse_ids_is_numbered_over_many_ranges(spark):
    rows = [(i * 7_000_000_000_037 % (1 << 60), "hot" if i % 3 else "cold") for i in range(3000)]
    got = mixing.interleave(spark.createDataFrame(rows, "doc_id long, source string").repartition(8), block_rows=1).collect()
    for source in ("hot", "cold"):
        own = sorted((r.block, r.doc_id) for r in got if r.source == source)
        assert [b for b, _ in own] == list(range(len(own))) and [i for _, i in own] == sorted(i for i, s in rows if s == source)
