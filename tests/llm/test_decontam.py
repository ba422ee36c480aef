"""Decontamination against a plain scan for every window."""

import hashlib
import random
import re

from cairn.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12)) if w else ():
            wins.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    out = []
    for d, t in docs:
        w = words(t)
        hit, own = set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    own |= wins[tuple(w[k : k + n])]
        sha = hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
        out.append((str(d), len(w), len(hit), len(own), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_every_window_is_found(spark):
    rng = random.Random(4)
    make = lambda n, of="abcdefg": " ".join(rng.choice(of) + rng.choice("xyÉ") for _ in range(n))
    items = [(1, make(30)), (2, make(13)), (10, make(5)), (3, "solo"), (4, None), (5, ""), (6, "... !"), (7, make(2, "pq")), (8, make(30, "a"))]
    items += [(9, items[0][1]), (None, make(20))]
    docs = [(i, make(rng.randrange(80))) for i in range(60)]
    docs += [(100, f"{make(300, 'xyz')} {items[0][1].upper().replace('É', 'É')} {make(9)}"), (101, items[1][1] + "!" + items[1][1]), (102, "SOLO"), (103, None), (104, ""), (105, make(400, "a"))]
    docs += [(106, items[7][1] + " " + make(30)), (None, items[2][1]), (101, items[1][1]), (101, items[1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as _k1", "2 as win", "3 as item_id")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as words")
    # an item without an id can't be listed; its windows still hit
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.contamination(df, bench.where("item_id is not null")).collect())
    assert got == brute(docs, [x for x in items if x[0] is not None])
    kept = sorted(str(r.doc_id) for r in decontam.drop_contaminated(df, bench.where("item_id is not null")).collect())
    assert kept == sorted(x[0] for x in got if not x[5])
    assert decontam.contamination(df, bench).where("n_hit > 0").count() >= sum(x[2] > 0 for x in got)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontam.contamination(df.limit(0), bench).count() == 0
    assert [r.contaminated for r in decontam.contamination(df, bench.limit(0)).collect()] == [False]
