"""Order MinHash against all pairs on a small corpus; alignment; components."""

import random
from itertools import combinations

import numpy as np

from cairn.llm import ordminhash
from cairn.session import materialise


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def shingles(text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    return ordminhash.labelled_shingles(data, np.array([0, len(data)]))[0]


def test_similarity_is_that_of_a_full_alignment():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.randrange(30) for _ in range(rng.randrange(1, 40))]
        b = [x for x in a if rng.random() > 0.07] + [rng.randrange(30) for _ in range(rng.randrange(3))]
        x, y = shingles(" ".join(map(str, a))), shingles(" ".join(map(str, b)))
        if not len(y):
            continue
        m = lcs(x.tolist(), y.tolist())
        want = m / (len(x) + len(y) - m)
        got = ordminhash.similarity(x, y)
        assert abs(got - want) < 1e-12 or (want < 0.8 and got < 0.8)


def corpus():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(40, 200))]
        for _ in range(rng.randrange(1, 9)):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((n, " ".join(own)))
            n += 1
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    for _ in range(25):
        rows.append((n, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(60))))
        n += 1
    a, b = rows[0][1].split(), rows[0][1].split()[::-1]
    return rows + [(n, " ".join(b)), (n + 1, None), (n + 2, None), (n + 3, ""), (n + 4, "!!!"), (n + 5, "!!!"), (n + 6, "Hi, there"), (n + 7, "hi there"), (n + 8, " ".join(a) + "!"), (n + 8, " ".join(a) + "!")]


def test_classes_are_those_of_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as s", "3 as class")
    got = [(r.doc_id, r.class_id, r.class_size) for r in ordminhash.classify(df).collect()]
    assert len(got) == len(rows)
    own = {r: shingles(t) for r, (_, t) in enumerate(rows)}
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        equal = rows[i][1] and rows[i][1] == rows[j][1]
        if equal or ordminhash.similarity(own[i], own[j]) >= 0.8:
            up[max(top(i), top(j))] = min(top(i), top(j))
    want = sorted((rows[i][0], rows[top(i)][0]) for i in range(len(rows)))
    assert sorted((d, c) for d, c, _ in got) == want
    kept = ordminhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({rows[top(i)][0] for i in range(len(rows))})


def test_empty_table_and_nothing_alike(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "q w e r t y")], "doc_id long, text string")
    assert ordminhash.classify(df.limit(0)).count() == 0
    assert sorted(r.class_id for r in ordminhash.classify(df).collect()) == [1, 2]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"x", b"z")], "a binary, b binary")
    got = {bytes(r.node): bytes(r["class"]) for r in ordminhash.connected(edges).collect()}
    assert got == {bytes([i]): b"\x00" for i in range(41)} | {b"z": b"x", b"x": b"x"}


def test_copies_alike_only_through_their_original(spark):
    rng = random.Random(3)
    original = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(original))]
    for n in range(1, 301):
        own = list(original)
        for k in rng.sample(range(5, 295, 6), 5):  # 25 of 296 shingles
            own[k] = f"x{n}k{k}"
        rows.append((n, " ".join(own)))
    own = [shingles(t) for _, t in rows]
    assert all(ordminhash.similarity(own[0], x) >= 0.8 for x in own)
    assert sum(ordminhash.similarity(own[i], own[i + 1]) >= 0.8 for i in range(1, 300)) < 30
    got = ordminhash.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.class_id, r.class_size) for r in got} == {(0, 301)}


def classes_of_all_pairs(texts):
    own, up = [shingles(t) for t in texts], list(range(len(texts)))
    for j in range(len(own)):
        for i in range(j):
            if up[i] != up[j] and ordminhash.similarity(own[i], own[j]) >= 0.8:
                up = [min(up[i], up[j]) if u in (up[i], up[j]) else u for u in up]
    return up


def test_pairs_among_many_texts_of_one_template(spark):
    rng = random.Random(11)
    template, texts = [f"t{i}" for i in range(110)], []
    for n in range(400):
        own = [f"o{n}x{i}" for i in range(60)]
        texts.append(" ".join(template + own))
        if n % 40 == 0:
            own[rng.randrange(10, 50)] = "other"
            own[rng.randrange(10, 50)] = "word"
            texts.append(" ".join(template + own))
    want = classes_of_all_pairs(texts)
    assert len(set(want)) == 400
    got = ordminhash.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == list(enumerate(want))


def test_rounds_only_spare_work(spark, monkeypatch):
    rows = [(n, t) for n, t in corpus()[:80] if t]
    want = sorted((n, rows[u][0]) for (n, _), u in zip(rows, classes_of_all_pairs([t for _, t in rows])))
    assert len({c for _, c in want}) < len(rows) - 10
    monkeypatch.setattr(ordminhash, "ROUNDS", 0)
    monkeypatch.setattr(ordminhash, "BLOCK", 2, raising=False)
    got = ordminhash.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == want


def test_no_link_of_a_whole_table_is_lost(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = {}
    for (doc_id, _), u in zip(rows, classes_of_all_pairs([t for _, t in rows])):
        want.setdefault(u, set()).add(doc_id)
    got = {}
    for r in ordminhash.classify(docs).collect():
        got.setdefault(r.class_id, set()).add(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert all(c == min(ids) for c, ids in got.items()) and len(got) < len(rows) - 40


def test_texts_that_collide_in_a_polynomial_hash_stay_apart(spark):
    """Blocks in the order of the Thue-Morse sequence and of its complement are equal to any polynomial hash modulo 2**64."""
    order = [bin(i).count("1") % 2 for i in range(2048)]
    texts = []
    for blocks in (("a", "b"), (" ".join(f"x{i}" for i in range(12)), " ".join(f"y{i}" for i in range(12)))):
        texts += [" ".join(blocks[o] for o in order), " ".join(blocks[1 - o] for o in order)]
    got = ordminhash.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(i, i) for i in range(4)]


def test_folded_words_tell_words_apart():
    def folded(*texts):
        data = "".join(texts).encode()
        at = np.cumsum([0, *(len(t.encode()) for t in texts)])
        out, ends = ordminhash.folded_words(np.frombuffer(data, np.uint8), at)
        return [out[i:j].tobytes() for i, j in zip(ends, ends[1:])]

    assert folded("Ab, c", "", "ab c!", "abc", " é", "--") == [b"ab\0c\0", b"", b"ab\0c\0", b"abc\0", "é".encode() + b"\0", b""]
    assert folded("", "") == [b"", b""]


def test_texts_that_share_a_passage_only_are_not_compared_in_rounds(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = word(100)
    rows = [(i, " ".join(passage + word(55))) for i in range(60)]
    copy = rows[0][1].split()
    copy[-1] = "other"
    rows.append((60, " ".join(copy)))
    compared, verified = [], ordminhash._verified
    monkeypatch.setattr(ordminhash, "_verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    got = ordminhash.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {**{i: i for i in range(60)}, 60: 0}
    assert 1 <= sum(compared) < 60


def test_components_of_few_links_take_few_stages(spark, monkeypatch):
    """Facts by node of few links are broadcast; the shuffles beyond that number give the same components."""
    edges = materialise(spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(0, 12) if i % 4 < 3], "a binary, b binary"), "edges")
    components = lambda: {bytes(r.node): bytes(r["class"]) for r in ordminhash.connected(edges).collect()}
    stages = lambda: spark.sparkContext._jsc.sc().dagScheduler().nextStageId()
    start = stages()
    got = components()
    few = stages() - start
    assert got == {bytes([i]): bytes([i // 4 * 4]) for i in range(12)}
    monkeypatch.setattr(ordminhash, "FEW", -1)
    start = stages()
    assert components() == got and few < stages() - start
