"""The chain's marginals against enumeration; held-out accuracy; defined cases."""

import itertools

import numpy as np

from cairn.llm import quality

SF = "/root/testdata/sf0.01"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(5)
    lens = [3, 1, 5, 0, 4]
    offsets = np.concatenate([[0], np.cumsum(lens)])
    e, t = rng.normal(size=offsets[-1]), rng.normal(size=(2, 2))
    f, b = quality.chain(e, offsets, t)
    for i, n in enumerate(lens):
        own = e[offsets[i] : offsets[i] + n]
        total, up = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            p = np.exp(sum(own[k] * y[k] for k in range(n)) + sum(t[y[k], y[k + 1]] for k in range(n - 1)))
            total += p
            up += p * np.array(y)
        if n:
            at = slice(offsets[i], offsets[i] + n)
            assert np.allclose(quality._sigmoid(f[at] + b[at]), up / total)


def test_features_do_not_depend_on_neighbouring_texts():
    texts = [b"One two.\n\nThree THREE three\nOne two.", b"", b"\n \n", b"x" * 3000, "é a\né a".encode()]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    x, size, lines = quality.line_features(np.frombuffer(b"".join(texts), np.uint8), at)
    for i, t in enumerate(texts):
        own = quality.line_features(np.frombuffer(t, np.uint8), np.array([0, len(t)], np.int64))
        assert np.allclose(x[lines[i] : lines[i + 1]], own[0]) and np.allclose(size[lines[i] : lines[i + 1]], own[1])
    assert np.diff(lines).tolist() == [3, 0, 0, 1, 2]


def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out").select("quality", "predicted").collect()
    for kind in (0, 1):
        own = [r.predicted == kind for r in got if r.quality == kind]
        assert sum(own) / len(own) > 0.9


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None), (1, "a b"), (2, ""), (3, "word " * 200000)], "doc_id long, text string").selectExpr("*", "1 as score", "2 as held_out", "3 as label")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (9, None)], "doc_id long, quality int")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == 5 and all(r.score == 0.5 for r in got)
    assert quality.score(docs.limit(0), quality.train(docs, labels.limit(0))).count() == 0
    assert docs.select(quality.held_out().alias("h")).where("h is null").count() == 0
