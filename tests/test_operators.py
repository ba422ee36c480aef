"""Operators on small literals, against plain Python where an order is followed."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions import vectors as V
from cairn.operators import chunking as C
from cairn.operators import evaluation as E
from cairn.operators import finance as X
from cairn.operators import guards as G
from cairn.operators import ranking as R
from cairn.operators import sections as S
from cairn.plans.audits import eligible_blocks
from cairn.plans.chunks import ORACLES as CHUNK_SQL
from cairn.plans.chunks import sentence_similarity
from cairn.plans.figures import financial_metadata, financial_units, html_rows, snapshot_violations, table_text
from cairn.plans.ranks import ORACLES as RANK_SQL
from cairn.plans.ranks import certified_search
from cairn.plans.texts import common_prefix
from tests.oracle import same, views


def one(spark, column, **values):
    types = {str: "string", int: "long", float: "double", list: "array<double>"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("v")).first().v


def split_python(text, limit):
    out = []
    while len(text) > limit:
        at = text.rfind(" ", 0, limit + 1)
        cut = at if at > 0 else limit
        out.append(text[:cut])
        text = text[cut + 1 :] if text[cut : cut + 1] == " " else text[cut:]
    return [*out, text] if text else out


def pack_python(units, limit):
    out = []
    for u in units:
        if out and len(out[-1]) + 1 + len(u) <= limit:
            out[-1] += " " + u
        else:
            out.append(u)
    return out


def test_splits_and_packs_like_a_loop(spark):
    rng = random.Random(1)
    texts = [" ".join("x" * rng.randrange(1, 15) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", C.hard_split(F.col("t"), 11).alias("h"), C.pack(F.split("t", " "), 30).alias("p"), C.pack_words(F.col("t"), 25).alias("w")).collect():
        assert "".join(r.h).replace(" ", "") == r.t.replace(" ", "") and all(len(x) <= 11 for x in r.h)
        assert r.h == split_python(r.t, 11)
        assert r.p == pack_python(r.t.split(" "), 30)
        assert " ".join(r.w) == r.t


def test_windows_stop_at_the_first_that_reaches_the_end(spark):
    assert one(spark, C.fixed_windows(F.col("t"), 4, 1), t="abcdefg") == ["abcd", "defg"]
    assert one(spark, C.fixed_windows(F.col("t"), 4, 1), t="abcdefgh") == ["abcd", "defg", "gh"]
    assert one(spark, C.fixed_windows(F.col("t"), 4, 1), t="") == []
    with pytest.raises(ValueError):
        C.fixed_windows(F.col("t"), 4, 4)


def test_structure_keeps_tables_whole_and_drops_headings(spark):
    rows = [(1, 0, "heading", "H"), (1, 1, "paragraph", "aa"), (1, 2, "paragraph", "bb"), (1, 3, "table", "c | d"), (1, 4, "paragraph", "long one. and two."), (1, 5, "paragraph", "z")]
    got = C.structure_aware(spark.createDataFrame(rows, "source_id int, ordinal int, block_type string, text string"), 10).orderBy("n").collect()
    assert [(r.n, r.kind, r.text) for r in got] == [(1, "text", "aa\nbb"), (2, "table", "c | d"), (3, "long", "long one."), (4, "long", "and two."), (5, "text", "z")]


def test_vectors_near_the_largest_number(spark):
    assert one(spark, V.cosine(V.normalize(F.col("v")), V.normalize(F.col("v"))), v=[1e308, 1e308]) == pytest.approx(1.0)
    assert one(spark, V.normalize(F.col("v")), v=[0.0, 0.0]) == [0.0, 0.0]


def test_numbers_phrases_and_scores(spark):
    assert one(spark, T.numeric_tokens(F.col("t")), t="EUR 40.2bn, 18.7% and $193.7 x1 2,500 5.") == ["eur40.2bn", "18.7%", "$193.7", "2,500", "5"]
    assert one(spark, T.fact_present(F.col("f"), F.col("a")), f="Net Sales", a="the net-sales grew") is True
    assert one(spark, T.fact_present(F.col("f"), F.col("a")), f="net", a="internet") is False
    assert one(spark, T.common_prefix(F.col("a"), F.col("b")), a="abcdx", b="abcdy") == 4
    assert one(spark, T.common_prefix(F.col("a"), F.col("b")), a="", b="b") == 0
    assert one(spark, T.call_signature(F.lit("f"), F.col("j")), j='{"b": 1.50, "a": 2}') == 'f:{"a":2,"b":1.5}'


def test_fusion_and_its_refusals(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, passage_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1)], "query_id int, passage_id string, rank int")
    got = R.fuse({"a": a, "b": b}).orderBy("rank").collect()
    assert [(r.passage_id, r.channels) for r in got] == [("y", "a=2,b=1"), ("x", "a=1")]
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)
    for bad in ({"k": 0}, {"weights": {"c": 1.0}}, {"weights": {"a": -1.0}}, {"weights": {"a": math.inf}}):
        with pytest.raises(ValueError):
            R.fuse({"a": a}, **bad)


def test_bm25_against_the_formula(spark):
    p = spark.createDataFrame([("p1", "en", "apple pie apple"), ("p2", "en", "pie"), ("p3", "fr", "tarte")], "passage_id string, period string, text string")
    q = spark.createDataFrame([(1, "apple pie pie", None), (2, "pie", "fr")], "query_id int, question string, period string")
    got = {(r.query_id, r.passage_id): r.score for r in R.bm25_scores(p, q).collect()}
    avg = 5 / 3
    part = lambda df, tf, dl: math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got == {(1, "p1"): pytest.approx(part(1, 2, 3) + part(2, 1, 3), abs=1e-6), (1, "p2"): pytest.approx(part(2, 1, 1), abs=1e-6)}
    filled = R.ranked(R.fill_zero(R.bm25_scores(p, q), p, q, 3), 3)
    assert sorted((r.query_id, r.passage_id, r.score == 0) for r in filled.collect()) == [(1, "p1", False), (1, "p2", False), (1, "p3", True), (2, "p3", True)]


def test_call_graphs(spark):
    rows = [(1, 1, None), (1, 2, 1), (2, 1, 2), (2, 2, 1), (2, 3, 2), (3, 1, 9), (4, 1, 1)]
    got = {(r.case_id, r.call_id, r.problem) for r in E.call_graph_problems(spark.createDataFrame(rows, "case_id int, call_id int, needs int")).collect()}
    assert got == {(2, 1, "cycle"), (2, 2, "cycle"), (2, 3, "cycle"), (3, 1, "unknown_prerequisite"), (4, 1, "cycle")}


def test_guards_and_figures(spark):
    df = spark.createDataFrame([(1, "a", " b"), (2, None, ""), (3, "x", "y")], "id int, p string, q string")
    assert {(r.key, r.field, r.problem) for r in G.check_required(df, "id", ["p", "q"]).collect()} == {(1, "q", "untrimmed"), (2, "p", "missing"), (2, "q", "missing")}
    assert one(spark, G.redact(F.col("t")), t="my_api_key = abc, Authorization: Bearer x.y /home/me") == "my_[credential], [header] [path]".replace("my_[credential]", "[credential]")
    assert one(spark, G.unsafe_key(F.col("t")), t="a/..b/c") is False and one(spark, G.unsafe_key(F.col("t")), t="a/../c") is True
    assert one(spark, X.basis(F.col("t")), t="Non-GAAP") == "non-GAAP" and one(spark, X.audited(F.col("t")), t="unaudited") is False
    assert one(spark, X.half_up(F.col("x"), 1), x=0.25) == 0.3


def test_html_blocks():
    html = "<h1>A</h1><p>one <b>two</b><p>three</p><ul><li>x<ul><li>y</li></ul></li></ul><script>var t='</p>'</script><p> </p>"
    assert [(t, x) for _, t, x in html_rows(html)] == [("h1", "A"), ("p", "one two three x y"), ("p", "three"), ("li", "x y")]
    assert html_rows(None) == []
    assert re.fullmatch(r"\d+", str(len(html_rows("<p>" * 50))))


def test_financial_metadata_reads_whole_texts(spark, tmp_path):
    late = "word " * 60
    rows = [(2, late + "non-GAAP unaudited H2 2025 € million", "src1"), (5, late + "In millions", "src1"), (8, late + "In millions", "src2"), (11, late, "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.basis, r.audited, r.periods) for r in financial_metadata(spark, str(tmp_path)).collect()}
    assert got[2] == ("non-GAAP", False, "H2 2025") and got[11] == (None, None, "FY2024")
    units = {r.doc_id: (r.currency, r.scale) for r in financial_units(spark, str(tmp_path)).collect()}
    assert units == {2: ("EUR", "millions"), 5: ("USD", "millions"), 8: (None, "millions"), 11: (None, None)}


def test_eligible_blocks_far_into_a_document(spark, tmp_path):
    text = "head\n" + "line\n" * 9 + "er | 1\nEr  | 2\nother | 3"
    spark.createDataFrame([(7, text), (8, "head\nline")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["filter"]: (r.n, r.documents) for r in eligible_blocks(spark, str(tmp_path)).collect()}
    assert got == {"table": (3, 1), "paragraph": (10, 2), "document": (13, 1), "segment": (2, 1)}


def test_no_sort_in_one_task(spark, tmp_path):
    rng = random.Random(5)
    texts = ["ab" * rng.randrange(4) + "c" * rng.randrange(3) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = common_prefix(spark, str(tmp_path))
    want = {i: next((k for k, (x, y) in enumerate(zip(texts[i - 1], texts[i])) if x != y), min(len(texts[i - 1]), len(texts[i]))) for i in range(1, 200)}
    assert {r.item_id: r.shared for r in df.collect()} == want
    assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()
    plan = snapshot_violations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_units_keep_the_digits_of_their_own_place(spark):
    text = " a1. 19.37.233.111\n22 or 2"
    assert one(spark, C.sentence_units(F.col("t")), t=text) == ["a1.", "19.37.233.111", "22 or 2"]
    assert one(spark, C.sentence_units(F.col("t"), 300), t="0. 1! 2? 10") == ["0.", "1!", "2?", "10"]
    blocks = spark.createDataFrame([(1, 0, "heading", "H", ["A"], 1), (1, 1, "paragraph", text, ["A"], 1)], "source_id long, ordinal int, block_type string, text string, section_path array<string>, page int")
    assert [r.text for r in C.structure_aware(blocks, 20).orderBy("n").collect()] == ["a1. 19.37.233.111", "22 or 2"]
    assert [r.text for r in S.hierarchical_chunks(blocks, 300).where("role = 'child'").collect()] == ["a1. 19.37.233.111 22 or 2"]


def test_cells_keep_the_digits_of_their_own_place(spark, tmp_path):
    spark.createDataFrame([(1, "head\n0 a | 11 | 2 |  | 34"), (2, "head\n | 1 | 22 ")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.source_id: (r.cells, r.md5) for r in table_text(spark, str(tmp_path)).collect()}
    assert got == {1: (4, hashlib.md5(b"0 a | 11 | 2 | 34").hexdigest()), 2: (2, hashlib.md5(b"1 | 22").hexdigest())}


def test_dense_ranking_over_blocks_is_that_over_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_ROWS", 7)
    rng = random.Random(5)
    vs = [(f"p{i:03}", rng.choice(["en", " EN", "fr", None]), [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(90)]
    qs = [(i, rng.choice(["en", None, "xx"]), [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(30)]
    unit = lambda v: [x / (math.hypot(*v) or 1) for x in v]
    want = {}
    for q, limit, a in qs:
        rows = [(-round(sum(x * y for x, y in zip(unit(a), unit(b), strict=True)), 6) + 0.0, p) for p, own, b in vs if limit is None or (own or "").strip().lower() == limit]
        want |= {(q, n): (p, -s + 0.0) for n, (s, p) in enumerate(sorted(rows)[:5], 1)}
    odd = [("n1", "en", None), ("n2", "en", [1.0, None, 0.0, 0.0]), ("n3", "en", [math.nan, 0.0, 0.0, 0.0]), ("n4", "en", [math.inf, 0.0, 0.0, 0.0])]  # without a cosine
    v = spark.createDataFrame(vs + odd, "passage_id string, period string, v array<double>")
    got = R.dense_ranked(v, spark.createDataFrame(qs, "query_id long, period string, v array<double>"), 5).collect()
    assert {(r.query_id, r.rank): (r.passage_id, r.score + 0.0) for r in got} == want and len(got) == len(want)
    assert R.dense_ranked(v.limit(0), spark.createDataFrame(qs, "query_id long, period string, v array<double>"), 5).count() == 0


def test_scores_by_blocks_hand_on_the_best_only_and_all_ties(spark, monkeypatch):
    monkeypatch.setattr(R, "SCORE_ROWS", 4)
    rows = [(f"P{i:02}", "en" if i % 3 else "De ", "alpha beta " + "gamma " * (i // 4)) for i in range(40)]
    p = spark.createDataFrame([*rows, ("P40", "en", None), ("P41", None, "alpha")], "passage_id string, period string, text string")
    q = spark.createDataFrame([(1, "alpha gamma", None), (2, "beta gamma gamma", "de"), (3, "delta", None), (4, "alpha", "EN"), (5, "alpha", None), (6, None, None)], "query_id long, question string, period string")
    for scores in (R.bm25_scores, lambda *a, **o: R.bm25_scores(*a, "eligible", **o), R.tfidf_scores):
        every, some = scores(p, q).collect(), scores(p, q, k=2).collect()
        best = lambda rows: {r: [x.passage_id for x in sorted((x for x in rows if x.query_id == r), key=lambda x: (-x.score, x.passage_id))[:2]] for r in range(1, 7)}
        assert best(every) == best(some) and len(some) < len(every)
        assert {(r.query_id, r.passage_id) for r in every if r.query_id == 2} == {(2, f"P{i:02}") for i in range(0, 40, 3)}
        assert len([r for r in every if r.query_id == 4]) == 26 and not best(every)[3] and not best(every)[6]


@pytest.mark.parametrize("bound", [10, 200_000])
def test_tfidf_postings_are_dealt_by_their_number(spark, monkeypatch, bound):
    """Beyond ``bound`` terms meet by a shuffle; a task's rows don't grow with the table either way."""
    monkeypatch.setattr(R, "QUERY_ROWS", bound)
    monkeypatch.setattr(R, "TASK_ROWS", 100, raising=False)
    texts = {f"P{i:02}": ["common", *(f"word{i * 7 % 40 + j * j}" for j in range(30)), *["twice"] * (i % 3)] for i in range(60)}
    p = spark.createDataFrame([(k, "en", " ".join(v)) for k, v in texts.items()] + [("P98", "en", None), ("P99", "en", "")], "passage_id string, period string, text string")
    df = Counter(t for v in texts.values() for t in set(v))
    want = {}
    for k, v in texts.items():
        raw = [n * (math.log((1 + 62) / (1 + df[t])) + 1) for t, n in Counter(v).items()]
        want[k] = sorted(round(x / math.sqrt(sum(y * y for y in raw)), 9) for x in raw)
    weights, got = R.tfidf_weights(p), {}
    for r in weights.collect():
        got.setdefault(r.passage_id, []).append(round(r.w, 9))
    assert {k: sorted(v) for k, v in got.items()} == want
    assert weights.rdd.getNumPartitions() >= sum(map(len, want.values())) / 100
    if bound == 10:
        own, idf, parts = R._inverse_frequencies(p)
        met = R._with_idf(own, idf, parts)
        assert met.rdd.getNumPartitions() >= parts > 10 and met.where("idf is null").count() == 0 and met.count() == own.count()


@pytest.mark.parametrize("tokens", [1, 40, 1_000_000])
def test_neighbouring_sentences_meet_within_their_row(spark, tmp_path, monkeypatch, tokens):
    """Nothing but ids, and texts of ids that come again, is shuffled; the results are those of the SQL, whatever is compared at a time."""
    monkeypatch.setattr(C, "PROFILE_TOKENS", tokens, raising=False)
    rng = random.Random(3)
    words = ["red", "Blue", "the", "of", "x", "été", "1a", "same"]
    text = lambda: "".join(" ".join(rng.choices(words, k=rng.randrange(6))) + rng.choice([". ", "\n", "?! ", " "]) for _ in range(rng.randrange(12)))
    rows = [(i, text()) for i in range(60)] + [(i % 3 + 58, text()) for i in range(7)] + [(None, "red blue. red blue."), (100, None), (101, ""), (101, "red same. red."), (102, "the. of."), (59, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/parts")
    next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    got = sentence_similarity(spark, str(tmp_path))
    same(got, views(str(tmp_path)), CHUNK_SQL["sentence_similarity"])
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 2 and "SortMergeJoin" not in plan and "term" not in plan
    assert sentence_similarity(spark, str(tmp_path)).where("doc_id > 101").count() == 0


def test_ranks_of_wanted_pairs_are_those_among_all(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_ROWS", 7)
    rng = random.Random(8)
    vs = [(f"p{i:03}", rng.choice(["en", " EN", "fr", None]), [float(rng.randrange(-1, 2)) for _ in range(3)]) for i in range(80)] + [("n1", "en", None), ("n2", "en", [math.nan, 0.0, 0.0])]
    v = spark.createDataFrame(vs, "passage_id string, period string, v array<double>")
    q = spark.createDataFrame([(i, rng.choice(["en", None]), [float(rng.randrange(-1, 2)) for _ in range(3)]) for i in range(20)], "query_id long, period string, v array<double>")
    every = {(r.query_id, r.passage_id): r.rank for r in R.dense_ranked(v, q, 1000).collect()}
    wanted = [p for p in every if rng.random() < 0.2 and p[0] != 3] + [(1, "n1"), (1, "n2")]
    got = R.dense_ranks(v, q, spark.createDataFrame(wanted, "query_id long, passage_id string")).collect()
    assert {(r.query_id, r.passage_id): r.rank for r in got} == {p: every[p] for p in wanted if p in every} and len(got) == len(wanted) - 2


def test_no_candidate_of_the_certified_search_is_cut(spark, tmp_path, monkeypatch):
    """More than twenty passages tie or come first in each channel; ranks beyond them, and of score 0, count too."""
    monkeypatch.setattr(R, "BLOCK_ROWS", 9)
    rng = random.Random(11)
    texts = [rng.choice(["alpha beta", "alpha", "beta gamma alpha", "gamma", "", None]) for _ in range(150)] + ["rare alpha", "rare"]
    docs = [(i, t, "s", rng.choice(["en", "fr", None])) for i, t in enumerate(texts)]
    asked = [(0, "rare"), (2, "alpha"), (3, "gamma beta alpha"), (4, "rare gamma"), (5, "..."), (7, "unknown"), (8, "unknown"), (9, None)]
    vectors = [(i, [float(rng.randrange(-2, 3)) for _ in range(3)]) for i in range(140)] + [(140, None), (141, [math.nan, 1.0, 0.0]), (142, [math.inf, 1.0, 0.0]), (151, [1.0, 2.0, 2.0])]
    for name, rows, schema in (("documents", docs, "doc_id long, text string, source string, lang string"), ("benchmark", asked, "item_id long, text string"), ("embeddings", vectors, "vec_id long, embedding array<float>")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}-parts")
        next((tmp_path / f"{name}-parts").glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
    con = views(str(tmp_path))
    con.execute("CREATE TABLE events (user_id BIGINT, event_id BIGINT, event_type VARCHAR, ts TIMESTAMP, value DOUBLE, props VARCHAR)")
    got = certified_search(spark, str(tmp_path))
    same(got, con, RANK_SQL["certified_search"])
    unit = lambda v: [x / (math.hypot(*v) or 1) for x in v]
    vector, want = {i: unit(v) for i, v in vectors if v and all(map(math.isfinite, v))}, {}
    for q, question in asked:
        own = {i: Counter((t or "").split()) for i, t, _, lang in docs if q % 2 or lang == "en"}
        mean = sum(t.total() for t in own.values()) / len(own)
        idf = {w: math.log(1 + (len(own) - n + 0.5) / (n + 0.5)) for w in set((question or "").split()) if (n := sum(w in t for t in own.values())) + 1}
        score = {i: round(sum(x * t[w] * 2.5 / (t[w] + 1.5 * (0.25 + 0.75 * t.total() / mean)) for w, x in idf.items()), 6) for i, t in own.items()}
        near = {i: round(sum(a * b for a, b in zip(vector[q], vector[i], strict=True)), 6) for i in own if i in vector}
        fused = Counter()
        for weight, channel in ((10, score), (1, near)):
            for n, i in enumerate(sorted(channel, key=lambda i: (-channel[i], i)), 1):
                fused[i] += weight / (60 + n)
        want |= {(q, n): (f"DOC-{i:08}", round(fused[i], 9)) for n, i in enumerate(sorted(fused, key=lambda i: (-round(fused[i], 9), i))[:3], 1)}
        assert min(len(score), len(near)) > 40
    assert {(r["query_id"], r["rank"]): (r["passage_id"], round(r["score"], 9)) for r in got.collect()} == want


def test_depth_of_a_fusion_that_its_leading_channel_decides():
    for k in (1, 3, 5):
        m = R.deciding_depth({"a": 10.0, "b": 1.0}, "a", k)
        assert 10 / (60 + m + 1) + 1 / 61 < 10 / (60 + k) <= 10 / (60 + m) + 1 / 61
    with pytest.raises(ValueError):
        R.deciding_depth({"a": 1.0, "b": 1.0}, "a", 3)
