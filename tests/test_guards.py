"""Whole guards: a row that breaks each rule."""

from pyspark.sql import functions as F

from cairn.operators import guards as G


def test_unsafe_texts(spark):
    cases = {
        " ": ["blank"], "": ["blank"], "plain": [], "my API_KEY here": ["credential"], "https://me:pw@example.org/x": ["userinfo"], "https://example.org/@x": [], "see /home/me": ["personal_path"], "x/home/me": [],
        r"\Users\me": ["personal_path", "rooted_path"], "at c:/work": ["rooted_path"], "https://example.org": [], r"\\server\share": ["rooted_path"], "the Chain-of-Thought": ["hidden_reasoning"], "sk-abcdefghijklmn at D:\\x": ["credential", "rooted_path"],
    }
    df = spark.createDataFrame([(t,) for t in cases] + [(None,)], "t string").select("t", G.unsafe_text(F.col("t")).alias("r"))
    assert {r.t: r.r for r in df.collect()} == cases | {None: []}


def test_redaction_takes_quoted_values_whole(spark):
    cases = {
        'MY_API_KEY = "a b c" next': "[credential] next", "api-key='x y', z": "[credential], z", "apikey=abc;d": "[credential];d", 'Authorization: Bearer "t u" v': "[header] v", "authorization: basic abc, x": "[header], x",
        "Bearer abc.def": "[token]", "sk-12345678 x": "[token] x", "at /home/me/x y\nz": "at [path]\nz",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", G.redact(F.col("t")).alias("r"))
    assert {r.t: r.r for r in df.collect()} == cases


def test_audit_counts_what_it_looked_at(spark):
    df = spark.createDataFrame([("a", 1, "c:/x"), (" ", 2, None), ("chain of thought", 3, "ok")], "a string, n int, b string")
    got = {(r.column, r.rule): (r["values"], r.hits) for r in G.audit_values(df).collect()}
    assert {k: v for k, v in got.items() if v[1]} == {("a", "blank"): (3, 1), ("a", "hidden_reasoning"): (3, 1), ("b", "rooted_path"): (2, 1)}
    assert len(got) == 2 * 6


def test_golden_set(spark):
    case = "case_id string, question string, expected array<string>, requires_abstention boolean"
    known = spark.createDataFrame([("p1",), ("p2",)], "passage_id string")
    version = lambda *v: spark.createDataFrame([(x,) for x in v], "dataset_version string")
    found = lambda v, rows: sorted((r.key, r.rule) for r in G.golden_violations(v, spark.createDataFrame(rows, case), known).collect())
    good = [("A", "q", ["p1"], False), ("b", "q", [], True)]
    assert found(version("1"), good) == []
    assert found(version(), []) == [("dataset", "empty"), ("dataset", "version")]
    bad = [*good, (" a", "", ["p2", "p9"], False), (None, "q", ["p1"], True)]
    assert found(version(" "), bad) == [("", "abstention"), ("", "case_id"), (" a", "question"), ("a", "duplicate_case"), ("dataset", "version"), ("p9", "unknown_evidence")]


def test_elements(spark):
    schema = "element_id string, element_type string, bbox struct<x0:int,y0:int,x1:int,y1:int>, rows array<array<string>>, row_count int, column_count int"
    box = (0, 0, 1, 1)
    rows = [
        ("ok", "table", box, [["a", "b"], ["c", "d"]], 2, 2), ("text", "paragraph", box, None, None, None), ("flat", "paragraph", (0, 3, 1, 3), None, None, None), ("no box", "paragraph", None, None, None, None), ("open", "paragraph", (0, None, 1, 1), None, None, None),
        ("absent", "table", box, None, None, None), ("other", "list", box, [["a"]], 1, 1), ("short", "table", box, [["a"]], 2, 1), ("ragged", "table", box, [["a"], ["b", "c"]], 2, 1), ("empty", "table", box, [], 0, 0),
    ]
    got = {}
    for r in G.element_violations(spark.createDataFrame(rows, schema)).collect():
        got.setdefault(r.element_id, []).append(r.rule)
    assert got == {"flat": ["area"], "open": ["area"], "absent": ["table"], "other": ["table"], "short": ["row_count"], "ragged": ["column_count"], "empty": ["row_count", "column_count"]}


def test_fusion_inputs(spark):
    hits = lambda *rows: spark.createDataFrame(list(rows), "query_id long, passage_id string, rank int, content string")
    found = lambda c, k, w=None: sorted((r.rule, r.channel or "", r.key or "") for r in G.fusion_violations(c, k, w).collect())
    good = {"a": hits((1, "p", 1, "x")), "b": hits((1, "p", 1, "x"))}
    assert found(good, 60, {"a": 1}) == []
    assert found({}, 60) == [("no_channels", "", "")]
    assert found(good, 0, {"a": -1, "b": float("nan"), "z": 1}) == [("k", "", "0"), ("unknown_weight", "z", ""), ("weight", "a", "-1"), ("weight", "b", "nan")]
    bad = {"a": hits((1, "p", 1, "x"), (1, "p", 2, "x"), (2, "p", 1, "x")), "b": hits((1, "p", 1, "y")), " ": hits((1, "q", 1, "x")).limit(0)}
    assert found(bad, 60) == [("channel_name", " ", ""), ("conflict", "", "p"), ("duplicate", "a", "1:p"), ("empty", " ", "")]
