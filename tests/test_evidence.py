"""Filters, flattened observations, revisions of plans, claims by company: a case for each rule."""

from pyspark.sql import functions as F

from cairn.operators import evidence as X

CHUNK = "chunk_id int, company string, period string, document_type string, element_type string, document_id string, segments array<string>"
FILTER = "filter_id int, company string, period string, document_type string, element_type string, document_id string, segment string"


def test_filters_meet_all_wishes(spark):
    chunks = spark.createDataFrame([(1, "Acme", "FY26", "10-K", "table", "d1", ["Data", "Gaming"]), (2, "acme", "FY25", "10-K", "list", "d2", []), (3, None, "FY26", "10-K", "table", "d3", None)], CHUNK)
    filters = spark.createDataFrame([(1, " ACME ", None, None, None, None, None), (2, None, "fy26", None, "Table ", None, None), (3, None, None, None, None, None, " gaming"), (4, None, None, None, "image", None, None), (5, None, None, None, None, None, None), (6, "Acme", "FY26", "10-k", "table", "D1", "data"), (7, "Acme", "FY24", None, None, None, None)], FILTER)
    got = {}
    for r in X.filtered(chunks, filters).collect():
        got.setdefault(r.filter_id, set()).add(r.chunk_id)
    assert got == {1: {1, 2}, 2: {1, 3}, 3: {1}, 5: {1, 2, 3}, 6: {1}}
    assert [(r.filter_id, r.element_type) for r in X.filter_violations(filters).collect()] == [(4, "image")]


def test_payloads_of_every_shape(spark):
    payloads = {
        '{"source":"a","hits":[{"source":"b","evidence_id":"e1"},{"source":"a","evidence_id":"e1"},{"source":"c"}]}': (["e1", "e1"], ["a", "b", "c"]),
        '{"hits":[1,null,"x",{"evidence_id":2,"source":null},{"evidence_id":"e"}]}': (["e"], []),
        '{"hits":{"evidence_id":"e"},"source":["a"]}': ([], []), '{"source":"a"}': ([], ["a"]), "[]": ([], []), "7": ([], []), "null": ([], []), "no json": ([], []),
    }
    df = spark.createDataFrame([(p,) for p in payloads], "p string").withColumn("result", F.try_parse_json("p"))
    assert {r.p: (r.evidence_ids, r.source_references) for r in X.flattened(df).collect()} == payloads


def test_revisions(spark):
    rows = [(1, 0, "plan", None), (1, 1, "Replace_Remaining now", None), (1, 2, None, None), (1, 3, "seen", 5), (1, 4, "seen", 2), (1, 5, "replace_remaining", 9), (1, 6, "x", None), (2, 0, "x", None), (2, 1, "replace_remaining", None)]
    df = spark.createDataFrame(rows, "run_id int, index int, summary string, plan_revision int")
    got = {}
    for r in X.plan_revisions(df).orderBy("run_id", "index").collect():
        got.setdefault(r.run_id, []).append(r.revision)
    assert got == {1: [1, 2, 2, 5, 5, 10, 10], 2: [1, 2]}


def test_claims(spark):
    rows = [(1, 3, "N", "c"), (1, 1, "S", "a"), (1, 2, "N", "b"), (1, 4, None, "d"), (1, 5, "X", None), (2, 1, "N", "e")]
    got = [(r.run_id, r.place, r.company, r.claims) for r in X.company_claims(spark.createDataFrame(rows, "run_id int, fact_no int, company string, claim string")).orderBy("run_id", "place").collect()]
    assert got == [(1, 1, "S", ["a"]), (1, 2, "N", ["b", "c"]), (2, 1, "N", ["e"])]
    df = spark.createDataFrame([(["l"], ["q", "r"]), (None, None)], "l array<string>, q array<string>").select(X.open_points(F.col("l"), F.col("q")).alias("p"))
    assert [r.p for r in df.collect()] == [["l", "Open question: q", "Open question: r"], []]
