"""Chains of evidence: a hit for each link that breaks; gates; the five measures of a run."""

from cairn.operators import gates as X

HIT = "run_id long, hit_no int, company string, chunk_id string, element_type string, unit string, element_ids array<string>, physical_page int, document_id string, document_sha256 string, source_reference string"
GOOD = (1, 1, "N", "c1", "table", "USD", ["e1", "e2"], 3, "N-1", "h1", "s1")
FIELDS = [c.split()[0] for c in HIT.split(", ")]


def hits(spark, *changes):
    rows = [tuple((dict(zip(FIELDS, GOOD)) | {"hit_no": i} | c).values()) for i, c in enumerate(changes, 1)]
    return spark.createDataFrame(rows, HIT)


def certified(spark):
    return spark.createDataFrame([("h1", "N"), ("h2", "S")], "document_sha256 string, owner string")


def test_table_chain_names_the_first_broken_link(spark):
    changes = [{}, {"company": "X", "unit": None}, {"element_type": "list"}, {"unit": None, "physical_page": 0}, {"chunk_id": " "}, {"element_ids": []}, {"element_ids": None}, {"physical_page": 0}, {"physical_page": None}, {"document_sha256": "h9"}, {"document_sha256": None}]
    got = [r.broken for r in X.table_chain(hits(spark, *changes), certified(spark), ["N", "S"]).orderBy("hit_no").collect()]
    assert got == [None, "company", "element_type", "unit", "chunk", "elements", "elements", "page", "page", "hash", "hash"]


def test_ownership_chain_names_the_first_broken_link(spark):
    changes = [{}, {"element_type": "image"}, {"element_ids": []}, {"source_reference": " "}, {"chunk_id": ""}, {"document_sha256": "h9", "document_id": "?"}, {"document_sha256": "h9"}, {"document_sha256": "h2"}, {"physical_page": -1}, {"unit": None, "element_type": "list"}]
    rows = X.ownership_chain(hits(spark, *changes), certified(spark), {"N-": "N", "S-": "S"}).orderBy("hit_no").collect()
    assert [r.broken for r in rows] == [None, "element_type", "elements", "source", "chunk", "owner", None, "claim", "page", None]
    assert rows[6].owner == "N" and rows[7].owner == "S"  # by the id where the hash is unknown; the hash goes first


def test_gate_lists_what_each_run_lacks(spark):
    runs = spark.createDataFrame([(1,), (2,), (3,)], "run_id long")
    seen = spark.createDataFrame([(1, "N", "metric"), (1, "N", "document"), (1, "S", "metric"), (1, "S", "document"), (2, "S", "metric"), (2, "S", "metric"), (2, "X", "metric"), (9, "N", "metric")], "run_id long, company string, kind string")
    got = {r.run_id: (r.passed, r.missing) for r in X.gate(runs, seen, ["N", "S"], ["metric", "document"]).collect()}
    every = ["N metric", "N document", "S metric", "S document"]
    assert got == {1: (True, []), 2: (False, ["N metric", "N document", "S document"]), 3: (False, every)}


def test_evidence_of_observations(spark):
    schema = "run_id long, capability string, status string, company string, source_references array<string>, evidence_ids array<string>, hits array<struct<source:string,evidence_id:string>>"
    m, s = "get_company_metric", "search_financial_documents"
    rows = [
        (1, m, "ok", "N", ["a"], [], []), (2, m, "ok", "N", ["a", " "], [], []), (3, m, "ok", "N", [], [], []), (4, m, "error", "N", ["a"], [], []), (5, m, "ok", None, ["a"], [], []), (6, s, "ok", "N", ["a"], ["e"], [("a", "e")]),
        (7, s, "ok", "N", ["a"], ["e"], [("b", "e"), ("a", "x")]), (8, s, "ok", "N", ["a"], ["e"], None), (9, s, "ok", "N", [""], ["e"], [("", "e")]), (10, "other", "ok", "N", ["a"], ["e"], [("a", "e")]),
    ]
    assert sorted((r.run_id, r.kind) for r in X.evidence_kinds(spark.createDataFrame(rows, schema)).collect()) == [(1, "metric"), (6, "document")]


RUN = "run_id long, status string, replans int, max_steps int, max_replans int, intent string, label string, briefing boolean, summary string, cross_observations int, interpretation int, limitations int, covered array<string>, aggregate_sources array<string>"
RUN_FIELDS = [c.split()[0] for c in RUN.split(", ")]
FACT = "run_id long, fact_no int, company string, chunk_id string, element_ids array<string>, source_reference string, physical_page int"


CASES = {
    "whole": ({}, [1, 1, 1, 1, 1]),
    "another order": ({"calls": [(1, 1, "b", "ok"), (1, 2, "a", "ok")]}, [0, 1, 1, 1, 1]),
    "a call more": ({"calls": [(1, 1, "a", "ok"), (1, 2, "b", "ok"), (1, 3, "c", "ok")]}, [0, 1, 1, 1, 1]),
    "an error": ({"calls": [(1, 1, "a", "ok"), (1, 2, "b", "error")]}, [0, 1, 1, 1, 1]),
    "repeated": ({"calls": [(1, 1, "a", "ok"), (1, 2, "a", "ok")]}, [0, 0, 1, 1, 1]),
    "too many replans": ({"run": {"replans": 2}}, [0, 0, 1, 1, 1]),
    "no briefing": ({"run": {"briefing": False}}, [1, 1, 0, 0, 0]),
    "not completed": ({"run": {"status": "stopped"}}, [1, 1, 0, 1, 1]),
    "other words": ({"run": {"summary": "Margins"}}, [1, 1, 0, 1, 1]),
    "reference mission": ({"run": {"summary": "Margins", "intent": "reference"}}, [1, 1, 1, 1, 1]),
    "no intent": ({"run": {"intent": None}}, [1, 1, 0, 1, 1]),
    "no limitations": ({"run": {"limitations": 0}}, [1, 1, 1, 0, 1]),
    "one company": ({"run": {"covered": ["N"]}}, [1, 1, 1, 0, 1]),
    "sources in another order": ({"run": {"aggregate_sources": ["s1", "s2"]}}, [1, 1, 1, 1, 0]),
    "no facts": ({"facts": []}, [1, 1, 0, 1, 0]),
    "another element": ({"hit": {"element_ids": ["e1"]}}, [1, 1, 1, 1, 0]),
    "another page": ({"hit": {"physical_page": 9}}, [1, 1, 1, 1, 0]),
    "not certified": ({"hit": {"document_sha256": "h9"}}, [1, 1, 1, 1, 0]),
    "gate closed": ({"passed": False}, [1, 1, 1, 1, 0]),
}


def test_each_measure_of_a_run(spark):
    """All cases at once, each a run of its own."""
    runs, calls, facts, found, gates = [], [], [], [], []
    for n, (change, _) in enumerate(CASES.values()):
        runs.append(tuple((dict(zip(RUN_FIELDS, (n, "completed", 0, 4, 1, "growth", "growth", True, "The Growth of both", 1, 1, 1, ["N", "S"], ["s2", "s1"]))) | change.get("run", {})).values()))
        calls += [(n, *c[1:]) for c in change.get("calls", [(1, 1, "a", "ok"), (1, 2, "b", "ok")])]
        facts += [(n, *f[1:]) for f in change.get("facts", [(1, 1, "S", "c2", ["e1"], "s2", 4), (1, 2, "N", "c1", ["e2"], "s1", 3)])]
        for no, own in enumerate(({"chunk_id": "c1", "element_ids": ["zz"]}, {"chunk_id": "c1"} | change.get("hit", {}), {"chunk_id": "c2", "company": "S", "source_reference": "s2", "physical_page": 4, "document_sha256": "h2"})):
            found.append(tuple((dict(zip(FIELDS, GOOD)) | {"run_id": n, "hit_no": no} | own).values()))
        gates.append((n, change.get("passed", True)))
    out = X.evaluate_runs(
        spark.createDataFrame(runs, RUN), spark.createDataFrame(calls, "run_id long, position int, signature string, status string"), spark.createDataFrame([(1, "a"), (2, "b")], "position int, signature string"),
        spark.createDataFrame(facts, FACT), spark.createDataFrame(found, HIT), spark.createDataFrame(gates, "run_id long, passed boolean"), certified(spark), ["N", "S"],
    )
    got = {r.run_id: ([r[m] for m in X.METRICS], r.release) for r in out.collect()}
    assert {name: got[n] for n, name in enumerate(CASES)} == {name: (want, want == [1] * 5) for name, (_, want) in CASES.items()}
