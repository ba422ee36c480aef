"""Scores of answers: a case for each check."""

from cairn.operators import scoring as S
from cairn.session import materialise

CASE = "case_id long, expected_status string, allow_briefing boolean, required_companies array<string>, required_evidence_ids array<string>, required_fact_kinds array<string>, required_limitations array<string>"
PREDICTION = "case_id long, configuration_id string, status string, briefing boolean, text string, cross_observations int, limitations array<string>, source_references array<string>"
FACT = "case_id long, configuration_id string, fact_no int, kind string, source_references array<string>, evidence_ids array<string>"
OBSERVED = "case_id long, configuration_id string, capability string, status string, source_references array<string>, evidence_ids array<string>, hits array<struct<source:string,evidence_id:string>>, duration_ms double"
M, D = "get_company_metric", "search_financial_documents"
GOOD_CASE = {"expected_status": "completed", "allow_briefing": True, "companies": ["Acme", "Borel"], "ids": ["e1", "e2"], "kinds": ["metric", "document"], "limits": ["Currencies", "reporting periods", "other"]}
GOOD = {"status": "completed", "briefing": True, "text": "ACME and borel: P/E, revenue growth", "cross": 1, "limits": ["Currency effects, reporting period", "and other things"], "sources": ["s2", "s1"]}
FACTS = [(1, "document", ["s2"], ["e1"]), (2, "metric", ["s1"], []), (3, "document", ["s2"], ["e2"])]
CALLS = [(M, "ok", ["s1"], [], None), (D, "ok", ["s2"], ["e1", "e2"], [("s2", "e1"), ("s2", "e2"), ("s9", "e1")])]
CASES = {  # (changed case, changed prediction, facts, calls) -> relevance, completeness, citations
    "whole": ({}, {}, FACTS, CALLS, (1, 1, 1)),
    "one company": ({}, {"text": "Acme valuation operating-growth"}, FACTS, CALLS, (0.75, 5.5 / 6, 1)),
    "no dimension": ({}, {"text": "acme borel"}, FACTS, CALLS, (0.5, 1, 1)),
    "another status": ({}, {"status": "stopped"}, FACTS, CALLS, (1, 5 / 6, 1)),
    "missing id": ({"ids": ["e1", "e3"]}, {}, FACTS, CALLS, (1, 5.5 / 6, 1)),
    "missing kind": ({"kinds": ["price"]}, {}, FACTS, CALLS, (1, 5 / 6, 1)),
    "nothing required": ({"companies": [], "ids": [], "kinds": [], "limits": []}, {"limits": None}, FACTS, CALLS, (1, 1, 1)),
    "no comparison": ({}, {"cross": 0}, FACTS, CALLS, (1, 5 / 6, 1)),
    "limits": ({}, {"limits": ["currencies"]}, FACTS, CALLS, (1, (5 + 1 / 3) / 6, 1)),
    "stop as expected": ({"allow_briefing": False, "expected_status": "stopped", "ids": [], "kinds": [], "limits": [], "companies": []}, {"status": "stopped", "briefing": False, "text": None, "cross": None, "limits": None, "sources": None}, [], CALLS, (1, 5 / 6, 1)),
    "stop with a briefing": ({"allow_briefing": False, "expected_status": "stopped"}, {}, FACTS, CALLS, (0, 5 / 6, 1)),
    "no briefing": ({}, {"briefing": False, "text": None, "cross": None, "limits": None, "sources": None}, [], CALLS, (0, 1 / 6, 0)),
    "another order": ({}, {"sources": ["s1", "s2"]}, FACTS, CALLS, (1, 1, 0)),
    "no facts": ({"ids": [], "kinds": []}, {"sources": []}, [], CALLS, (1, 1, 0)),
    "metric with an id": ({}, {}, [FACTS[0], (2, "metric", ["s1"], ["e1"]), FACTS[2]], CALLS, (1, 1, 0)),
    "two sources": ({}, {}, [FACTS[0], (2, "metric", ["s1", "s2"], []), FACTS[2]], CALLS, (1, 1, 0)),
    "unknown kind": ({}, {}, [FACTS[0], FACTS[1], (3, None, ["s2"], ["e2"])], CALLS, (1, 1, 0)),
    "pair not returned": ({}, {"sources": ["s9", "s1", "s2"]}, [(1, "document", ["s9"], ["e1"]), *FACTS[1:]], CALLS, (1, 1, 0)),
    "call failed": ({}, {}, FACTS, [(M, "error", ["s1"], [], None), CALLS[1]], (1, 1, 0)),
}


def tables(spark):
    cases, predictions, facts, calls = [], [], [], []
    for n, (case, told, own, made, _) in enumerate(CASES.values()):
        c, p = GOOD_CASE | case, GOOD | told
        cases.append((n, c["expected_status"], c["allow_briefing"], c["companies"], c["ids"], c["kinds"], c["limits"]))
        predictions.append((n, "a", p["status"], p["briefing"], p["text"], p["cross"], p["limits"], p["sources"]))
        facts += [(n, "a", *f) for f in own]
        calls += [(n, "a", *c, 2.5) for c in made]
    return spark.createDataFrame(cases, CASE), spark.createDataFrame(predictions, PREDICTION), spark.createDataFrame(facts, FACT), spark.createDataFrame(calls, OBSERVED)


def test_each_check(spark):
    cases, predictions, facts, calls = tables(spark)
    found = [S.answer_relevance(cases, predictions), S.answer_completeness(cases, predictions, facts), S.citation_integrity(cases, predictions, facts, calls)]
    got = [{r.case_id: r.value for r in t.collect()} for t in found]
    for n, (name, (*_, want)) in enumerate(CASES.items()):
        assert [round(x, 6) for x in want] == [g[n] for g in got], name
    told = {r.case_id: r.rationale for r in found[0].collect()}
    assert told[1] == "Satisfied: company Acme, mission dimension valuation, mission dimension operating growth. Missing: company Borel."


def test_case_scores_and_summary(spark):
    cases, predictions, facts, calls = tables(spark)
    citations = S.citation_integrity(cases, predictions, facts, calls)
    scores = {m: citations for m in S.MEASURES}
    trajectory = spark.createDataFrame([(0, "a", 1.0), (0, "a", 2.0)], "case_id long, configuration_id string, duration_ms double")
    rows = {r.case_id: r for r in S.case_scores(cases, predictions, scores, trajectory, calls).collect()}
    names = list(CASES)
    assert rows[0].latency_ms == 3.0 and rows[1].latency_ms == 5.0 and rows[0].calls == 2
    assert {names[n] for n, r in rows.items() if r.release} == {name for name, (*_, want) in CASES.items() if want[2] == 1} - {"stop with a briefing"}
    s = S.summarise(S.case_scores(cases, predictions, scores, trajectory, calls)).first()
    assert s.cases == len(CASES) and not s.released and s.answer_relevance_passed == sum(w[2] == 1 for *_, w in CASES.values()) and s.max_latency_ms == 5.0


def test_rows_of_cases_are_never_broadcast(spark):
    """Files of repeated values are small whatever the number of cases: their size must not choose the join."""
    cases, predictions, facts, calls = (materialise(t, "scoring") for t in tables(spark))
    for scored in (S.answer_relevance(cases, predictions), S.answer_completeness(cases, predictions, facts), S.citation_integrity(cases, predictions, facts, calls)):
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
