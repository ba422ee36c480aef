"""A row that breaks each rule of the agents' audits, and each owner of a failure."""

from cairn.operators import agents

STEP = "run_id string, step_id int, place int, capability string, signature string, purpose string, expected_evidence array<string>, depends_on array<int>"


def step(run, n, place=None, tool="get", signature=None, purpose="why", evidence=("e",), needs=()):
    return (run, n, place or n, tool, signature or f"s{n}", purpose, list(evidence), list(needs))


def test_each_rule_of_plans(spark):
    catalog = spark.createDataFrame([("get",), ("find",)], "capability string")
    rows = [step("good", 1), step("good", 2, needs=[1]), step("gap", 1), step("gap", 3), step("long", 1), step("long", 2), step("long", 3), step("long", 4)]
    rows += [step("tool", 1, tool="rm"), step("blank", 1, purpose=" "), step("none", 1, evidence=()), step("empty", 1, evidence=("x", "")), step("later", 1, needs=[2]), step("later", 2), step("lost", 1, needs=[9]), step("self", 1, needs=[1])]
    got = sorted((r.run_id, r.step_id, r.rule) for r in agents.plan_violations(spark.createDataFrame(rows, STEP), catalog, 3).collect())
    assert got == [
        ("blank", 1, "purpose"), ("empty", 1, "evidence"), ("gap", 3, "step_ids"), ("later", 1, "later_dependency"), ("long", 4, "step_budget"), ("lost", 1, "unknown_dependency"), ("none", 1, "evidence"), ("self", 1, "later_dependency"), ("tool", 1, "capability"),
    ]


def test_each_rule_of_replacements(spark):
    catalog = spark.createDataFrame([("get",)], "capability string")
    executed = spark.createDataFrame([(r, 1, True, "s1") for r in ("good", "old", "down", "fail", "again", "many")] + [(r, 2, False, "s2") for r in ("good", "old", "down", "fail", "again", "many")], "run_id string, step_id int, ok boolean, signature string")
    tail = [step("good", 3, needs=[1]), step("good", 4, needs=[3]), step("old", 2, signature="x"), step("down", 5, 1), step("down", 4, 2), step("fail", 3, needs=[2]), step("again", 3, signature="s1"), step("again", 4, signature="s2"), step("many", 3), step("many", 4), step("many", 5)]
    got = sorted((r.run_id, r.step_id, r.rule) for r in agents.replacement_violations(spark.createDataFrame(tail, STEP), executed, catalog, 4).collect())
    assert got == [("again", 3, "repeated_call"), ("down", 4, "step_ids"), ("fail", 3, "dependency"), ("many", 5, "step_budget"), ("old", 2, "step_ids")]


def test_each_owner(spark):
    good = dict(errors=[], want=0, replans=0, status="completed", expected="completed", gate=True, allow=True, brief=True, needs=[], seen=True, planned=True, code=None, correctness=1.0, redundant=0, citation=1.0)
    cases = {
        "none": {}, "blocked": {"status": "plan_blocked"}, "unplanned": {"seen": False, "planned": False}, "boundary": {"seen": False}, "replanner": {"seen": False, "planned": False, "needs": [7], "replans": 1, "want": 1},
        "untyped": {"errors": ["lost"]}, "typed": {"errors": ["lost"], "code": "lost"}, "redundant": {"redundant": 2}, "count": {"replans": 1}, "stopped": {"expected": "execution_stopped"}, "order": {"correctness": 0.5},
        "thin": {"status": "insufficient_evidence"}, "gate": {"gate": False}, "brief": {"allow": False}, "cite": {"citation": 0.0},
    }
    rows = {k: good | v for k, v in cases.items()}
    case = spark.createDataFrame([(k, c["errors"], c["want"], c["replans"], c["status"], c["expected"], c["gate"], c["allow"], c["brief"]) for k, c in rows.items()], "case_id string, expected_errors array<string>, expected_replans int, replans int, status string, expected_status string, gate_passed boolean, allow_briefing boolean, has_briefing boolean")
    expected = spark.createDataFrame([(k, 1, "a", c["needs"]) for k, c in rows.items()], "case_id string, call_id int, signature string, needs array<int>")
    planned = spark.createDataFrame([(k, s) for k, c in rows.items() for s in (["z", "a"] if c["planned"] else ["z"])], "case_id string, signature string")
    observed = spark.createDataFrame([(k, 0, "a" if c["seen"] else "b", "error" if c["code"] else "ok", c["code"]) for k, c in rows.items()], "case_id string, position int, signature string, status string, error_code string")
    scores = spark.createDataFrame([(k, c["correctness"], c["redundant"], c["citation"], 1.0, 1.0) for k, c in rows.items()], "case_id string, correctness double, redundant int, citation double, relevance double, completeness double")
    got = {r.case_id: r.owner for r in agents.failure_owner(case, expected, planned, observed, scores).collect()}
    assert got == {
        "none": "none", "blocked": "planner", "unplanned": "planner", "boundary": "tool_boundary", "replanner": "replanner", "untyped": "tool_boundary", "typed": "none", "redundant": "replanner", "count": "replanner",
        "stopped": "replanner", "order": "replanner", "thin": "evidence_gate", "gate": "evidence_gate", "brief": "evidence_gate", "cite": "report_writer",
    }
    made = {r.case_id: (r.value, r.rationale) for r in agents.call_correctness(case, expected, observed).collect()}
    assert made["untyped"] == (round(2 / 3, 6), "Satisfied: expected call 1, replan count 0. Missing: typed error lost.")
    assert made["replanner"] == (round(1 / 3, 6), "Satisfied: replan count 1. Missing: expected call 1, dependency 7 before 1.")


def test_call_graph_rounds_aggregate_nothing(spark, monkeypatch):
    """Calls are only held against, so repeated ones needn't be gathered first; they change nothing."""
    from cairn import session
    from cairn.operators import evaluation

    plans, write = [], session.materialise
    monkeypatch.setattr(session, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, name))
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 2, 1), (1, 3, 2), (2, 1, None), (2, 2, 1), (2, 3, 9), (2, 3, 9)], "case_id long, call_id long, needs long")
    got = sorted((r.case_id, r.call_id, r.problem) for r in evaluation.call_graph_problems(edges).collect())
    assert got == [(1, 1, "cycle"), (1, 2, "cycle"), (1, 3, "cycle"), (2, 3, "unknown_prerequisite"), (2, 3, "unknown_prerequisite")]
    assert plans and not any("Aggregate" in p for p in plans)


def test_call_checks_hold_no_sorts_of_the_calls(spark):
    cases = spark.createDataFrame([(1, ["e"], 1, 1)], "case_id long, expected_errors array<string>, expected_replans int, replans int")
    expected = spark.createDataFrame([(1, 1, "a", []), (1, 2, "b", [1])], "case_id long, call_id long, signature string, needs array<long>")
    observed = spark.createDataFrame([(1, 5, "a", "ok", None), (1, 7, "b", "error", "e")], "case_id long, position long, signature string, status string, error_code string")
    scored = agents.call_correctness(cases, expected, observed)
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("min(position") == 0
    assert [r.value for r in scored.collect()] == [1.0]
