"""Values of tables in two layouts, comparisons of configurations, balanced rankings: a case for each rule."""

from cairn.operators import evaluation as E
from cairn.operators import finance, ranking

TABLE = "table_id string, layout string, unit string, period string, rows array<array<string>>"
HEAD, YEARS = ["", "Data Center", "Gaming", "Other"], [["Revenue", "1,234", "56", "7"], ["Costs", "1", "2", "3"], ["REVENUE", "1", "2", "3"], ["revenue", "4", "5", "6"]]
PERIODS, METRICS = ["", "FY 2024", "", "FY 2025", ""], ["", "Growth", "Revenue € millions", "Organic", ""]
TOTALS = [["Energy", "1", "2", "3"], ["Total part", "1%", "5", "2%"], ["Total Group", "4%", "38,153 ", "7%"]]


def test_a_table_for_each_rule(spark):
    cases = {
        "segments": ("segments", "USD", [HEAD, *YEARS], ("Data Center revenue", 1234.0, "USD", None)),
        "years": ("segments", "USD", [HEAD, *YEARS[:3]], "rows"),
        "numbers": ("segments", "USD", [HEAD, ["Revenue", "1", "-", "7"], *YEARS[1:]], "values"),
        "header": ("segments", "USD", [["", "Data Center", " ", "Other"], *YEARS], "header"),
        "two numbers": ("segments", "USD", [HEAD, ["Revenue", "1 of 2", "5", "7"], *YEARS[1:]], "number"),
        "short row": ("segments", "USD", [["", "", "", "", "", "A", "B", "C"], *YEARS], "number"),
        "periods": ("periods", "EUR", [PERIODS, METRICS, *TOTALS], ("Total Group revenue", 38153.0, "EUR", None)),
        "few rows": ("periods", "EUR", [PERIODS, METRICS], "rows"),
        "no period": ("periods", "EUR", [["", "FY 2024", "", "FY 2023"], METRICS, *TOTALS], "period"),
        "two periods": ("periods", "EUR", [["", "FY2025", "", "fy 2025"], METRICS, *TOTALS], "period"),
        "first column": ("periods", "EUR", [["FY 2025"], METRICS, *TOTALS], "metric"),
        "another metric": ("periods", "EUR", [PERIODS, ["", "", "Margin", ""], *TOTALS], "metric"),
        "no total": ("periods", "EUR", [PERIODS, METRICS, ["Totals", "", "3", ""]], "total"),
        "no number": ("periods", "EUR", [PERIODS, METRICS, ["Total", "", "", ""], ["Total x", "", "n/a", ""]], "number"),
        "no unit": ("periods", None, [PERIODS, METRICS, *TOTALS], "table"),
        "no rows": ("segments", "USD", None, "table"),
        "empty": ("segments", "USD", [], "table"),
        "other layout": ("?", "USD", [HEAD], "layout"),
    }
    df = spark.createDataFrame([(name, layout, unit, "FY2025", rows) for name, (layout, unit, rows, _) in cases.items()], TABLE)
    got = {r.table_id: (r.label, r.value, r.unit, r.error) for r in finance.reported_values(df).collect()}
    want = {name: w if isinstance(w, tuple) else (None, None, None, w) for name, (*_, w) in cases.items()}
    assert got == want


def test_displayed_numbers(spark):
    from pyspark.sql import functions as F

    from cairn.functions import text as T

    cells = {"1,234": 1234, "$ 56 m": 56, "12,34": None, "1,234,567 ": 1234567, "1 2": None, "": None, "-": None, "1,2345": None}
    df = spark.createDataFrame([(c,) for c in cells], "c string").select("c", T.displayed_number(F.col("c")).alias("n"))
    assert {r.c: r.n for r in df.collect()} == cells


def refusals(spark, scores, parameters):
    return {r.reason for r in E.comparison_refusals(spark.createDataFrame(scores, "configuration string, case_id long"), spark.createDataFrame(parameters, "configuration string, dataset_version string, dataset_hash string")).collect()}


def test_comparisons_are_refused(spark):
    both = [("a", "1", "h"), ("b", "1", "h")]
    assert refusals(spark, [("a", 1), ("b", 1)], both) == set()
    assert refusals(spark, [("a", 1)], both[:1]) == {"fewer than two configurations"}
    assert refusals(spark, [("a", 1), ("b", 1)], [*both, both[0]]) == {"a configuration twice"}
    assert refusals(spark, [("a", 1), ("b", 1)], [both[0], ("b", "1", "g")]) == {"several datasets"}
    assert refusals(spark, [("a", 1), ("b", 1), ("b", 2), ("a", 1)], both) == {"cases that not all have", "a case twice"}


def test_comparison_rows(spark):
    scores = spark.createDataFrame([("a", 1, 1.0, "none", 5.0, 2), ("a", 2, 0.5, "x", 7.0, 3), ("b", 1, 0.0, "x", 1.0, 2), ("b", 2, 0.5, "x", 2.0, 1)], "configuration string, case_id long, m double, failure_stage string, ms double, n int")
    parameters = spark.createDataFrame([("a", "1", "h"), ("b", "1", "h")], "configuration string, dataset_version string, dataset_hash string")
    got = sorted((r.kind, r.configuration, r.metric, r.case_id or 0, r.value) for r in E.compare_configurations(scores, parameters, ["m"], base="a", latency="ms", calls="n").collect())
    assert got == sorted([
        ("mean", "a", "m", 0, 0.75), ("mean", "b", "m", 0, 0.25), ("passed", "a", "m", 0, 1.0), ("passed", "b", "m", 0, 0.0), ("delta", "b", "m", 1, -1.0), ("failure", "a", "x", 0, 1.0), ("failure", "b", "x", 0, 2.0),
        ("latency", "a", "mean", 0, 6.0), ("latency", "a", "max", 0, 7.0), ("latency", "b", "mean", 0, 1.5), ("latency", "b", "max", 0, 2.0), ("calls", "a", "n", 1, 2.0), ("calls", "a", "n", 2, 3.0), ("calls", "b", "n", 1, 2.0), ("calls", "b", "n", 2, 1.0),
    ])


def test_balanced_ranking(spark):
    companies = spark.createDataFrame([("N", "Acme", 1, ["gaming"]), ("S", "Borel", 2, [])], "company string, name string, place int, expansion array<string>")
    chunks = spark.createDataFrame(
        [("n1", "N", "text", 1, "revenue gaming"), ("n2", "N", "table", 9, "revenue gaming"), ("n3", "N", "text", 1, "revenue"), ("n4", "N", "text", 1, "the what"), ("s1", "S", "text", 2, "Revenue growth"), ("s2", "S", "text", 1, "revenue"), ("s3", "S", "text", 1, "gaming"), ("s4", "S", "text", 1, "revenue")],
        "chunk_id string, company string, kind string, page int, text string",
    )
    questions = spark.createDataFrame([(1, "What revenue growth did ACME report?"), (2, "the revenue growth"), (3, "Acme and Borel revenue growth"), (4, "nothing"), (5, None)], "query_id long, question string")
    got = {}
    for r in ranking.balanced(questions, chunks, companies, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got[1] == ["n2", "n1", "n3"]  # one company is named: all four places are its own; no words in common, no place
    assert got[2] == got[3] == ["n2", "n1", "s1", "s2"]  # tables first, then pages, then ids
    assert got[4] == ["n2", "n1"]  # a company's own words alone
    one = ranking.balanced(questions.where("query_id = 2"), chunks, companies, 1).collect()
    assert [(r.chunk_id, r.rank) for r in one] == [("n2", 1)]  # one place for each company, one in all


def test_balanced_ranking_by_blocks_hands_on_the_best_only(spark, monkeypatch):
    for name, rows in (("CHUNK_ROWS", 20), ("ASKED_ROWS", 3), ("SCORE_ROWS", 2)):
        monkeypatch.setattr(ranking, name, rows)
    handed = []
    monkeypatch.setattr(ranking, "_share_best", lambda *a, f=ranking._share_best: handed.append(f(*a)) or handed[-1])
    companies = [("N", "acme", 1, ["gaming"]), ("S", "borel", 2, [])]
    words = ("revenue", "growth", "gaming", "cost", "the")
    chunks = [(f"c{i:03}", "NSX"[i % 3] if i % 17 else None, "table" if i % 7 == 0 else None, i % 5 or None, " ".join(w for j, w in enumerate(words) if i >> j & 1) if i % 19 else None) for i in range(300)]
    questions = [(1, "Acme revenue growth"), (2, "revenue cost"), (3, "acme and borel cost growth"), (4, "nothing"), (5, None), (6, "gaming the Borel"), (7, "growth"), (8, "cost")]
    chunks_, questions_ = spark.createDataFrame(chunks, "chunk_id string, company string, kind string, page int, text string"), spark.createDataFrame(questions, "query_id long, question string")
    k, want = 6, []
    for q, text in questions:
        named = [c for c in companies if text and c[1] in text.lower()]
        asked, found = named if len(named) == 1 else companies, []
        for company, _, _, expansion in asked:
            # without a question there are no words, the company's own neither
            terms = {w for w in (text or "").lower().split() if w not in ranking.BALANCED_STOP_WORDS} | set(expansion) if text else set()
            scored = [(-len(terms & set((c[4] or "").split()) - {"the"}), c[2] != "table", c[3] or 0, c[0]) for c in chunks if c[1] == company]
            found += [(q, company, c, -s) for s, _, _, c in sorted(scored)[: k // len(asked)] if s]
        want += [(*x, i) for i, x in enumerate(found, 1)]
    got = ranking.balanced(questions_, chunks_, spark.createDataFrame(companies, "company string, name string, place int, expansion array<string>"), k)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 20
    # 100 chunks of a company at most are 5 blocks: of each, the share of an asking at most, not a row for each chunk that meets
    assert handed and handed[0].groupBy("query_id", "company", "share").count().where("count > 5 * share").count() == 0
