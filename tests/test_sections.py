"""Pages as trees; chunks that follow sections."""

import random

import duckdb
import pyarrow as pa
from pyspark.sql.types import LongType

from cairn.operators import sections as S
from cairn.plans import figures
from cairn.plans.sections import ORACLES, html_sections
from cairn.sources import html as H
from tests.oracle import same


def blocks_of(html):
    return [(kind, text, path, rows) for _, _, kind, _, text, path, rows in H.read(html, "P")]


def test_root_is_main_then_body_then_the_page():
    out = "<p>nav</p>"
    assert [b[1] for b in blocks_of(f"<body>{out}<main><p>a</p></main>{out}<main><p>second</p></main></body>")] == ["a"]
    assert [b[1] for b in blocks_of(f"{out}<body><p>a</p></body>")] == ["a"]
    assert [b[1] for b in blocks_of(f"{out}<p>a</p>")] == ["nav", "a"]
    assert [b[1] for b in blocks_of("<body><div><main><section><p>deep</p></section></main></div><p>x</p></body>")] == ["deep"]
    assert blocks_of("") == blocks_of(None) == blocks_of("<main></main><p>outside</p>") == []


def test_heading_path_keeps_what_a_skipped_level_leaves():
    got = blocks_of("<h1>A</h1><h3>B</h3><h3>C</h3><p>x</p><h2>D</h2><p>y</p><h1> </h1><p>z</p>")
    assert [(b[1], b[2]) for b in got] == [("A", ["A"]), ("B", ["A", "B"]), ("C", ["A", "B", "C"]), ("x", ["A", "B", "C"]), ("D", ["A", "D"]), ("y", ["A", "D"]), ("z", [""])]


def test_lists_tables_and_nesting():
    got = blocks_of("<ul><li>a<ul><li>b</li></ul></li><li> </li></ul><table><tr><th>k</th><th>v <b>w</b></th></tr><tr></tr><tr><td></td><td>1<br>2</td></tr></table><table></table>")
    assert got[0] == ("list", "a b", [], None)
    assert got[1] == ("table", "k | v w | 1 2", [], [["k", "v w"], ["", "1 2"]]) and len(got) == 2
    nested = blocks_of("<table><tr><td>o<table><tr><td>i</td></tr></table></td></tr></table>")
    assert [b[3] for b in nested] == [[["o i"], ["i"]], [["i"]]]


def test_unclosed_and_stray_tags_scripts_and_entities():
    got = blocks_of('<div><p>a<p>b</div><p>c</p></span><p>d &amp; <script>"</p>"</script>e<!-- no --></p><style>p{}</style><p/>f')
    assert [b[1] for b in got] == ["a b", "b", "c", "d & e"]
    ids = [(i, n) for i, n, *_ in H.read("<p>a</p><p></p><p>b</p>", "S")]
    assert ids == [("S-B001", 0), ("S-B002", 1)]


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "<h1>a</h1><p>b</p>"), (None, "<p>c</p>"), (3, None), (4, "<p>" + "x " * 200_000 + "</p>")], "page_id long, html string").selectExpr("*", "'z' as text", "1 as ordinal")
    got = {(r.page_id, r.block_id): (r.text[:3], r.section_path) for r in H.html_blocks(df).collect()}
    assert got == {(1, "1-B001"): ("a", ["a"]), (1, "1-B002"): ("b", ["a"]), (None, "-B001"): ("c", []), (4, "4-B001"): ("x x", [])}
    assert H.html_blocks(df.limit(0)).count() == 0


BLOCK = "source_id long, ordinal int, block_type string, text string, section_path array<string>, page int"


def packed(rows, budget):
    """One block after the other."""
    out, group = [], []
    for r in rows:
        _, _, kind, text, path, page = r
        if kind == "table":
            out, group = [*out, group, [r]], []
        elif kind not in ("paragraph", "list"):
            out, group = [*out, group], []
        elif group and group[-1][4] == path and group[-1][5] == page and sum(len(g[3]) for g in group) + len(text) <= budget:
            group.append(r)
        else:
            out, group = [*out, group], [r]
    return [[g[1] for g in group] for group in [*out, group] if group]


def test_financial_packing_is_that_of_a_plain_loop(spark):
    rng = random.Random(4)
    rows = [(s, i, rng.choice(["paragraph", "paragraph", "list", "table", "heading"]) if i % 9 else "paragraph", "x" * rng.choice([1, 20, 60]), rng.choice([["a"], ["a"], ["a", "b"], []]) if i % 4 == 0 else ["a"], i // 10) for s in range(4) for i in range(80)]
    got = {}
    for r in S.financial_chunks(spark.createDataFrame(rows, BLOCK), 100).orderBy("source_id", "n").collect():
        got.setdefault(r.source_id, []).append(r.ordinals)
    assert got == {s: packed([r for r in rows if r[0] == s], 100) for s in range(4)}


def test_financial_text(spark):
    rows = [(1, 0, "paragraph", "one", ["H", "I"], 2), (1, 1, "list", "two", ["H", "I"], 2), (1, 2, "table", "t", [], 3)]
    df = spark.createDataFrame(rows, BLOCK).selectExpr("*", "'ACME' as company")
    got = S.financial_chunks(df, 100, {"Company": "company"}).orderBy("n").collect()
    assert [(r.kind, r.text) for r in got] == [("paragraph", "Company: ACME\n\nHeading path: H > I\n\none\n\ntwo\n\nSource page: 2"), ("table", "Company: ACME\n\nt\n\nSource page: 3")]
    assert S.financial_chunks(df.limit(0), 100).count() == 0


def test_hierarchy_numbers_parents_over_all_chunks(spark):
    rows = [(1, 0, "heading", "H", ["A"], 1), (1, 1, "paragraph", "One is here. Two is here.", ["A"], 1), (1, 2, "paragraph", "No path.", [], 1), (1, 3, "list", "Three.", ["A"], 2), (1, 4, "paragraph", "Four.", ["B"], 2)]
    got = {r.chunk_id: (r.role, r.parent_id, r.text) for r in S.hierarchical_chunks(spark.createDataFrame(rows, BLOCK), 14).collect()}
    assert got == {
        "1-HIERARCHICAL-001": ("parent", None, "One is here. Two is here.\nThree."), "1-HIERARCHICAL-001-C01": ("child", "1-HIERARCHICAL-001", "One is here."), "1-HIERARCHICAL-001-C02": ("child", "1-HIERARCHICAL-001", "Two is here."),
        "1-HIERARCHICAL-001-C03": ("child", "1-HIERARCHICAL-001", "Three."), "1-HIERARCHICAL-005": ("parent", None, "No path."), "1-HIERARCHICAL-005-C01": ("child", "1-HIERARCHICAL-005", "No path."),
        "1-HIERARCHICAL-007": ("parent", None, "Four."), "1-HIERARCHICAL-007-C01": ("child", "1-HIERARCHICAL-007", "Four."),
    }


def test_sql_of_pages_knows_skipped_levels(spark, tmp_path):
    table = " | ".join("xyz")
    texts = ["A\nli\np\n" + table + f"\np\nB\np\nli\np\n{table}\np\nC\np\nli\np\nD\np\nE\np", "-\nli\np\n" + table + "\np\nB\np\nli\np\nC\np\nD\np\nli\np\nE\np\nF\np"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' as source", "'en' as lang").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR); CREATE TABLE events (user_id BIGINT, event_id BIGINT, event_type VARCHAR, ts TIMESTAMP, value DOUBLE, props VARCHAR)")
    same(html_sections(spark, str(tmp_path)), con, ORACLES["html_sections"])


def test_pages_are_handed_on_in_small_batches(monkeypatch):
    texts = ["x" * 30, None, "y" * 70, "z" * 250, "", "w"]
    batch = pa.RecordBatch.from_pydict({"page_id": pa.array(range(6)), "html": pa.array(texts, pa.string())})
    monkeypatch.setattr(H, "CHARACTERS", 100)
    assert [b.column(0).to_pylist() for b in H.small_batches(batch, 1)] == [[0, 1, 2], [3], [4, 5]]
    assert [b.column(0).to_pylist() for b in H.small_batches(batch.slice(3, 1), 1)] == [[3]] and list(H.small_batches(batch.slice(0, 0), 1)) == []


def test_a_large_batch_of_pages_is_not_read_whole(monkeypatch):
    """The functions of both parsers give several batches for one: what they hold doesn't grow with Spark's batches."""
    monkeypatch.setattr(H, "CHARACTERS", 1000)
    pages = pa.RecordBatch.from_pydict({"page_id": pa.array(range(50)), "name": pa.array(["n"] * 50), "html": pa.array(["<p>" + "a " * 200 + "</p>"] * 50)})

    class Pages:
        schema = {"page_id": type("Field", (), {"dataType": LongType()})}
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    monkeypatch.setattr(figures, "table", lambda *_: Pages())
    monkeypatch.setattr(H.F, "col", lambda name: type("Column", (), {"alias": lambda *_: None, "cast": lambda self, _: self})())
    for run, columns in ((H.html_blocks(Pages()), ["page_id", "name", "html"]), (figures._blocks(None, None), ["page_id", "html"])):
        out = list(run(iter([pages.select(columns)])))
        assert len(out) == 17 and sum(b.num_rows for b in out) == 50


def test_every_block_has_its_heading_path(spark, tmp_path):
    pages = {
        1: "<nav><li>n</li></nav><h1>A</h1><p>a</p><h3>B</h3><h3>C</h3><table><tr><td>1</td></tr></table><h2>D</h2><p>d</p><h1>E</h1><ul><li>e</li></ul>",
        2: "<p>no heading</p>", 3: None, 4: "<h2>F</h2><p>f</p><h2> </h2><p>g</p>", 5: "<body><h1>out</h1><main><h2>in</h2><p>x</p></main><p>y</p></body>",
    }
    spark.createDataFrame(list(pages.items()), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {}
    for r in figures.heading_paths(spark, str(tmp_path)).orderBy("page_id", "ordinal").collect():
        got.setdefault(r.page_id, []).append((r.block_type, r.level, r.path))
        assert r.ordinal == len(got[r.page_id]) - 1 and r.depth == (len(r.path.split(" > ")) if r.path or r.page_id == 4 and r.ordinal > 1 else 0)
    assert got == {
        1: [("list", None, ""), ("heading", 1, "A"), ("paragraph", None, "A"), ("heading", 3, "A > B"), ("heading", 3, "A > B > C"), ("table", None, "A > B > C"), ("heading", 2, "A > D"), ("paragraph", None, "A > D"), ("heading", 1, "E"), ("list", None, "E")],
        2: [("paragraph", None, "")], 4: [("heading", 2, "F"), ("paragraph", None, "F"), ("paragraph", None, "F > ")], 5: [("heading", 2, "in"), ("paragraph", None, "in")],
    }
