"""Layout rules on small cases, one row for each rule."""

import pytest
from pyspark.sql import functions as F

from cairn.operators import layout
from cairn.plans.layout import PERIOD, _tables, table_labels

BOX = "document_id string, page int, box int, boxclass string, header_level int, x0 double, y0 double, x1 double, y1 double, text string, markdown string"


def test_boxes(spark):
    at = lambda page, box, kind, level, text, markdown=None, x1=1.0: ("d", page, box, kind, level, 0.0, 0.0, x1, 1.0, text, markdown)
    rows = [
        at(1, 0, "page-header", 0, "top"), at(1, 1, "title", 1, "A"), at(1, 2, "text", 3, "B"), at(1, 3, "text", 3, "C"), at(1, 4, "text", 0, "p"), at(1, 5, "text", None, "flat", None, 0.0),
        at(1, 6, "table", 0, "x", " "), at(1, 7, "table", 0, "y", "|y|"), at(1, 8, "page-footer", 0, "12"), at(1, 9, "page-footer", 0, " 7 "), at(1, 10, "page-footer", 0, "a 9"),
        at(2, 0, "list-item", 0, "q"), at(2, 1, "footnote", 0, "n"), at(2, 2, "caption", 0, "f"), at(2, 3, None, None, "z"), at(2, 4, "text", 0, " "), at(2, 5, "title", 2, "D"), at(2, 6, "text", 0, "r"),
    ]
    got = [(r.ordinal, r.printed_page, r.element_type, r.text, r.heading_path) for r in layout.elements_from_boxes(spark.createDataFrame(rows, BOX)).orderBy("ordinal").collect()]
    path = ["A", "B", "C"]  # a level that is skipped keeps siblings nested
    assert got == [
        (0, 7, "heading", "A", ["A"]), (1, 7, "heading", "B", ["A", "B"]), (2, 7, "heading", "C", path), (3, 7, "paragraph", "p", path), (4, 7, "table", "y", path),
        (5, None, "list", "q", path), (6, None, "footnote", "n", path), (7, None, "figure_caption", "f", path), (8, None, "paragraph", "z", path), (9, None, "heading", "D", ["A", "D"]), (10, None, "paragraph", "r", ["A", "D"]),
    ]
    assert layout.elements_from_boxes(spark.createDataFrame([], BOX)).count() == 0


def test_page_blocks(spark):
    rows = [("d", 1, ["Head", "a  b", "1", "x 1 2", "only 1", None], [[["1", "2"], ["", None]], [[" ", ""]]]), ("d", 2, [], None), ("d", 3, ["H", "text"], [])]
    df = spark.createDataFrame(rows, "document_id string, page int, lines array<string>, tables array<array<array<string>>>").withColumn("lines", F.array_compact("lines"))
    got = [(r.page, r.part, r.block_type, r.text) for r in layout.page_blocks(df).orderBy("page", "part").collect()]
    assert got == [(1, 0, "heading", "Head"), (1, 1, "paragraph", "a b only 1"), (1, 2, "table", "1 | 2"), (2, 0, "heading", "Page 2"), (3, 0, "heading", "H")]


def test_table_labels(spark):
    rows = [
        ("r", [["", "FY2025", "Growth"], ["Revenue", "1", "2"], ["Q4 2025 total", "3", ""], ["Note", "none", ""], ["Revenue", "5", ""]], ["Results"]),
        ("b", [["", "Revenue", "FY 2025"], ["", "Revenue", "Growth"], ["North", "1", "2"], ["South", "3", "4"], ["North", "9", ""]], ["Sales", "By Business"]),
        ("e", [], []),
    ]
    df = spark.createDataFrame(rows, "id string, rows array<array<string>>, path array<string>")
    got = {r.id: (r.m, r.r, r.t) for r in df.select("id", *(c.alias(n) for c, n in zip(layout.table_labels(F.col("rows"), F.col("path"), PERIOD).values(), "mrt"))).collect()}
    assert got == {"r": (["Revenue"], [], "Growth"), "b": (["Revenue", "Growth"], ["North", "South"], "Revenue | Growth"), "e": ([], [], None)}


def test_one_to_one_join(spark):
    a = spark.createDataFrame([(1, 2), (None, 3), (None, 4)], "k int, x int")
    b = spark.createDataFrame([(1, 5), (2, 6)], "k int, y int")
    assert [tuple(r) for r in layout.join_one_to_one(a, b, ["k"]).collect()] == [(1, 2, 5)]
    with pytest.raises(ValueError, match="right"):
        layout.join_one_to_one(a, b.unionByName(b), ["k"])


def test_contained(spark):
    chunks = spark.createDataFrame([("d", "a b c"), ("d", "c d"), ("e", "zz")], "source_id string, text string")
    tables = spark.createDataFrame([("d", 1, "b c"), ("d", 2, "c d e"), ("f", 1, "zz")], "source_id string, table_no int, text string")
    assert {(r.source_id, r.table_no): r.kept for r in layout.contained(chunks, tables, "source_id").collect()} == {("d", 1): True, ("d", 2): False, ("f", 1): False}


def test_cells_of_tables_keep_the_digits_of_their_own_place(spark, tmp_path):
    spark.createDataFrame([(1, "head\n0 rows | 11 | 21\nnet1 | x\n101 | 2")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (row,) = _tables(spark, str(tmp_path)).collect()
    assert row.rows == [["head"], ["0 rows", "11", "21"], ["net1", "x"], ["101", "2"]]
    (row,) = table_labels(spark, str(tmp_path)).collect()
    assert (row.metrics, row.row_labels) == ("0 rows;101", "")
