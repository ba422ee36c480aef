"""Laid-out pages to elements and blocks, and what tables of elements say about themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Printed page numbers, cells with figures, period labels, and the types of boxes.
PRINTED_PAGE = r"^\s*(\d{1,4})\s*$"
FIGURE = r"\d"
BOX_TYPES = {"title": "heading", "heading": "heading", "list-item": "list", "list": "list", "figure-caption": "figure_caption", "caption": "figure_caption", "footnote": "footnote", "footer": "footnote"}


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def elements_from_boxes(boxes: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(document_id, page, box, boxclass, header_level, x0, y0, x1, y1, text, markdown) to elements, with the path of headings.

    Page headers and footers go, and boxes without an area, tables without markdown and other boxes without text; a page is
    printed under the number of its last footer that is one. A heading cuts the path of its document at its own level. Null
    or absent levels are 0; null classes are paragraphs; an empty table gives an empty one. ``box`` orders boxes in a page.
    """
    level = F.coalesce("header_level", F.lit(0))
    printed = F.max_by(F.regexp_extract("text", PRINTED_PAGE, 1).cast("int"), "box")
    pages = boxes.where((F.col("boxclass") == "page-footer") & F.col("text").rlike(PRINTED_PAGE)).groupBy("document_id", "page").agg(printed.alias("printed_page"))
    kind = F.when(F.col("boxclass") == "table", "table").when(level > 0, "heading")
    for name, of in BOX_TYPES.items():
        kind = kind.when(F.col("boxclass") == name, of)
    area = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    filled = F.when(F.col("boxclass") == "table", F.trim(F.coalesce("markdown", F.lit(""))) != "").otherwise(F.trim(F.coalesce("text", F.lit(""))) != "")
    rows = boxes.where(~F.coalesce("boxclass", F.lit("")).isin("page-header", "page-footer") & area & filled).withColumn("element_type", kind.otherwise("paragraph"))
    heads = rows.where("element_type = 'heading'").select("document_id", "page", "box", F.greatest(level, F.lit(1)).alias("level"), "text")
    stack = lambda acc, s: F.concat(F.slice(acc, F.lit(1), s["level"] - 1), F.array(s["text"]))
    sofar = Window.partitionBy("document_id").orderBy("page", "box").rowsBetween(Window.unboundedPreceding, 0)
    paths = heads.withColumn("_h", F.collect_list(F.struct("level", "text")).over(sofar))
    paths = paths.select("document_id", "page", "box", F.aggregate("_h", F.array().cast("array<string>"), stack).alias("_path"))
    out = rows.join(paths, ["document_id", "page", "box"], "left").withColumn("heading_path", F.coalesce(F.last("_path", True).over(sofar), F.array().cast("array<string>")))
    ordinal = F.row_number().over(Window.partitionBy("document_id").orderBy("page", "box")) - 1
    return out.join(pages, ["document_id", "page"], "left").select("document_id", ordinal.alias("ordinal"), "page", "printed_page", "element_type", "text", "markdown", "heading_path", *extra)


def page_blocks(pages: DataFrame) -> DataFrame:
    """(document_id, page, lines, tables) to (document_id, page, part, block_type, text): heading, paragraph, then each table.

    The first line is the heading, ``Page n`` where there is none. Lines that equal a cell or hold all cells of the page are
    the tables' own and dropped; on a page without cells that holds for every line, as the fixed rule has it.
    """
    lines = F.filter(F.transform(F.coalesce("lines", F.array().cast("array<string>")), collapsed), lambda x: x != "")
    clean = lambda t: F.filter(F.transform(t, lambda r: F.transform(r, lambda c: collapsed(F.coalesce(c, F.lit(""))))), lambda r: F.exists(r, lambda c: c != ""))
    tables = F.filter(F.transform(F.coalesce("tables", F.array().cast("array<array<array<string>>>")), clean), lambda t: F.size(t) > 0)
    rows = pages.select("document_id", "page", lines.alias("lines"), tables.alias("tables"))
    rows = rows.withColumn("cells", F.array_distinct(F.filter(F.flatten(F.flatten("tables")), lambda c: c != "")))
    own = lambda x: F.array_contains(F.col("cells"), x) | F.forall("cells", lambda c: F.contains(x, c))
    left = F.array_join(F.filter(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0))), lambda x: ~own(x)), " ")
    block = lambda kind, text: F.struct(F.lit(kind).alias("block_type"), text.alias("text"))
    heading = F.coalesce(F.get("lines", F.lit(0)), F.concat(F.lit("Page "), F.col("page").cast("string")))
    joined = F.transform("tables", lambda t: block("table", F.array_join(F.transform(t, lambda r: F.array_join(r, " | ")), " ")))
    parts = F.concat(F.array(block("heading", heading)), F.filter(F.array(block("paragraph", left)), lambda b: b["text"] != ""), joined)
    return rows.select("document_id", "page", F.posexplode(parts).alias("part", "b")).select("document_id", "page", "part", "b.block_type", "b.text")


def has_figures(row: Column) -> Column:
    """Whether a row is one of data: a label, and a figure in a later cell."""
    return (F.coalesce(F.get(row, F.lit(0)), F.lit("")) != "") & F.exists(F.slice(row, F.lit(2), F.greatest(F.size(row) - 1, F.lit(0))), lambda c: c.rlike(FIGURE))


def table_labels(rows: Column, heading_path: Column, period: str) -> dict[str, Column]:
    """metric_labels, row_labels and title of a table (array of rows of cells).

    In a table ``by business`` metrics stand in the header, the rows before the first one of data, and rows are labelled by
    business; elsewhere the rows of data are the metrics, save those labelled by a ``period``. The title is the header's cells.
    """
    business = F.lower(F.array_join(heading_path, " ")).contains("by business")
    at = F.array_position(F.transform(rows, has_figures), True)
    header = F.slice(rows, F.lit(1), F.when(at > 0, (at - 1).cast("int")).otherwise(F.size(rows)))
    plain = lambda cells: F.filter(cells, lambda c: (c != "") & ~c.rlike(f"^(?:{period})$"))
    rest = lambda r: F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0)))
    data = F.transform(F.filter(rows, has_figures), lambda r: F.get(r, F.lit(0)))
    none = F.array().cast("array<string>")
    return {
        "metric_labels": F.array_distinct(F.when(business, plain(F.flatten(F.transform(header, rest)))).otherwise(F.filter(data, lambda c: ~c.rlike(period)))),
        "row_labels": F.when(business, F.array_distinct(data)).otherwise(none),
        "title": F.nullif(F.array_join(F.array_distinct(plain(F.flatten(header))), " | "), F.lit("")),
    }


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that refuses a key which stands twice on either side. Null keys match nothing, so they may repeat."""
    for name, side in (("left", left), ("right", right)):
        twice = side.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys).take(1)
        if twice:
            raise ValueError(f"the {name} side has {twice[0].asDict()} more than once")
    return left.join(right, keys)


def contained(chunks: DataFrame, tables: DataFrame, key: str) -> DataFrame:
    """(key, table_no, kept): whether some chunk of the same document holds the whole text of each table.

    Equi-joined on the document, so pairs grow with its chunks and tables, not with the corpus.
    """
    held = tables.select(key, "table_no", F.col("text").alias("_table")).join(chunks.select(key, F.col("text").alias("_chunk")), key, "left")
    return held.groupBy(key, "table_no").agg(F.max(F.coalesce(F.contains("_chunk", "_table"), F.lit(False))).alias("kept"))
