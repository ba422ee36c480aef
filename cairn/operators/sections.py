"""Chunks that follow the sections of a document: blocks are (source_id, ordinal, block_type, text, section_path, page)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.binding import let
from cairn.operators.chunking import pack, sentence_units


def _group_starts(sizes: Column, budget: int) -> Column:
    """Places at which a new group begins when each takes elements while the sum of their sizes stays within the budget; a larger one stands alone."""
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).cast("long").alias("held"), F.lit(0).alias("i"))

    def step(acc: Column, size: Column) -> Column:
        new = (acc["i"] == 0) | (acc["held"] + size > budget)
        return F.struct(F.when(new, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"), F.when(new, size).otherwise(acc["held"] + size).cast("long").alias("held"), (acc["i"] + 1).alias("i"))

    return F.aggregate(sizes, start, step)["starts"]


def financial_chunks(blocks: DataFrame, budget: int = 3200, context: dict[str, str] | None = None) -> DataFrame:
    """(source_id, n, kind, ordinals, text): tables stand alone; neighbouring paragraphs and list items of one section path and page are
    joined while their lengths together stay within ``budget``; blocks of other types end a group and are left out.

    The text starts with the lines of ``context`` (label to column) and the section path, and ends with the page. Groups are folded within
    their island, the run of neighbours that may be joined at all.
    """
    if budget <= 0:
        raise ValueError("the budget must be positive")
    own = Window.partitionBy("source_id").orderBy("ordinal")
    joinable = F.col("block_type").isin("paragraph", "list")
    before = lambda c: F.lag(c).over(own)
    rows = blocks.withColumn("_j", joinable)
    new = ~(F.col("_j") & F.coalesce(before("_j"), F.lit(False)) & F.col("section_path").eqNullSafe(before("section_path")) & F.col("page").eqNullSafe(before("page")))
    rows = rows.withColumn("_island", F.sum(new.cast("int")).over(own)).where("_j or block_type = 'table'")
    extra = list(dict.fromkeys((context or {}).values()))
    islands = rows.groupBy("source_id", "_island").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "block_type", "text"))).alias("b"), F.first("section_path").alias("section_path"), F.first("page").alias("page"), *(F.first(c).alias(c) for c in extra)
    )

    def groups(starts: Column) -> Column:
        end = lambda k: F.coalesce(F.get(starts, k + 1), F.size("b"))
        return F.transform(starts, lambda s, k: F.slice("b", s + 1, end(k) - s))

    cut = let(_group_starts(F.transform("b", lambda x: F.length(x["text"])), budget), groups)
    each = islands.select("source_id", "section_path", "page", *extra, F.explode(cut).alias("g"))
    head = [F.concat(F.lit(f"{label}: "), F.col(column).cast("string")) for label, column in (context or {}).items()]
    path = F.when(F.size("section_path") > 0, F.concat(F.lit("Heading path: "), F.array_join("section_path", " > ")))
    body = F.array_join(F.transform("g", lambda x: x["text"]), "\n\n")
    text = F.concat_ws("\n\n", *head, path, body, F.concat(F.lit("Source page: "), F.col("page").cast("string")))
    kind = F.get("g", F.lit(0))["block_type"]
    number = F.row_number().over(Window.partitionBy("source_id").orderBy(F.get("ordinals", F.lit(0))))
    return each.select("source_id", kind.alias("kind"), F.transform("g", lambda x: x["ordinal"]).alias("ordinals"), text.alias("text")).select("source_id", number.alias("n"), "kind", "ordinals", "text")


def hierarchical_chunks(blocks: DataFrame, child_limit: int) -> DataFrame:
    """(source_id, chunk_id, role, parent_id, section_path, text): a parent for each section path, in the order in which they first come, with
    its blocks' texts by line, and its children, packed sentences of each block.

    Headings are left out; blocks without a path are of the section "Document". A parent's number counts all chunks before it, children too.
    """
    if child_limit < 1:
        raise ValueError("the limit must be positive")
    path = F.when(F.size("section_path") > 0, F.col("section_path")).otherwise(F.array(F.lit("Document")))
    rows = blocks.where("block_type <> 'heading'").select("source_id", "ordinal", "text", path.alias("section_path"))
    rows = rows.withColumn("c", pack(sentence_units(F.col("text"), child_limit), child_limit))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n")
    parents = rows.groupBy("source_id", "section_path").agg(F.min("ordinal").alias("first"), F.sum(F.size("c")).alias("children"), whole.alias("text"))
    earlier = F.sum(F.col("children") + 1).over(Window.partitionBy("source_id").orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    name = F.concat(F.col("source_id").cast("string"), F.lit("-HIERARCHICAL-"), F.format_string("%03d", F.coalesce(earlier, F.lit(0)) + 1))
    parents = parents.withColumn("parent", name)
    each = rows.select("source_id", "section_path", "ordinal", F.posexplode("c").alias("part", "text"))
    number = F.row_number().over(Window.partitionBy("source_id", "section_path").orderBy("ordinal", "part"))
    children = each.withColumn("k", number).join(parents.select("source_id", "section_path", "parent"), ["source_id", "section_path"])
    child = children.select("source_id", F.concat("parent", F.format_string("-C%02d", "k")).alias("chunk_id"), F.lit("child").alias("role"), F.col("parent").alias("parent_id"), "section_path", "text")
    return parents.select("source_id", F.col("parent").alias("chunk_id"), F.lit("parent").alias("role"), F.lit(None).cast("string").alias("parent_id"), "section_path", "text").unionByName(child)
