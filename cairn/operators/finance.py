"""Tables of figures and market data: labels, cells, comparable units, closes and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions.binding import let

# Period labels, and patterns of basis and audit.
PERIODS = {"FY2026": r"(?i)Year Ended Jan 25, 2026", "FY2025": r"(?i)FY\s*2025", "H2 2025": r"(?i)H2\s*2025", "Q4 2025": r"(?i)Q4\s*2025"}
FOOTNOTE = r"^(\(\d+\)|\d+\.)"


def basis(text: Column) -> Column:
    return F.when(text.rlike(r"(?i)\bnon[- ]GAAP\b"), "non-GAAP").when(text.rlike(r"(?i)\bGAAP\b"), "GAAP")


def audited(text: Column) -> Column:
    return F.when(text.rlike(r"(?i)\bunaudited\b"), F.lit(False)).when(text.rlike(r"(?i)\baudited\b"), F.lit(True))


def periods(text: Column, default: Column, rules: dict[str, str] = PERIODS) -> Column:
    found = F.array_compact(F.array(*(F.when(text.rlike(p), label) for label, p in rules.items())))
    return F.when(F.size(found) > 0, found).otherwise(F.array(default))


def currency(text: Column, ticker: Column) -> Column:
    """The euro sign decides before the heading of the one company that reports in dollars."""
    return F.when(text.contains("€ million"), "EUR").when(text.contains("In millions") & (ticker == "NVDA"), "USD")


def contextualised(text: Column, names: tuple[str, ...] = ("revenue", "income", "total")) -> Column:
    """Whether figures come with what tells what they are: a basis, a scale, an audit, or one of ``names``. Text without figures has no such context."""
    told = basis(text).isNotNull() | scale(text).isNotNull() | audited(text).isNotNull() | text.rlike(rf"(?i)\b(?:{'|'.join(names)})\b")
    return F.coalesce(text.rlike("[0-9]") & told, F.lit(False))


def scale(text: Column) -> Column:
    return F.when(text.rlike(r"(?i)(?:In|€) millions?"), "millions")


def adjacent(elements: DataFrame, key: str, order: str, page: str, text: str) -> DataFrame:
    """Adds the texts before and after, of the same page only."""
    own = Window.partitionBy(key).orderBy(order)
    same = lambda f: F.when(f(page).over(own) == F.col(page), f(text).over(own))
    return elements.withColumns({"before": same(F.lag), "after": same(F.lead)})


def melt(rows: Column) -> Column:
    """Rows of cells as (row, col, cell)."""
    return F.flatten(F.transform(rows, lambda r, i: F.transform(r, lambda c, j: F.struct(i.alias("row"), j.alias("col"), c.alias("cell")))))


def compare(left_value: Column, left_unit: Column, right_value: Column, right_unit: Column) -> Column:
    """Difference of values in the same currency and scale; otherwise the reason why there is none."""
    part = lambda u, k: F.split_part(u, F.lit(" "), F.lit(k))
    reason = F.when(part(left_unit, 1) != part(right_unit, 1), "currency_mismatch").when(part(left_unit, 2) != part(right_unit, 2), "scale_mismatch")
    return F.struct(F.when(reason.isNull(), F.round(left_value - right_value, 6)).alias("difference"), reason.alias("reason"))


def last_close(prices: DataFrame, symbol: str, close: str, *order: str) -> DataFrame:
    """The latest complete close of each symbol."""
    have = prices.where(F.col(close).isNotNull())
    return have.groupBy(symbol).agg(F.max_by(F.struct(close, *order), F.struct(*order)).alias("last")).select(symbol, "last.*")


def half_up(value: Column, places: int) -> Column:
    return F.round(value.cast("decimal(38,18)"), places).cast("double")


def _row_label(row: Column) -> Column:
    return T.fold(F.coalesce(F.get(row, F.lit(0)), F.lit("")))


def _outcome(label: Column, cell: Column, *errors: tuple[str, Column]) -> Column:
    """(label, value, error): the first error that holds, or the one number of the cell."""
    value = T.displayed_number(cell)
    error = F.coalesce(*(F.when(F.coalesce(holds, F.lit(True)), name) for name, holds in errors), F.when(value.isNull(), "number"))
    return F.struct(F.when(error.isNull(), label).alias("label"), F.when(error.isNull(), value.cast("double")).alias("value"), error.alias("error"))


def value_by_segment(rows: Column, metric: str = "revenue", repeats: int = 3, segments: int = 3) -> Column:
    """(label, value, error) of a table whose header names ``segments`` and whose metric has a row for each of ``repeats`` years.

    The value is that of the first segment in the first such row. Errors: rows (not as many rows of the metric), values (not a number
    for each segment in the first), header (not as many named columns), number (none or several in the cell).
    """
    zero = F.lit(0)
    shown = lambda r: F.size(F.filter(r, lambda c: c.rlike("[0-9]")))

    def found(own: Column, header: Column) -> Column:
        first, places = F.get(own, zero), F.filter(F.transform(header, lambda h, i: F.when(F.trim(h) != "", i)), lambda i: i.isNotNull())
        at = F.get(places, zero)
        label = F.concat(F.get(header, at), F.lit(" "), _row_label(first))
        return _outcome(label, F.get(first, at), ("rows", F.size(own) != repeats), ("values", shown(first) != segments), ("header", F.size(places) != segments))

    return let(F.filter(rows, lambda r: _row_label(r) == metric), lambda own: let(F.get(rows, zero), lambda header: found(own, header)))


def value_by_period(rows: Column, period: Column, metric: str = "revenue", total: str = "total ") -> Column:
    """(label, value, error) of a table with a row of periods over a row of metrics; each period stands over the change, beside its amount.

    The value is the amount of ``period`` in the last row of totals. Errors: rows (fewer than three), period (its column is not the only one),
    metric (the column before it is not of the metric), total (no row of totals), number (none or several in the cell).
    """
    folded = lambda c: F.replace(T.fold(c), F.lit(" "), F.lit(""))

    def found(places: Column, totals: Column) -> Column:
        at = F.get(places, F.lit(0)) - 1
        name, row = F.get(F.get(rows, F.lit(1)), at), F.get(totals, F.size(totals) - 1)
        label = F.concat(F.get(row, F.lit(0)), F.lit(" "), T.fold(F.trim(F.get(F.split(name, "€"), F.lit(0)))))
        errors = (("rows", F.size(rows) < 3), ("period", F.size(places) != 1), ("metric", (at < 0) | ~F.contains(T.fold(name), F.lit(metric))), ("total", F.size(totals) == 0))
        return _outcome(label, F.get(row, at), *errors)

    places = F.filter(F.transform(F.get(rows, F.lit(0)), lambda c, i: F.when(folded(c) == folded(period), i)), lambda i: i.isNotNull())
    data = F.slice(rows, 3, F.greatest(F.size(rows) - 2, F.lit(0)))
    return let(places, lambda p: let(F.filter(data, lambda r: F.startswith(_row_label(r), F.lit(total))), lambda t: found(p, t)))


def reported_values(tables: DataFrame, *, metric: str = "revenue") -> DataFrame:
    """(table_id, label, value, unit, error) of (table_id, layout, unit, period, rows): one value of each table, or why there is none.

    ``layout`` is ``segments`` or ``periods``, the two ways that tables are laid out; ``rows`` an array of rows of cells. A table without rows
    or unit has the error ``table``, one of another layout ``layout``.
    """
    bad = lambda why: F.struct(F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("value"), F.lit(why).alias("error"))
    value = (
        F.when(F.col("rows").isNull() | (F.size("rows") == 0) | F.col("unit").isNull(), bad("table")).when(F.col("layout") == "segments", value_by_segment(F.col("rows"), metric))
        .when(F.col("layout") == "periods", value_by_period(F.col("rows"), F.col("period"), metric)).otherwise(bad("layout"))
    )
    return tables.select("table_id", "unit", value.alias("v")).select("table_id", "v.label", "v.value", F.when(F.col("v.error").isNull(), F.col("unit")).alias("unit"), "v.error")
