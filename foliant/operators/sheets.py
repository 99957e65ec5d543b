"""Spreadsheet-shaped data: detection, page breaks, pagination and grids.

Cells are rows ``doc, sheet, row, col, value``; sheet rows are ``doc, sheet, row,
cells`` with an array of texts. A sheet may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from foliant.functions.text import strip
from foliant.operators.joins import salted_join
from foliant.operators.ordered import GROUP_LIMIT, Run, dealt, group_sizes, running

# Page rules of sheets.
BREAK_MARK = "<<<PAGE_BREAK>>>"
BLANK_ROWS = 1
ROWS_PER_PAGE = 15
WIDE_ABOVE = 6
SHEET = ["doc", "sheet"]


def filled(value: Column) -> Column:
    return strip(F.coalesce(value, F.lit(""))) != ""


def detect_tables(cells: DataFrame, in_place: bool = False) -> DataFrame:
    """One row per sheet: ``is_table`` and ``n_columns``.

    A table has three rows or more, two filled cells in the first, and at least
    half of them filled in 70 % of the next ten rows.

    With ``in_place`` it takes sheet rows and adds ``_is_table`` and ``_n_columns`` to each, by windows over whole
    sheets: rows that lie by sheet stay where they are. No sheet may then be larger than a task can sort.
    """
    if in_place:
        return _tables_in_place(cells)
    bounds = cells.groupBy(*SHEET).agg(F.min("row").alias("first"), F.max("row").alias("last"))
    head = salted_join(cells, bounds, SHEET).where("row <= first + 10")
    counts = head.groupBy(*SHEET, "first", "last", "row").agg(F.count_if(filled(F.col("value"))).alias("n"))
    tops = counts.groupBy(*SHEET, "first", "last").agg(
        F.max(F.when(F.col("row") == F.col("first"), F.col("n"))).alias("header_cells"),
        F.sort_array(F.collect_list(F.when(F.col("row") > F.col("first"), F.col("n")))).alias("ns"))
    alike = F.size(F.filter("ns", lambda n: _alike(n, F.col("header_cells"))))
    is_table = _is_table(F.col("first"), F.col("last"), F.col("header_cells"), alike)
    return tops.select(*SHEET, is_table.alias("is_table"), F.when(is_table, F.col("header_cells")).otherwise(0).alias("n_columns"))


def _alike(n: Column, header_cells: Column) -> Column:
    return n >= header_cells * 0.5


def _is_table(first: Column, last: Column, header_cells: Column, alike: Column) -> Column:
    # rows without any cell count as checked and as unlike the header
    checked = F.least(last - first, F.lit(10))
    return F.coalesce((last - first >= 2) & (header_cells >= 2) & (alike / checked >= 0.7), F.lit(False))


def _tables_in_place(rows: DataFrame) -> DataFrame:
    sheet, order = W.partitionBy(*SHEET), W.partitionBy(*SHEET).orderBy("row")
    # a row number that comes twice is one row
    n = F.sum(F.coalesce(F.size(F.filter("cells", filled)), F.lit(0))).over(order.rangeBetween(W.currentRow, W.currentRow))
    out = rows.withColumns({"_n": n, "_above": F.lag("row").over(order)})
    own = (F.col("_n") > 0) & ~F.col("_above").eqNullSafe(F.col("row"))
    held = F.when(F.col("_n") > 0, F.col("row"))
    out = out.withColumns({"_first": F.min(held).over(sheet), "_last": F.max(held).over(sheet)})
    out = out.withColumn("_top", F.max(F.when(F.col("row") == F.col("_first"), F.col("_n"))).over(sheet))
    near = (F.col("row") > F.col("_first")) & (F.col("row") <= F.col("_first") + 10)
    alike = F.count_if(own & near & _alike(F.col("_n"), F.col("_top"))).over(sheet)
    out = out.withColumn("_alike", alike)
    named = F.col(SHEET[0]).isNotNull() & F.col(SHEET[1]).isNotNull()
    out = out.withColumn("_is_table", named & _is_table(F.col("_first"), F.col("_last"), F.col("_top"), F.col("_alike")))
    out = out.withColumn("_n_columns", F.when(F.col("_is_table"), F.col("_top")).otherwise(0))
    return out.drop("_n", "_above", "_first", "_last", "_top", "_alike")


def page_segments(rows: DataFrame, is_table: Column | None = None, header_rows: int | Column = 1, blank_rows: int = BLANK_ROWS,
                  mark: str = BREAK_MARK, page_rows: int = ROWS_PER_PAGE, group_limit: int = GROUP_LIMIT,
                  sizes: tuple[int, int] | None = None) -> DataFrame:
    """Add ``segment`` and ``page`` to sheet rows (``row`` counts from 0 without gaps).

    A segment starts at a mark, or at the n-th blank row in a row. In a table a new
    page also starts after ``page_rows`` data rows. All three counters are running
    sums, so no sheet needs to be walked row by row.

    ``sizes`` are the ``group_sizes`` of rows that lie by sheet already, and are then not moved again.
    """
    largest, n_rows = group_sizes(rows, SHEET) if sizes is None else sizes
    known = {"group_limit": group_limit, "known_largest": largest}
    is_table = F.lit(True) if is_table is None else is_table
    after_first = F.col("row") > 0
    blank = ~F.exists("cells", filled)
    marked = F.exists("cells", lambda c: F.coalesce(c.contains(mark), F.lit(False))) if mark else F.lit(False)
    out = rows.withColumns({"_blank": blank & after_first, "_mark": marked & after_first})
    out = out.withColumn("_solid", (~F.col("_blank")).cast("int"))
    if largest <= group_limit and sizes is None:
        out = dealt(out, SHEET, n_rows)  # all windows below keep these partitions
    out = running(out, SHEET, ["row"], [Run("_run", "sum", F.col("_solid"))], **known)
    out = running(out, [*SHEET, "_run"], ["row"], [Run("_place", "sum", F.col("_blank").cast("int"))], **known)
    by_blank = F.col("_blank") & (F.col("_place") == blank_rows) if blank_rows > 0 else F.lit(False)
    out = out.withColumn("_cut", (F.col("_mark") | by_blank).cast("int"))
    data = is_table & ~F.col("_blank") & ~F.col("_mark") & (F.col("row") >= header_rows) & after_first
    out = out.withColumn("_data", data.cast("int"))
    out = running(out, SHEET, ["row"], [Run("segment", "sum", F.col("_cut"))], **known)
    out = running(out, [*SHEET, "segment"], ["row"], [Run("_before", "sum", F.col("_data"), True)], **known)
    page = F.floor(F.col("_before") / page_rows) if page_rows > 0 else F.lit(0)
    return out.withColumn("page", page).select(*rows.columns, "segment", "page")


def detected_segments(rows: DataFrame, panes: DataFrame | None = None, group_limit: int = GROUP_LIMIT,
                      sizes: tuple[int, int] | None = None, **kw) -> DataFrame:
    """Page segments where the sheets themselves say what they are.

    A sheet that is no table (``detect_tables``) has no page ends but its marks and blank rows; the rows above a frozen
    pane, or the first row, are headers and count for no page.

    Rows are moved once, to partitions of whole sheets, and judged and summed there. With ``sizes`` (see
    ``page_segments``) they lie there already. Where a sheet is beyond ``group_limit`` they are moved at each step.
    """
    counted = group_sizes(rows, SHEET) if sizes is None else sizes
    if counted[0] <= group_limit:
        lying = dealt(rows, SHEET, counted[1]) if sizes is None else rows
        told = sheet_profile(detect_tables(lying, in_place=True), panes, in_place=True)
        told = told.select(*rows.columns, F.col("_is_table").alias("_table"), F.greatest("_frozen", F.lit(1)).alias("_heads"))
    else:
        cells = rows.select(*SHEET, "row", F.posexplode_outer("cells").alias("col", "value")).where(filled(F.col("value")))
        flags = detect_tables(cells).select(*SHEET, "is_table").join(sheet_profile(cells, panes).select(*SHEET, "frozen"), SHEET)
        told = salted_join(rows, flags.select(*SHEET, F.col("is_table").alias("_table"), F.greatest("frozen", F.lit(1)).alias("_heads")), SHEET, "left")
        told = told.withColumns({"_table": F.coalesce("_table", F.lit(False)), "_heads": F.coalesce("_heads", F.lit(1))})
    # a sheet of several panes has its rows as often
    times = 1 if panes is None else max(group_sizes(panes.dropna(subset=SHEET), SHEET)[0], 1)
    out = page_segments(told, F.col("_table"), F.col("_heads"), group_limit=group_limit, sizes=(counted[0] * times, counted[1] * times), **kw)
    return out.select(*rows.columns, "segment", "page")


def paginate(rows: DataFrame, frozen: int = 0, page_rows: int = ROWS_PER_PAGE, source_date: str | None = None) -> DataFrame:
    """Fixed pages of data rows, each with the header rows, its label and source line."""
    n_head = max(frozen, 1)
    sizes = rows.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("_n"))
    heads = rows.where(F.col("row") < n_head).groupBy(*SHEET).agg(
        F.sort_array(F.collect_list(F.struct("row", "cells"))).alias("_h"))
    # a sheet no longer than its header has one header row
    per_sheet = sizes.join(heads, SHEET).withColumn("_head", F.when(F.col("_n") <= n_head, 1).otherwise(n_head))
    out = salted_join(rows, per_sheet, SHEET).where(F.col("row") >= F.col("_head"))
    pages = F.ceil((F.col("_n") - F.col("_head")) / page_rows)
    page = F.floor((F.col("row") - F.col("_head")) / page_rows) + 1
    label = F.when(pages > 1, F.concat(
        F.lit("Table page "), page.cast("string"), F.lit(" of "), pages.cast("string"), F.lit(" (Sheet: "), F.col("sheet"), F.lit(")")))
    source = F.concat(F.col("doc"), F.lit(" | Sheet: "), F.col("sheet"), F.lit(f" | {source_date}" if source_date else ""))
    headers = F.transform(F.slice("_h", 1, F.col("_head")), lambda h: h["cells"])
    return out.select(*rows.columns, page.alias("page"), pages.alias("pages"), label.alias("label"),
                      source.alias("source_line"), headers.alias("headers"))


def _cell_type(cells: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(c, cells.schema[c].dataType) for c in ("col", "value")])


def to_grid(cells: DataFrame) -> DataFrame:
    """One row of texts per sheet row, with empty text where there is no cell.

    Rows without any cell, from row 0 to the last row of the sheet, are there too.
    """
    size = cells.groupBy(*SHEET).agg(F.max("col").alias("_w"), F.max("row").alias("_last"))
    gaps = size.select(*SHEET, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last").cast("bigint"))).alias("row"),
                       F.array().cast(T.ArrayType(_cell_type(cells))).alias("_c"))
    filled = cells.groupBy(*SHEET, F.col("row").cast("bigint").alias("row")).agg(
        F.collect_list(F.struct("col", "value")).alias("_c"))
    rows = filled.unionByName(gaps).groupBy(*SHEET, "row").agg(F.sort_array(F.flatten(F.collect_list("_c"))).alias("_c"))
    joined = salted_join(rows, size.drop("_last"), SHEET)
    named = F.map_from_entries(F.transform("_c", lambda c: F.struct(c["col"], c["value"])))
    out = joined.withColumn("_m", named)
    return out.select(*SHEET, "row", F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("_w").cast("bigint")),
        lambda i: F.coalesce(F.try_element_at("_m", i.cast("int")), F.lit(""))).alias("cells"))


def used_range(cells: DataFrame) -> DataFrame:
    """Rectangle that holds all values of a sheet."""
    return cells.where("value IS NOT NULL").groupBy(*SHEET).agg(
        F.min("row").alias("first_row"), F.min("col").alias("first_col"), F.max("row").alias("last_row"), F.max("col").alias("last_col"))


def frozen_rows(pane: Column) -> Column:
    """Header rows above a frozen pane such as ``A2``."""
    return F.coalesce(F.greatest(F.regexp_extract(pane, "^[A-Za-z]+([0-9]+)$", 1).try_cast("int") - 1, F.lit(0)), F.lit(0))


def sheet_profile(cells: DataFrame, panes: DataFrame | None = None, in_place: bool = False) -> DataFrame:
    """Rows, columns, has_table and frozen header rows per sheet. ``panes(doc, sheet, pane)``.

    With ``in_place`` it takes sheet rows and adds ``_n_rows``, ``_n_cols``, ``_has_table`` and ``_frozen`` to each, as
    ``detect_tables`` does.
    """
    if in_place:
        return _profile_in_place(cells, panes)
    base = cells.groupBy(*SHEET).agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"))
    base = base.withColumn("has_table", _has_table(F.col("n_rows"), F.col("n_cols")))
    if panes is None:
        return base.withColumn("frozen", F.lit(0))
    return base.join(panes, SHEET, "left").withColumn("frozen", frozen_rows(F.col("pane"))).drop("pane")


def _has_table(n_rows: Column, n_cols: Column) -> Column:
    return (n_rows > 2) & (n_cols > 1)


def _profile_in_place(rows: DataFrame, panes: DataFrame | None) -> DataFrame:
    sheet = W.partitionBy(*SHEET)
    last = F.array_max(F.transform("cells", lambda c, i: F.when(filled(c), i)))
    out = rows.withColumns({"_n_rows": F.max(F.when(last.isNotNull(), F.col("row") + 1)).over(sheet), "_n_cols": F.max(last + 1).over(sheet)})
    out = out.withColumn("_has_table", _has_table(F.col("_n_rows"), F.col("_n_cols")))
    if panes is None:
        return out.withColumn("_frozen", F.lit(0))
    # a sheet without any cell has no profile
    on = F.col("_n_rows").isNotNull()
    for k in SHEET:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    # only the panes are moved, and no rows are sorted for them
    told = panes.select(*[F.col(k).alias(f"_k_{k}") for k in SHEET], frozen_rows(F.col("pane")).alias("_frozen")).hint("shuffle_hash")
    out = out.join(told, on, "left").withColumn("_frozen", F.coalesce("_frozen", F.lit(0)))
    return out.drop(*[f"_k_{k}" for k in SHEET])


def wide_documents(cells: DataFrame, above: int = WIDE_ABOVE) -> DataFrame:
    return cells.groupBy("doc").agg((F.max("col") + 1 > above).alias("is_wide"))
