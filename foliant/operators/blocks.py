"""Documents as rows that hold an ordered array of typed blocks.

A block array is made inside the row that holds the text, so neither the split
nor the section rules need a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.arrays import bind, cut_at, explode_indexed, positions
from foliant.functions.text import SPACE_RUN, contains_any, is_upper, strip

# Marks of a list item and of source code.
BULLETS = "•\\-*◦▪"
LIST_ITEM = "^(?:[" + BULLETS + "]|[0-9]+[.)]|[a-zA-Z][.)])" + SPACE_RUN
CODE_MARKS = [
    "def ", "class ", "import ", "from ", "return ", "function ", "const ", "let ", "var ",
    "{", "}", "=>", "->",
]
HEADER_BELOW = 100
MEDIA = ["image", "figure", "chart"]
SPECIAL = ["table", *MEDIA]

BBOX = "struct<x0:double,y0:double,x1:double,y1:double,page:int>"
# The fields of one block; block_type is the content type.
BLOCK_FIELDS = {
    "block_type": "string",
    "content": "string",
    "page": "int",
    "section": "string",
    "para": "int",
    "para_in_section": "int",
    "headers": "array<string>",
    "rows": "array<array<string>>",
    "caption": "string",
    "alt_text": "string",
    "bbox": BBOX,
}


def is_header(content: Column) -> Column:
    return (F.length(content) < HEADER_BELOW) & is_upper(content)


def is_list_item(content: Column) -> Column:
    return strip(content).rlike(LIST_ITEM)


def is_code(content: Column) -> Column:
    return contains_any(content, CODE_MARKS)


def block_type(content: Column) -> Column:
    """header before list before code before text."""
    return (
        F.when(is_header(content), "header")
        .when(is_list_item(content), "list")
        .when(is_code(content), "code")
        .otherwise("text")
    )


def embedding_text(block: Column) -> Column:
    """Text of one block for an embedding model, with its section as context."""
    section = F.when(F.coalesce(block["section"], F.lit("")) != "", F.concat(F.lit("[Section: "), block["section"], F.lit("]")))
    shown = F.transform(F.slice(block["rows"], 1, 5), lambda row: F.array_join(row, " | "))
    extra = F.size(block["rows"]) - 5
    table = F.concat_ws(
        "\n",
        section,
        F.when(F.size(block["headers"]) > 0, F.concat(F.lit("Table columns: "), F.array_join(block["headers"], ", "))),
        F.when(F.size(block["rows"]) > 0, F.array_join(shown, "\n")),
        F.when(extra > 0, F.concat(F.lit("... and "), extra.cast("string"), F.lit(" more rows"))),
    )
    media = F.concat_ws(
        "\n",
        section,
        F.when(F.coalesce(block["caption"], F.lit("")) != "", F.concat(F.lit("Figure: "), block["caption"])),
        F.when(F.coalesce(block["alt_text"], F.lit("")) != "", F.concat(F.lit("Description: "), block["alt_text"])),
        block["content"],
    )
    plain = F.concat_ws("\n", section, block["content"])
    kind = block["block_type"]
    return F.when(kind == "table", table).when(kind.isin(MEDIA), media).otherwise(plain)


def _block(fields: dict[str, Column]) -> Column:
    return F.struct(
        *[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in BLOCK_FIELDS.items()]
    )


def _split_paragraphs(text: Column, sep: str) -> Column:
    """array<struct<para, content, header>>; ``para`` counts empty paragraphs too."""
    parts = F.transform(F.split(text, sep), lambda p, i: F.struct(i.alias("para"), strip(p).alias("content")))
    kept = F.filter(parts, lambda p: p["content"] != "")
    return F.transform(
        kept, lambda p: F.struct(p["para"], p["content"], is_header(p["content"]).alias("header"))
    )


def _typed_sections(items: Column, classify: bool) -> Column:
    """Blocks with the section they belong to; a header opens its own section."""

    def run_to_blocks(runs: Column, run: Column, j: Column) -> Column:
        first = run["items"][0]
        before = F.get(runs, j - 1)
        open_before = F.when(j > 0, F.size(before["items"]) - before["items"][0]["header"].cast("int")).otherwise(0)

        def one(p: Column, i: Column) -> Column:
            content = p["content"]
            kind = block_type(content) if classify else F.when(p["header"], "header").otherwise("text")
            return _block({
                "block_type": kind,
                "content": content,
                "page": F.lit(1),
                "section": F.when(first["header"], first["content"]),
                "para": p["para"],
                "para_in_section": F.when(p["header"], open_before).otherwise(i - first["header"].cast("int")),
            })

        return F.transform(run["items"], one)

    def with_items(ps: Column) -> Column:
        starts = F.array_union(F.array(F.lit(0)), positions(ps, lambda p: p["header"]))
        return bind(
            cut_at(ps, starts),
            lambda runs: F.flatten(F.transform(runs, lambda run, j: run_to_blocks(runs, run, j))),
        )

    return bind(items, lambda ps: F.when(F.size(ps) == 0, F.array().cast(_block_array())).otherwise(with_items(ps)))


def _block_array() -> str:
    return "array<struct<" + ",".join(f"{n}:{t}" for n, t in BLOCK_FIELDS.items()) + ">>"


def blocks_from_text(df: DataFrame, text: str = "text", sep: str = "\n", classify: bool = True) -> DataFrame:
    """Add ``blocks`` to each document row. ``sep`` is a regular expression."""
    return df.withColumn("blocks", _typed_sections(_split_paragraphs(F.col(text), sep), classify))


def explode_blocks(docs: DataFrame, *ids: str) -> DataFrame:
    """One row per block, with its zero-based position."""
    return explode_indexed(docs, list(ids), "blocks", "block_idx", "b").select(*ids, "block_idx", "b.*")


def documents_from_blocks(blocks: DataFrame, ids: list[str]) -> DataFrame:
    """Long block rows back to document rows. A document is one row by definition,
    so its blocks are bounded by what one row can hold."""
    have = set(blocks.columns)
    fields = {n: F.col(n) for n in BLOCK_FIELDS if n in have}
    entry = F.struct(F.col("block_idx").alias("block_idx"), _block(fields).alias("b"))
    rows = blocks.groupBy(*ids).agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    return rows.select(*ids, F.transform("_e", lambda e: e["b"]).alias("blocks"))


def media_type(width: Column, height: Column, min_size: int = 100) -> Column:
    """chart, figure or image; null for pictures that are too small to keep."""
    return (
        F.when((width < min_size) | (height < min_size), None)
        .when(width > height * 1.5, "chart")
        .when((width > 200) & (height > 200), "figure")
        .otherwise("image")
    )


def table_text(headers: Column, rows: Column) -> Column:
    """A table as markdown."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(headers, lambda _: F.lit("---")), "|"), F.lit("|"))
    return F.array_join(F.concat(F.array(line(headers), rule), F.transform(rows, line)), "\n")


def table_block(grid: Column) -> Column:
    """First row as headers, null cells as empty text; null for fewer than two rows."""
    filled = F.transform(grid, lambda row: F.transform(row, lambda c: F.coalesce(c, F.lit(""))))
    return F.when(
        F.size(grid) >= 2,
        F.struct(filled[0].alias("headers"), F.slice(filled, 2, F.size(grid)).alias("rows")),
    )
