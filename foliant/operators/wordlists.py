"""Long lists of banned terms, found with Aho-Corasick automata.

A list of any length is cut into lots of a bounded number of characters. Each lot becomes one
automaton that is sent to the tasks, where a text is read once whatever the number of terms. More
lots than one mean more passes over the texts, in which only row keys and terms found are kept;
the texts themselves are never stored or shuffled.

Terms are plain substrings, compared in lower case unless ``fold`` is off. Null and empty terms
and repeated ones count for nothing; a null text holds no term.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.session import cut_lineage, spread

#: Characters of the terms of one automaton; it takes up to about fifty times as many bytes in a task.
LOT = 2_000_000


def _automaton(terms: list[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for term in terms:
        made.add_word(term, term)
    made.make_automaton()
    return made


def _lots(terms: Column | str, rows: DataFrame, fold: bool, lot: int) -> list[list[str]]:
    term = F.col(terms) if isinstance(terms, str) else terms
    known = cut_lineage(rows.select((F.lower(term) if fold else term).alias("term")).where("term <> ''").distinct())
    size = known.agg(F.sum(F.length("term"))).first()[0] or 0
    n = -(-size // lot)
    if n <= 1:
        parts = [known]
    else:
        parts = [known.where(F.pmod(F.xxhash64("term"), F.lit(n)) == i) for i in range(n)]
    return [sorted(r[0] for r in p.collect()) for p in parts]  # about one lot of characters each


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value
        for batch in batches:
            found = [sorted({term for _, term in made.iter(text)}) if text else [] for text in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(found, pa.list_(pa.string()))], names=["_row", "terms"])

    return run


def find_terms(rows: DataFrame, terms: DataFrame, keep: list[str], text_col: str = "text", term_col: str = "term", fold: bool = True, lot: int = LOT) -> DataFrame:
    """``keep`` and ``terms``, the sorted different terms that occur in the text, for every row.

    With one lot the rows stay where they are. Rows that are equal in all of ``keep`` are told apart by their text.
    """
    text = F.lower(text_col) if fold else F.col(text_col)
    spark = rows.sparkSession
    lots = _lots(term_col, terms, fold, lot)
    held = spread(rows.select(F.struct(*keep).alias("_row"), text.alias("_text")))
    if len(lots) > 1:
        held = held.withColumn("_row", F.struct(F.col("_row").alias("row"), F.xxhash64(F.lit(5), "_text").alias("a"), F.xxhash64("_text").alias("b")))
    schema = f"_row {held.schema['_row'].dataType.simpleString()}, terms array<string>"
    passes = [held.mapInArrow(_search(spark.sparkContext.broadcast(_automaton(part))), schema) for part in lots if part]
    if not passes:
        return held.select("_row.*", F.array().cast("array<string>").alias("terms")) if len(lots) <= 1 else held.select("_row.row.*", F.array().cast("array<string>").alias("terms"))
    if len(passes) == 1 and len(lots) == 1:
        return passes[0].select("_row.*", "terms")
    # Equal rows have equal terms: they are counted, their lots put together, and repeated again.
    met = None
    for one in passes:
        met = one if met is None else met.unionByName(one)
    per = met.groupBy("_row").agg(F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("terms")))).alias("terms"))
    again = F.explode(F.sequence(F.lit(1).cast("long"), (F.col("n") / len(passes)).cast("long")))
    return per.select("_row.row.*", "terms", again.alias("_n")).drop("_n")
