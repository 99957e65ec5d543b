"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. The
first four return the columns of ``documents``; the last returns the pieces with their places.

Cases: documents with a null text have no words and go in the first stage; an empty table
goes through all stages; extra columns come through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontaminate, langid, ngram_join, packing, quality
from foliant.llm.queries import LANGUAGE_SAMPLE, learnable, tokenizer_path
from foliant.session import cut_lineage, table

#: No SQL: language model and join hashes have no SQL form. The stages are tested one by one.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines go, and documents that fail the base rules or lose too much."""
    return quality.keep_clean(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model does not recognise go."""
    model = langid.train(langid.draw_sample(docs.where(learnable()), "doc_id", "text", "lang", LANGUAGE_SAMPLE))
    judged = langid.predict(docs.select(F.struct("*").alias("_row"), "text"), model, ["_row"])
    return judged.where(~F.col("rejected")).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays."""
    return ngram_join.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a ten-word window of a benchmark item go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"), 10)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of 2048 tokens."""
    cut = packing.pieces(docs, tokenizer_path(), 2048, 0, keep=["doc_id"], ranks_path=tokenizer_path("byte_bpe_50k.tiktoken"))
    return packing.pack(cut, 2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
