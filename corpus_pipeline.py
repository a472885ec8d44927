"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. All stages but the last return the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrapoint.llm import decontaminate, near_dup, packing, quality, substring_dedup
from terrapoint.llm.common import fold, ship, staged, table
from terrapoint.llm.queries import WINDOW, tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.3; the field is learned as in op1_quality, on the given documents."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    marked = quality.mark(docs, model, 0.3)
    return marked.where("quality_keep").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest id."""
    ship(spark)
    return near_dup.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id holds too."""
    ship(spark)
    return substring_dedup.cut(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their token ids."""
    ship(spark)
    return packing.pack(docs, tokenizer_path(), WINDOW)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", one_of_each),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: The stages learn a field, align texts and cut bytes, which SQL can't express; tests/llm holds each stage and run()
#: against brute force on a small table.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
