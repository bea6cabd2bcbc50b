"""A corpus pipeline from five operators: each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.

Rows keep the columns of `documents`; n_chars follows the text where a stage changes it. The last stage adds `copy`.

Every stage takes any rows: documents without text or letters go at the first stage, and lines or spans that go never leave an empty text;
nulls in other columns and columns whose names an operator uses come through unchanged; rows that repeat an id and a text are
decided alike by the line stage and are one document for the near-copy stage, which of ties keeps the least id, then the
lesser row; texts of any length are whole; an empty table gives an empty table with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.llm import decontaminate, langid, linededup, mixing, neardup
from sheetloom.llm.common import set_aside, stash, table

#: A document of which a larger share of words belongs to benchmark items goes; of others the spans go.
MAX_CONTAMINATED = 0.5


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars, where there is such a column, after a change of text."""
    out = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else docs
    return out.select(*columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; the others go."""
    return langid.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go, and documents that are left without words by it."""
    return _measured(linededup.without_removed(docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return neardup.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark items go, and documents that are mostly such spans."""
    free, back = set_aside(docs, [f.name for f in decontaminate.FIELDS])
    out = decontaminate.decontaminate(free, table(spark, sf_dir, "benchmark"))
    kept = out.where(F.col("n_hit") <= MAX_CONTAMINATED * F.col("n_words"))
    return _measured(kept.select(*(F.col("clean_text").alias("text") if c == "text" else c for c in free.columns)).withColumnsRenamed(back), docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontaminate", benchmark), ("mixing", mixture)]

#: Likelihoods, components and Newton steps are beyond SQL; tests hold each operator, and the line stage of the pipeline, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
