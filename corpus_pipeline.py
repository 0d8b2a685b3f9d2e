"""A corpus pipeline of five stages: language, repeated lines, near copies, benchmark items, source mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm import decontaminate, jaccard_join, language_id, line_dedup, mixing
from docframe.plans.ship import ship
from docframe.plans.stage import stage

#: A filter that rejects by a trained model has no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None

MIN_SCORE = 0.5
KEPT = "caller's "
"""Prefix of columns that an operator does not read while it runs: it may replace columns of its own names."""
SPARE = 16
"""At 0.8 the prefixes are long and close pairs share many of their hashes: fewer places are paired."""


def shielded(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` whose columns, but for ``used``, cannot meet a column that an operator adds."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in used else KEPT + c) for c in docs.columns])


def as_given(found: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of ``docs`` again, under their names."""
    return found.select(*[F.col(f"`{c if c in used else KEPT + c}`").alias(c) for c in docs.columns])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without letters and doubtful ones go."""
    ship(spark)
    found = language_id.predict_languages(shielded(docs, "text"), language_id.fit(docs))
    sure = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= MIN_SCORE)
    return as_given(found.filter(sure), docs, "text")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of windows of three that occurred before are cut; ``n_chars`` follows the text."""
    ship(spark)
    used = ["doc_id", "text", *[c for c in ("n_chars",) if c in docs.columns]]
    kept = line_dedup.dedup_lines(shielded(docs, *used))
    if "n_chars" in used:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return as_given(kept, docs, *used)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by word-shingle similarity of 0.8 or more."""
    ship(spark)
    used = ("doc_id", "text")
    return as_given(jaccard_join.drop_near_duplicates(shielded(docs, *used), spare=SPARE), docs, *used)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths of a benchmark item's shingles go."""
    used, items = ("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return as_given(decontaminate.drop_contaminated(shielded(docs, *used), items, short_items=True), docs, *used)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How much of every document the mix takes."""
    sized = stage(docs.select("doc_id", "source", mixing.n_words("text").alias("size")), "sizes")
    return mixing.mix_sources(sized).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language ID", known_language),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("source mix", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}")
    return docs
