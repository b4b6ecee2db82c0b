"""The corpus pipeline: graded quality, near-duplicates, repeated strings, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontam, neardup, packing, quality, repeats
from palimpsest.llm.common import written
from palimpsest.llm.queries import table, word_bpe


def _aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list]:
    """docs with columns of these names under other ones, as a stage makes columns of that name; and all as they were."""
    own = {n: f"__own_{n}" for n in names if n in docs.columns}
    return docs.withColumnsRenamed(own), [F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is likelier than not the better one; blank texts go."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality")
    docs, columns = _aside(docs, ("expected_grade", "tail_probability", "selected"))
    return quality.graded(docs, model, at_least=1).where("selected").select(columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): the one with the least doc_id."""
    return neardup.keep_first(docs, shingle=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that start elsewhere too. A character that a cut splits goes as a whole,
    n_chars is counted anew, and texts of which no word is left go."""
    docs, columns = _aside(docs, ("n_bytes", "n_removed", "n_spans"))
    cut = repeats.remove_repeats(docs, 200, whole_characters=True).withColumn("n_chars", F.length("text").cast("long"))
    return cut.where(r"n_removed = 0 or text rlike '[^\\x20\\x09-\\x0D]'").select(columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that holds a test item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, each a sequence whose length is a power of two."""
    return packing.pack(docs, word_bpe(), max_tokens=4096)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packed),
]

#: No SQL expresses a fitted classifier; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of `documents` after all stages, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
