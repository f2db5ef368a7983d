"""A training corpus from `documents`, in five stages.

Each stage works on all that the one before it kept: quality rules, SimHash near-duplicates, substring dedup,
benchmark decontamination, and packing into sequences. A stage's rows are written before the next one begins, so that its
working tables go then.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, packing, quality, simhash, substrings
from lectern.llm.common import discard, recorded, written

#: Working tables of the stage before, in this thread.
_working: ContextVar[tuple[DataFrame, ...]] = ContextVar("working", default=())


def stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Delete the working tables of the stage before, and remember this one's."""

    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(*[t for t in _working.get() if t.sparkSession.sparkContext is spark.sparkContext])
        _working.set(())
        with recorded() as made:
            try:
                return fn(spark, docs, sf_dir)
            finally:
                _working.set(tuple(made))

    return run


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.filter_quality(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest id."""
    return simhash.drop_near_duplicates(docs, size=5, similarity=0.8)


@stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what repeats earlier ones for 20 words or more; n_chars follows."""
    kept = substrings.deduplicate(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else kept


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more of the benchmark than a twentieth of their words."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", pack_sequences),
]

#: SQL can't express the fingerprints and the tokenizer; tests compare the stages with a brute-force version on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
