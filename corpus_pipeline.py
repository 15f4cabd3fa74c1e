"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept;
all but the last return the columns of ``documents``. ``run`` writes each stage's result
as Parquet to the shared folder and reads it again for the next; what a stage wrote for itself
is deleted once its result is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from canopy.llm import decontamination, line_dedup, minhash, packing
from canopy.llm import toxicity as tox
from canopy.llm.queries import held_out
from canopy.llm.stage import clean, mark, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    return tox.below(docs, tox.fit(docs, labels))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated chunks of lines; documents of which nothing is left go."""
    return line_dedup.remaining(docs, size_col="n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, similarity 0.8)."""
    return minhash.keep_one(docs, similarity=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row per piece of a document."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Scores, hashed chunks and token ids can't be written in SQL; the tests compare with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, start = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}", spark)
        clean(spark, start, last=False)
    return STAGES[-1][1](spark, docs, sf_dir)
