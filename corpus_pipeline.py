"""The corpus pipeline: documents judged, deduplicated, decontaminated, redacted and packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
All but the last return the columns of documents; the last returns packed pieces. Null and
empty texts are texts without words: they are judged, are copies of each other, hold no
benchmark item or secret, and pack to their end id. Rows with a null or repeated id are rows
like any other, an empty table gives an empty one, other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silt.llm import decontaminate, packing, quality, secrets, simhash
from silt.llm.common import discard, materialize_only, table
from silt.llm.queries import tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking does not reject."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 or more of its five-word shingles."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced and n_chars made to fit."""
    redacted = secrets.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in redacted.columns else redacted


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    return packing.pack(docs, **tokenizer())


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: No stage but the last could be said in SQL (a fitted ranking, connected components,
#: edit distances, learned limits, a tokenizer); tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each one's rows are written and read again.

    A stage's own steps and the rows of the one before go as soon as its rows are written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize_only(lambda now=docs, stage=stage: stage(spark, now, sf_dir), f"pipeline-{name}", spark)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
