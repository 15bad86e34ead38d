"""Structured Streaming over the run log and over closed runs.

Report counts are incremental; a run's stages need its whole document, so runs are
filtered when they are closed, batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from silt.operators import log
from silt.plans import pipeline


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """Records of a growing folder of log files, with their time as ``at``."""
    lines = spark.readStream.text(folder)
    return log.parse(lines).withColumn("at", F.to_timestamp("t"))


def hourly(records: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Runs, tokens and passthroughs of each command and hour; late records are let in
    until the watermark passes."""
    runs = records.where(F.col("type") == "run").withWatermark("at", late)
    return runs.groupBy(F.window("at", width), "cmd").agg(
        F.count("*").alias("runs"),
        F.sum(F.coalesce("in_tok", F.lit(0))).alias("in_tok"),
        F.sum(F.coalesce("out_tok", F.lit(0))).alias("out_tok"),
        F.count_if("passthrough").alias("passthrough"),
    )


def filter_closed(streams: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, level: int = 2) -> StreamingQuery:
    """Views of closed runs' streams as they arrive, given to ``sink`` batch by batch."""

    def batch(df: DataFrame, number: int) -> None:
        sink(pipeline.filter_view(df, level), number)

    return streams.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
