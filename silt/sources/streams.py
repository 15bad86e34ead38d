"""Raw streams as DataFrames: (run_id, stream, raw, exit_code), one row a stream.

A run's two streams are never merged; (run_id, stream) is the key of a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["run_id", "stream"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_text(df: DataFrame, run_id: str, text: str, stream: str = "stdout", exit_code: int = 0) -> DataFrame:
    """Any table with a key and a text as streams."""
    return df.select(F.col(run_id).alias("run_id"), F.lit(stream).alias("stream"), F.col(text).alias("raw"), F.lit(exit_code).alias("exit_code"))


def from_events(events: DataFrame) -> DataFrame:
    """A text log for each user of the events table: one line an event, in time order."""
    k = F.get_json_object("props", "$.k")
    line = (
        F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 20 == 0, F.concat(F.lit("error: request "), k, F.lit(" rejected"))).otherwise("retrying request"))
        .when(F.col("event_type") == "signup", "warning: legacy signup form")
        .when(F.col("event_type") == "click", F.concat(F.lit("   Compiling page_"), k, F.lit(" v1")))
        .when(F.col("event_type") == "view", F.concat(F.lit("checked item "), k))
        .otherwise("")
    )
    rows = events.select("user_id", F.struct("ts", "event_id", line.alias("line")).alias("e"))
    logs = rows.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["line"]), "\n").alias("raw"))
    return logs.select(
        F.col("user_id").alias("run_id"),
        F.when(F.col("user_id") % 2 == 1, "stderr").otherwise("stdout").alias("stream"),
        "raw",
        (F.col("user_id") % 3).cast("int").alias("exit_code"),
    )


def from_conversations(conversations: DataFrame) -> DataFrame:
    """A stream for each conversation: its turns in order, with a blank line between."""
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    raw = F.array_join(F.transform("t", lambda t: F.coalesce(t["text"], F.lit(""))), "\n\n")
    return turns.select(F.col("conv_id").alias("run_id"), F.lit("stdout").alias("stream"), raw.alias("raw"), F.lit(1).alias("exit_code"))


def decode(streams: DataFrame, column: str = "raw") -> DataFrame:
    """Binary streams as text, with ``is_text`` false where the bytes are not UTF-8.

    Such a stream is kept out of filtering and shown as it is.
    """
    return streams.withColumn("is_text", F.is_valid_utf8(F.col(column).cast("string"))).withColumn("text", F.make_valid_utf8(F.col(column).cast("string")))
