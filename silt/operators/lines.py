"""Streams to lines: split, clean, and flag before anything is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.functions import text as T


def split_lines(streams: DataFrame, raw: str = "raw") -> DataFrame:
    """One row a line with ``origin``, its number from 1, blank lines counted.

    A line ends with \\n or \\r\\n; a last line without an end keeps a lone \\r, and no
    empty line follows a final \\n. All other columns but ``raw`` are kept.
    """
    kept = [c for c in streams.columns if c != raw]
    parts = streams.select(*kept, F.split(F.coalesce(F.col(raw), F.lit("")), "\n", -1).alias("_parts"))
    lines = parts.select(*kept, F.size("_parts").alias("_n"), F.posexplode("_parts").alias("_at", "text"))
    lines = lines.where((F.col("_at") < F.col("_n") - 1) | (F.col("text") != ""))
    ended = F.col("_at") < F.col("_n") - 1
    line = F.col("text")
    text = F.when(ended & line.endswith("\r"), line.substr(F.lit(1), F.length(line) - 1)).otherwise(line)
    return lines.select(*kept, (F.col("_at") + 1).alias("origin"), text.alias("text"))


def clean_lines(lines: DataFrame) -> DataFrame:
    """Terminal escapes and overwritten text out of every line that has any."""
    return lines.withColumn("text", T.clean_line(F.col("text")))


def flag_lines(lines: DataFrame) -> DataFrame:
    """What later stages ask of a line's shape (as it came) and text (cleaned)."""
    raw, clean = F.col("text"), F.col("clean")
    flagged = lines.select(
        "*",
        T.is_blank(raw).alias("blank"),
        T.is_indented(raw).alias("indented"),
        T.is_gutter(raw).alias("gutter"),
        T.clean_line(raw).alias("clean"),
    )
    return flagged.select(
        *[c for c in lines.columns if c != "text"],
        F.col("clean").alias("text"),
        "blank",
        "indented",
        "gutter",
        T.is_progress(clean).alias("progress"),
        T.is_failure_line(clean).alias("failing"),
        (T.is_failure_line(clean) & T.is_test_failure_line(clean)).alias("testing"),
        T.is_warning_line(clean).alias("warning"),
        T.has_content(clean).alias("content"),
    )
