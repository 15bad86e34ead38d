"""Measurements against a baseline, and how cost grows with the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGRESSION = 1.2
NOISE_US = 100
GROWTH = 8.0


_TIMES = "struct<p50_us:long,p99_us:long>"


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(fixture, stage, p50, p99) of a baseline file; a fixture's whole is its stage ``total``."""
    return parse_baseline(spark.read.text(path, wholetext=True))


def parse_baseline(files: DataFrame, value: str = "value") -> DataFrame:
    """Baseline files given as texts; a text that is no JSON object gives no rows."""
    parsed = F.from_json(value, f"map<string,struct<stages:map<string,{_TIMES}>,total:{_TIMES}>>")
    fixtures = files.select(F.explode(parsed).alias("fixture", "f"))
    whole = F.when(F.col("f.total").isNotNull(), F.create_map(F.lit("total"), F.col("f.total")))
    none = F.create_map().cast(f"map<string,{_TIMES}>")
    stages = F.map_concat(F.coalesce("f.stages", none), F.coalesce(whole, none))
    return fixtures.select("fixture", F.explode(stages).alias("stage", "t")).select("fixture", "stage", F.col("t.p50_us").alias("p50"), F.col("t.p99_us").alias("p99"))


def against_baseline(measured: DataFrame, baseline: DataFrame, limit: float = REGRESSION, noise: int = NOISE_US) -> DataFrame:
    """(fixture, stage, p50) with the baseline's ``was``, the ratio and a verdict.

    A fixture or stage that the baseline lacks is ``new``; one measured there under
    ``noise`` microseconds is ``noise``; over the limit is a ``regression``.
    """
    was = baseline.select("fixture", "stage", F.col("p50").alias("was"))
    rows = measured.join(was, ["fixture", "stage"], "left").withColumn("ratio", F.when(F.col("was") > 0, F.col("p50") / F.col("was")))
    verdict = F.when(F.col("was").isNull(), "new").when(F.col("was") < noise, "noise").when(F.col("ratio") > limit, "regression").otherwise("ok")
    return rows.withColumn("verdict", verdict)


def growth(times: DataFrame, limit: float = GROWTH) -> DataFrame:
    """(fixture, p50 at scales 1, 4 and 16) to both ratios and whether they stay linear."""
    at = times.groupBy("fixture").agg(*(F.max(F.when(F.col("scale") == s, F.greatest(F.col("p50"), F.lit(1)))).alias(f"x{s}") for s in (1, 4, 16)))
    rows = at.select("fixture", (F.col("x4") / F.col("x1")).alias("g4"), (F.col("x16") / F.col("x4")).alias("g16"))
    return rows.withColumn("verdict", F.when((F.col("g4") > limit) | (F.col("g16") > limit), "superlinear").otherwise("ok"))


def format_bytes(n: Column) -> Column:
    """Whole KB from 1024 on, else bytes."""
    return F.when(n >= 1024, F.concat(F.floor(n / 1024).cast("string"), F.lit(" KB"))).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def milliseconds(micros: Column) -> Column:
    return micros / 1000.0
