"""Views of marked blocks. Whatever a view leaves out is announced where it stood."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silt.functions.text import TAG, token_estimate
from silt.sources.streams import KEY

from .stages import is_failure, kept, ordered

SUMMARY, ITEMS, DETAIL, RAW = 0, 1, 2, 3
REASONS = {"filtered": "filtered", "summary": "level 0 shows counts only"}


def marker(lines: Column, reason: str, blocks: Column, handle: Column | None = None) -> Column:
    """One line that says how much is missing, why, and how to get it."""
    n = lines.cast("string")
    plain = F.concat(n, F.when(lines == 1, " line outside this view").otherwise(" lines outside this view"))
    what = F.when(blocks > 1, F.concat(n, F.lit(" lines in "), blocks.cast("string"), F.lit(" blocks outside this view"))).otherwise(plain)
    tail = F.lit("") if handle is None else F.when(handle.isNotNull(), F.concat(F.lit(f" · {TAG} show "), handle, F.lit(" --level 3"))).otherwise("")
    return F.concat(F.lit(f"[{TAG}: "), what, F.lit(f" · {reason}"), tail, F.lit("]"))


def _handle(blocks: DataFrame) -> Column | None:
    return F.col("handle") if "handle" in blocks.columns else None


def _kept_lines() -> Column:
    return F.sum(F.when(kept(), F.col("n_lines")).otherwise(0)).alias("kept_lines")


def summary(blocks: DataFrame) -> DataFrame:
    """Counts only, of all blocks, dropped ones too: (run_id, stream, body, lines, kept_lines)."""
    hold = [F.first("handle").alias("handle")] if "handle" in blocks.columns else []
    counts = blocks.groupBy(*KEY).agg(
        F.sum("n_lines").alias("lines"),
        _kept_lines(),
        F.sum(is_failure().cast("int")).alias("failing"),
        F.sum((F.col("class") == "Warning").cast("int")).alias("warnings"),
        *hold,
    )
    head = F.concat(F.col("lines").cast("string"), F.lit(" lines · "), F.col("failing").cast("string"), F.lit(" failing · "), F.col("warnings").cast("string"), F.when(F.col("warnings") == 1, " warning\n").otherwise(" warnings\n"))
    return counts.select(*KEY, F.concat(head, marker(F.col("lines"), REASONS["summary"], F.lit(1), _handle(counts)), F.lit("\n")).alias("body"), "lines", "kept_lines")


def body(blocks: DataFrame, failures_only: bool = False) -> DataFrame:
    """Kept blocks in place, and a marker for each stretch of others: (run_id, stream, body,
    lines, kept_lines), the lines counted in the same grouping."""
    show = kept() & is_failure() if failures_only else kept()
    blocks = blocks.withColumn("_show", show)
    new = F.coalesce(F.col("_show") != F.lag("_show").over(ordered()), F.lit(True)) | F.col("_show")
    blocks = blocks.withColumn("_new", new.cast("int")).withColumn("_part", F.sum("_new").over(ordered()))
    text = F.array_join("lines.text", "\n")
    hold = [F.first("handle").alias("handle")] if "handle" in blocks.columns else []
    parts = blocks.groupBy(*KEY, "_part").agg(F.first("_show").alias("_show"), F.sum("n_lines").alias("n"), F.count("*").alias("b"), F.min(F.when(F.col("_show"), text)).alias("t"), _kept_lines(), *hold)
    piece = F.when(F.col("_show"), F.col("t")).otherwise(marker(F.col("n"), REASONS["filtered"], F.col("b"), _handle(parts)))
    parts = parts.select(*KEY, F.struct("_part", piece.alias("piece")).alias("p"), "n", "kept_lines")
    whole = parts.groupBy(*KEY).agg(F.sort_array(F.collect_list("p")).alias("p"), F.sum("n").alias("lines"), F.sum("kept_lines").alias("kept_lines"))
    return whole.select(*KEY, F.concat(F.array_join("p.piece", "\n"), F.lit("\n")).alias("body"), "lines", "kept_lines")


def counted(blocks: DataFrame, streams: DataFrame, level: int = DETAIL) -> DataFrame:
    """Every stream with its view's ``body`` and its ``lines`` and ``kept_lines``, from one
    pass over its blocks; one without blocks is empty."""
    if level not in (SUMMARY, ITEMS, DETAIL):
        raise ValueError(f"no such level: {level}")
    view = summary(blocks) if level == SUMMARY else body(blocks, failures_only=level == ITEMS)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return streams.join(view, KEY, "left").select(*streams.columns, F.coalesce("body", F.lit("")).alias("body"), zero("lines"), zero("kept_lines"))


def render(blocks: DataFrame, streams: DataFrame, level: int = DETAIL) -> DataFrame:
    """(run_id, stream, level, body) for every stream; one without blocks is empty."""
    return counted(blocks, streams.select(*KEY), level).select(*KEY, F.lit(level).alias("level"), "body")


def raw(streams: DataFrame) -> DataFrame:
    """The streams as they came; nothing is parsed."""
    return streams.select(*KEY, F.lit(RAW).alias("level"), F.col("raw").alias("body"))


def accounting(blocks: DataFrame) -> DataFrame:
    """Lines kept and elided of each stream; together they are all of its lines."""
    return blocks.groupBy(*KEY).agg(
        F.sum("n_lines").alias("lines"),
        F.sum(F.when(kept(), F.col("n_lines")).otherwise(0)).alias("kept_lines"),
        F.sum(F.when(~kept(), F.col("n_lines")).otherwise(0)).alias("elided_lines"),
        F.max(is_failure().cast("int")).alias("has_failure"),
    )


def report(blocks: DataFrame, streams: DataFrame, level: int = DETAIL, estimate: Callable[[Column], Column] = token_estimate) -> DataFrame:
    """Lines and estimated tokens before and after, for each run over both its streams.

    ``estimate`` gives a text's tokens; any function of a column will do.
    """
    views = counted(blocks, streams.select(*KEY, "raw"), level)
    before, after = estimate(F.coalesce(F.col("raw"), F.lit(""))), estimate(F.col("body"))
    rows = views.select("run_id", "lines", "kept_lines", before.alias("in_tok"), after.alias("out_tok"))
    return rows.groupBy("run_id").agg(F.sum("lines").alias("in_lines"), F.sum("kept_lines").alias("out_lines"), F.sum("in_tok").alias("in_tok"), F.sum("out_tok").alias("out_tok"))
