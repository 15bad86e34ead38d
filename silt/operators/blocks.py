"""Lines to blocks, in windows over one hash partitioning by (run_id, stream)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silt.sources.streams import KEY


def assign_blocks(flagged: DataFrame) -> DataFrame:
    """Non-blank lines with ``block``, the number of their block in the stream from 1.

    A blank line ends a block and is no content. A line at the margin (neither indented
    nor in a gutter) begins a block once the block has an indented line after its first.
    """
    order = Window.partitionBy(*KEY).orderBy("origin")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    lines = flagged.withColumn("first", F.coalesce(F.lag("blank").over(order), F.lit(True))).where(~F.col("blank"))
    margin = ~F.col("indented") & ~F.col("gutter")
    # indented lines so far that follow another line of their block's stretch
    lines = lines.withColumn("c", F.coalesce(F.sum((F.col("indented") & ~F.col("first")).cast("int")).over(before), F.lit(0)))
    seen = F.last(F.when(margin | F.col("first"), F.col("c")), ignorenulls=True).over(before)
    lines = lines.withColumn("boundary", F.col("first") | (margin & (F.col("c") > seen)))
    return lines.withColumn("block", F.sum(F.col("boundary").cast("int")).over(order)).drop("first", "c", "boundary", "blank", "indented", "gutter")


def split_repeats(lines: DataFrame) -> DataFrame:
    """Runs of three or more equal lines in a block that is not all progress, set apart.

    The run's first line becomes a block of its own, marked ``repeated``; the other
    copies become a dropped block (``copies``). Blocks are numbered anew. All windows
    share one sort: a line's place in its run shows in the lines up to three away.
    """
    whole = Window.partitionBy(*KEY, "block").orderBy("origin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.partitionBy(*KEY).orderBy("block", "origin")

    def like(here: Column, column: str, k: int) -> Column:
        return F.coalesce(F.lag(column, k).over(order) == here, F.lit(False))

    def same(k: int) -> Column:
        """Whether the line ``k`` before (after, if negative) is of this block and equal."""
        return like(F.col("block"), "block", k) & like(F.col("text"), "text", k)

    lines = lines.withColumn("all_progress", F.min("progress").over(whole))
    before = F.lag("text", 1).over(order)
    lines = lines.select(
        "*",
        (~like(F.col("block"), "block", 1)).alias("_first"),
        same(1).alias("_b1"),
        (same(1) & same(2)).alias("_b2"),
        same(-1).alias("_f1"),
        (same(-1) & same(-2)).alias("_f2"),
        (like(F.col("block"), "block", 3) & like(before, "text", 2) & like(before, "text", 3)).alias("_was"),
    )
    split = ~F.col("all_progress")
    repeated = split & ~F.col("_b1") & F.col("_f2")
    copies = split & F.col("_b1") & (F.col("_b2") | F.col("_f1"))
    starts = F.col("_first") | repeated | (copies & ~F.col("_b2")) | (split & ~F.col("_b1") & F.col("_was"))
    lines = lines.withColumn("repeated", repeated).withColumn("copies", copies).withColumn("_starts", starts)
    lines = lines.withColumn("block", F.sum(F.col("_starts").cast("int")).over(order))
    return lines.drop("_first", "_b1", "_b2", "_f1", "_f2", "_was", "_starts")


def gather(lines: DataFrame, extra: list[str] = ["exit_code"]) -> DataFrame:  # noqa: B006
    """One row a block: its lines in order and what the stages need of them.

    A block is bounded by its stream's own lines; the grouping keys contain the
    window keys, so no new shuffle is needed.
    """
    failing = F.when(F.col("failing"), F.struct("origin", "testing"))
    blocks = lines.groupBy(*KEY, "block").agg(
        *[F.first(c).alias(c) for c in extra],
        F.sort_array(F.collect_list(F.struct("origin", "text"))).alias("lines"),
        F.count("*").cast("int").alias("n_lines"),
        F.first("all_progress").alias("all_progress"),
        F.max("repeated").alias("repeated"),
        F.max("copies").alias("copies"),
        F.min(failing)["testing"].alias("first_failing_tests"),
        F.max("warning").alias("warning"),
        F.max("content").alias("content"),
    )
    # a repeated line's copies are all of the next block
    copied = F.lead("n_lines").over(Window.partitionBy(*KEY).orderBy("block")) + F.lit(1)
    return blocks.withColumn("repeats", F.when(F.col("repeated"), copied)).drop("repeated")
