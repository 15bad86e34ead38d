"""The marking stages over blocks. A stage marks; it never removes a block.

Each is a function from DataFrame to DataFrame over (run_id, stream, block) with
``keep`` (Force, Normal, Drop), ``reason`` (why a dropped block left the view) and
``class``. All windows are over (run_id, stream), so one partitioning serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from silt.functions.text import TAG, normalise_digits
from silt.session import python_workers
from silt.sources.streams import KEY

from .folds import LIVE_LEAST, fold_codes

FLOOR = {"stdout": 3, "stderr": 5}
CONTEXT = 3



def ordered() -> WindowSpec:
    """The blocks of a stream in order."""
    return Window.partitionBy(*KEY).orderBy("block")


def whole() -> WindowSpec:
    """All blocks of a stream; in the same order, so that one sort serves both."""
    return ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def kept() -> Column:
    return F.col("keep") != "Drop"


def is_failure() -> Column:
    return F.col("class").isin("Error", "Failure")


def block_text() -> Column:
    return F.array_join("lines.text", "\n")


def annotate(lines: Column, total: Column) -> Column:
    """The repeat count after the last line, unless it has one."""
    last = F.element_at(lines, -1)
    mark = F.concat(F.lit(f"  [{TAG}: ×"), total.cast("string"), F.lit("]"))
    marked = F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(F.struct(last["origin"].alias("origin"), F.concat(last["text"], mark).alias("text"))))
    return F.when(total.isNotNull() & ~last["text"].contains(f"[{TAG}: ×"), marked).otherwise(lines)


def drop_progress(blocks: DataFrame) -> DataFrame:
    """Blocks made of progress lines alone are dropped; every block gets its marks."""
    dropped = F.when(F.col("all_progress"), "progress").when(F.col("copies"), "dedupe")
    blocks = blocks.withColumn("reason", dropped).withColumn("keep", F.when(dropped.isNull(), "Normal").otherwise("Drop"))
    return blocks.withColumn("class", F.when(F.col("all_progress"), "Progress").otherwise("Info")).withColumn("lines", annotate(F.col("lines"), F.col("repeats"))).withColumn("marked", F.col("repeats").isNotNull()).drop("repeats", "copies", "all_progress")


def collapse_adjacent(blocks: DataFrame) -> DataFrame:
    """Of adjacent kept blocks with equal lines the first stays, with their number."""
    blocks = blocks.withColumn("_text", F.col("lines.text"))
    same = kept() & (F.lag("keep").over(ordered()) != "Drop") & (F.col("_text") == F.lag("_text").over(ordered()))
    blocks = blocks.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(ordered()))
    run = Window.partitionBy(*KEY, "_run").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.withColumn("_n", F.count("*").over(run))
    copy, survivor = F.col("_new") == 0, (F.col("_new") == 1) & (F.col("_n") > 1)
    blocks = blocks.withColumn("lines", annotate(F.col("lines"), F.when(survivor, F.col("_n"))))
    blocks = blocks.withColumn("marked", F.col("marked") | survivor)
    blocks = blocks.withColumn("reason", F.when(copy, "dedupe").otherwise(F.col("reason"))).withColumn("keep", F.when(copy, "Drop").otherwise(F.col("keep")))
    return blocks.drop("_text", "_new", "_run", "_n")


def collapse_windows(blocks: DataFrame) -> DataFrame:
    """Repeated runs of blocks, digits aside, reduced to their first copy.

    The greedy search is a fold over a stream's kept blocks, so each stream's keys go to
    Python as one array, unless they are too few to repeat. The blocks ride along in
    the same row and come apart again: the partitioning stays, and nothing is joined.
    """
    python_workers(blocks.sparkSession)
    columns = [c for c in blocks.columns if c not in KEY]
    flat = normalise_digits(block_text())
    live = blocks.withColumn("_key", F.when(kept(), F.xxhash64(flat, F.length(flat)))).withColumn("_at", F.sum(kept().cast("int")).over(ordered()))
    rows = live.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("block", *(c for c in columns if c != "block"), "_key", "_at"))).alias("_b"))
    keys = F.filter(F.col("_b._key"), lambda k: k.isNotNull())
    search = F.pandas_udf(fold_codes, "array<long>")
    rows = rows.withColumn("_codes", search(F.when(F.size(keys) >= LIVE_LEAST, keys)))
    code = lambda b: F.when(b["keep"] != "Drop", F.element_at("_codes", b["_at"].cast("int")))
    codes = F.when(F.size("_codes") > 0, F.transform("_b", code)).otherwise(F.array().cast("array<long>"))
    out = rows.select(*KEY, F.explode(F.arrays_zip("_b", codes.alias("_code"))).alias("_z"))
    out = out.select(*KEY, *(F.col(f"_z._b.{c}").alias(c) for c in columns), F.coalesce("_z._code", F.lit(0)).alias("_code"))
    gone, times = F.col("_code") < 0, F.when(F.abs("_code") > 1, F.abs("_code"))
    out = out.withColumn("lines", annotate(F.col("lines"), times)).withColumn("marked", F.col("marked") | times.isNotNull())
    out = out.withColumn("reason", F.when(gone, "dedupe").otherwise(F.col("reason"))).withColumn("keep", F.when(gone, "Drop").otherwise(F.col("keep")))
    return out.drop("_code")


def classify(blocks: DataFrame) -> DataFrame:
    """Severity of every block but progress, dropped ones too.

    An annotation holds letters, so a marked block is never noise.
    """
    severity = (
        F.when(F.col("class") == "Progress", "Progress")
        .when(F.col("first_failing_tests"), "Failure")
        .when(F.col("first_failing_tests").isNotNull(), "Error")
        .when(F.col("warning"), "Warning")
        .when(F.col("content") | F.col("marked"), "Info")
        .otherwise("Noise")
    )
    return blocks.withColumn("class", severity).drop("first_failing_tests", "warning", "content", "marked")


def _force(blocks: DataFrame, chosen: Column) -> DataFrame:
    blocks = blocks.withColumn("_force", F.coalesce(chosen, F.lit(False)))
    return blocks.withColumn("keep", F.when(F.col("_force"), "Force").otherwise(F.col("keep"))).withColumn("reason", F.when(~F.col("_force"), F.col("reason"))).drop("_force")


def failure_floor(blocks: DataFrame) -> DataFrame:
    """A failed run whose stream shows no failure keeps its last blocks.

    Progress blocks are not kept but take up places.
    """
    silent = F.max(is_failure().cast("int")).over(whole()) == 0
    depth = F.when(F.col("stream") == "stderr", FLOOR["stderr"]).otherwise(FLOOR["stdout"])
    last = F.count("*").over(whole()) - F.row_number().over(ordered()) < depth
    return _force(blocks, (F.col("exit_code") != 0) & silent & last & (F.col("class") != "Progress"))


def failure_context(blocks: DataFrame, context_blocks: int = CONTEXT) -> DataFrame:
    """Every block but progress within reach of a failure is kept."""
    near = F.max(is_failure().cast("int")).over(ordered().rowsBetween(-context_blocks, context_blocks)) == 1
    return _force(blocks, near & (F.col("class") != "Progress"))


def elided(blocks: DataFrame) -> DataFrame:
    """Adds the countable record of what left the view: lines_removed and reason."""
    record = F.struct(F.col("n_lines").alias("lines_removed"), F.col("reason").alias("reason"))
    return blocks.withColumn("elided", F.when(F.col("keep") == "Drop", record))
