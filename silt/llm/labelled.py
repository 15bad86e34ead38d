"""What the two classifiers share: folds by row key and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Labelled rows of each class that a model is fitted on, at most; the rows of least
#: hash are taken, so the sample is the same on every run and of every source alike.
SAMPLE_PER_CLASS = 6000


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; -1 for a null key."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(-1))


def sample(labels: DataFrame, id_col: str, label_col: str, train: Column, per_class: int = SAMPLE_PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """(id, y) of at most ``per_class`` training rows of each class, and all classes' counts.

    Rows with a null key, or a label other than 0 and 1, are left out.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & train).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    some = [rows.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    return materialize(some[0].unionByName(some[1]), "labelled"), counts


def within(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, chars: int) -> DataFrame:
    """The chosen rows, in order of hash, that fit in ``chars`` characters of text a class.

    A row that does not fit is passed over and the next ones tried; a class of which no
    row fits keeps its shortest. The sizes, one a chosen id, are at most as many as
    ``chosen`` has rows, so they are looked through in the driver.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.length(text_col).cast("long").alias("n")).join(F.broadcast(chosen.distinct()), "id")
    sizes = rows.groupBy("id", "y").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).orderBy("y", F.xxhash64("id"), "id").collect()
    left, kept = {0: chars, 1: chars}, []
    for r in sizes:
        if r["n"] <= left[r["y"]]:
            left[r["y"]] -= r["n"]
            kept.append((r["id"], r["y"]))
    for y in {r["y"] for r in sizes} - {y for _, y in kept}:
        kept.append(min(((r["n"], r["id"]) for r in sizes if r["y"] == y))[1:] + (y,))
    return materialize(docs.sparkSession.createDataFrame(kept, chosen.select("id", "y").schema), "labelled")


def with_labels(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(y, text) of the chosen rows, whose number is bounded, so they are broadcast."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.join(F.broadcast(chosen), "id").select("y", "text")
