"""The content-addressed run store: writing, listing, retention and showing runs.

A store is a folder of runs; a run's folder is its handle and holds ``stdout``,
``stderr`` and ``meta.json``. At scale the same rows live in a partitioned table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silt.functions.scalars import handle, is_handle, rfc3339, run_key
from silt.plans import pipeline
from silt.schemas import META

from . import render

MAX_RUNS = 200
MAX_BYTES = 64 << 20


def with_handle(runs: DataFrame) -> DataFrame:
    """Runs (argv, cwd, stdout, stderr as binary, ...) with their key and their short address."""
    parts = [F.col(c) for c in ("argv", "cwd", "stdout", "stderr")]
    return runs.withColumn("run_key", run_key(*parts)).withColumn("handle", handle(*parts))


def write(runs: DataFrame, path: str, partitions: int = 16) -> None:
    """Add runs to a store table; a run that is there already is not written again.

    Runs are told apart by ``run_key``; ``handle`` is for display, and two runs may share
    one. ``bucket`` is the first digit of the handle, so that a look-up of one run prunes
    to one of 16 folders, as the search for known keys does to their column.
    """
    spark = runs.sparkSession
    rows = with_handle(runs).dropDuplicates(["run_key"]).withColumn("bucket", F.substring("handle", 1, 1))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        rows = rows.join(_table(spark, path).select("bucket", "run_key"), ["bucket", "run_key"], "left_anti")
    rows.repartition(partitions, "bucket").write.mode("append").partitionBy("bucket").parquet(path)


def _table(spark: SparkSession, path: str) -> DataFrame:
    """A store table; a bucket is text, though some look like numbers."""
    return spark.read.parquet(path).withColumn("bucket", F.col("bucket").cast("string"))


def read_run(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The run of a handle, from its bucket's folder alone; more where runs share the handle."""
    if spark.range(1).select(is_handle(F.lit(key))).first()[0] is not True:
        raise ValueError(f"not a handle: {key!r}")
    return _table(spark, path).where((F.col("bucket") == key[0]) & (F.col("handle") == key))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a store folder: (handle, name, modified, length, content); strays are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    parts = F.split("path", "/")
    rows = files.select(F.element_at(parts, -2).alias("handle"), F.element_at(parts, -1).alias("name"), F.col("modificationTime").alias("modified"), "length", "content")
    return rows.where(is_handle(F.col("handle")))


def read_streams(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, stream, raw) of every run in a store folder, as bytes.

    Every run has both streams: the reader leaves out files without bytes.
    """
    files = read_files(spark, folder)
    both = files.select("handle").distinct().withColumn("stream", F.explode(F.array(F.lit("stdout"), F.lit("stderr"))))
    found = files.where(F.col("name").isin("stdout", "stderr")).select("handle", F.col("name").alias("stream"), "content")
    rows = both.join(found, ["handle", "stream"], "left")
    return rows.select(F.col("handle").alias("run_id"), "stream", F.coalesce("content", F.lit(b"")).alias("raw"))


def read_meta(spark: SparkSession, folder: str) -> DataFrame:
    """Each run's metadata, with its handle; unknown keys are ignored."""
    meta = read_files(spark, folder).where(F.col("name") == "meta.json")
    parsed = F.from_json(F.col("content").cast("string"), META)
    return meta.select("handle", parsed.alias("m")).where("m is not null").select("handle", "m.*")


def entries(files: DataFrame) -> DataFrame:
    """(handle, bytes, modified) of each run, from rows (handle, length, modified)."""
    return files.groupBy("handle").agg(F.sum("length").alias("bytes"), F.max("modified").alias("modified"))


def listing(store: DataFrame) -> DataFrame:
    """Newest first, equal times by handle."""
    return store.orderBy(F.desc("modified"), "handle")


def retention(store: DataFrame, max_runs: int = MAX_RUNS, max_bytes: int = MAX_BYTES, scope: list[str] | None = None) -> DataFrame:
    """Every entry with ``place``, ``running`` bytes and whether it is ``evicted``.

    Past the run count, or once the bytes of it and all newer ones pass the limit; the
    newest is never evicted. The order is global, so without ``scope`` (the columns of
    one store among many) a single task ranks the entries of the one store: three
    short columns each.
    """
    order = Window.partitionBy(*(scope or [])).orderBy(F.desc("modified"), "handle")
    rows = store.withColumn("place", F.row_number().over(order) - 1).withColumn("running", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("evicted", (F.col("place") >= max_runs) | ((F.col("running") > max_bytes) & (F.col("place") > 0)))


def prune(store: DataFrame, max_runs: int = MAX_RUNS, max_bytes: int = MAX_BYTES, scope: list[str] | None = None) -> DataFrame:
    """The entries that retention keeps."""
    return retention(store, max_runs, max_bytes, scope).where(~F.col("evicted")).drop("place", "running", "evicted")


def with_exit_codes(streams: DataFrame, meta: DataFrame) -> DataFrame:
    """Streams with their runs' exit codes; a run without metadata counts as failed."""
    codes = meta.select(F.col("handle").alias("run_id"), F.col("exit_code").alias("_code"))
    return streams.join(codes, "run_id", "left").withColumn("exit_code", F.coalesce("_code", F.lit(1))).drop("_code")


def show(streams: DataFrame, meta: DataFrame, level: int = render.RAW) -> DataFrame:
    """Stored runs rendered again; the default is their bytes as they were."""
    return pipeline.filter_view(with_exit_codes(streams, meta), level)


def logged(log: DataFrame, store: DataFrame) -> DataFrame:
    """Log records with their store entry, null where the run was evicted."""
    return log.join(store, "handle", "left")


def evicted(log: DataFrame, store: DataFrame) -> DataFrame:
    """Log records whose run is no longer in the store."""
    return log.where(F.col("handle").isNotNull()).join(store, "handle", "left_anti")


def meta_row(exit_code: Column, started: Column) -> Column:
    """Metadata of a run from its columns, as JSON."""
    return F.to_json(F.struct("argv", "cwd", exit_code.alias("exit_code"), rfc3339(started).alias("timestamp"), "duration_ms", F.octet_length("stdout").cast("long").alias("stdout_bytes"), F.octet_length("stderr").cast("long").alias("stderr_bytes")))
