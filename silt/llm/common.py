"""Shared plumbing: shared-folder tables, table loading and bounded Arrow batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from silt.session import python_workers

#: Rows in an Arrow batch sent to Python; whole long texts stay well under executor memory.
BATCH_ROWS = 1024
#: Makes Spark remove an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark (any store Spark can reach)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where set.

    Where it is not, one machine alone (tests) gets a folder in the warehouse; on a cluster
    executors could not see what others wrote there, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/silt-shared"
    return found.rstrip("/")


#: Paths of all steps written by this process, in order.
_written: list[str] = []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, so a lost executor costs
    a reread of its splits and never a recomputation of the plan behind them. The
    step's own shuffle files go as soon as the table is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._silt_path = path
    _written.append(path)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing will read again."""
    for df in tables:
        _remove(df.sparkSession, df._silt_path)


def _remove(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    if name in _written:
        _written.remove(name)


def materialize_only(stage, label: str, spark: SparkSession) -> DataFrame:
    """Write what ``stage()`` returns, and remove all steps that it wrote on the way."""
    before = set(_written)
    out = materialize(stage(), label)
    for path in [p for p in _written if p not in before and p != out._silt_path]:
        _remove(spark, path)
    return out


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Make Python workers ready: this package importable, and Arrow batches small.

    Batches stay small enough even where they hold only very long texts. On a cluster
    without a common file system, ship the package with --py-files.
    """
    python_workers(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fresh(df: DataFrame, *names: str) -> None:
    """Raise early if a needed column is missing; others are simply not read."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")
