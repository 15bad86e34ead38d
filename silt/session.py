"""Session helpers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def python_workers(spark: SparkSession) -> None:
    """Make this package importable in Python workers that share a file system.

    On a cluster without one, ship the package with --py-files.
    """
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "")
    if ROOT not in paths.split(":"):
        environment["PYTHONPATH"] = f"{ROOT}:{paths}".rstrip(":")


def local_session(name: str = "silt", cpus: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    base = {
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cpus),
        # small tables, heavy work on each row: let every core have a part of them
        "spark.sql.files.maxPartitionBytes": "4m",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    }
    spark = builder.config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
