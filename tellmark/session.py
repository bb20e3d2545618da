"""Session and shared-folder helpers used by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark share."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; a lazy, column-pruned Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task where windows, joins and groups hold a whole partition.
ROWS = 200_000


def dealt(df: DataFrame, rows: int, *keys: str, each: int = ROWS) -> DataFrame:
    """``df`` hashed by ``keys`` over partitions of about ``each`` rows, ``rows`` in all, at least one for every core.

    Sizes of compressed shuffles say little about what a task's sorts hold, so the
    number of partitions follows the rows. Windows, groups and joins by ``keys`` or
    more columns stay in these partitions.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)), *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, also set as checkpoint folder; a local one stands in only for a local master."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
