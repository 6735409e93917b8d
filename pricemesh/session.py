"""Session helpers: a tuned local session and lineage cutting."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", app: str = "pricemesh", partitions: int = 8, shared: str | None = None) -> SparkSession:
    """A session for tests and the bench; clusters bring their own.  ``shared``: folder for intermediate tables."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = (builder.config("spark.checkpoint.dir", shared) if shared else builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share.

    In this order: the checkpoint folder already set in the session, the one the
    cluster names in ``spark.checkpoint.dir``, a folder below the warehouse.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_pricemesh"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written below ``folder`` as Parquet and read back: the lineage ends here.

    Columns with repeated values take a fraction of the room that a checkpoint's whole rows take.
    """
    path = f"{folder}/{uuid.uuid4().hex}"
    # A copy runs: the shuffles of a frame that a caller still names would be kept with it.
    df.select("*").write.option("compression", "zstd").parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_folder(spark: SparkSession, label: str) -> Iterator[str]:
    """A fresh folder in the shared one, deleted on leaving: nothing read from it may be used any more."""
    folder = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        release(spark)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing uses: it does so when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def filter_here(df: DataFrame, condition: Column) -> DataFrame:
    """``df.filter(condition)``, tested on the columns as they stand.

    A plain filter is moved below the projections that make its columns, and their rules are then
    written out in it once per use: dozens of evaluations a row where one would do.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.explode(F.when(condition, F.array(row))).alias("_row")).select("_row.*")


def spread(rows: DataFrame, *by: str, rows_per_task: int = 10_000) -> DataFrame:
    """The same rows dealt over one task per ``rows_per_task`` of them, by hash of ``by`` or evenly.

    A small compressed file is one task however many rows it holds; text rules cost a third of a
    millisecond a row.  The number of rows is read by a first small job.
    """
    tasks = -(-rows.count() // rows_per_task)
    return rows.repartition(tasks, *by) if tasks > 1 else rows
