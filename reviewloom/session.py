"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "6g", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine; on a cluster use spark-submit's own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("reviewloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``; make one only in local mode, where it is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that every executor shares")
        folder = tempfile.mkdtemp(prefix="reviewloom-checkpoint-", dir=os.environ.get("TMPDIR"))
    context.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder, so that what follows survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path of that name in the shared folder, for files that are written and read within one query."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}-{name}"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, spread over the cores where it lies in so few pieces that more than half of them would idle.

    A table of many files or row groups is read as it lies, without a shuffle.
    """
    table, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() * 2 <= cores else table


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once a context, so that Python workers find it wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_reviewloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="reviewloom-"), "reviewloom"), "zip", root, "reviewloom")
    context.addPyFile(archive)
    context._reviewloom_shipped = True
