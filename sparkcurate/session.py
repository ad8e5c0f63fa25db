"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "sparkcurate") -> SparkSession:
    """A local session for tests and benchmarks. On a cluster use the session you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # Call sites of Columns are only for error messages and cost a round trip each.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: whatever ``spark.checkpoint.dir`` names.

    Where that is unset it lies in the session's warehouse, which every session has. On a cluster that
    must be a folder that all machines share; one of the local file system is refused, because each
    executor would write to its own disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    if not spark.sparkContext.master.startswith("local") and _file_system(spark, folder).getScheme() == "file":
        raise ValueError(f"{folder} is local to a machine: set spark.checkpoint.dir to a folder that all share")
    return folder


def _file_system(spark: SparkSession, path: str):
    context = spark.sparkContext
    return context._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(context._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever file system the path names."""
    return _file_system(spark, path).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))


def modified_millis(spark: SparkSession, path: str) -> int:
    """When a file was last modified, in milliseconds since 1970."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return _file_system(spark, path).getFileStatus(where).getModificationTime()


def application_folder(spark: SparkSession) -> str:
    """The application's own part of :func:`scratch_dir`; it is deleted when the driver ends."""
    context = spark.sparkContext
    folder = f"{scratch_dir(spark)}/{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives Catalyst a real size for the
    result, so that later joins may choose a broadcast by themselves when it is small.
    Tables of one application lie in one folder, which goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{application_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
