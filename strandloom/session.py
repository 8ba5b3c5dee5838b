"""Session defaults and the lineage cut that survives the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g", temporary: str | None = None) -> SparkSession:
    """SRC-01: a session for one machine; ``memory`` and the folder for ``temporary`` files as Spark takes them."""
    builder = SparkSession.builder.config("spark.local.dir", temporary) if temporary else SparkSession.builder
    spark = (
        builder.master(f"local[{cores}]")
        .appName("strandloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which the cluster names in ``spark.checkpoint.dir``. Only on one
    machine may that setting be missing: then a temporary folder is used."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="strandloom-checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there on."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def by_value(df: DataFrame, column: str) -> DataFrame:
    """``df`` written to the shared folder with a directory per value of ``column``, so that a
    filter on it reads its own files only."""
    path = f"{_shared_folder(df.sparkSession)}/by-{column}-{uuid.uuid4().hex}"
    df.write.partitionBy(column).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for costly work per row.

    Only an input smaller than that is shuffled; a large one has more partitions as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
