"""Session settings and durable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Most tasks that a table of few splits is dealt to.
SPREAD = 32


def build_session(master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings the operators are tuned for.

    Cluster sizing (shuffle partitions, memory) is left to spark-submit; only
    ``master`` given explicitly (tests, bench) pins anything local.
    """
    builder = SparkSession.builder.appName("lectern")
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of few splits with rows work for every core before heavy row-local steps.

    Only a table whose rows stand in less than ``SPREAD`` / 2 splits is dealt out, on however many
    cores: any other comes back unchanged and is not shuffled. Splits go by the bytes of a file and
    rows by its row groups, so a large file of one row group has its rows in one of many splits;
    that is counted without reading a column.
    """
    cores = min(df.sparkSession.sparkContext.defaultParallelism, SPREAD)
    splits = df.rdd.getNumPartitions()
    if splits * 2 <= cores:
        return df.repartition(cores)
    if df.select(F.spark_partition_id().alias("p")).distinct().count() * 2 > cores:
        return df
    # dealt by the number of the row: a plain repartition would sort the whole table in its one task
    return df.withColumn("_row", F.monotonically_increasing_id()).repartition(max(splits, SPREAD), "_row").drop("_row")


def work_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and working tables.

    It is the one the cluster names in ``spark.checkpoint.dir``; only a local session without it
    (tests on one machine) gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lectern-ckpt-"))
    return context.getCheckpointDir()


def durable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so a lost executor re-reads files."""
    work_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def durable_table(df: DataFrame, *used: DataFrame) -> DataFrame:
    """The same rows, stored as compressed columns beside the checkpoints; readers read only the columns they need.

    The shuffles behind the rows are done with, so the driver's JVM is asked to collect garbage, on which Spark's cleaner
    removes their files; ``used`` are such tables that nothing else reads, removed as well. Unlike a checkpoint, the table
    keeps neither partitioning nor order.
    """
    spark = df.sparkSession
    place = f"{work_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(place)
    jvm = spark.sparkContext._jvm
    for folder in {file.rsplit("/", 1)[0] for table in used for file in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    jvm.System.gc()
    return spark.read.schema(df.schema).parquet(place)
