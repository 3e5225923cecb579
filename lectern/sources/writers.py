"""Writers: published versions, partition replacement, chunk files and ordered Markdown documents.

A published table is a folder of versions and one pointer that names the current one. A new
version is written whole before the pointer moves, so readers see the old rows until then, and a
driver lost in between leaves the old version in place; writing again starts a new version.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

POINTER = "CURRENT"


def _point(spark: SparkSession, root: str, version: str) -> None:
    """Moves the pointer in one step: a small file is written aside and renamed over it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    aside, target = path(f"{root}/.{POINTER}-{uuid.uuid4().hex}"), path(f"{root}/{POINTER}")
    out = aside.getFileSystem(conf).create(aside, True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), conf).rename(aside, target, options)


def current_version(spark: SparkSession, root: str) -> str | None:
    """Name of the published version; None if nothing was published yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.text(f"{root}/{POINTER}").first()[0]


def publish(df: DataFrame, root: str, version: str | None = None) -> str:
    """Writes a new version of a table and makes it the current one; returns its name.

    Work that can run again (a repeated stream batch) passes its own name and replaces its output.
    """
    version = version or uuid.uuid4().hex
    df.write.mode("overwrite").parquet(f"{root}/version={version}")
    _point(df.sparkSession, root, version)
    return version


def published(spark: SparkSession, root: str) -> DataFrame:
    """The current version of a published table."""
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"nothing is published under {root}")
    return spark.read.parquet(f"{root}/version={version}")


def publish_partitions(df: DataFrame, root: str, keys: Sequence[str] = ("video_id", "page")) -> None:
    """Replaces the partitions that ``df`` holds in a published table; all others stay as they are.

    New partitions are written beside the old ones. A published list tells which writing holds each
    partition; readers of :func:`published_partitions` change over when that list does.
    """
    spark, keys, write = df.sparkSession, list(keys), uuid.uuid4().hex
    df.write.partitionBy(*keys).parquet(f"{root}/data/write={write}")
    fresh = spark.read.parquet(f"{root}/data/write={write}").select(*keys).distinct().withColumn("write", F.lit(write))
    if current_version(spark, f"{root}/list"):
        fresh = fresh.unionByName(published(spark, f"{root}/list").join(fresh, keys, "left_anti"))
    publish(fresh, f"{root}/list")


def published_partitions(spark: SparkSession, root: str) -> DataFrame:
    """All current partitions of a table written by :func:`publish_partitions`."""
    current = published(spark, f"{root}/list")
    keys = [c for c in current.columns if c != "write"]
    data = spark.read.option("basePath", f"{root}/data").parquet(f"{root}/data")
    match = [data[k].eqNullSafe(current[k]) for k in keys]
    return data.join(current, [data["write"] == current["write"], *match], "left_semi").drop("write")


def write_partitions(df: DataFrame, path: str, keys: Sequence[str] = ("video_id", "page")) -> None:
    """Replace only the partitions that ``df`` holds, in place: readers must wait (see :func:`publish_partitions`)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*keys).parquet(path))


def chunk_files(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add the file name of each chunk."""
    number = F.lpad(F.col("chunk_no").cast("string"), F.greatest(F.lit(2), F.length(F.col("chunk_no").cast("string"))), F.lit("0"))
    return chunks.select(key, "chunk_no", F.concat(F.col(key).cast("string"), F.lit(".chunk-"), number, F.lit(".txt")).alias("file"), "chars", "text")


def write_chunks(chunks: DataFrame, path: str, key: str = "doc_id", buckets: int = 256) -> None:
    """Chunk table, partitioned by a bucket of the document (one folder per document would not scale)."""
    rows = chunk_files(chunks, key).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    rows.write.mode("overwrite").partitionBy("bucket").parquet(path)


def report_documents(lines: DataFrame, doc: str, order: Sequence[str]) -> DataFrame:
    """One text per document from its ordered lines, for documents that fit a cell."""
    keyed = lines.select(doc, F.struct(*order).alias("_o"), "line")
    return keyed.groupBy(doc).agg(F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY _o)").alias("text"))


def write_report_lines(lines: DataFrame, path: str, doc: str, order: Sequence[str]) -> None:
    """Lines sorted and range-partitioned by document and order: reading the files in order gives
    each document, and a huge document spreads over many tasks."""
    ranged = lines.repartitionByRange(doc, *order).sortWithinPartitions(doc, *order)
    ranged.write.mode("overwrite").parquet(path)


def publish_report_lines(lines: DataFrame, root: str, doc: str, order: Sequence[str]) -> str:
    """Publishes a new version of ordered document lines (see :func:`write_report_lines`)."""
    return publish(lines.repartitionByRange(doc, *order).sortWithinPartitions(doc, *order), root)
