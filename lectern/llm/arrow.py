"""Arrow steps inside Spark tasks: bounded slices of a batch, added columns, text buffers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of text that one step works on at once; a single longer text is a step of its own.
SLICE_BYTES = 2_000_000


_BYTES = (pa.binary(), pa.large_binary())
_SIZED = (pa.string(), pa.large_string(), *_BYTES)
_ROOT = str(Path(__file__).resolve().parents[2])


def importable(df: DataFrame) -> DataFrame:
    """Lets Python workers import this package from where the driver has it (a cluster may also have it installed)."""
    environment = df.sparkSession.sparkContext.environment
    paths = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables: spark.checkpoint.dir, which a cluster must set.

    Only a local session without that setting, as in tests, gets a folder of its own.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lectern-checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def remove_table(spark: SparkSession, path: str) -> None:
    """Removes a working table that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again.

    A task has a Python worker for each Arrow step of its stage; steps with a table between them take turns in one worker.
    """
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files and checkpoints that nothing refers to any more.

    Its cleaner acts when the driver collects garbage, which a driver with little to do may not for a long time.
    """
    spark.sparkContext._jvm.System.gc()


def slices(lengths: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) with about `limit` bytes each, in order, covering all rows."""
    if not len(lengths):
        return
    step = (np.cumsum(lengths) - lengths) // limit
    cuts = np.flatnonzero(np.diff(step)) + 1
    yield from zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(lengths)].tolist())


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and the offset of each row in them (one more than rows); nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=column.offset + len(column) + 1)[column.offset:]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(at), dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]], at - at[0]


def byte_lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each row of a string or binary column; nulls have none."""
    if column.type in _BYTES:
        return pc.binary_length(column).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    return np.diff(text_buffer(column)[1])


def with_columns(df: DataFrame, inputs: list[str], outputs: T.StructType,
                 step: Callable[..., list[pa.Array]]) -> DataFrame:
    """Adds columns that `step` computes from the input columns, a bounded slice of rows at a time.

    Other columns pass through; an existing column named like an output is replaced. The first input is the
    text, or the bytes, that bounds a slice.
    """
    names = {f.name.lower() for f in outputs}
    kept = [f for f in df.schema if f.name.lower() not in names]
    extra = [c for c in inputs if c.lower() in names]
    carried = df.select(*[df[f"`{f.name}`"] for f in kept], *[df[f"`{c}`"].alias(f"__in_{c}") for c in extra])
    where = {c: f"__in_{c}" if c in extra else c for c in inputs}
    kept_names, out_names = [f.name for f in kept], outputs.fieldNames()

    def run(batches):
        for batch in batches:
            columns = [batch.column(where[c]) for c in inputs]
            text = columns[0]
            lengths = byte_lengths(text) if text.type in _SIZED else np.full(len(text), 1024)
            for a, b in slices(lengths):
                made = step(*[c.slice(a, b - a) for c in columns])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(n).slice(a, b - a) for n in kept_names] + made, names=kept_names + out_names)

    return importable(carried).mapInArrow(run, T.StructType(kept + list(outputs)))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Work that runs inside gets Arrow batches of so many rows; the session's own setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bounded_batches(df: DataFrame, rows: int = 2000) -> DataFrame:
    """Keeps Arrow batches of long texts small, unless the session has its own setting."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10000:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    return df
