"""Incremental forms of the note gate and of the mark log, on file streams.

Both write one folder per micro-batch under its id, so a batch that runs again after a lost
executor or driver replaces its own output and nothing is counted twice.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from lectern.operators import lint
from lectern.operators.course import mark_outcome
from lectern.session import durable_checkpoint
from lectern.sources.writers import current_version, publish, published


def note_verdicts(notes: DataFrame, transcripts: DataFrame | None = None, inventory: DataFrame | None = None,
                  manifest: DataFrame | None = None) -> DataFrame:
    """Verdict per note by all rules for which there is data: of the text, the transcripts and the images."""
    verdicts = lint.gate_summary(notes, lint.lint_notes(notes, transcripts, inventory, manifest))
    return verdicts.join(notes.select("note_id", F.coalesce("template", F.lit("")).alias("template")), "note_id")


_SEEN = "note_id long, row string"
_STATE = "sha string, template string"


def _changed(key, frames, state):
    """Keeps the hash and template last seen of a note; gives its newest version if that differs."""
    last = None
    for rows in frames:  # one version is held at a time, however many arrive together
        rows = pd.concat([last, rows]) if last is not None else rows
        last = rows.sort_values(["version", "sha", "template"], kind="stable").iloc[-1:]
    now = (last["sha"].iloc[0], last["template"].iloc[0])
    if not (state.exists and state.get == now):
        state.update(now)
        yield last[["note_id", "row"]]


def changed_notes(stream: DataFrame, version: str | None = None) -> DataFrame:
    """Of a stream of notes, those whose content or template differs from the last seen; whole rows.

    The state of a note is its last hash and template, so a return to an older content counts as a
    change and no earlier output is read. Of several versions in one batch the last by the column
    ``version`` counts (without one, the greatest hash).
    """
    schema = stream.schema
    keyed = stream.where("note_id IS NOT NULL").select(
        F.col("note_id").cast("long").alias("note_id"), (F.col(version).cast("string") if version else F.lit("")).alias("version"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), F.coalesce("template", F.lit("")).alias("template"), F.to_json(F.struct("*")).alias("row"))
    keyed = keyed.withColumn("version", F.coalesce("version", F.lit("")))
    fresh = keyed.groupBy("note_id").applyInPandasWithState(_changed, _SEEN, _STATE, "update", GroupStateTimeout.NoTimeout)
    return fresh.select(F.from_json("row", schema).alias("r")).select("r.*")


def gate_stream(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, version: str | None = None,
                transcripts: DataFrame | None = None, inventory: DataFrame | None = None, manifest: DataFrame | None = None,
                snapshot_every: int = 100, **trigger) -> StreamingQuery:
    """Re-check arriving notes; a note as last seen is skipped. Verdicts go to ``out/batch=<id>``.

    Every ``snapshot_every`` batches the newest verdict of each note is published under
    ``out-snapshot``, so that readers need the later batches only.
    """
    stream = changed_notes(spark.readStream.schema(schema).parquet(source), version)

    def run(batch: DataFrame, batch_id: int) -> None:
        note_verdicts(durable_checkpoint(batch), transcripts, inventory, manifest).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if batch_id % snapshot_every == snapshot_every - 1:
            rows = _verdict_rows(batch.sparkSession, out).filter(F.col("batch") <= batch_id)
            publish(newest_rows(rows, "note_id"), f"{out}-snapshot", f"{batch_id:012d}")

    return (stream.writeStream.outputMode("update").foreachBatch(run)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def newest_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """The row of the highest batch of each key, with its batch."""
    kept = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "batch").alias("v"))
    return kept.select(*keys, "v.*")


def _verdict_rows(spark: SparkSession, out: str) -> DataFrame:
    """Verdicts with their batch: the published snapshot and the batches after it."""
    rows = spark.read.option("basePath", out).parquet(out)
    done = current_version(spark, f"{out}-snapshot")
    if done is None:
        return rows
    snapshot = published(spark, f"{out}-snapshot")
    return snapshot.unionByName(rows.filter(F.col("batch") > int(done)).select(*snapshot.columns))


def latest_verdicts(spark: SparkSession, out: str) -> DataFrame:
    """Newest verdict per note."""
    return newest_rows(_verdict_rows(spark, out), "note_id").drop("batch")


def latest_marks(events: DataFrame) -> DataFrame:
    """Latest valid mark per item; works on a batch and, in update mode, on a stream."""
    valid = mark_outcome(events).filter("error IS NULL")
    last = F.max_by(F.struct("state", "ts", "note", "reason"), F.struct("ts", "event_id"))
    return valid.groupBy("course_id", "idx").agg(last.alias("m"))


def marks_stream(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Mark events to item states: changed items of each batch go to ``out/batch=<id>``."""
    stream = latest_marks(spark.readStream.schema(schema).parquet(source)).select("course_id", "idx", "m.*")

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (stream.writeStream.outputMode("update").foreachBatch(run)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def marks_snapshot(spark: SparkSession, out: str) -> DataFrame:
    """Current state per item from the batches written so far."""
    return newest_rows(spark.read.option("basePath", out).parquet(out), "course_id", "idx").drop("batch")
