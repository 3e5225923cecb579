"""Ordered computations per key that survive a hot key.

A plain ``OVER (PARTITION BY key ORDER BY ord)`` sends one key to one task. Here every key
is first cut into segments of the ordinal. Windows run inside ``(key, segment)``; one row
per segment then carries the state across the cuts. The carry table has 1/``SEGMENT`` of
the rows, so a key with a third of a huge table still spreads over all tasks, and the
join back reuses the ``(key, segment)`` partitioning of the window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lectern.session import durable_table

SEGMENT = 65536
SEG = "_seg"


def with_segment(df: DataFrame, order: str, size: int = SEGMENT) -> DataFrame:
    return df.withColumn(SEG, F.floor(F.col(order) / F.lit(size)).cast("bigint"))


def _join_carry(df: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(carry, [*keys, SEG], "left")


def lag_row(
    df: DataFrame, keys: Sequence[str], order: str, columns: Mapping[str, str],
    size: int = SEGMENT,
) -> DataFrame:
    """Previous row's values in ``order``: ``columns`` maps new name to source column."""
    seg = with_segment(df, order, size)
    inner = W.partitionBy(*keys, SEG).orderBy(order)
    across = W.partitionBy(*keys).orderBy(SEG)
    packed = F.struct(*[F.col(src).alias(new) for new, src in columns.items()])
    carry = (
        seg.groupBy(*keys, SEG)
        .agg(F.max_by(packed, F.col(order)).alias("_last"))
        .select(*keys, SEG, F.lag("_last").over(across).alias("_carry"))
    )
    out = _join_carry(seg, carry, keys)
    out = out.withColumn("_prev", F.coalesce(F.lag(packed).over(inner), F.col("_carry")))
    for new in columns:
        out = out.withColumn(new, F.col("_prev").getField(new))
    return out.drop("_prev", "_carry", SEG)


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, columns: Mapping[str, Column],
    size: int = SEGMENT,
) -> DataFrame:
    """Inclusive running sums; ``columns`` maps new name to the summed expression."""
    seg = with_segment(df, order, size)
    inner = W.partitionBy(*keys, SEG).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy(SEG).rowsBetween(W.unboundedPreceding, -1)
    carry = seg.groupBy(*keys, SEG).agg(
        *[F.sum(expr).alias(f"_c_{new}") for new, expr in columns.items()]
    )
    carry = carry.select(
        *keys, SEG,
        *[F.coalesce(F.sum(f"_c_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in columns],
    )
    out = _join_carry(seg, carry, keys)
    for new, expr in columns.items():
        out = out.withColumn(new, F.sum(expr).over(inner) + F.col(f"_b_{new}"))
    return out.drop(SEG, *[f"_b_{n}" for n in columns])


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: str, name: str, bucket: Column,
) -> DataFrame:
    """Dense 1-based numbers in ``order``; ``bucket`` must not decrease along ``order``."""
    seg = df.withColumn(SEG, bucket)
    inner = W.partitionBy(*keys, SEG).orderBy(order)
    before = W.partitionBy(*keys).orderBy(SEG).rowsBetween(W.unboundedPreceding, -1)
    carry = seg.groupBy(*keys, SEG).agg(F.count("*").alias("_n")).select(
        *keys, SEG, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    out = _join_carry(seg, carry, keys)
    return out.withColumn(
        name, (F.row_number().over(inner) + F.col("_base")).cast("int")
    ).drop("_base", SEG)


def sorted_numbers(df: DataFrame, key: str, order: str, name: str, total: str | None = None) -> DataFrame:
    """1-based numbers of the rows of each ``key`` in ``order``, without gathering a key; ``total`` adds the key's rows.

    Rows are range-sorted over the cluster and stored once; a row's number is its place in its
    partition plus the rows of its key in earlier partitions, known from one row per key and
    partition. Equal orders get distinct numbers.
    """
    ranged = df.repartitionByRange(key, order).sortWithinPartitions(key, order)
    rows = durable_table(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    every = W.partitionBy(key)
    before = every.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # stored, so that its size is known: a small one is sent to the rows, which are then not shuffled again
    starts = durable_table(rows.groupBy(key, "_part").agg(F.min("_at").alias("_start"), F.count("*").alias("_n")).select(
        key, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_start") + 1).alias("_shift"),
        *([F.sum("_n").over(every).alias(total)] if total else [])))
    return rows.join(starts, [key, "_part"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def number_lines(blocks: Sequence[DataFrame], key: str) -> DataFrame:
    """Documents ``(key, line_no, line)`` from blocks ``(key, o, line)`` with a common sort key ``o``.

    A document never ends with an empty line.
    """
    lines = sorted_numbers(reduce(DataFrame.unionByName, blocks), key, "o", "line_no", "_last")
    return lines.filter("line_no < _last OR line <> ''").select(key, "line_no", "line")
