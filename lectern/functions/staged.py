"""Compute columns once, behind a barrier the optimizer does not look through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a one-row generator.

    Catalyst copies a column's expression into every lambda and every inferred or pushed-down
    filter that uses it (``explode`` of an array infers one), which evaluates heavy array
    expressions again and again, in lambdas even once per element.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))
