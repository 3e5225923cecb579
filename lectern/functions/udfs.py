"""The few Arrow functions: semantics Spark has no built-in for.

Each one is a small vector helper; callers keep partitioning, joins and grouping in Spark.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F, types as T


def _fold(name: str | None) -> str | None:
    if name is None:
        return None
    return "".join(unicodedata.normalize("NFKC", name).split()).casefold()


def _per_distinct(values: pa.Array, fold) -> pa.Array:
    """``fold`` of each value, computed once per distinct value of the batch."""
    coded = pc.dictionary_encode(values)
    return pa.array([fold(v) for v in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


@F.arrow_udf(T.StringType())
def fold_name(names: pa.Array) -> pa.Array:
    """Identity of a concept name: NFKC, no white space, case folded."""
    return _per_distinct(names, _fold)


@F.arrow_udf(T.StringType())
def case_fold(values: pa.Array) -> pa.Array:
    """Full Unicode case folding."""
    return _per_distinct(values, str.casefold)
