"""Approximate nearest neighbours by a permutation index.

Each vector is represented by its nearest pivots, in order, and posted under them in inverted files; the files are
sharded by vector. A query goes through the files of its own pivots and adds up how far each vector's pivot order is
from its own (the footrule distance, a pivot that is not posted counting as the first place beyond the order); the
nearest by footrule are ranked again by the exact inner product on the original vectors.

For the inner product, vectors get one more coordinate that brings all to one length, so that the order by angle in
the longer space is the order by inner product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.arrow import importable

PIVOTS = 256
#: Vectors that pivots are chosen from (a bounded sample, the first by a hash of their id), and the cosine to a chosen
#: pivot from which on a vector is passed over, so that a crowd of like vectors gives one pivot.
SAMPLE, ALIKE = 2048, 0.8
#: Pivots that a vector is posted under.
ORDER = 64
#: Vectors of one shard and queries of one block, on average: both bound what a task holds.
SHARD, BLOCK = 8192, 1024
#: Share of a shard that is ranked again, and the least number.
SHARE, LEAST = 0.2, 400
#: Vectors whose footrule is at most this share of the greatest are ranked again as well, however many they are:
#: a crowd of almost equal vectors is then not cut.
CROWD = 0.12


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _order(x: np.ndarray, pivots: np.ndarray, order: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first, ties to the earlier pivot."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :order].astype(np.int32)


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """The first vectors of the sample that are unlike all chosen before; too few are filled up in order."""
    unit = _unit(sample)
    chosen: list[int] = []
    for i in range(len(unit)):
        if len(chosen) < pivots and (not chosen or (unit[chosen] @ unit[i]).max() < ALIKE):
            chosen.append(i)
    passed = sorted(set(range(len(unit))) - set(chosen))
    return unit[chosen + passed[:pivots - len(chosen)]]


def search_shard(ids, vectors, longer, query_ids, queries, pivots, k, order, share=SHARE, least=LEAST, crowd=CROWD):
    """(query, vector, score) of the k best of a shard for each query: inverted files, footrule, exact products."""
    count, width = len(ids), len(pivots)
    posted = _order(_unit(longer), pivots, order)
    flat = posted.ravel()
    by_pivot = np.argsort(flat, kind="stable")
    bounds = np.searchsorted(flat[by_pivot], np.arange(width + 1))
    who, place = by_pivot // order, (by_pivot % order).astype(np.uint16)
    wanted = min(count, max(least, int(np.ceil(share * count))))
    asked = _order(_unit(np.hstack([queries, np.zeros((len(queries), 1))])), pivots, order)
    lengths, steps = np.diff(bounds), np.arange(order, dtype=np.uint16)
    vectors_of, places = np.split(who, bounds[1:-1]), np.split(place, bounds[1:-1])
    greatest = order * (order + 1) // 2
    out_q, out_v, out_s = [], [], []
    for q in range(len(queries)):
        # without a common pivot two orders are farthest apart; one at places i and j brings them 2 * (order - max(i, j)) nearer
        files = asked[q]
        posted_place = np.concatenate([places[p] for p in files])
        gain = order - np.maximum(np.repeat(steps, lengths[files]), posted_place)
        near = np.bincount(np.concatenate([vectors_of[p] for p in files]), gain, minlength=count)
        if wanted < count:
            least_near = np.partition(near, count - wanted)[count - wanted]
            chosen = np.flatnonzero(near >= min(least_near, (1 - crowd) * greatest))
        else:
            chosen = np.arange(count)
        chosen = chosen[ids[chosen] != query_ids[q]]
        score = (vectors[chosen] * queries[q]).sum(axis=1)
        if len(chosen) > k:
            top = score >= np.partition(score, len(score) - k)[len(score) - k]
            chosen, score = chosen[top], score[top]
        best = np.lexsort((ids[chosen], -score))[:k]
        out_q.append(np.full(len(best), query_ids[q]))
        out_v.append(ids[chosen[best]])
        out_s.append(score[best])
    return [np.concatenate(x) if x else np.zeros(0) for x in (out_q, out_v, out_s)]


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().astype(np.float64).reshape(rows, -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding",
           pivots: int = PIVOTS, order: int = ORDER) -> DataFrame:
    """query_id, rank (from 1), the found key and score: the k nearest found of each query by inner product.

    Ties go to the smaller key. Vectors that are null, zero, or hold null or non-finite components take no part, on
    either side, nor do null keys; a row is not its own neighbour (rows are told apart by key). Vectors of another
    length than the queries are an error of numpy. Rows repeated under one key count once.
    """
    def usable(df: DataFrame) -> DataFrame:
        value = F.transform(F.col(vector), lambda x: x.cast("double"))
        good = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        found = df.select(F.col(key).cast("long").alias("id"), value.alias("v"), good.alias("good"))
        return (found.where("id is not null and good and exists(v, x -> x <> 0)").drop("good")
                .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))))

    # equal rows of one key come from repeated rows; the least vector stands for different ones
    base = usable(importable(vectors))
    asked = usable(queries)
    size = base.agg(F.count("*").alias("n"), F.max("norm").alias("top")).first()
    sample = base.orderBy(F.xxhash64("id"), "id", "v").limit(max(pivots, SAMPLE)).collect()
    empty = "query_id long, rank int, " + f"`{key}` long, score double"
    if not sample:
        return vectors.sparkSession.createDataFrame([], empty)
    shards = -(-size["n"] // SHARD)
    n_asked = asked.count()
    blocks = max(1, -(-n_asked // BLOCK))
    top = size["top"]
    raw = np.array([r["v"] for r in sample])
    pivot = choose_pivots(np.hstack([raw, np.sqrt(np.maximum(0, top**2 - (raw * raw).sum(1)))[:, None]]), pivots)
    order = min(order, len(pivot))
    shared = vectors.sparkSession.sparkContext.broadcast(pivot)

    def meet(key_row, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, x = left["id"].to_numpy(), left["v"]
        if not len(ids) or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x, q = _matrix(x, len(ids)), _matrix(right["v"], right.num_rows)
        first = np.lexsort((*x.T[::-1], ids))
        first = first[np.r_[True, ids[first][1:] != ids[first][:-1]]]
        ids, x = ids[first], x[first]
        longer = np.hstack([x, np.sqrt(np.maximum(0, top**2 - (x * x).sum(1)))[:, None]])
        found = search_shard(ids, x, longer, right["id"].to_numpy(), q, shared.value, k, order)
        return pa.table({"query_id": pa.array(found[0].astype(np.int64)), "id": pa.array(found[1].astype(np.int64)),
                         "score": pa.array(found[2].astype(np.float64))})

    # every shard meets every block of the stated queries, each pair in a task of its own
    left = base.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"),
                       F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = asked.dropDuplicates(["id"]).select(
        "id", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(int(shards) - 1))).alias("shard"))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(
        meet, T.StructType([T.StructField("query_id", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())]))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(key), "score"))
