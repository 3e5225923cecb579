"""Quality classifier: a factorisation machine over hashed words, structure statistics and length.

The pairwise part is scored in linear time by the identity
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 * sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.arrow import bounded_batches, text_buffer, with_columns
from lectern.llm.words import SPACED, Words, mix

WORD_BUCKETS = 1 << 14
#: Quantile bins of each structure statistic.
BINS = 8
STATISTICS = ("words", "chars_per_word", "upper", "digits", "marks", "bangs", "pipes", "symbols", "beyond_ascii",
              "lines", "distinct_words", "repeats", "distinct_pairs", "words_per_line", "shouted_ends", "longest_word")
#: Most labelled texts that a model is fitted on; they are the first by a hash of their id.
FIT_ROWS = 6000


_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#$%&*@^~", np.uint8))


def _shares(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return np.diff(total[offsets])


def _distinct(text: np.ndarray, h: np.ndarray, texts: int) -> np.ndarray:
    """Number of different values in each text (44 bits of a value, as only a share is made of it)."""
    if not len(h):
        return np.zeros(texts)
    key = np.sort((text.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    new = np.r_[True, key[1:] != key[:-1]]
    return np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=texts)


def featurise(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets of all texts, the end of each text in them, and a row of structure statistics for each text."""
    data, offsets = text_buffer(column)
    texts = len(offsets) - 1
    words = Words(data, offsets, SPACED, lower=True)
    size, count = np.maximum(1, np.diff(offsets)), words.counts
    some = np.maximum(1, count)
    accent = np.zeros(len(data), dtype=bool)
    accent[1:] = (data[:-1] == 0xC3) & (data[1:] < 0x9F)
    of = words.texts()
    same = np.zeros(len(words), dtype=bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (of[1:] == of[:-1])
    pair = mix(words.hash[:-1] * np.uint64(3) + words.hash[1:]) if len(words) else words.hash
    inner = of[1:] == of[:-1]
    lines = _shares(data == 10, offsets) + 1
    longest = np.zeros(texts)
    filled = np.flatnonzero(count)
    if len(filled):
        longest[filled] = np.maximum.reduceat(words.length, words.first[:-1][filled])
    last = data[words.end - 1] if len(words) else data
    statistics = np.column_stack([
        np.log1p(count), size / some, _shares(((data > 64) & (data < 91)) | accent, offsets) / size,
        _shares((data > 47) & (data < 58), offsets) / size,
        _shares(((data > 32) & (data < 48)) | ((data > 57) & (data < 65)), offsets) / size,
        _shares(data == 33, offsets) / some, _shares(data == 124, offsets) / some,
        _shares(_SYMBOL[data], offsets) / some,
        _shares(data > 127, offsets) / size, np.log1p(lines), _distinct(of, words.hash, texts) / some,
        np.bincount(of[same], minlength=texts) / some, _distinct(of[1:][inner], pair[inner], texts) / some,
        count / lines, np.bincount(of[last == 33], minlength=texts) / some, np.log1p(longest)])
    key = np.sort(of * WORD_BUCKETS + (words.hash % np.uint64(WORD_BUCKETS)).astype(np.int64))
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return (key % WORD_BUCKETS).astype(np.int32), np.cumsum(np.bincount(key // WORD_BUCKETS, minlength=texts)), statistics


@dataclass
class Model:
    edges: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, buckets: np.ndarray, ends: np.ndarray, statistics: np.ndarray) -> np.ndarray:
        columns, values, starts = design(buckets, ends, statistics, self.edges)
        linear = np.add.reduceat(self.weights[columns] * values, starts)
        v = self.factors[columns] * values[:, None]
        total, squares = np.add.reduceat(v, starts, axis=0), np.add.reduceat(v * v, starts, axis=0)
        return self.bias + linear + 0.5 * (total * total - squares).sum(axis=1)


def design(buckets, ends, statistics, edges):
    """Sparse rows: the words of a text (together of length one), and one bin of each statistic."""
    texts, fields = statistics.shape
    counts = np.diff(ends, prepend=0)
    binned = np.empty((texts, fields), dtype=np.int64)
    for j in range(fields):
        binned[:, j] = WORD_BUCKETS + j * BINS + np.searchsorted(edges[j], statistics[:, j], side="right")
    starts = ends - counts + fields * np.arange(texts)
    columns = np.empty(len(buckets) + binned.size, dtype=np.int64)
    values = np.empty(len(columns))
    place = (starts[:, None] + np.arange(fields)).ravel()
    columns[place], values[place] = binned.ravel(), 1 / np.sqrt(fields)
    rest = np.ones(len(columns), dtype=bool)
    rest[place] = False
    columns[rest], values[rest] = buckets, np.repeat(1 / np.sqrt(np.maximum(1, counts)), counts)
    return columns, values, starts


def fit(buckets: np.ndarray, ends: np.ndarray, statistics: np.ndarray, labels: np.ndarray, rank: int = 4,
        steps: int = 700, rate: float = 0.08, decay: float = 3e-4, seed: int = 11) -> Model:
    """Logistic loss by Adagrad on small batches; rows in the given order, so equal inputs give equal models."""
    rng = np.random.Generator(np.random.PCG64(seed))
    size = WORD_BUCKETS + len(STATISTICS) * BINS
    edges = np.quantile(statistics, np.arange(1, BINS) / BINS, axis=0).T.copy()
    model = Model(edges, float(np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3))), np.zeros(size),
                  rng.normal(0, 0.05, (size, rank)))
    seen_w, seen_v, seen_b = np.full(size, 1e-2), np.full((size, rank), 1e-2), 1e-2
    heads = ends - np.diff(ends, prepend=0)
    for _ in range(max(1, round(steps * 128 / len(labels)))):
        shuffled = rng.permutation(len(labels))
        for at in range(0, len(labels), 128):
            rows = shuffled[at:at + 128]
            counts = ends[rows] - heads[rows]
            picked = np.repeat(heads[rows] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            columns, values, starts = design(buckets[picked], np.cumsum(counts), statistics[rows], edges)
            v = model.factors[columns] * values[:, None]
            total = np.add.reduceat(v, starts, axis=0)
            logit = model.bias + np.add.reduceat(model.weights[columns] * values, starts) + 0.5 * (
                (total * total).sum(1) - np.add.reduceat((v * v).sum(1), starts))
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[rows]) / len(rows)
            each = np.repeat(np.arange(len(rows)), np.diff(np.r_[starts, len(columns)]))
            push = error[each] * values
            g_w = np.bincount(columns, push, minlength=size) + decay * model.weights / len(rows)
            seen_w += g_w * g_w
            model.weights -= rate * g_w / np.sqrt(seen_w)
            inner = total[each] - v
            for f in range(rank):
                g = np.bincount(columns, push * inner[:, f], minlength=size) + decay * model.factors[:, f] / len(rows)
                seen_v[:, f] += g * g
                model.factors[:, f] -= rate * g / np.sqrt(seen_v[:, f])
            seen_b += error.sum() ** 2
            model.bias -= rate * error.sum() / np.sqrt(seen_b)
    return model


_FEATURES = T.StructType([T.StructField("buckets", T.ArrayType(T.IntegerType())),
                          T.StructField("statistics", T.ArrayType(T.DoubleType()))])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id",
          rows: int = FIT_ROWS) -> Model:
    """Fits on the texts of at most `rows` labels, the first by a hash of their key (a documented bound).

    Rows whose key or label is null take no part. Without labelled texts the model gives every text 0.5.
    """
    rank = [F.xxhash64(F.col(key).cast("string")), F.col(key), F.col(label)]
    picked = labels.where(F.col(label).isNotNull()).select(key, label).orderBy(*rank).limit(rows)
    texts = docs.select(key, text).join(F.broadcast(picked), key)

    def features(column: pa.Array) -> list[pa.Array]:
        buckets, ends, statistics = featurise(column)
        return [pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(buckets)),
                pa.array(list(statistics), pa.list_(pa.float64()))]

    made = with_columns(bounded_batches(texts), [text], _FEATURES, features).drop(text)
    got = made.orderBy(*rank, "buckets", "statistics").limit(rows).collect()
    if not got:
        size = WORD_BUCKETS + len(STATISTICS) * BINS
        return Model(np.zeros((len(STATISTICS), BINS - 1)), 0.0, np.zeros(size), np.zeros((size, 1)))
    buckets = np.array([b for r in got for b in r["buckets"]], dtype=np.int64)
    ends = np.cumsum([len(r["buckets"]) for r in got])
    return fit(buckets, ends, np.array([r["statistics"] for r in got]), np.array([float(r[label]) for r in got]))


def score(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Adds the probability of label 1 from the whole text alone; null and empty texts are scored as texts without words."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def step(texts: pa.Array) -> list[pa.Array]:
        logit = shared.value.logits(*featurise(texts))
        return [pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))]

    return with_columns(bounded_batches(df), [text], T.StructType([T.StructField(name, T.DoubleType())]), step)
