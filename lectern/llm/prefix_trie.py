"""Trie of conversation prefixes by collapsing whole sequences.

Conversations with the same turns are collapsed into one weighted sequence first, named by its length and a fingerprint
of all its turns. Only the distinct sequences are laid out into prefixes. Sequences that are a proper prefix of another
one are dropped by an anti-join, which leaves the leaves of the trie; the weighted prefixes are aggregated to its nodes.

A prefix is named by its depth and the sums, over its turns, of four 32-bit parts of a fingerprint of (place, role,
text): sums combine before a shuffle, and running sums go along a conversation in segments, so neither a conversation
nor a group of equal ones has to fit one task. Texts stay in their rows; numbers and fingerprints are all that moves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.ordered import SEGMENT, row_numbers, running_sum
from lectern.llm.arrow import importable, shared_folder

WORD = r"[^\x20\x09-\x0D]+"
#: Parts of the name of a prefix.
PARTS = ["k1", "k2", "k3", "k4"]
NODE = ["depth", *PARTS]
#: Neighbouring ids whose decimals are joined to one text before the texts of an end list are hashed in order.
ID_BLOCK = 8192


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(c, n, f1, f2, words): turns of each conversation numbered from 1, with fingerprints of role and text.

    Turns go by number, null first; turns of one number by role, then by fingerprint of the text; repeated rows are
    turns of their own. Null role or text is empty. Rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").alias("c"), F.col("turn").cast("long").alias("turn"),
        F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), F.xxhash64(F.lit(1), text).alias("text")).alias("order"),
        F.xxhash64(F.lit(1), role, text).alias("f1"), F.xxhash64(F.lit(2), text, role).alias("f2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    bucket = F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(2**62))).cast("long")
    return row_numbers(turns, ["c"], "order", "n", bucket).select("c", "n", "f1", "f2", "words")


def shared_head(c: Column) -> Column:
    """How many turns a conversation takes over from the one it is based on."""
    return (F.crc32(c.cast("string")) % 4).cast("int")


def rebuilt_turns(turns: DataFrame, every: int = 20) -> tuple[DataFrame, DataFrame]:
    """(c) of all conversations and (c, place, f1, f2, words) of all rebuilt ones, places from 1.

    A conversation takes its first turns, `shared_head` of them, from the one whose number is the next multiple of
    `every` towards zero (fewer if that has fewer, none if it does not exist), and then its own turns after that number.
    """
    lengths = turns.groupBy("c").agg(F.max("n").alias("length"))
    heads = turns.where(f"n <= 3 and c % {every} = 0").select(F.col("c").alias("base"), "n", "f1", "f2", "words")
    base = lengths.where(f"c % {every} = 0").select(F.col("c").alias("base"), F.col("length").alias("base_length"))
    all_c = lengths.select("c", (F.col("c") - F.col("c") % every).alias("base"), shared_head(F.col("c")).alias("h"))
    known = all_c.join(base, "base", "left").select("c", "base", "h", F.least("h", F.coalesce("base_length", F.lit(0))).alias("taken"))
    first = known.where("taken > 0").join(heads, "base").where("n <= taken").select("c", F.col("n").alias("place"), "f1", "f2", "words")
    own = turns.where(F.col("n") > shared_head(F.col("c"))).join(known.select("c", "h", "taken"), "c").select(
        "c", (F.col("n") - F.col("h") + F.col("taken")).alias("place"), "f1", "f2", "words")
    return lengths.select("c"), first.unionByName(own)


def _parts() -> list[Column]:
    """Four numbers below 2^32 for a turn at its place; sums of them stay below 2^63 for 2^31 turns."""
    place = F.col("place").cast("long")
    whole = [F.xxhash64(place, "f1", "f2"), F.xxhash64("f2", "f1", place)]
    return [p for w in whole for p in (F.shiftrightunsigned(w, 32), w.bitwiseAND(F.lit(2**32 - 1)))]


def weighted_sequences(all_c: DataFrame, rebuilt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Collapses equal conversations: members (depth, k1..k4, c), and per sequence its least member and their number.

    The depth of a sequence is its length; conversations left without a turn are the empty sequence.
    """
    whole = rebuilt.groupBy("c").agg(F.count("*").alias("depth"), *[F.sum(p).alias(k) for p, k in zip(_parts(), PARTS)])
    members = all_c.join(whole, "c", "left").select("c", *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in NODE])
    return members, members.groupBy(*NODE).agg(F.min("c").alias("rep"), F.count("*").alias("weight"))


def end_lists(members: DataFrame) -> DataFrame:
    """(depth, k1..k4, ends_sha256): digest of the ascending decimal ids of each sequence's members, joined by commas.

    Blocks of neighbouring ids are joined first, in parallel; the digest itself reads the sorted blocks as a stream, so
    no list is held whole.
    """
    blocks = members.groupBy(*NODE, F.floor(F.col("c") / ID_BLOCK).alias("block")).agg(
        F.array_join(F.array_sort(F.collect_list("c")).cast("array<string>"), ",").alias("ids"))
    blocks = importable(blocks).repartition(*NODE).sortWithinPartitions(*NODE, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done = []
            for *now, ids in zip(*[batch.column(k).to_pylist() for k in [*NODE, "ids"]]):
                if now == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = now, hashlib.sha256()
                digest.update(ids.encode())
            yield _digests(done)
        if key is not None:
            yield _digests([(*key, digest.hexdigest())])

    return blocks.mapInArrow(run, "depth long, k1 long, k2 long, k3 long, k4 long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    kinds = [pa.int64()] * 5 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*NODE, "ends_sha256"])


def prefixes(sequences: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """(rep, depth, k1..k4, p1..p4, weight, length, words): every prefix of every distinct sequence, the empty one too.

    p1..p4 name the prefix one turn shorter (null for the empty one); words are those of the last turn.
    """
    shape = sequences.select(F.col("rep").alias("c"), "weight", F.col("depth").alias("length"))
    turns = rebuilt.join(shape, "c").select("c", "place", "words", "weight", "length", *[p.alias(f"own_{k}") for p, k in zip(_parts(), PARTS)])
    sums = running_sum(turns, ["c"], "place", {k: F.col(f"own_{k}") for k in PARTS})
    laid = sums.select(F.col("c").alias("rep"), F.col("place").cast("long").alias("depth"), *PARTS,
                       *[(F.col(k) - F.col(f"own_{k}")).alias(f"p{k[1]}") for k in PARTS], "weight", "length", "words")
    empty = shape.select(F.col("c").alias("rep"), F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(k) for k in PARTS],
                         *[F.lit(None).cast("long").alias(f"p{k[1]}") for k in PARTS], "weight", "length", F.lit(0).cast("long").alias("words"))
    return laid.unionByName(empty)


def prefix_trie(conversations: DataFrame, every: int = 20) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Needs conv_id, turn, role and text; other columns take no part. An empty table has no node, not even a root.
    See `numbered_turns` for nulls, ties and repeated rows; empty texts are turns with no words.
    """
    shared_folder(conversations.sparkSession)
    all_c, rebuilt = rebuilt_turns(numbered_turns(conversations).checkpoint(), every)
    rebuilt = rebuilt.checkpoint()
    members, sequences = weighted_sequences(all_c, rebuilt)
    laid = prefixes(sequences, rebuilt).checkpoint()

    nodes = laid.groupBy(*NODE).agg(F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("words").alias("words"),
                                    *[F.max(f"p{k[1]}").alias(f"p{k[1]}") for k in PARTS]).checkpoint()
    ends = laid.where("depth = length")
    leaves = ends.join(laid.where("depth < length").select(*NODE).distinct(), NODE, "left_anti").select("rep", F.lit(1).alias("leaf"))

    # every node's own saving is laid on its least sequence and summed from there towards the root
    owned = nodes.select(F.col("conv_id").alias("rep"), "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saving"))
    charged = laid.select("rep", *NODE).join(owned, ["rep", "depth"], "left").withColumn("height", -F.col("depth"))
    below = running_sum(charged, ["rep"], "height", {"saved": F.coalesce("saving", F.lit(0))})
    sums = below.join(leaves, "rep", "left").groupBy(*NODE).agg(
        F.sum("saved").alias("saved_tokens"), F.count("leaf").alias("n_leaves"))

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *[F.col(f"p{k[1]}").alias(k) for k in PARTS]).agg(
        F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(k).alias(f"p{k[1]}") for k in PARTS], F.col("conv_id").alias("parent_conv_id"))
    named = nodes.join(parents, ["depth", *[f"p{k[1]}" for k in PARTS]], "left")
    return named.join(sums, NODE).join(children, NODE, "left").join(end_lists(members), NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
