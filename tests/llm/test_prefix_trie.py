"""Trie of conversation prefixes against a plain trie in Python, and on odd rows."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from lectern.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(t)] for c, t in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    nodes = {}
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    children = {}
    for s in nodes:
        if s:
            children.setdefault(s[:-1], []).append(s)

    def below(s):
        stack = [s]
        while stack:
            n = stack.pop()
            yield n
            stack += children.get(n, [])

    for s, members in nodes.items():
        subtree = list(below(s))
        ends = ",".join(str(c) for c in sorted(members) if rebuilt[c] == s)
        yield (min(members), len(s), min(nodes[s[:-1]]) if s else None, len(members), len(children.get(s, [])),
               sum(n not in children for n in subtree),
               sum((len(nodes[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in subtree if n),
               hashlib.sha256(ends.encode()).hexdigest())


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = prefix_trie.prefix_trie(df.withColumn("depth", F.lit("x")).withColumn("rep", F.lit(1)).withColumn("n", F.lit(2)))
    assert tuple(got.columns) == COLUMNS
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain(rows), key=key)


def test_random_conversations(spark):
    rng = random.Random(7)
    rows = [(c, t if t else None, rng.choice(["user", "assistant"]), rng.choice(["a b c", "hi", "", "é x y", "z\n\nw"]))
            for c in range(-45, 130) if rng.random() < 0.9 for t in range(rng.randint(1, 6))]
    check(spark, rows)


def test_copies_long_conversations_and_odd_rows(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(400, 460) for t in range(1, 5)]
    rows += [(480, t, "user", "again") for t in range(300)] + [(481, t, "user", "again") for t in range(150)]
    rows += [(None, 1, "user", "no conversation"), (7, 1, None, None), (7, None, "user", "first"), (8, 3, "b", "tie"), (8, 3, "a", "tie")]
    rows += [(9, 1, "user", "x " * 50_000), (10, 2, "user", "same"), (10, 2, "user", "same"), (2**40 + 3, 1, "user", "far")]
    check(spark, rows)


def test_segments_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "SEGMENT", 2)
    monkeypatch.setattr(prefix_trie, "running_sum", lambda *a: prefix_trie_running(*a))
    check(spark, [(c, t, "user", str(t % 3)) for c in range(40) for t in range(1, 12)])


def prefix_trie_running(df, keys, order, columns):
    from lectern.functions.ordered import running_sum

    return running_sum(df, keys, order, columns, 3)


def test_no_conversations(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []
