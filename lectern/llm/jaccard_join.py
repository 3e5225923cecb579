"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of distinct five-word shingles; equal sets are one class. Shingles are ordered by how frequent
they are in the corpus (a sketch of fixed size counts every shingle of every document), rare ones first. A class posts
a prefix of its set: with l shingles more than an overlap can miss, two similar sets share at least l of them. Each
class takes the l that makes its estimated cost least: longer prefixes post more, but a pair must then share more
shingles before it is verified. A pair is met only if the shingles from the shared one on suffice for a link, which
the first shingle that two similar sets share always fulfils. Before their texts are joined, pairs whose bitmaps show that
they have too little in common are left out; a bitmap never shows less than what two sets share, so no link is lost.
The others are verified on whole sets.

Groups that share a shingle are not expanded into all pairs. In rounds, a few members of each group are compared with
all its members of other components, and leave the group; links join components. First the member of least rank is
compared, the same one for most shingles of a crowd, then a few more, at last the members outside the group's largest
component. A group ends when it is one component, so that no link between two components is lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.arrow import bounded_batches, importable, release, remove_table, shared_folder, slices, text_buffer
from lectern.llm.words import SPACED, Words, grams, mix, run_hash, signed

SHINGLE = 5
#: A pair is a link when PART * union <= WHOLE * intersection.
PART, WHOLE = 75, 100
#: Buckets of the frequency sketch: its size is fixed, whatever the corpus.
SKETCH_BITS = 18
#: Bits of a bitmap for each shingle of its set, at least; their number is a power of two.
BITMAP_BITS = 4
_CHUNK = 4096
#: Postings of one shingle beyond which they are dealt to several tasks.
HOT_POSTINGS = 20_000
LONGEST_EXTRA = 16
#: Members of a group that are compared with all its others, round by round; after these, up to LATER of those outside
#: its largest component in every round, until the group is one component or has no such member left.
COMPARED, LATER = (1, 4, 16), 256


def shingle_sets(words: Words) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; a text with fewer words has them all as one."""
    h, first = words.hash, words.first
    found = grams(h, SHINGLE, 5)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= SHINGLE:
            s = np.sort(found[a:b - SHINGLE + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif b > a:
            out.append(run_hash(h, np.array([a]), np.array([b - a]), 6))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _sets(column: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    data, offsets = text_buffer(column)
    for a, b in slices(np.diff(offsets)):
        words = Words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], SPACED, lower=True)
        yield a, b, shingle_sets(words)


def _class_id(s: np.ndarray) -> np.uint64:
    return mix(np.add.reduce(mix(s + np.uint64(len(s))), keepdims=True))[0]


def bitmap(s: np.ndarray) -> np.ndarray:
    """Bits of the buckets that the shingles of a set fall into; fewer buckets are those of more buckets laid on each other."""
    bits = np.zeros(max(64, 1 << (BITMAP_BITS * len(s) - 1).bit_length()), dtype=bool)
    bits[((s >> np.uint64(24)) & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def may_link(a: np.ndarray, size_a: int, b: np.ndarray, size_b: int) -> bool:
    """Whether two sets of these bitmaps and sizes can be linked: a bucket that only one of them fills holds a shingle of its own."""
    if len(a) > len(b):
        a, size_a, b, size_b = b, size_b, a, size_a
    b = np.bitwise_or.reduce(b.reshape(-1, len(a)))
    common = min(size_a - int(np.bitwise_count(a & ~b).sum()), size_b - int(np.bitwise_count(b & ~a).sum()))
    return (PART + WHOLE) * common >= PART * (size_a + size_b)


_PROFILE = T.StructType([
    T.StructField("doc", T.LongType()), T.StructField("mark", T.LongType()), T.StructField("n", T.IntegerType()),
    T.StructField("id", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("chunk", T.IntegerType()),
    T.StructField("counts", T.ArrayType(T.IntegerType()))])


def _profile(batches) -> Iterator[pa.RecordBatch]:
    """A row for each document, then this task's share of the sketch in chunks."""
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    names = _PROFILE.fieldNames()
    for batch in batches:
        sizes, ids, bits = [], [], []
        for _, _, sets in _sets(batch.column(0)):
            sizes += map(len, sets)
            ids += [_class_id(s) for s in sets]
            bits += [bitmap(s).tobytes() for s in sets]
            if sets:
                buckets = np.concatenate(sets) & np.uint64(len(sketch) - 1)
                sketch += np.bincount(buckets.astype(np.int64), minlength=len(sketch))
        rows = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), batch.column(2), pa.array(sizes, pa.int32()), pa.array(signed(np.array(ids, dtype=np.uint64))),
             pa.array(bits, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.list_(pa.int32()))], names=names)
    for chunk in np.unique(np.flatnonzero(sketch) // _CHUNK).tolist():
        counts = np.minimum(sketch[chunk * _CHUNK:(chunk + 1) * _CHUNK], 2**31 - 1).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())]
            + [pa.array([chunk], pa.int32()), pa.array([counts], pa.list_(pa.int32()))], names=names)


def _frequencies(profile: DataFrame) -> np.ndarray:
    """Estimated documents of each sketch bucket beyond what chance puts there; zero where nothing stands out."""
    counts = (profile.where("chunk is not null").select("chunk", F.posexplode("counts"))
              .groupBy("chunk", "pos").agg(F.sum("col").alias("n")).where("n > 0").toPandas())
    sketch = np.zeros(1 << SKETCH_BITS)
    sketch[counts["chunk"].to_numpy() * _CHUNK + counts["pos"].to_numpy()] = counts["n"].to_numpy()
    usual = float(np.median(sketch))
    return np.where(sketch > usual + 6 * np.sqrt(usual) + 4, sketch - usual, 0).astype(np.float32)


def prefix(s: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The shingles that a set posts, their frequencies, and how many of them a similar set must share."""
    often = frequency[(s & np.uint64(len(frequency) - 1)).astype(np.int64)]
    order = np.lexsort((s, often))
    least = -(-PART * len(s) // WHOLE)
    extra = np.arange(1, min(LONGEST_EXTRA, least) + 1)
    postings = len(s) - least + extra
    shared = np.cumsum(often[order], dtype=np.float64)[postings - 1]
    cost = postings + shared + shared / extra * len(s) / 8  # by Markov, at most shared / extra candidates match
    best = int(np.argmin(cost))
    chosen = order[:postings[best]]
    return s[chosen], often[chosen], int(extra[best])


_POSTING = T.StructType([T.StructField("token", T.LongType()), T.StructField("salt", T.IntegerType()),
                         T.StructField("id", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("rest", T.IntegerType())])


def _postings(shared):
    def run(batches):
        for batch in batches:
            frequency = shared.value
            for _, _, sets in _sets(batch.column(0)):
                tokens, often, ids, sizes, rests = [], [], [], [], []
                seen = set()
                for s in sets:
                    if len(s) and (own := _class_id(s)) not in seen:
                        seen.add(own)
                        t, f, _ = prefix(s, frequency)
                        tokens.append(t)
                        often.append(f)
                        ids.append(np.full(len(t), own, dtype=np.uint64))
                        sizes.append(np.full(len(t), len(s), dtype=np.int32))
                        rests.append(np.arange(len(s), len(s) - len(t), -1, dtype=np.int32))
                if tokens:
                    own, parts = np.concatenate(ids), 1 + np.concatenate(often).astype(np.int64) // HOT_POSTINGS
                    salt = np.where(parts > 1, 1 + (own >> np.uint64(8)).astype(np.int64) % parts, 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(np.concatenate(tokens))), pa.array(salt.astype(np.int32)),
                         pa.array(signed(own)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(rests))], names=_POSTING.fieldNames())
    return run


def _shared_postings(batches) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by token, salt and class: groups of the different classes that post a token, if several do.

    `rest` is the number of shingles from the posted one on. Two similar sets have no more in common than the rest
    behind the first shingle that they share, so a posting goes whose rest is too short for the least set of its group.
    Tokens of equal classes are one group, named by a fingerprint of its classes, with the largest rest of each. The
    postings of a hot token lie in several tasks and are kept under the token itself. Other groups are below HOT_POSTINGS.
    """
    held = None

    def groups(columns, last: bool):
        token, salt, own, n, reach = columns
        starts = np.r_[True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])]
        fresh = starts | np.r_[True, own[1:] != own[:-1]]
        end = len(token) if last else np.flatnonzero(starts)[-1]
        fresh[end:] = False
        rest = None if last else [c[end:] for c in columns]
        group = np.cumsum(starts) - 1
        wide = n.astype(np.int64)
        least = np.where(salt > 0, 0, np.minimum.reduceat(wide, np.flatnonzero(starts))[group])
        fresh &= (PART + WHOLE) * reach.astype(np.int64) >= PART * (wide + np.maximum(least, -(-PART * wide // WHOLE)))
        size = np.bincount(group, fresh)
        kept = np.flatnonzero(fresh & ((size[group] > 1) | (salt > 0)))
        if not len(kept):
            return rest, None
        group = group[kept]
        heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        name = mix(np.add.reduceat(mix(own[kept].view(np.uint64)), heads) + size[group[heads]].astype(np.uint64))
        name = np.repeat(name, np.diff(np.r_[heads, len(kept)])).view(np.int64)
        name = np.where(salt[kept] > 0, token[kept], name)
        order = np.lexsort((own[kept], name))
        name, kept = name[order], kept[order]
        new = np.r_[True, (name[1:] != name[:-1]) | (own[kept][1:] != own[kept][:-1])]
        most = np.maximum.reduceat(reach[kept], np.flatnonzero(new))
        return rest, pa.RecordBatch.from_arrays([pa.array(name[new]), pa.array(own[kept][new]), pa.array(n[kept][new]), pa.array(most)],
                                                names=["token", "id", "n", "rest"])

    for batch in batches:
        if batch.num_rows:
            columns = [np.array(batch.column(i)) for i in range(5)]
            columns = columns if held is None else [np.concatenate([h, c]) for h, c in zip(held, columns)]
            held, found = groups(columns, False)
            if found is not None:
                yield found
    if held is not None:
        _, found = groups(held, True)
        if found is not None:
            yield found


def _pack(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [pa.compress(t.encode(), "zstd", asbytes=True) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), batch.column(2), pa.array(packed, pa.binary()),
             pa.array(np.diff(text_buffer(batch.column(0))[1]).astype(np.int32))], names=["doc", "mark", "packed", "size"])


#: Shingles of sets that a verifying task remembers, as members of one group come by again and again.
REMEMBERED = 4_000_000


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


_LOOKED = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b", "ra", "rb", "doc_a", "mark_a", "doc_b", "mark_b")]
                       + [T.StructField("open", T.BooleanType())])


def _look(batches) -> Iterator[pa.RecordBatch]:
    """Whether pairs with the bitmaps of both sets can be links."""
    names = _LOOKED.fieldNames()[:-1]
    for batch in batches:
        maps = [[np.frombuffer(x, dtype=np.uint8) for x in batch.column(f"bits_{s}").to_pylist()] for s in "ab"]
        sizes = [batch.column(f"n_{s}").to_pylist() for s in "ab"]
        open_ = [may_link(*x) for x in zip(maps[0], sizes[0], maps[1], sizes[1])]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(open_, pa.bool_())], names=[*names, "open"])


def _verify(shared):
    """Pairs with both texts: a first look at the prefixes, then the exact test on whole sets."""
    def run(batches):
        frequency, known, held = shared.value, {}, 0
        for batch in batches:
            columns = {c: batch.column(c) for c in ("packed_a", "size_a", "packed_b", "size_b")}
            sides = [batch.column(c).to_pylist() for c in "ab"]

            def known_set(key, side, row):
                nonlocal held
                if (found := known.get(key)) is None:
                    if held > REMEMBERED:
                        known.clear()
                        held = 0
                    size = columns[f"size_{side}"][row].as_py()
                    text = pa.decompress(columns[f"packed_{side}"][row].as_py(), size, "zstd", asbytes=True) if size else b""
                    words = Words(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]), SPACED, lower=True)
                    s = shingle_sets(words)[0]
                    tokens, _, need = prefix(s, frequency)
                    found = known[key] = s, np.sort(tokens), need
                    held += len(s)
                return found

            links = []
            for row, (key_a, key_b) in enumerate(zip(*sides)):
                a, first, need_a = known_set(key_a, "a", row)
                b, second, need_b = known_set(key_b, "b", row)
                ok = _common(first, second) >= min(need_a, need_b)
                if ok:
                    both = _common(a, b)
                    ok = WHOLE * both >= PART * (len(a) + len(b) - both)
                links.append(ok)
            kept = ["a", "b", "ra", "rb"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(links, pa.bool_())], names=[*kept, "link"])
    return run


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the links, root being the least node that can be reached.

    Edges are turned in rounds so that each node points to smaller ones, until nothing changes; every round is a few
    joins whose hot side can be split, and is checkpointed.
    """
    shared_folder(links.sparkSession)
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct().checkpoint()
    state = None
    while True:
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        turned = large.where("u <> v")
        least = turned.groupBy("u").agg(F.min("v").alias("m"))
        small = turned.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = small.select("e.*").where("u <> v").distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select("v", "v").distinct()).distinct()


def similarity_join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: its key, n_shingles, and component_id (the least key reachable by links, or its own).

    Null and empty texts have no shingles and no links, and are components of their own. Repeated rows are one class.
    Null keys take part; a component of null keys only has a null id.
    """
    found = _linked(docs, key, text)
    named = found.where("n > 0").groupBy("id").agg(F.min("doc").alias("least"))
    return found.join(named, "id", "left").select(
        F.col("doc").alias(key), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc")).alias("component_id"))


def component_firsts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, mark) of the first document of each component, mark being xxhash64 of its text.

    First is the least key, of equal keys the least mark; documents without shingles are all first. Null keys are left out.
    """
    found = _linked(docs, key, text).where("doc is not null")
    firsts = found.where("n > 0").groupBy("id").agg(F.min(F.struct("doc", "mark")).alias("p")).select("p.doc", "p.mark")
    return firsts.union(found.where("n = 0").select("doc", "mark")).distinct().select(F.col("doc").alias(key), "mark")


def _linked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per input row: doc, mark, n (shingles), and id, the same for all rows of a component that has shingles."""
    own = bounded_batches(importable(docs)).select(
        F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("mark"))
    spark = docs.sparkSession
    shared_folder(spark)
    profile = own.mapInArrow(_profile, _PROFILE).checkpoint()
    frequency = spark.sparkContext.broadcast(_frequencies(profile))
    rows = profile.where("chunk is null")

    order = ["token", "salt"]
    postings = (own.select("text").mapInArrow(_postings(frequency), _POSTING)
                .repartition(*order).sortWithinPartitions(*order, "id")
                .mapInArrow(_shared_postings, "token long, id long, n int, rest int"))
    live = (postings.groupBy("token", "id").agg(F.max("n").alias("n"), F.max("rest").alias("rest"))
            .withColumn("root", F.col("id")).checkpoint())
    release(spark)
    # what a set must have in common with the least one of its group that can be similar to it, times WHOLE
    wide = F.col("n").cast("long")
    needed = F.greatest(WHOLE * PART * (wide + F.col("lo")), PART * (WHOLE + PART) * wide)
    open_ = WHOLE * (PART + WHOLE) * F.col("rest").cast("long") >= needed
    rank = F.struct(F.xxhash64("id").alias("r"), "id")
    # tables bucketed by what they are joined on, so that no round shuffles bitmaps or texts again
    parts, tables = int(spark.conf.get("spark.sql.shuffle.partitions")), []

    def bucketed(df: DataFrame, *by: str) -> DataFrame:
        tables.append(f"lectern_texts_{uuid.uuid4().hex}")
        df.write.bucketBy(parts, *by).option("path", f"{shared_folder(spark)}/{tables[-1]}").saveAsTable(tables[-1])
        return spark.table(tables[-1])

    named = F.coalesce("doc", F.lit(-(2**63))).alias("doc")
    classes = bucketed(rows.where("n > 0").select("id", F.struct(named, "mark", "n", "bits").alias("p")).repartition(parts, "id")
                       .groupBy("id").agg(F.min("p").alias("p")).select("id", "p.*"), "id")
    release(spark)
    texts = bucketed(own.withColumn("doc", named).mapInArrow(_pack, "doc long, mark long, packed binary, size int")
                     .repartition(parts, "doc", "mark").dropDuplicates(["doc", "mark"]), "doc", "mark")
    release(spark)

    tested, merges, turn = None, [], 0
    while True:
        shares = live.groupBy("token", "root").agg(F.count("*").alias("m"), F.min(rank).alias("first"), F.min("n").alias("lo"))
        groups = shares.groupBy("token").agg(
            F.sum("m").alias("m"), F.count("*").alias("roots"), F.min("first").alias("first"), F.min("lo").alias("lo"),
            F.max(F.struct("m", "root")).alias("main")).where("roots > 1")
        share = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1 << 40)) / F.lit(float(1 << 40))
        if turn == 0:
            chosen = rank == F.col("first")
        elif turn < len(COMPARED):
            chosen = share * F.col("m") < COMPARED[turn]
        else:
            outside = F.col("m") - F.col("main.m")
            chosen = (F.col("root") != F.col("main.root")) & (share * outside < LATER)
        live = live.join(groups, "token").where(open_).select("token", "id", "n", "rest", "root", chosen.alias("chosen")).checkpoint()
        if live.isEmpty():
            break
        picked = live.where("chosen").groupBy("token").agg(F.collect_list(F.struct("id", "root", "n", "rest")).alias("picked"))
        # two sets that first share this shingle have at most the shorter rest in common; sizes too far apart fail it as well
        far = F.filter("picked", lambda c: (c["root"] != F.col("root"))
                       & ((PART + WHOLE) * F.least(c["rest"], F.col("rest")).cast("long") >= PART * (c["n"].cast("long") + F.col("n"))))
        far = F.transform(far, lambda c: F.struct(c["id"].alias("id"), c["root"].alias("root")))
        # the shingles that two classes share give one row for each class, not one for each pair
        met = live.join(picked, "token").select("id", "root", far.alias("far")).where("size(far) > 0")
        met = met.groupBy("id", "root").agg(F.array_distinct(F.flatten(F.collect_set("far"))).alias("far"))
        each = met.select("id", "root", F.explode("far").alias("c"))
        pairs = each.select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b"),
                            F.least("root", "c.root").alias("ra"), F.greatest("root", "c.root").alias("rb")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        maps, whole = [[t.select(*[F.col(c).alias(f"{c}_{s}") for c in t.columns]) for s in "ab"] for t in (classes, texts)]
        looked = (pairs.join(maps[0].withColumnRenamed("id_a", "a"), "a").join(maps[1].withColumnRenamed("id_b", "b"), "b")
                  .mapInArrow(_look, _LOOKED).checkpoint())
        tested = looked.select("a", "b") if tested is None else tested.union(looked.select("a", "b"))
        links = (looked.where("open").join(whole[0], ["doc_a", "mark_a"]).join(whole[1], ["doc_b", "mark_b"])
                 .mapInArrow(_verify(frequency), "a long, b long, ra long, rb long, link boolean").where("link"))
        merged = components(links, "ra", "rb").select(F.col("node").alias("root"), F.col("root").alias("now"))
        merges.append(merged.checkpoint())
        release(spark)
        live = (live.where(~F.col("chosen")).drop("chosen").join(merges[-1], "root", "left")
                .select("token", "id", "n", "rest", F.coalesce("now", "root").alias("root")))
        turn += 1

    for table in tables:
        spark.sql(f"DROP TABLE {table}")
        remove_table(spark, f"{shared_folder(spark)}/{table}")
    found = rows.select("doc", "mark", "n", "id")
    for merged in merges:
        found = found.join(merged.withColumnRenamed("root", "id"), "id", "left").select(
            "doc", "mark", "n", F.coalesce("now", "id").alias("id"))
    return found
