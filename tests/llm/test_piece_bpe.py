"""Piece encoding and decoding against the library, and on odd rows."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from lectern.llm import piece_bpe, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    return piece_bpe.PieceCodec(piece_bpe.read_model(PATH))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def unpacked(packed):
    return list(memoryview(packed).cast("i"))


def test_ids_and_texts_equal_the_library(codec, library):
    rng = random.Random(3)
    pools = ["abcdefghi thеing,!?#", " \t\n\r\x0b\x0c\x1c\x85\xa0 　a1▁▁", "éèêñ日本語中文кириллица😀🇩🇪a͸�\x00", "0123456789-., ",
             "    a", ["the ", "ing", "▁", "<s>", "</s>", "<0x0A>", "<unk>", "tion", "  ", "\n\n", "ee", "Straße", "ﬀ"]]
    for k in range(6000):
        pool = pools[k % len(pools)]
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 90)))
        ids = unpacked(codec.encode(text))
        assert ids == library.encode(text)
        assert codec.decode([*ids, 2]) == library.decode([*ids, 2])
    for text in ("x" * 3000, "ab" * 2000, " " * 1000, "日" * 1000, "͸" * 500, "a" + "▁" * 100 + "b"):
        assert unpacked(codec.encode(text)) == library.encode(text)


def test_decoding_of_any_ids(codec, library):
    rng = random.Random(4)
    for k in range(3000):
        ids = [rng.choice([rng.randint(0, 31999), rng.randint(0, 260), rng.randint(3, 258), 28705, 259]) for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_odd_rows(spark, odd_docs, clashing, no_docs, library):
    model = piece_bpe.read_model(PATH)
    for docs in (odd_docs, clashing):
        rows = piece_bpe.decode(piece_bpe.encode(docs, model), model).collect()
        assert len(rows) == 10
        for r in rows:
            assert r.ids == library.encode(r.text or "", add_eos=True)
            assert r.decoded == library.decode(r.ids)
    assert piece_bpe.encode(no_docs, model).count() == 0
    assert piece_bpe.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), model).collect()[0].decoded == ""


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        piece_bpe.PieceCodec(b"")


def test_query_equals_the_library(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, sf, "documents").collect()}
    rows = queries.op11_piece_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
