import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from conftest import ODD

from llm import kernel, op11_piece_ids, queries, vocab

SF = "/root/testdata/sf0.001"
#: Texts are drawn from these: markers of both kinds, white space, signs, several scripts, names of special pieces.
PARTS = [" ", "  ", "\n", "\t", "\r", "▁", "a", "b", "The", "ing", " the", "1", "23", ".", ",", "é", "é", "ß", "日本", "語", " ", " ", "😀", "\x00", "\x01", "~", "ﬁ", "<s>", "</s>", "<unk>", "<0x41>", "Жи", "﻿", "​", "http://", "==", "--"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(op11_piece_ids.MODEL))


@pytest.fixture(scope="module")
def pieces():
    with open(public_tokenizers.path(op11_piece_ids.MODEL), "rb") as f:
        return op11_piece_ids.Pieces(f.read())


def same(library, row_text, ids, back):
    want = library.encode(row_text or "", add_bos=True, add_eos=True)
    return np.frombuffer(ids, "<u4").tolist() == want and back.decode() == library.decode(want)


def test_fuzzed_texts_are_encoded_as_by_the_library(library, pieces):
    rng = random.Random(5)
    cache = vocab.Cache(pieces)
    for _ in range(20):
        texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(25))) for _ in range(300)] + [None, ""]
        data, offsets = kernel.strings(pa.array(texts, pa.string()))
        out = op11_piece_ids._encoded(pa.array(range(len(texts))), data, offsets, pieces, cache)
        for text, ids, back in zip(texts, out.column(2).to_pylist(), out.column(3).to_pylist(), strict=True):
            assert same(library, text, ids, back), text


def test_any_ids_are_decoded_as_by_the_library(library, pieces):
    rng = random.Random(6)
    for _ in range(300):
        ids = [rng.randrange(32000) if rng.random() < 0.6 else rng.randrange(259) for _ in range(rng.randrange(12))]
        assert pieces.decoded(ids) == library.decode(ids), ids


def test_a_chunk_is_segmented_once(pieces):
    class Counted:
        def __init__(self):
            self.seen = []

        def __call__(self, chunks):
            self.seen += chunks
            return pieces(chunks)

    counted = Counted()
    cache = vocab.Cache(counted)
    texts = ["the cat and the dog\nthe end 11 22"] * 3
    data, offsets = kernel.strings(pa.array(texts))
    for _ in range(2):
        op11_piece_ids._encoded(pa.array(range(3)), data, offsets, pieces, cache)
    assert len(counted.seen) == len(set(counted.seen)) and counted.seen.count(b" the") == 1


def test_odd_rows(spark, odd, empty, library):
    got = op11_piece_ids.encode(odd)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    rows = got.collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted((i for i, _ in ODD), key=str)
    want = sorted(library.encode(t or "", add_bos=True, add_eos=True) for _, t in ODD)
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in rows) == want
    assert sorted(r.decoded.decode() for r in rows) == sorted(library.decode(w) for w in want)
    assert all(r.n_tokens * 4 == len(r.ids) for r in rows)
    assert op11_piece_ids.encode(empty).count() == 0


def test_texts_of_a_megabyte(spark, library):
    texts = ["ab" * 500_000, "word " * 200_000, " " * 300_000, "日本" * 150_000]
    rows = op11_piece_ids.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        assert same(library, texts[r.doc_id], r.ids, r.decoded)


def test_query(spark, texts, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op11_piece_ids"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
