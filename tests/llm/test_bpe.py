"""Against the tokenizers library, and exact round trips."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpuscope.llm import bpe
from corpuscope.llm.queries import QUERIES


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


def ids(text):
    return np.frombuffer(bpe.codec().encode(text), "<u4").tolist()


CASES = [
    "", "a", " ", "  a", " \n\n b\t\tc   ", "<|endoftext|>x <|endoftext|>", "don't we'll 'S", "x\x1cy\x85z q",
    "😀👩‍👩‍👧 é", "x" * 5000, "ab" * 3000 + " 12 ½ ²³ Ⅷ", "​　日本語 テスト", "a\x00b",
]


@pytest.mark.parametrize("text", CASES)
def test_equals_the_library(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    assert bpe.codec().decode(np.array(want, "<u4").tobytes()) == library.decode(want, skip_special_tokens=False)


def test_every_code_point_beside_letters(library):
    texts = [f"a{chr(c)}{chr(c)}b 1{chr(c)} " for c in range(0x3100)]
    for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert ids(text) == found.ids


def test_full_memo_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 2)
    fresh = bpe.Codec(public_tokenizers.path(bpe.VOCABULARY))
    text = "one two three two one four"
    assert np.frombuffer(fresh.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(fresh.memo) <= 2


def test_broken_bytes_decode_as_in_the_library(library):
    broken = [bpe.codec().byte_ids[b] for b in (0xE2, 0x82, 0x41, 0xFF)]
    assert bpe.codec().decode(np.array(broken, "<u4").tobytes()) == library.decode(broken, skip_special_tokens=False)


def test_query_over_whole_table(spark, sf_dir, library):
    rows = {r.doc_id: r for r in QUERIES["op6_bpe"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for doc, found in zip(docs, library.encode_batch([d.text or "" for d in docs], add_special_tokens=False)):
        row = rows[doc.doc_id]
        assert row.n_tokens == len(found.ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(found.ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((doc.text or "").encode()).hexdigest()


def test_odd_rows_and_empty_table(odd, empty):
    encoded = bpe.encode(odd)
    assert encoded.columns == ["doc_id", "ids"] and encoded.count() == odd.count()
    back = sorted(r.text for r in bpe.decode(encoded).collect())
    assert back == sorted(r.text or "" for r in odd.collect())
    assert bpe.round_trip(empty).count() == bpe.encode(empty).count() == 0
