"""Against the tokenizers library, document by document, and the index by itself."""

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpuscope.llm import id_shards
from corpuscope.llm.queries import QUERIES
from corpuscope.session import run_dir


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(id_shards.VOCABULARY))


def direct(library, rows):
    """(id, start, n_tokens, crc) of (id, text) rows in ascending order."""
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: r[1])


def test_query_over_whole_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert order(QUERIES["op13_id_shards"](spark, sf_dir).collect()) == direct(library, map(tuple, docs))


ODD = st.text(st.sampled_from(list("aAéÉªºµßÿÞ×÷.,;:?² ΣΟ'sS1½ﬁ́\u0085  ẛİ\t\n\r\x0b\x1c#!<|>한ᅡ😀")) | st.characters(codec="utf-8"), max_size=40)


@settings(max_examples=300, deadline=None, database=None)
@given(ODD)
def test_words_are_encoded_as_the_whole_text_is(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(id_shards.encoder().encode([text], 2)[0], "<u2").tolist() == want


def test_a_word_is_new_once_whatever_stands_behind_it(library, monkeypatch):
    coder, seen = id_shards.Encoder(id_shards.VOCABULARY), []
    monkeypatch.setattr(coder, "_new", lambda words, new=coder._new: seen.extend(words) or new(words))
    text = "word word, Word. wörd$$$ wörd%%% 7. «. ×. word's. a.b. wörd"
    packed = coder.encode([text], 2)[0]
    assert np.frombuffer(packed, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
    assert sorted(seen) == sorted(["word", "wörd", ",", ".", "$$$", "%%%", "7.", "«.", "×.", "word's", "a.b"])


def test_words_of_one_hash_stay_apart(library, monkeypatch):
    monkeypatch.setattr(id_shards, "mix", lambda x: x & np.uint64(1))
    text = "b a ab a b " + "long" * 9 + " abcdefgh abcdefghi abcdefgh " + "long" * 9 + " a"
    packed = id_shards.Encoder(id_shards.VOCABULARY).encode([text], 2)[0]
    assert np.frombuffer(packed, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", "  ", "a<|endoftext|>b <|startoftext|>", "## # ###", "word " * 9, "x" * 500])
def test_slices_and_a_full_memo_change_nothing(library, monkeypatch, text):
    monkeypatch.setattr(id_shards, "SLICE_CHARS", 7)
    monkeypatch.setattr(id_shards, "MEMO_WORDS", 2)
    coder = id_shards.Encoder(id_shards.VOCABULARY)
    assert coder.by_word and coder.plain
    want = library.encode(text, add_special_tokens=False).ids
    for _ in range(2):
        for width in (2, 4):
            got = coder.encode([text, "x y z", text], width)
            assert [np.frombuffer(g, f"<u{width}").tolist() for g in (got[0], got[2])] == [want, want]


def test_a_vocabulary_that_keeps_white_space_is_not_cut():
    coder = id_shards.Encoder("byte_bpe_50k.json")
    text = "two  words\n and more "
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert not coder.by_word and np.frombuffer(coder.encode([text], 2)[0], "<u2").tolist() == whole


@settings(max_examples=60, deadline=None, database=None)
@given(st.integers(0, 3000), st.integers(0, 99))
def test_perfect_hash_gives_each_key_a_slot_of_its_own(n, seed):
    draw = np.random.default_rng(seed)
    h1, h2 = draw.integers(0, 1 << 64, (2, n), np.uint64)
    perfect = id_shards.PerfectHash.from_bytes(id_shards.PerfectHash.build(h1, h2).to_bytes())
    assert sorted(perfect.slots(h1, h2).tolist()) == list(range(n))
    others = perfect.slots(*draw.integers(0, 1 << 64, (2, 500), np.uint64))
    assert ((others >= -1) & (others < max(n, 1))).all()


def test_equal_hashes_are_an_error():
    same = np.array([5, 5], np.uint64)
    with pytest.raises(ValueError, match="same 128-bit hash"):
        id_shards.PerfectHash.build(same, same)


def test_lookup_of_some_keys_and_of_strangers(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = run_dir(spark, "id-test")
    id_shards.write_shards(docs, path, shard_text=20_000)
    id_shards.build_index(spark, path, keys_per_part=16)
    ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
    asked = spark.createDataFrame([(i,) for i in ids[::3] + [-1, 10**12, *range(10**9, 10**9 + 3000)]], "doc_id long")
    got = order(id_shards.fetch(spark, path, asked).select("doc_id", "start", "n_tokens", "ids").collect())
    want = [r for r in direct(library, map(tuple, docs.collect())) if r[0] in set(ids[::3])]
    assert [(d, s, n, zlib.crc32(x)) for d, s, n, x in got] == want
    # Few strangers reach a shard, if any: a slot keeps 32 bits of a key.
    assert id_shards.locate(spark, path, asked).count() <= len(ids[::3]) + 1
    assert len({r.shard for r in id_shards.shard_files(spark, path).select("shard").collect()}) > 1


def test_odd_rows(spark, odd, empty, library):
    path = run_dir(spark, "id-test")
    id_shards.write_shards(odd, path, shard_text=5_000)
    id_shards.build_index(spark, path, keys_per_part=3)
    got = id_shards.fetch(spark, path, odd).select("doc_id", "start", "n_tokens", "ids").collect()
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    want = direct(library, rows)
    assert sorted((str(d), n, zlib.crc32(x)) for d, _, n, x in got) == sorted((str(d), n, c) for d, _, n, c in want)
    # Rows of one key may stand in any order; together they leave no gap.
    spans = sorted((s, s + n) for _, s, n, _ in got)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert [d for d, *_ in order(got)] == [w[0] for w in want]

    path = run_dir(spark, "id-test")
    id_shards.write_shards(empty, path)
    id_shards.build_index(spark, path)
    assert id_shards.fetch(spark, path, odd).count() == 0


def test_a_repeated_key_over_many_shards(spark, library):
    rows = [(7, f"text number {i}") for i in range(300)] + [(1, "first"), (9, "last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = run_dir(spark, "id-test")
    id_shards.write_shards(docs, path, shard_text=300)
    id_shards.build_index(spark, path)
    found = id_shards.locate(spark, path, docs.where("doc_id = 7")).collect()
    assert len(found) == 1 and found[0]["last"] > found[0].shard
    got = id_shards.fetch(spark, path, docs.where("doc_id = 7")).collect()
    want = direct(library, rows)
    assert sorted((r.n_tokens, zlib.crc32(r.ids)) for r in got) == sorted((n, c) for d, _, n, c in want if d == 7)
    assert sorted(r.start for r in got)[0] == next(s for d, s, *_ in want if d == 7)


def test_a_cut_file_is_an_error():
    table = id_shards._table([b"k1"], [1], 2)
    whole = b"\x02\0" + table
    assert id_shards.Shard(io.BytesIO(whole), len(whole)).ids(0, 0).tolist() == [2]
    for cut in (whole[1:], whole[:-1], whole[-20:]):
        with pytest.raises(ValueError, match="no whole shard file"):
            id_shards.Shard(io.BytesIO(cut), len(cut))
    with pytest.raises(ValueError, match="cut off"):
        id_shards.Shard(io.BytesIO(whole[:-1]), len(whole))


def test_long_runs_are_read_in_bounded_requests(monkeypatch):
    monkeypatch.setattr(id_shards, "READ_BYTES", 64)
    lengths = [3, 50, 1, 1, 40, 2, 9, 1]
    ids = np.arange(sum(lengths), dtype="<u2")
    whole = ids.tobytes() + id_shards._table([b"k%d" % i for i in range(8)], lengths, 2)
    shard = id_shards.Shard(io.BytesIO(whole), len(whole))
    wanted = [0, 1, 2, 3, 5, 6, 7]
    rows = [r for b in id_shards._read_documents(4, shard, wanted) for r in b.to_pylist()]
    starts = np.cumsum([0, *lengths])
    assert [(r["key"], r["doc"], r["offset"], np.frombuffer(r["ids"], "<u4").tolist()) for r in rows] == [
        (b"k%d" % d, d, starts[d], list(range(starts[d], starts[d + 1]))) for d in wanted
    ]
