"""Stages against what the operators say, and the whole run against brute force."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from corpuscope.llm import mixing
from corpuscope.session import materialize
from test_near_copies import brute_links, roots_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 6000")
    return materialize(docs, "pipeline-test")


def cut_brute(docs, length=50):
    """(id, text left) with the bytes of earlier strings gone; texts of nothing else go."""
    seen, out = set(), {}
    for d, t in sorted(docs):
        data = t.encode()
        gone = np.zeros(len(data), bool)
        strings = [data[i : i + length] for i in range(len(data) - length + 1)]
        for i, s in enumerate(strings):
            if s in seen:
                gone[i : i + length] = True
        seen.update(strings)
        left = np.frombuffer(data, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        if left or not gone.any():
            out[d] = left
    return out


def test_stages_and_run_by_brute_force(spark, small):
    docs = {r.doc_id: r for r in small.collect()}
    stages = dict(pipeline.STAGES)

    named = materialize(stages["language_id"](spark, small, ""), "pipeline-test")
    assert named.columns == small.columns
    assert {r.doc_id: r for r in named.collect()} == docs  # all are clean

    single = materialize(stages["ngram_jaccard_join"](spark, named, ""), "pipeline-test")
    ids = sorted(docs)
    pairs = [(ids[i], ids[j]) for i, j in brute_links([docs[d].text for d in ids])]
    firsts = {d for d, root in roots_of(ids, pairs).items() if d == root}
    assert {r.doc_id: r for r in single.collect()} == {d: docs[d] for d in firsts}

    cut = materialize(stages["suffix_array_dedup"](spark, single, ""), "pipeline-test")
    want = cut_brute([(d, docs[d].text) for d in firsts])
    assert {r.doc_id: r.text for r in cut.collect()} == want
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    mixed = materialize(stages["source_mixing"](spark, cut, ""), "pipeline-test")
    rows = mixed.collect()
    taken = {}
    for r in rows:
        assert want[r.doc_id].startswith(r.text)
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(WORD.findall(r.text))
    plan = {r.doc_id: r.taken for r in mixing.mix(cut).collect() if r.taken}
    assert {d: n for d, n in taken.items() if n} == plan

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = sorted(tuple(r) for r in stages["bpe_encoding"](spark, mixed, "").collect())
    expect = []
    for r in rows:
        found = library.encode(r.text, add_special_tokens=False).ids
        packed = np.array(found, "<u4").tobytes()
        expect.append((r.doc_id, len(found), hashlib.sha256(packed).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert tokens == sorted(expect)


def test_rejected_documents_go(spark):
    rows = [(i, "the cat and the dog are in the house", "en", "s", 36) for i in range(3)]
    rows += [(7, "12 34 --", "en", "s", 8), (8, None, None, "s", None), (9, "", "fr", None, 0)]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "pipeline-test")
    kept = pipeline.identify_language(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2]


def test_stages_take_odd_and_no_rows(spark, odd, empty):
    for docs in (odd, empty):
        n = docs.count()
        for name, stage in pipeline.STAGES:
            out = materialize(stage(spark, docs.select(*pipeline.COLUMNS), ""), "pipeline-test")
            if name != "bpe_encoding":
                assert out.columns == list(pipeline.COLUMNS)
            assert out.count() <= 2 * n


def test_registered(spark, sf_dir):
    import __spark_entry__ as entry

    assert set(f"op{i}" for i in range(1, 14)) == {q.split("_")[0] for q in entry.queries() if re.match(r"op\d+_", q)}
    assert entry.queries()["pipeline"] is pipeline.run
    assert pipeline.run(spark, sf_dir).count() > 0
