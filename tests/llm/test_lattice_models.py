"""Lattices against enumeration; language identification; lattice likelihood."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpuscope.llm import langid, lattice, lattice_lm
from corpuscope.llm.queries import QUERIES


def segmentations(text, index):
    if not text:
        yield []
    for k in range(1, len(text) + 1):
        if text[:k] in index:
            for rest in segmentations(text[k:], index):
                yield [index[text[:k]], *rest]


@pytest.fixture(scope="module")
def vocab():
    return lattice.pieces()


WORDS = ["the", "thonre", "a", "élleç", "日😀x", "in", "", "▁x", "!!!", "abab"]


def test_forward_sums_all_segmentations(vocab):
    rng = np.random.default_rng(1)
    log_p = np.log(rng.dirichlet(np.ones(vocab.size), 2).T)
    got = lattice.Lattice(vocab, WORDS).forward(log_p)
    for word, row in zip(WORDS, got):
        paths = list(segmentations(vocab.spell(word), vocab.index))
        want = [np.logaddexp.reduce([log_p[p, k].sum() for p in paths]) for k in range(2)]
        assert np.allclose(row, want, rtol=1e-10)


def test_expected_uses_are_path_weights(vocab):
    log_p = np.log(np.random.default_rng(2).dirichlet(np.ones(vocab.size)))[:, None]
    counts = np.arange(1.0, len(WORDS) + 1)
    uses, total = lattice.Lattice(vocab, WORDS).expected(log_p, counts, vocab.size)
    want, likelihood = np.zeros(vocab.size), 0.0
    for word, n in zip(WORDS, counts):
        paths = list(segmentations(vocab.spell(word), vocab.index))
        scores = np.array([log_p[p, 0].sum() for p in paths])
        whole = np.logaddexp.reduce(scores)
        likelihood += n * whole
        for p, s in zip(paths, scores):
            np.add.at(want, p, n * math.exp(s - whole))
    assert np.allclose(uses, want) and math.isclose(total, likelihood)


def test_long_words_and_memo(vocab):
    log_p = np.log(vocab.prior() + 1e-12)[:, None]
    long = b"ab" * 3000
    memo = lattice.Memo(vocab, log_p, most=2)
    for words in ([b"a", b"b"], [b"c", long, b"a"], [b"a"]):
        direct = dict(zip(*lattice.word_scores(vocab, words, log_p)))
        assert np.allclose(memo.lookup(words), [direct[w] for w in words])
    assert np.isfinite(direct[b"a"]).all()


# --- language identification ----------------------------------------------------


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op9_langid"](spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert unseen and sum(r.lang_pred == lang[r.doc_id] for r in unseen) >= 0.98 * len(unseen)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(odd, empty):
    model = langid.fit(odd)
    assert model.langs == ["en", "fr"]
    rows = langid.predict(odd, model).collect()
    assert len(rows) == odd.count() and rows[0].asDict().keys() == set(odd.columns) | {"lang_pred", "score"}
    for r in rows:
        none = r.text is None or not re.search(r"[^\W\d_]", r.text)
        assert (r.lang_pred == "und") == none and (r.score == 0.0) == none
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id in (1, 2)}) == 1
    assert langid.predict(empty, model).count() == 0
    nobody = langid.fit(empty)
    assert nobody.langs == [] and {r.lang_pred for r in langid.predict(odd, nobody).collect()} == {"und"}


def test_labels_of_scored_rows_are_not_read(spark, odd):
    from pyspark.sql import functions as F

    model = langid.fit(odd)
    plain = langid.predict(odd.select("row", "text"), model).select("text", "lang_pred", "score")
    other = langid.predict(odd.withColumn("lang", F.lit("xx")), model).select("text", "lang_pred", "score")
    assert sorted(plain.collect(), key=repr) == sorted(other.collect(), key=repr)


# --- likelihood -----------------------------------------------------------------------


def base_by_hand(docs):
    split = re.compile(r"[^\x20\x09-\x0D]+")
    words = {d: [w.encode().lower().decode() for w in split.findall(t or "")] for d, t in docs}
    counts = Counter()
    for d, ws in words.items():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            counts.update(ws)
            counts["\n"] += 1
    n, v = sum(counts.values()), len(counts)
    score = {d: sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*ws, "\n"]) for d, ws in words.items()}
    known = {d: sum(counts[w] > 0 for w in [*ws, "\n"]) for d, ws in words.items()}
    return n, score, known, {d: len(ws) + 1 for d, ws in words.items()}


@pytest.mark.parametrize("hot", [lattice_lm.HOT_WORDS, 50])
def test_base_figures_by_hand(spark, sf_dir, hot):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    n, score, known, tokens = base_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    from corpuscope.llm.common import held_out

    model = lattice_lm.fit(docs, train=~held_out("doc_id", 5), rounds=1, hot_words=hot)
    rows = lattice_lm.score(docs, model).collect()
    assert len(rows) == len(score)
    for r in rows:
        assert (r.train_tokens, r.n_known, r.n_tokens) == (n, known[r.doc_id], tokens[r.doc_id])
        assert math.isclose(r.base_score, score[r.doc_id], rel_tol=1e-9)
        assert -1e9 < r.score < 0


def test_model_beats_the_base_on_unseen_documents(spark):
    rows = QUERIES["op10_lattice_lm"](spark, "/root/testdata/sf0.1").where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_score_of_a_text_by_hand(spark, odd):
    """Sum over classes of the product over words of path sums and whole-word edges."""
    model = lattice_lm.fit(odd, rounds=1)
    vocab = lattice.pieces()
    table = {r.word: r for r in model.words.collect()}
    rows = {r.doc_id: r for r in lattice_lm.score(odd, model).collect() if r.doc_id is not None}
    for doc_id in (6, 4, 3, 12):
        text = odd.where(f"doc_id = {doc_id}").head().text or ""
        total = model.log_share / lattice_lm.LN10 + model.end_scores()
        for word in text.encode().lower().split():
            total = total + np.array(table[word.decode()].scores)
        assert math.isclose(rows[doc_id].score, np.log10(np.sum(10.0 ** (total - total.max()))) + total.max(), rel_tol=1e-9)
    word = "alpha1"
    paths = list(segmentations(vocab.spell(word), vocab.index))
    for k in range(model.classes):
        path = np.logaddexp.reduce([model.log_p[p, k].sum() for p in paths]) + model.log_rest[k]
        zero = model.scores([word.encode()], np.zeros((1, model.classes)))[0, k] * lattice_lm.LN10
        assert math.isclose(zero, path, rel_tol=1e-9)


def test_probabilities_of_all_tokens_stay_below_one(odd):
    model = lattice_lm.fit(odd, rounds=1)
    seen = np.array([r.scores for r in model.words.collect()])
    mass = (10.0**seen).sum(axis=0) + 10.0 ** model.end_scores()
    assert (mass <= 1 + 1e-9).all()
    some = [("".join(p)).encode() for p in itertools.product("abc", repeat=3)]
    assert ((10.0 ** model.scores(some, np.zeros((len(some), model.classes)))).sum(axis=0) < 1).all()


def test_likelihood_of_odd_rows(odd, empty):
    model = lattice_lm.fit(odd, rounds=1)
    rows = lattice_lm.score(odd, model).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r.score) for r in rows)
    nothing = lattice_lm.fit(empty, rounds=1)
    assert all(math.isfinite(r.score) and r.n_known == 0 for r in lattice_lm.score(odd, nothing).collect())
    assert lattice_lm.score(empty, model).count() == 0


def test_all_starts_of_a_block_go_down_the_pieces_together(monkeypatch):
    vocab = lattice.pieces()
    words = ["", "token", "日本語", "\U0010fe41a😀", "token", "tokenization"]
    texts = [vocab.spell(w) for w in words]
    want = [
        (w, i, j, vocab.index[t[i:j]])
        for w, t in enumerate(texts) for i in range(len(t)) for j in range(i + 1, len(t) + 1) if t[i:j] in vocab.index
    ]

    class Untouched(dict):
        def get(self, *_):
            raise AssertionError("a substring was looked up by itself")

    monkeypatch.setattr(vocab, "index", Untouched(vocab.index))
    made = lattice.Lattice(vocab, words)
    assert list(zip(*(x.tolist() for x in (made.word, made.start, made.end, made.piece)))) == want
    assert lattice.Lattice(vocab, []).forward(np.zeros((vocab.size, 2))).shape == (0, 2)
