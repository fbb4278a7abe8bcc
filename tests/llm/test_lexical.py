"""Against SQL, and against scoring every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle_check import compare, connect

from corpuscope.llm import lexical
from corpuscope.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms_of(text):
    return [] if text is None else TERM.findall(text.translate(UPPER))


def direct(docs, items, top=20):
    """(item, rank, id, score): every document scored by the formula."""
    held = [(i, Counter(terms_of(t)), len(terms_of(t))) for i, t in docs if terms_of(t)]
    n, total = len(held), sum(h[2] for h in held)
    df = Counter(t for _, counts, _ in held for t in counts)
    out = []
    for item, text in items:
        found = []
        for i, counts, size in held:
            m = 100 - 25 + (25 * size * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 12 * m))
                for t in terms_of(text) if t in counts
            )
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:top])]
    return out


def rows_of(frame):
    return sorted(map(tuple, frame.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_query_matches_sql(spark, sf_dir):
    assert compare(spark, connect(sf_dir), sf_dir, QUERIES["op11_lexical"], ORACLES["op11_lexical"]) is None


@settings(max_examples=200, deadline=None, database=None)
@given(st.text(st.sampled_from(list("abAZ09 -_/@[`{~\x7f\x80éÉß😀\n\0")), max_size=60), st.integers(1, 9))
def test_terms(text, size):
    old, lexical.SLICE = lexical.SLICE, size
    try:
        got = [t.decode() for part in lexical.term_slices(text.encode()) for t in part]
    finally:
        lexical.SLICE = old
    assert got == terms_of(text)


def collection(n=700, seed=2):
    """Some words in nearly every document, some in few; many equal scores."""
    draw = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)]
    weights = 1 / np.arange(1, 61)
    weights /= weights.sum()
    return [(int(i), " ".join(draw.choice(words, draw.integers(1, 30), p=weights))) for i in draw.permutation(n)]


@pytest.mark.parametrize("window, share, block", [(4, 8, 50), (16, 2, 4096), (128, 1000, 64), (8, 1, 30)])
def test_skipping_loses_nothing(spark, monkeypatch, window, share, block):
    docs = collection()
    items = [(k, f"w{k} w{k + 7} W{59 - k} w0 w0 w1 none") for k in range(12)] + [(50, "w0"), (51, "w55 w56"), (52, "nothing")]
    vocabulary, wanted = {}, []
    for item, text in items:
        counts = Counter(t.encode() for t in terms_of(text))
        wanted.append((item, np.array([vocabulary.setdefault(t, len(vocabulary)) for t in counts], np.int32), np.array(list(counts.values()))))
    monkeypatch.setattr(lexical, "WINDOW", window)
    monkeypatch.setattr(lexical, "LONG_SHARE", share)
    filing, blocks = lexical._Filing(vocabulary), []
    import pyarrow as pa

    for i, (d, t) in enumerate(docs):
        filing.add(d, t.encode())
        if len(filing.ids) >= block or i == len(docs) - 1:
            blocks.append(filing.batch(pa.int64()).to_pylist()[0])
    dfs = np.zeros(len(vocabulary), np.int64)
    for b in blocks:
        dfs[np.frombuffer(b["terms"], np.int32)] += np.diff(np.frombuffer(b["starts"], np.int64))
    n, total = len(docs), sum(len(t.split()) for _, t in docs)
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in dfs.tolist()], np.int64)
    best = [lexical._Best(20) for _ in wanted]
    for b in blocks:
        lists = lexical._Lists(b, weights, n, total)
        for (_, terms, times), mine in zip(wanted, best):
            lists.search(terms, times, mine)
    got = [(item, r + 1, row[2], -row[0]) for (item, _, _), mine in zip(wanted, best) for r, row in enumerate(mine.rows)]
    assert got == direct(docs, items)


def test_batches_and_blocks_by_brute_force(spark, monkeypatch):
    docs = collection(200, 5)
    items = [(k % 7, f"w{k} w{2 * k} w3") for k in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    asked = spark.createDataFrame(items, "item_id int, text string")
    assert rows_of(lexical.search(frame, asked, batch_bytes=60, top=5)) == sorted(direct(docs, items, 5), key=str)


def test_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    items = [(1, "alpha1 BETA2 omega"), (1, "alpha1 BETA2 omega"), (2, None), (3, ""), (None, "é😀 x"), (4, "long" * 30_000), (5, "--")]
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS row", "'q' AS query", "2 AS rank")
    want = sorted(direct(rows, [i for i in items if i[1]]), key=str)
    assert rows_of(lexical.search(odd, asked)) == want
    assert lexical.search(empty, asked).count() == 0
    assert lexical.search(odd, asked.where("false")).count() == 0


def test_very_long_documents_keep_whole_numbers():
    lengths = np.array([5, 10**7], np.int64)
    n, total = 10**11, 10**14
    assert lexical.length_norms(lengths, n, total).tolist() == [75 + 25 * x * n // total for x in (5, 10**7)]
