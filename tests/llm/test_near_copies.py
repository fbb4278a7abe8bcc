"""Jaccard join, suffix-array removal and embeddings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

from corpuscope.llm import embedding_dedup, jaccard_join, suffix_dedup
from corpuscope.llm.common import bucketed
from corpuscope.llm.components import components
from corpuscope.llm.queries import ORACLES, QUERIES
from corpuscope.llm.shingles import buffers, shingle_hashes, word_hashes
from corpuscope.session import materialize


def roots_of(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(5, 5)]
    want = {k: v for k, v in roots_of({x for p in pairs for x in p}, pairs).items()}
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {k: v for k, v in want.items() if k in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_are_those_of_the_words(monkeypatch):
    from corpuscope.llm import shingles

    rng = random.Random(3)
    texts = [b"".join(rng.choice([b"a", b"b", b" ", b"\n", b"cde", "é".encode()]) for _ in range(rng.choice([0, 1, 5, 40, 400]))) for _ in range(200)]
    texts += [b"x" * 50, b"  ", b"", b"q w e r t"]
    for piece in (1 << 20, 64, 7):
        monkeypatch.setattr(shingles, "PIECE", piece)
        data, offsets = buffers(pa.array([None, *texts], pa.binary()).slice(1))
        words, at = word_hashes(data, offsets)
        found, bounds = shingle_hashes(data, offsets)
        known = {}
        for i, text in enumerate(texts):
            w = text.split()
            assert at[i + 1] - at[i] == len(w)
            want = [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
            assert bounds[i + 1] - bounds[i] == len(want)
            for a, b in zip(want, found[bounds[i] : bounds[i + 1]].tolist()):
                assert known.setdefault(a, b) == b
        assert len(set(known.values())) == len(known)


# --- Jaccard join -------------------------------------------------------------------


def shingle_set(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_links(texts):
    sets = [shingle_set(t) for t in texts]
    return [
        (i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
        and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])
    ]


def check_links(rows, docs):
    """rows: (doc_id, class_id, n_links) against all pairs of (doc_id, text)."""
    pairs = [(docs[i][0], docs[j][0]) for i, j in brute_links([t for _, t in docs])]
    counts = Counter(x for p in pairs for x in p)
    roots = roots_of([d for d, _ in docs], pairs)
    assert {d: (c, n) for d, c, n in rows} == {d: (roots[d], counts[d]) for d, _ in docs}


def test_join_over_whole_table(spark, sf_dir):
    rows = QUERIES["op4_jaccard_join"](spark, sf_dir).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_links([(r.doc_id, r.class_id, r.n_links) for r in rows], docs)
    assert sum(r.kept for r in rows) == len({r.class_id for r in rows})


def test_large_nodes_are_compared_in_blocks(spark):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for d in range(90):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(120)] = f"x{rng.randrange(3)}"
        docs.append((d, " ".join(words)))
    df = materialize(spark.createDataFrame(docs, "doc_id long, text string"), "join-test")
    rows = jaccard_join.link(df, small=8, depth=2).collect()
    check_links([(r.doc_id, r.class_id, r.n_links) for r in rows], docs)


def test_runs_follow_from_the_target():
    assert jaccard_join.runs_needed(0.8, 1, 0.9) < jaccard_join.runs_needed(0.8, 4, 0.9) < jaccard_join.runs_needed(0.8, 4, 0.9999)


def test_runs_allow_for_sketches_that_agree_on_few_positions():
    runs, rng = jaccard_join.runs_needed(0.8, 4, 0.9999), np.random.default_rng(6)
    share = rng.binomial(64, 0.8, 400_000) / 64
    lost = 0.0
    for _ in range(4):
        gone = 1.0 - share + share * lost
        lost = 0.75 * gone + 0.25 * gone * gone
    assert (lost**runs).mean() <= 1.1e-4 < (lost ** (runs - 2)).mean()


def test_join_of_odd_rows(odd, empty):
    rows = jaccard_join.link(odd, keep=("text", "row")).collect()
    assert len(rows) == odd.count()
    same = odd.where("doc_id = 1").head().text
    for r in rows:
        if not shingle_set(r.text):
            assert r.n_links == 0 and r.kept
        if r.text == same:
            assert (r.class_id, r.text_class, r.n_links) == (1, 1, 3)
        if r.doc_id == 6:
            assert (r.class_id, r.n_links) == (1, 3)
    assert jaccard_join.link(empty).count() == 0


# --- suffix arrays --------------------------------------------------------------------


def brute_removed(docs, length=50):
    seen, out = {}, {}
    for order in sorted({d for d, _ in docs}):
        new = {}
        for d, t in docs:
            if d != order:
                continue
            data = t.encode() if isinstance(t, str) else t or b""
            gone = np.zeros(len(data), bool)
            for i in range(len(data) - length + 1):
                if data[i : i + length] in seen:
                    gone[i : i + length] = True
                new[data[i : i + length]] = True
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
            out.setdefault(d, []).append((len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
        seen |= new
    return {d: sorted(v) for d, v in out.items()}


def test_suffix_order_is_the_sorted_order():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 30))) for _ in range(40)]
    stops = np.cumsum([len(s) + 1 for s in strings]) - 1
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.uint16) + 1
    text[stops] = 0
    suffixes = [(s[k:], i) for i, s in enumerate(strings) for k in range(len(s) + 1)]
    order = suffix_dedup.suffix_order(text, stops)
    assert [suffixes[p] for p in order] == sorted(suffixes)


@pytest.mark.parametrize("shard", [40, 200, 10**6])
def test_merged_transforms_find_the_earliest(shard):
    rng = random.Random(shard)
    block = [bytes(rng.choice(b"abc") for _ in range(30)) for _ in range(6)]
    segments = [b"".join(rng.choice(block) for _ in range(rng.randrange(1, 5))) + bytes([rng.randrange(256)]) for _ in range(40)]
    owners = np.array([rng.randrange(10) for _ in segments])
    length = 12
    least = {}
    for s, o in zip(segments, owners.tolist()):
        for i in range(len(s) - length + 1):
            least[s[i : i + length]] = min(o, least.get(s[i : i + length], o))
    got = suffix_dedup.earliest(segments, owners, length, shard)
    assert [g.tolist() for g in got] == [[least[s[i : i + length]] for i in range(len(s) - length + 1)] for s in segments]


def test_merge_refines_to_the_sorted_interleave():
    strings = [b"banana", b"ananas", b"bandana", b"nab"]
    transforms, suffixes = [], []
    for s in strings:
        text = np.r_[np.frombuffer(s, np.uint8).astype(np.uint16) + 1, 0].astype(np.uint16)
        order = suffix_dedup.suffix_order(text, np.array([len(s)]))
        transforms.append(np.where(order > 0, text[order - 1], 0))
        suffixes += [s[p:] for p in order]
    places, border = suffix_dedup.merge_transforms(transforms, [1] * 4, 3)
    merged = [b""] * len(places)
    for suffix, place in zip(suffixes, places):
        merged[place] = suffix
    assert [m[:3] for m in merged] == sorted(m[:3] for m in merged)
    for a, b, new in zip(merged, merged[1:], border[1:]):
        assert new == (a[:3] != b[:3] or len(a) < 3)


def test_removal_over_whole_table(spark, sf_dir):
    rows = QUERIES["op2_suffix_dedup"](spark, sf_dir).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert {r.doc_id: [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)] for r in rows} == brute_removed(docs)


def test_removal_of_shifted_and_overlapping_passages(spark):
    rng = random.Random(11)
    passages = ["".join(rng.choice("abcdefghij é") for _ in range(rng.randrange(40, 90))) for _ in range(8)]
    docs = []
    for d in range(60):
        parts = [rng.choice(passages)[rng.randrange(0, 20) :] + rng.choice(["", "x", "é"]) for _ in range(rng.randrange(1, 5))]
        docs.append((d // 2 if d % 7 == 0 else d, "".join(parts)))
    docs += [(70, "-" * 400), (71, "-" * 130), (72, "ab" * 100), (73, "b" + "ab" * 80), (1, docs[5][1])]
    df = materialize(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), "cut-test")
    got = {}
    for r in suffix_dedup.remove_repeats(df).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert {d: sorted(v) for d, v in got.items()} == brute_removed(docs)


@pytest.mark.parametrize("crowded", [20, 3, 1])
def test_a_crowded_hash_is_no_single_task(spark, monkeypatch, crowded):
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    gathered = []
    merged_of = suffix_dedup._merged
    monkeypatch.setattr(suffix_dedup, "_merged", lambda segments, length: gathered.append(segments) or merged_of(segments, length))
    rng = random.Random(13)

    def noise(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))

    # A line too short to repeat, a longer one that does, one many times in one text.
    short, long = "all rights reserved, see the licence here", "this longer line of sixty bytes is in many of the texts here"
    docs = [(d, noise(60) + short + noise(60) + (long if d % 3 == 0 else "") + noise(30)) for d in range(60)]
    docs += [(70, "".join(noise(20) + "printed in the same text" for _ in range(30))), (71, noise(40) + "printed in the same text" + noise(40))]
    docs += [(72, docs[4][1][20:120]), (9, noise(80) + long)]
    df = materialize(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), "crowd-test")
    got = {}
    for r in suffix_dedup.remove_repeats(df).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert {d: sorted(v) for d, v in got.items()} == brute_removed(docs)
    # No group that was dealt again has more different segments than a task may merge.
    assert len(gathered) > 2
    for segments in gathered[1:]:
        sizes = segments.groupBy("grp").agg(F.countDistinct("segment").alias("n")).collect()
        assert max((r.n for r in sizes), default=0) <= crowded


def test_removal_of_odd_rows(odd, empty):
    rows = suffix_dedup.remove_repeats(odd, with_text=True, keep=("size", "lang")).collect()
    assert rows[0].asDict().keys() == {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "size", "lang"}
    docs = [(2**62 if r.doc_id is None else r.doc_id, r.text) for r in odd.collect()]
    got = {}
    for r in rows:
        got.setdefault(2**62 if r.doc_id is None else r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
        assert len(r.text.encode()) <= r.n_bytes - r.n_removed
    assert {d: sorted(v) for d, v in got.items()} == brute_removed(docs)
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("at_once", [256, 1000])
def test_a_text_is_cut_the_same_beside_any_others(monkeypatch, at_once):
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", at_once)
    rng = random.Random(21)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(n)).encode() for n in (0, 49, 50, 300, 1700, 90, 2500, 700)]

    def cut(these):
        data, offsets = np.frombuffer(b"".join(these), np.uint8), np.cumsum([0, *map(len, these)])
        found = {}
        for text, start, count, h in suffix_dedup.runs(data, offsets):
            for t, s, c, k in zip(text.tolist(), (start - offsets[text]).tolist(), count.tolist(), h.tolist()):
                found.setdefault(t, []).append((s, c, k))
        return found

    for k, text in enumerate(texts):
        alone = cut([text]).get(0, [])
        assert sum(c for _, c, _ in alone) == max(0, len(text) - 49)
        assert cut(texts[::-1]).get(len(texts) - 1 - k, []) == alone == cut(texts).get(k, [])


def test_filed_hashes_of_two_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWDED", 12)
    rng = random.Random(22)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(70)) for _ in range(12)]
    texts = ["".join(rng.choice(passages)[rng.randrange(9) :] for _ in range(4)) + str(d) * 9 for d in range(40)] + ["-" * 200, "", "short"]
    df = spark.createDataFrame([(d * 2**33, t.encode()) for d, t in enumerate(texts)], "row long, text binary").repartition(3)
    filed = suffix_dedup._shared_hashes(materialize(df, "filed-test"), 50)
    # Hashes cross the network in packs, not a row each.
    assert "Window" not in filed._jdf.queryExecution().executedPlan().toString()
    rows = {r.row: sorted(r.hashes) for r in filed.collect()}
    of, n = {}, {}
    for d, t in enumerate(texts):
        for _, _, _, h in suffix_dedup.runs(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])):
            for k in h.tolist():
                of.setdefault(k, set()).add(d * 2**33)
                n[k] = n.get(k, 0) + 1
    expected = {}
    for k, those in of.items():
        for d in those if len(those) > 1 else ():
            expected.setdefault(d, []).append(k)
    many = sorted(k for k in of if len(of[k]) > 1 and n[k] > 12)
    assert many and rows.pop(None) == many
    assert rows == {d: sorted(v) for d, v in expected.items()}


def test_few_files_of_many_splits(spark):
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(spark.sparkContext.defaultParallelism, buckets // 8)
    rows = materialize(spark.range(0, 6000, 1, 8 * tasks).withColumnRenamed("id", "row"), "splits-test").repartition(8 * tasks)
    stored = bucketed(rows, "row", "splits")
    assert len(stored.inputFiles()) <= tasks * buckets
    assert sorted(r.row for r in stored.collect()) == list(range(6000))


# --- embeddings -----------------------------------------------------------------------


def test_embeddings_match_sql(spark, sf_dir):
    assert compare(spark, connect(sf_dir), sf_dir, QUERIES["op7_embedding_dedup"], ORACLES["op7_embedding_dedup"]) is None


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(0)
    hub = rng.standard_normal(8)
    rows = [(1, hub.tolist(), 1), (2, (hub * 3).tolist(), 2), (2, hub.tolist(), None), (3, (hub + 0.05 * rng.standard_normal(8)).tolist(), 1)]
    rows += [(4, (-hub).tolist(), 1), (5, None, 1), (6, [], 1), (7, [0.0] * 8, 1), (8, [nan] + [1.0] * 7, 1), (9, [inf] * 8, 1)]
    rows += [(10, [None] + [1.0] * 7, 1), (11, hub[:4].tolist(), 1), (12, hub[:4].tolist(), 1), (None, (hub * 1e300 / np.abs(hub).max()).tolist(), 1), (13, (hub * 1e-300).tolist(), 1)]
    df = materialize(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep int"), "vec-test")
    got = embedding_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    for i in (1, 2, 3, 13, None):
        assert all(n == 5 and c == 1 for n, c, _ in by_id[i])
    for i in (4, 5, 6, 7, 8, 9, 10):
        assert by_id[i] == [(0, i, True)]
    assert by_id[11] == [(1, 11, True)] and by_id[12] == [(1, 11, False)]
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_clusters_larger_than_window_and_block(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(1)
    hubs = rng.standard_normal((3, 32))
    vectors = np.concatenate([h + 0.12 * rng.standard_normal((70, 32)) for h in hubs] + [rng.standard_normal((90, 32))])
    df = materialize(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"), "vec-test")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    roots = roots_of(range(len(vectors)), zip(*np.nonzero(near)))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, window=6).collect()}
    assert got == {i: (int(near[i].sum()), roots[i]) for i in range(len(vectors))}


def test_neighbours_meet_over_the_borders_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rng = np.random.default_rng(11)
    vectors = rng.standard_normal((120, 6))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    classes = materialize(spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(vectors)], "rep long, unit binary").repartition(5), "vec-test")
    keys = materialize(embedding_dedup._cells(classes, 3, 10), "vec-test")
    ordered = sorted((r.dim, r["pass"], r.key, r.rep) for r in keys.collect())
    for window in (1, 5, 20):
        want = set()
        for i, (dim, pass_, _, a) in enumerate(ordered):
            for _, other, _, b in ordered[i + 1 : i + 1 + window]:
                if other == pass_ and vectors[a] @ vectors[b] >= 0.8:
                    want.add((min(a, b), max(a, b)))
        edges = embedding_dedup._window_links(keys, classes, 0.8, window).collect()
        got = roots_of(range(120), [(r.a, r.b) for r in edges])
        assert want and got == roots_of(range(120), want)


def test_links_of_a_component_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 4)
    monkeypatch.setattr(embedding_dedup, "LINK_BLOCK", 16)
    rng = np.random.default_rng(4)
    vectors = np.array([1.0, 0, 0]) + rng.standard_normal((90, 3)) * 0.2
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    df = materialize(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"), "vec-test")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    near = vectors @ vectors.T >= 0.95
    assert got == {i: int(near[i].sum()) - 1 for i in range(90)}


@pytest.mark.parametrize("most", [None, 7])
def test_pairs_in_a_dense_cone_meet(spark, monkeypatch, most):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    if most:  # by passes of many planes, too
        monkeypatch.setattr(embedding_dedup, "_cheapest_bits", lambda *_: most, raising=False)
    rng = np.random.default_rng(3)
    # A narrow cone below the threshold, and a second vector at about 0.953 to every tenth.
    cone = rng.standard_normal(64) * 2.6 + rng.standard_normal((3000, 64))
    cone /= np.linalg.norm(cone, axis=1, keepdims=True)
    planted = cone[::10] + 0.0395 * rng.standard_normal((len(cone[::10]), 64))
    vectors = np.concatenate([cone, planted])
    df = materialize(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"), "vec-test")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    assert 60 < near.any(axis=1).sum() < len(vectors) / 2
    roots = roots_of(range(len(vectors)), zip(*np.nonzero(near)))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, window=4).collect()}
    assert got == {i: (int(near[i].sum()), roots[i]) for i in range(len(vectors))}


def test_pieces_are_hashed_in_bounded_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    piece = rng.integers(97, 101, 3 * suffix_dedup.HASHED + 77).astype(np.uint8)
    hash_of, sizes = suffix_dedup._piece_hashes, []
    monkeypatch.setattr(suffix_dedup, "_piece_hashes", lambda eight, n: sizes.append(n) or hash_of(eight, n))
    for n in (50, 51, suffix_dedup.HASHED + 48, suffix_dedup.HASHED + 49, suffix_dedup.HASHED + 50, len(piece)):
        padded = np.r_[piece[:n], np.zeros(8, np.uint8)]
        eight = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n].copy().view(np.uint64).ravel()
        each = np.lib.stride_tricks.sliding_window_view(hash_of(eight, n), 35)
        assert np.array_equal(suffix_dedup._least_hashes(piece[:n], 50), each.min(axis=1))
    assert max(sizes) < suffix_dedup.HASHED + 50


def test_digests_agree_with_keys():
    groups, segments = np.array([-(2**63), -1, 0, 7, 2**63 - 1]), [b"", b"a", b"ab" * 60, b"x" * 200, b"\0" * 8]
    digests = [suffix_dedup._digest(s, g) for s, g in zip(segments, suffix_dedup._group_bytes(groups))]
    assert list(zip(*(k.tolist() for k in suffix_dedup._keys(digests)))) == [suffix_dedup._key(s, g) for s, g in zip(segments, groups.tolist())]
    assert len(set(digests)) == 5
    assert [len(k) for k in suffix_dedup._keys([])] == [0, 0]
