"""Anchors and likeness against a direct reading."""

import hashlib

import xxhash
from pyspark.sql import functions as F

from corpuscope.llm import syncmers
from corpuscope.llm.queries import QUERIES


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def hash_text(text):
    return signed(xxhash.xxh64_intdigest(text.encode(), 42))


def hash_pair(a, b):
    first = xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True), 42)
    return xxhash.xxh64_intdigest(b.to_bytes(8, "little", signed=True), first) >> 32


def anchors(text):
    s, w = syncmers.INNER, syncmers.INNERS
    h = [hash_text(text[i : i + s]) for i in range(len(text) - s + 1)]
    closed = [i for i in range(len(h) - w + 1) if min(h[i : i + w]) in (h[i], h[i + w - 1])]
    return sorted({hash_pair(h[i], h[i + w - 1]) for i in closed})


def sketch(text):
    found = anchors(text)
    if not found and text:
        return [xxhash.xxh64_intdigest(text.encode(), 42) >> 32]
    return found[: syncmers.KEPT]


def likeness(a, b):
    if not a and not b:
        return 1.0
    union = sorted({*a, *b})[: syncmers.KEPT]
    return len([x for x in union if x in a and x in b]) / len(union)


def expected(docs):
    """docs: (id, text) in order of descending id."""
    out = []
    for i, (d, t) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        a, b, c = sketch(t), sketch(edited), sketch(after)
        strings = ["".join(f"{x:08x}" for x in s) for s in (a, b)]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), *strings, round(likeness(a, b), 9), round(likeness(a, c), 9)))
    return out


def rows_of(df):
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint")
    return [(*[r[n] for n in names], round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()]


def test_query_by_direct_reading(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy(F.desc("doc_id")).collect()
    got = rows_of(QUERIES["op8_syncmers"](spark, sf_dir))
    assert sorted(got) == sorted(expected([tuple(d) for d in docs]))
    assert sum(r[5] for r in got) / len(got) > 0.4 > 0.1 > sum(r[6] for r in got) / len(got)


def test_short_long_and_wide_texts(spark):
    texts = ["", "a", "abcdefg", "abcdefgh", "abcdefghijklmn", "abcdefghijklmno", "😀é" * 30, "ab" * 40_000, "a\nb" * 20, "", "a"]
    docs = [(100 - i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    from corpuscope.session import materialize

    assert sorted(rows_of(syncmers.fingerprints(materialize(df, "sync-test")))) == sorted(expected(docs))


def test_anchors_do_not_depend_on_context(spark):
    passage = "the quick brown fox jumps over the lazy dog and runs away again"
    df = spark.createDataFrame([(passage,), ("zzz " + passage + " qqq",)], "text string")
    alone, inside = (set(r[0]) for r in df.select(syncmers.anchors(F.col("text"))).collect())
    assert alone and alone <= inside


def test_odd_rows_and_empty_table(odd, empty):
    rows = syncmers.fingerprints(odd).collect()
    assert len(rows) == odd.count()
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 2)}) == 1
    assert all(r.fingerprint == "" and r.n_chars == 0 for r in rows if r.doc_id in (3, 4))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert syncmers.fingerprints(empty).count() == 0


def test_only_native_functions(spark, sf_dir):
    import io
    from contextlib import redirect_stdout

    from corpuscope.llm import kd_sharding, mixing

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in (syncmers.fingerprints(docs), kd_sharding.shards(docs, n_leaves=5), mixing.mix(docs)):
        text = io.StringIO()
        with redirect_stdout(text):
            df.explain("extended")
        assert not any(word in text.getvalue() for word in ("Python", "Pandas", "ArrowEval"))


def test_no_interpreted_sort_or_window_arrays(spark, sf_dir):
    import io
    from contextlib import redirect_stdout

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in (syncmers.fingerprints(docs), docs.select(syncmers.sketch(syncmers.placed_anchors(F.col("text"))["hashes"], F.col("text")))):
        text = io.StringIO()
        with redirect_stdout(text):
            df.explain("extended")
        assert "sort_array(" in text.getvalue()
        assert not any(word in text.getvalue() for word in ("array_sort(", "zip_with("))
