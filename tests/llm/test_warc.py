"""Round trips, SQL, and damaged archives."""

import gzip
import hashlib
import random

import pytest
from oracle_check import compare, connect

from corpuscope.llm import warc
from corpuscope.llm.queries import ORACLES, QUERIES
from corpuscope.session import run_dir


def record(i: int, payload: bytes) -> bytes:
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def seen(data: bytes):
    """(ids of records, gaps) and whether both cover the file in order."""
    found = list(warc.salvage(data))
    at = 0
    for start, end, _, _ in found:
        assert start in (at, at - (end - start)) or start == at
        at = end
    assert at == len(data)
    ids = [r["fields"]["warc-record-id"] for _, _, r, _ in found if r]
    return ids, [(s, e) for s, e, r, _ in found if r is None]


def names(*ids):
    return [f"<urn:page:{i}>" for i in ids]


def test_sound_files():
    records = [record(i, bytes(200)) for i in range(4)]
    assert seen(b"".join(records)) == (names(0, 1, 2, 3), [])
    assert seen(b"".join(map(warc.gzip_member, records))) == (names(0, 1, 2, 3), [])
    assert seen(b"".join(map(gzip.compress, records))) == (names(0, 1, 2, 3), [])


@pytest.mark.parametrize("at", [0, 7, 50, -3])
def test_a_damaged_plain_record_is_passed_over(at):
    records = [record(i, b"p" * 50) for i in range(4)]
    bad = bytearray(records[1])
    bad[at] ^= 0xFF
    records[1] = bytes(bad)
    ids, gaps = seen(b"".join(records))
    a, b = len(records[0]), len(records[0]) + len(records[1])
    if at == 50:  # inside the id: the header still holds
        assert len(ids) == 4 and gaps == []
    else:
        assert ids == names(0, 2, 3) and gaps == [(a, b)]


def test_a_damaged_member_is_passed_over():
    text = " ".join(str(random.Random(5).random()) for _ in range(60)).encode()
    members = [warc.gzip_member(record(i, text)) for i in range(4)]
    bad = bytearray(members[1])
    bad[40] ^= 0xFF
    ids, gaps = seen(b"".join([members[0], bytes(bad), *members[2:]]))
    assert ids == names(0, 2, 3)
    assert gaps == [(len(members[0]), len(members[0]) + len(members[1]))]


def noise(i: int) -> bytes:
    return random.Random(i).randbytes(3000)


def test_a_damaged_record_in_a_member_of_several_is_passed_over():
    records = [record(i, noise(i)) for i in range(5)]
    sizes = [len(r) for r in records]
    records[2] = records[2].replace(b"Content-Length: 3000", b"Content-Length: 9999")
    member = gzip.compress(b"".join(records))
    after = gzip.compress(record(9, b"after"))
    ids, gaps = seen(member + after)
    assert ids == names(0, 1, 3, 4, 9) and gaps == [(0, len(member))]
    why = next(w for _, _, r, w in warc.salvage(member + after) if r is None)
    assert why.endswith(f"(bytes {sum(sizes[:2])} to {sum(sizes[:3])} of the inflated member)")


@pytest.mark.parametrize("level", [0, 6])
def test_a_cut_archive_of_one_stream_keeps_its_records(level):
    member = gzip.compress(b"".join(record(i, noise(i)) for i in range(60)), level)
    cut = member[: len(member) // 2]
    ids, gaps = seen(cut)
    assert 28 <= len(ids) <= 30 and ids == names(*range(len(ids))) and gaps == [(0, len(cut))]
    assert all(r["block"] == noise(i) and r["digest_ok"] is None for i, (_, _, r, _) in enumerate(warc.salvage(cut)) if r)


def test_a_stream_with_an_error_keeps_the_records_that_hold():
    digest = b"WARC-Block-Digest: sha256:%s\r\nContent-Length"
    records = [record(i, noise(i)) for i in range(60)]
    records = [r.replace(b"Content-Length", digest % hashlib.sha256(noise(i)).hexdigest().encode()) if i % 2 else r for i, r in enumerate(records)]
    after = gzip.compress(record(99, b"after"))
    member = gzip.compress(b"".join(records))
    wrong_sum = member[:-8] + bytes(b ^ 0xFF for b in member[-8:-4]) + member[-4:]
    found = [r for _, _, r, _ in warc.salvage(wrong_sum + after) if r]
    assert [r["fields"]["warc-record-id"] for r in found] == names(*range(1, 60, 2), 99)
    assert [r["digest_ok"] for r in found] == [True] * 30 + [None]
    ids, gaps = seen(wrong_sum + after)
    assert set(gaps) == {(0, len(wrong_sum))}
    garbled = member[:100_000] + b"\xff" * 3_000 + member[103_000:]
    ids, gaps = seen(garbled + after)
    assert set(names(*range(30), 99)) <= set(ids) and len(gaps) >= 1
    assert [r["digest_ok"] for _, _, r, _ in warc.salvage(garbled) if r][:30] == [i % 2 == 1 for i in range(30)]


def test_length_too_long_digest_wrong_cut_and_junk():
    good = record(1, b"abc")
    long = record(0, b"x").replace(b"Content-Length: 1", b"Content-Length: 9")
    wrong = record(0, b"x").replace(b"WARC-Type", b"WARC-Block-Digest: sha256:00\r\nWARC-Type")
    for bad in (long, wrong, b"junk", b"\x1f\x8b\x08 no member", record(0, b"x")[:-6], b"WARC/1.0\r\n"):
        ids, gaps = seen(bad + good)
        assert ids == names(1) and gaps == [(0, len(bad))]
        ids, gaps = seen(good + bad)
        assert ids == names(1) and gaps == [(len(good), len(good) + len(bad))]
    assert [x[3] for x in warc.salvage(b"")] == ["empty file"]
    assert seen(b"nothing here") == ([], [(0, 12)])


def test_version_line_inside_a_payload_is_payload():
    inner = record(9, b"inside")
    assert seen(record(0, inner) + record(1, b"")) == (names(0, 1), [])


def test_sixteen_mebibytes_end_in_a_zero_byte():
    big = record(0, bytes(1 << 24))
    member = warc.gzip_member(big)
    assert member.endswith(b"\0") and gzip.decompress(member) == big


def test_query_matches_sql(spark, sf_dir):
    assert compare(spark, connect(sf_dir), sf_dir, QUERIES["op1_warc"], ORACLES["op1_warc"]) is None


@pytest.mark.parametrize("gz", [True, False])
def test_odd_pages(spark, gz):
    long = "a\r\nWARC/1.1\r\n" * 50
    pages = [(1, long), (2, long), (3, None), (4, ""), (5, None), (None, long), (6, "é" * 49), (7, "é" * 49), (8, "é" * 50), (9, "é" * 50), (9, "é" * 50)]
    df = spark.createDataFrame(pages, "page_id long, html string").selectExpr("*", "7 AS id", "'x' AS payload")
    folder = run_dir(spark, "warc-test")
    warc.write_archives(warc.with_revisits(df), folder, gzip=gz, rows_per_archive=3)
    read = warc.read_archives(spark, folder)
    assert read.where("gap IS NOT NULL").count() == 0 and read.select("path").distinct().count() > 1
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.page_records(read).collect()), key=repr)
    want = [
        (1, len(long), "response", None), (2, len(long), "revisit", 1), (3, 0, "response", None), (4, 0, "response", None),
        (5, 0, "response", None), (None, len(long), "response", None), (6, 98, "response", None), (7, 98, "response", None),
        (8, 100, "response", None), (9, 100, "revisit", 8), (9, 100, "revisit", 8),
    ]
    assert got == sorted(want, key=repr)


def test_gaps_are_logged_by_the_reader(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record(1, b"one") + b"broken" + record(2, b"two"))
    rows = warc.read_archives(spark, f"file://{tmp_path}").orderBy("start").collect()
    assert [r.record_id for r in rows] == ["<urn:page:1>", None, "<urn:page:2>"]
    assert rows[1].gap and (rows[1].start, rows[1].end) == (len(record(1, b"one")), len(record(1, b"one")) + 6)


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, html string")
    folder = run_dir(spark, "warc-test")
    warc.write_archives(warc.with_revisits(df), folder)
    assert warc.page_records(warc.read_archives(spark, folder)).count() == 0
