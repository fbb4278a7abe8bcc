"""WARC archives: writing records, and a reader that salvages damaged files.

Archives are plain (records follow each other) or gzip; the writer makes one member per
record, the reader takes members of any number of records, such as a plain archive that
was gzipped as a whole. The reader trusts nothing: a record counts only if its version
line, header block, length, end mark and block digest (where given) hold. After a failed
check it searches for the next place where a record or member can start, goes on there,
and reports the bytes passed over as a quarantined gap. Inside a member it searches the
inflated bytes in the same way, also those of a member that is cut off or damaged. If a
member fails its checksum, only records whose own digest holds count, as the damage may
be anywhere; of those before a place that does not inflate, a record without a digest
has ``digest_ok`` false, as nothing vouches for its bytes.

Writing goes through Spark's text sink, so it reaches any file system Spark can write.
Its line separator is the last byte of each record: LF for plain files; for gzip the
zero byte that ends a member of less than 16 MiB (a longer one gets an empty member
behind it, which ends in zero too).

Defined results: a null payload is an empty one; repeated rows, and rows of one page id,
are records of their own; a null page id is written as "none", read as null, and never
the response that others refer to; other columns are ignored; an empty table gives no archive; an empty or unreadably short file is one gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = re.compile(rb"WARC/1\.[01]\r\n")
CUT_OFF = "member runs past the end"
GZIP_START = b"\x1f\x8b\x08"
# Payloads shorter than this are never made revisits.
MIN_REVISIT_BYTES = 100
# Rows per archive file; a file is read by one task.
ROWS_PER_ARCHIVE = 4_000
_DATE = "2024-01-01T00:00:00Z"  # fixed: archives of equal pages are equal
_EMPTY_MEMBER = zlib.compressobj(9, zlib.DEFLATED, 31).flush()

RECORD = (
    "path string, start long, end long, record_id string, type string, uri string, refers_to string,"
    " payload_digest string, payload_length long, payload binary, digest_ok boolean, gap string"
)
_FIELDS = [f.strip().split(" ")[0] for f in RECORD.split(",")]


# --- writing ------------------------------------------------------------------


def with_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(id, payload, payload_bytes, payload_digest, record_type, refers_to) of each row.

    Of rows with equal payloads of at least 100 bytes the smallest id is the response.
    Sizes and digests aggregate map-side; a payload shared by a third of all rows is
    one row per task there, and Spark splits its side of the join.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    digests = rows.select("id", "payload_digest", "payload_bytes").where(F.col("payload_bytes") >= MIN_REVISIT_BYTES)
    first = digests.groupBy("payload_digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    first = first.where(F.col("n") > 1).drop("n")
    joined = rows.join(first, "payload_digest", "left")
    revisit = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return joined.select(
        "id", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def record_id(id_: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(id_.cast("string"), F.lit("none")), F.lit(">"))


def write_archives(records: DataFrame, path: str, gzip: bool = True, rows_per_archive: int = ROWS_PER_ARCHIVE) -> None:
    """Writes rows of :func:`with_revisits` as WARC records, many archives at once."""
    # A revisit has no block of its own: the payload's size and digest say what it was.
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    headers = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("id"))),
        F.lit(f"WARC-Date: {_DATE}"),
        F.concat(F.lit("WARC-Target-URI: urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none"))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.concat(F.lit("WARC-Block-Digest: sha256:"), F.sha2("block", 256)),
        F.concat(F.lit("WARC-Refers-To: "), F.when(F.col("refers_to").isNotNull(), record_id(F.col("refers_to")))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    ]
    head = F.concat(F.concat_ws("\r\n", *headers), F.lit("\r\n\r\n")).cast("binary")
    rows = records.withColumn("block", block).select(F.concat(head, F.col("block"), F.lit(b"\r\n\r\n")).alias("record"))
    if gzip:
        rows = rows.mapInArrow(_members, "record binary")
        end = "\0"
    else:
        rows = rows.select(F.expr("substring(record, 1, octet_length(record) - 1)").alias("record"))
        end = "\n"
    # Bytes stay as they are: the text sink writes what the string holds.
    text = rows.select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", end).option("maxRecordsPerFile", rows_per_archive).text(path)


def gzip_member(record: bytes) -> bytes:
    """One gzip member (or two), ending in a zero byte."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = packer.compress(record) + packer.flush()
    return member if member.endswith(b"\0") else member + _EMPTY_MEMBER


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [gzip_member(r)[:-1] for r in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["record"])


# --- salvage --------------------------------------------------------------------


class Damage(Exception):
    """Why the bytes at a place are no sound record."""


def _digest_ok(given: str | None, data: bytes) -> bool | None:
    """Whether a labelled digest fits; null for none or an algorithm not known here."""
    name, _, value = (given or "").partition(":")
    if not value or name.lower() not in ("sha1", "sha256", "md5"):
        return None
    made = hashlib.new(name.lower(), data)
    return value.lower() == made.hexdigest() or value.upper().rstrip("=") == base64.b32encode(made.digest()).decode().rstrip("=")


def parse_record(data: memoryview, start: int) -> tuple[dict, int]:
    """The record at ``start`` and where it ends; raises :class:`Damage`."""
    line = VERSION.match(data, start)
    if not line:
        raise Damage("no version line")
    head_end = _find(data, b"\r\n\r\n", line.end())
    if head_end < 0:
        raise Damage("header without end")
    fields: dict[str, str] = {}
    name = None
    for raw in bytes(data[line.end() : head_end]).split(b"\r\n"):
        text = raw.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            fields[name] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise Damage("header line without a name")
        fields[name] = value.strip()
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damage("no content length")
    body = head_end + 4
    end = body + int(length)
    if end + 4 > len(data):
        raise Damage("record runs past the end")
    if bytes(data[end : end + 4]) != b"\r\n\r\n":
        raise Damage("no end mark after the block")
    block = bytes(data[body:end])
    ok = _digest_ok(fields.get("warc-block-digest"), block)
    if ok is False:
        raise Damage("block digest differs")
    return {"fields": fields, "block": block, "digest_ok": ok}, end + 4


def _find(data: memoryview, what: bytes, start: int) -> int:
    found = re.compile(re.escape(what)).search(data, start)
    return found.start() if found else -1


def _inflate(data: memoryview, start: int) -> tuple[bytes, int, str | None]:
    """The member at ``start``, or its bytes before an error; where it ends, or the error
    is; and what is wrong."""
    machine = zlib.decompressobj(31)
    parts = []
    at, step = start, 65_536
    while not machine.eof:
        if at >= len(data):
            return b"".join(parts), at, CUT_OFF
        piece = data[at : at + step]
        before = machine.copy() if step > 1 else None
        try:
            parts.append(machine.decompress(piece))
        except zlib.error as error:
            if before is None:
                return b"".join(parts), at, f"member does not inflate: {error}"
            machine, step = before, 1  # up to the error byte by byte
            continue
        at += len(piece)
    return b"".join(parts), at - len(machine.unused_data), None


def _inflated_by(data: memoryview, start: int, end: int, size: int) -> int:
    """The place, up to the error at ``end``, by which a member has given ``size`` bytes."""
    machine = zlib.decompressobj(31)
    at = start
    while size > 0 and at < end:
        piece = data[at : min(at + 65_536, end)]
        size -= len(machine.decompress(piece, size))
        at += len(piece) - len(machine.unconsumed_tail)
    return at


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(start, end, record, None) of every sound record and (start, end, None, why) of
    every gap; together they cover the file, in order. What stands in a gzip member has
    the member's range; a gap there tells its range in the inflated bytes."""
    view = memoryview(data)
    at = 0
    gap: tuple[int, str] | None = None
    # The search after a failure is for either kind, so a file may mix them.
    starts = re.compile(rb"WARC/1\.[01]\r\n|" + re.escape(GZIP_START))
    while at < len(view):
        try:
            if bytes(view[at : at + 3]) == GZIP_START:
                content, end, why = _inflate(view, at)
                found = list(_inside(content, bool(why) and "incorrect data check" in why))
                sound = [b for _, b, record, _ in found if record]
                if why and not sound:
                    raise Damage(why)
                if why:
                    # The search goes on behind what the last sound record was made of.
                    next_ = starts.search(view, max(at + 1, _inflated_by(view, at, end, sound[-1])))
                    end = next_.start() if next_ else len(view)
                    if not found[-1][3]:
                        found.append((sound[-1], len(content), None, why))
                    else:
                        found[-1] = (*found[-1][:3], f"{why}; {found[-1][3]}")
                    for _, _, record, _ in found:
                        if record and why != CUT_OFF:
                            record["digest_ok"] = bool(record["digest_ok"])
            else:
                record, end = parse_record(view, at)
                found = [(at, end, record, None)]
        except Damage as damage:
            gap = gap or (at, str(damage))
            next_ = starts.search(view, at + 1)
            at = next_.start() if next_ else len(view)
            continue
        if gap:
            yield gap[0], at, None, gap[1]
            gap = None
        for low, high, record, why in found:
            yield at, end, record, why and f"{why} (bytes {low} to {high} of the inflated member)"
        at = end
    if gap:
        yield gap[0], len(view), None, gap[1]
    elif len(view) == 0:
        yield 0, 0, None, "empty file"


def _inside(content: bytes, digested: bool) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """Sound records and gaps of a member's inflated bytes, as of a plain file; if
    ``digested``, only records with a digest are sound."""
    view, at = memoryview(content), 0
    gap: tuple[int, str] | None = None
    while at < len(view):
        try:
            record, end = parse_record(view, at)
            if digested and not record["digest_ok"]:
                raise Damage("no digest")
        except Damage as damage:
            gap = gap or (at, str(damage))
            next_ = VERSION.search(view, at + 1)
            at = next_.start() if next_ else len(view)
            continue
        if gap:
            yield gap[0], at, None, gap[1]
            gap = None
        yield at, end, record, None
        at = end
    if gap:
        yield gap[0], at, None, gap[1]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of all archives under a path.

    Gaps have ``gap`` (why) and the byte range; records have the other columns. In
    gzip files the range is the member's, and ``gap`` also tells the inflated one. A file is one task's work, so archives
    should be cut to some hundred megabytes, as is usual.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                yield from _rows(name.as_py(), content.as_buffer())

    return files.mapInArrow(run, RECORD)


def _rows(path: str, data: bytes, at_once: int = 256) -> Iterator[pa.RecordBatch]:
    types = {"start": pa.int64(), "end": pa.int64(), "payload_length": pa.int64(), "payload": pa.binary(), "digest_ok": pa.bool_()}
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(_FIELDS, columns)], _FIELDS)

    size = 0
    for start, end, record, why in salvage(data):
        if record is None:
            rows.append((path, start, end, *[None] * 8, why))
        else:
            f, block = record["fields"], record["block"]
            given = f.get("warc-payload-length", "")
            length = int(given) if given.isascii() and given.isdigit() else len(block)
            row = (path, start, end, f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"))
            row += (f.get("warc-refers-to"), f.get("warc-payload-digest"), length, block, record["digest_ok"], None)
            rows.append(row)
            size += len(block)
        if len(rows) >= at_once or size >= 4_000_000:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def page_records(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records
    written by :func:`write_archives`. A response's figures are those of the payload
    read; a revisit has those of its header."""
    page = F.regexp_extract("record_id", r"urn:page:(-?\d+)", 1)
    target = F.regexp_extract("refers_to", r"urn:page:(-?\d+)", 1)
    is_response = F.col("type") == "response"
    given = F.lower(F.regexp_replace("payload_digest", "^sha256:", ""))
    return records.where(F.col("gap").isNull()).select(
        F.when(page != "", page).cast("long").alias("page_id"),
        F.when(is_response, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(is_response, F.sha2("payload", 256)).otherwise(given).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(target != "", target).cast("long").alias("refers_to"),
    )
