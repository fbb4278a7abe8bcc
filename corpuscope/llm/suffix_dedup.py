"""Suffix-array deduplication by merging shard Burrows-Wheeler transforms.

Removes every byte covered by a 50-byte string that also starts in an earlier document.

Where repeats can be. Two equal 50-byte strings hold the same 16-byte pieces, so the
same least piece hash: strings are filed under it. Only hashes that occur in two
different texts are followed up (lossless: nothing else can repeat), equal texts being
one text. Runs of neighbouring strings under one hash form a segment.

What repeats. Segments are dealt by hash and cut into shards. Each shard is suffix
sorted and transformed; then all transforms of a bin are merged by refining their
interleave: a stable counting sort of the rows by the next symbol, once per byte of
depth. After 50 steps neighbours that begin with the same string are the repeated
intervals, and the earliest document of an interval is known. No suffixes of different
shards are ever sorted against each other.

Crowded hashes. A hash of very many runs (a common phrase among ever other words) would
be one task's work. Strings that hold its piece are told apart by how many bytes of them
stand before the piece: those with a number from a to b all hold the a bytes before it and
the bytes behind it that the b-th one has, so segments are dealt by these, too, trimmed to
such strings, and equal ones are one. A group that is still crowded is dealt again with
half the numbers and thus more bytes in common, until it is not; at a single number a
group is one string. Every group is merged like any hash, and what is found goes back up
to the segments it was cut from.

Texts are written once, bucketed by row, so that the thin results come to them and
texts are not shuffled.

Defined results: a null text is an empty one; texts shorter than 50 bytes lose nothing
and take nothing; rows of one id are one document's and take nothing from each other; a
null id comes after all others; an empty table gives an empty result. ``docs`` is read
more than once and must give the same rows in the same splits, as stored tables do.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpuscope.llm.common import bucketed
from corpuscope.llm.shingles import buffers, mix
from corpuscope.session import materialize

LENGTH = 50
PIECE_BYTES = 16
# Bytes told apart at once in a worker, and hashed at once: what a core's cache holds.
AT_ONCE = 1 << 20
HASHED = 1 << 15
# Strings in one segment at most; a longer run is cut (strings stay whole).
RUN = 64
# Bytes of one shard, suffix sorted alone, and of the shards merged at once.
SHARD_BYTES = 1 << 15
BIN_BYTES = 1 << 17
# Runs of one hash, or different segments of one group, that are merged in one task at most.
CROWDED = 20_000
# Parts of the numbers of bytes before a piece in which segments are looked at for company.
SHARE_PARTS = 8
_LAST = 2**63 - 1
NONE = np.empty(0, np.int64)


# --- strings filed under their least piece hash -----------------------------------


def _piece_hashes(eight: np.ndarray, n: int) -> np.ndarray:
    """Hash of the 16 bytes at each place, from the 8 bytes at each place."""
    x = eight[: n - 15] * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x += eight[8 : n - 7] * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _least_hashes(piece: np.ndarray, length: int) -> np.ndarray:
    """For each start of a string in ``piece``, the least hash of its 16-byte pieces."""
    n = len(piece)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = piece
    out = np.empty(max(0, n - length + 1), np.uint64)
    for at in range(0, len(out), HASHED):
        m = min(HASHED + length - 1, n - at)
        least = _piece_hashes(np.ndarray((m,), np.uint64, padded, at, (1,)).copy(), m)
        width, span = length - PIECE_BYTES + 1, 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if width > span:
            least = np.minimum(least[: -(width - span)], least[width - span :])
        out[at : at + len(least)] = least
    return out


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first start, number of starts, hash) of runs of strings under one hash.

    A text's runs are the same whatever other texts stand beside it: what is looked at at
    once ends with a text, or a fixed number of bytes after the start of a longer one.
    """
    to, last = int(offsets[0]), int(offsets[-1])
    while to < last:
        at, to = to, int(offsets[np.searchsorted(offsets, to + AT_ONCE, "right") - 1])
        if to <= at:
            to = at + AT_ONCE
        piece = data[at : min(to + length - 1, last)]
        if len(piece) < length:
            continue
        least = _least_hashes(piece, length)[: to - at]
        n = len(least)
        # Strings may not run over the end of their text.
        out = np.zeros(n, bool)
        new = np.zeros(n, bool)
        new[0] = True
        ends = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, at + n + length, "left")]
        for end in (np.unique(ends) - at).tolist():
            out[max(0, end - length + 1) : max(0, end)] = True
            if end < n:
                new[end] = True
        new[1:] |= (least[1:] != least[:-1]) | (out[1:] != out[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.r_[first, n])
        keep = ~out[first]
        first, count = first[keep], count[keep]
        parts = -(-count // RUN)
        if (parts > 1).any():
            nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
            first, count = np.repeat(first, parts) + nth * RUN, np.minimum(np.repeat(count, parts) - nth * RUN, RUN)
        text = np.searchsorted(offsets, first + at, "right") - 1
        yield text, first + at, count, least[first].view(np.int64)


# --- transforms and their merge ------------------------------------------------------


def suffix_order(text: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Suffixes of a shard in order. ``text`` holds symbols from 1 and a 0 after each
    string (at ``stops``); equal suffixes stand in the order of their strings."""
    n = len(text)
    left = np.repeat(stops, np.diff(np.r_[-1, stops])) - np.arange(n)
    longest = int(left.max())
    # The first seven symbols at once, nine bits each; nothing behind a string's end.
    ahead = np.zeros(n + 6, np.int64)
    ahead[:n] = text
    key = ahead[:n]
    for k in range(1, 7):
        key = (key << 9) | np.where(left >= k, ahead[k : k + n], 0)
    order = np.argsort(key)
    ranked = key[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    rank = np.empty(n, np.int64)
    depth = 7
    while True:
        rank[order] = np.cumsum(new)
        # Only suffixes that are equal so far are told apart further.
        tied = ~new
        tied[:-1] |= tied[1:]
        places = np.flatnonzero(tied)
        if not len(places):
            return order
        here = order[places]
        if depth > longest:
            order[places] = here[np.argsort(rank[here] * n + here)]
            return order
        key = rank[here] * (n + 1) + np.where(left[here] >= depth, rank[np.minimum(here + depth, n - 1)], 0)
        finer = np.argsort(key)
        order[places], key = here[finer], key[finer]
        new[places] = np.r_[True, key[1:] != key[:-1]]
        depth *= 2


def merge_transforms(
    transforms: list[np.ndarray], ends: list[int], depth: int, borders: bool = True
) -> tuple[np.ndarray, np.ndarray | None]:
    """Interleave of several transforms refined to ``depth``.

    Gives, for every row of the transforms laid end to end, its place in the merged
    order, and for every place whether a new block (another first ``depth`` symbols)
    starts there (if ``borders`` are asked for). ``ends`` counts each transform's strings;
    symbol 0 ends a string.
    """
    symbols = np.concatenate(transforms)
    # Where a row's suffix goes in its own transform when the symbol before is put to it;
    # the interleave holds the rows, each transform's in their order.
    bases = np.cumsum([0, *(len(t) for t in transforms)])[:-1].tolist()
    ahead = np.empty(len(symbols), np.int32)
    for base, t in zip(bases, transforms):
        ahead[base + np.argsort(t, kind="stable")] = np.arange(base, base + len(t))
    interleave = np.arange(len(symbols), dtype=np.int32)
    n_ends = sum(ends)
    first_ends = np.concatenate([np.arange(base, base + n) for base, n in zip(bases, ends)])
    # Buckets of first symbols are the same at every step; each end of a string is a
    # symbol of its own.
    buckets = np.r_[0, np.cumsum(np.bincount(symbols))]
    border = np.zeros(len(symbols), bool)
    block = np.zeros(len(symbols), np.int32)
    for step in range(depth):
        # Rows move to the bucket of the symbol before them, keeping their order.
        moved = np.argsort(symbols[interleave], kind="stable")
        refined = ahead[interleave[moved]]
        refined[:n_ends] = first_ends
        done = step % 8 == 7 and np.array_equal(refined, interleave)
        interleave = refined
        if borders:
            of = block[moved]
            np.not_equal(of[1:], of[:-1], out=border[1:])
            border[buckets[buckets < len(symbols)]] = True
            border[: n_ends + 1] = True
            renewed = np.cumsum(border, dtype=np.int32)
            done = done and renewed[-1] == block[-1] and np.array_equal(renewed, block)
            block = renewed
        if done:
            break
    places = np.empty(len(symbols), np.int64)
    places[interleave] = np.arange(len(symbols))
    return places, np.r_[True, block[1:] != block[:-1]] if borders else None


def earliest(segments: list[bytes], owners: np.ndarray, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each start of a string in each segment, the least owner of an equal string."""
    least, n = _earliest_joined(segments, owners, length, shard_bytes)
    return np.split(least, np.cumsum(n)[:-1])


def _earliest_joined(segments: list[bytes], owners: np.ndarray, length: int, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """:func:`earliest` of all segments in one array, and how many each has."""
    sizes = np.array([len(s) for s in segments])
    shard = np.cumsum(sizes) // shard_bytes
    transforms, ends, suffixes = [], [], []
    stop_of = np.cumsum(sizes + 1) - 1
    base = 0
    for s in np.unique(shard):
        mine = np.flatnonzero(shard == s)
        joined = np.frombuffer(b"\0".join(segments[i] for i in mine.tolist()) + b"\0", np.uint8)
        stops = np.cumsum(sizes[mine] + 1) - 1
        text = joined.astype(np.uint16) + 1
        text[stops] = 0
        order = suffix_order(text, stops)
        transforms.append(np.where(order > 0, text[order - 1], 0))
        ends.append(len(mine))
        suffixes.append(order + base)
        base += len(text)
    if max(int(t.max()) for t in transforms) < 256:
        transforms = [t.astype(np.uint8) for t in transforms]
    places, _ = merge_transforms(transforms, ends, length, borders=False)
    suffix = np.empty(base, np.int64)
    suffix[places] = np.concatenate(suffixes)
    segment = np.searchsorted(stop_of, suffix)
    whole = suffix + length <= stop_of[segment]
    # Repeated intervals: neighbours that begin with one string. Rows too short for one are
    # intervals of their own.
    owner = np.where(whole, owners[segment], _LAST)
    joined = np.frombuffer(b"\0".join(segments) + bytes(8), np.uint8)
    eight = np.ndarray((len(joined) - 7,), np.uint64, joined, 0, (1,)).copy()
    if length < 8:
        eight <<= np.uint64(8 * (8 - length))
    same = np.flatnonzero(whole[1:] & whole[:-1])
    for k in [max(0, length - 8), *range(0, length - 8, 8)]:
        same = same[eight[suffix[same] + k] == eight[suffix[same + 1] + k]]
    border = np.ones(base, bool)
    border[same + 1] = False
    firsts = np.flatnonzero(border)
    least = np.repeat(np.minimum.reduceat(owner, firsts), np.diff(np.r_[firsts, base]))
    at = np.full(base, _LAST)
    at[suffix] = least
    n = np.maximum(0, sizes - length + 1)
    return at[_places_in(stop_of - sizes, n)], n


def _places_in(begins: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each of several stretches, ``n`` of each."""
    return np.arange(int(n.sum())) + np.repeat(begins - (np.cumsum(n) - n), n)


# --- the operator ---------------------------------------------------------------------


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, text][, kept columns]) of every row.

    ``text`` is what is left; bytes of a character that lost others of its bytes are
    left out there. ``keep`` names columns of the input to carry along.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("text"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("ord"), F.sha2(text, 256).alias("digest"),
        F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.lit(0).alias("none")).alias("kept"),
    )
    texts = bucketed(rows, "row", "suffix_texts")

    first = F.min(F.struct("ord", "row")).alias("first")
    firsts = texts.groupBy("digest").agg(first).select("digest", F.col("first.ord").alias("first_ord"), F.col("first.row").alias("first_row"))
    firsts = materialize(firsts, "suffix-firsts")
    heads = texts.select("row", "ord", "text").join(firsts.select(F.col("first_row").alias("row")), "row", "left_semi")

    filed = materialize(_shared_hashes(heads.select("row", "text"), length), "suffix-hashes")
    shared = filed.where(F.col("row").isNotNull())
    # At most one for every CROWDED runs of the whole input.
    crowded = np.array([r.hash for r in filed.where(F.col("row").isNull()).select(F.explode("hashes").alias("hash")).collect()], np.int64)
    followed = heads.join(shared, "row")
    mins = _merged(_segments(followed, length, crowded), length)
    if len(crowded):
        refined = _segments(heads.join(_among(shared, crowded), "row"), length)
        mins = mins.unionByName(_refined(refined, length))
    mins = materialize(mins, "suffix-earliest")
    spans = _found(followed, mins, length).groupBy("row").agg(F.collect_list("span").alias("spans"))

    # Copies of a text: of a later document all is gone; of the same one, the same.
    known = texts.select("row", "ord", "digest").join(firsts, "digest")
    known = known.select("row", "first_row", (F.col("ord") > F.col("first_ord")).alias("copy"))
    known = known.join(spans.withColumnRenamed("row", "first_row"), "first_row", "left")
    told = texts.select("row", "id", "text", "digest", "kept").join(known.select("row", "copy", "spans"), "row")
    figures = [StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    left = [StructField("text", StringType())] if with_text else []
    schema = StructType([texts.schema["id"], texts.schema["kept"], *figures, StructField("kept_sha256", StringType()), *left])
    names = schema.fieldNames()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = []
            for data, digest, copy, spans_ in zip(*(part.column(i) for i in range(2, 6))):
                data = data.as_py()
                kept, n_spans = _keep(data, copy.as_py(), spans_, length)
                sha = digest.as_py() if n_spans == 0 else hashlib.sha256(kept).hexdigest()
                out.append((len(data), len(data) - len(kept), n_spans, sha, kept.decode("utf-8", "ignore") if with_text else None))
            columns = list(zip(*out)) if out else [()] * 5
            types = [*[pa.int64()] * 3, pa.string(), pa.string()]
            made = [pa.array(c, t) for c, t in zip(columns, types)][: len(names) - 2]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names)

    made = told.select("id", "kept", "text", "digest", "copy", "spans").mapInArrow(cut, schema)
    carried = [F.col(f"kept.c{i}").alias(c) for i, c in enumerate(keep)]
    return made.select(F.col("id").alias(id_col), *names[2:], *carried)


def _keep(data: bytes, copy: bool, spans: pa.Scalar, length: int) -> tuple[bytes, int]:
    if copy and len(data) >= length:
        return b"", 1
    if not spans.is_valid or len(spans.values) == 0:
        return data, 0
    packed = np.sort(spans.values.to_numpy())
    starts, reach = packed >> 32, np.maximum.accumulate(packed & 0xFFFFFFFF)
    # Stretches that overlap or touch are one run.
    begins = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
    last = np.r_[begins[1:] - 1, len(starts) - 1]
    kept, at = [], 0
    for start, end in zip(starts[begins].tolist(), reach[last].tolist()):
        kept.append(data[at:start])
        at = end
    kept.append(data[at:])
    return b"".join(kept), len(begins)


def _shared_hashes(heads: DataFrame, length: int) -> DataFrame:
    """(row, hashes): the hashes of each text that another text has too. Those of more than
    CROWDED runs are named once more, under the row null.

    Hashes go in packs: a row for the hashes of one block (of all hashes) and one batch.
    """
    crowded = CROWDED
    n_blocks = np.uint64(max(1024, int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = part.column(0).to_numpy()
            found = [(t, h) for t, _, _, h in runs(*buffers(part.column(1)), length)]
            if not found:
                continue
            text, hashes = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            order = np.argsort(hashes)
            text, hashes = text[order], hashes[order]
            begin = np.r_[True, hashes[1:] != hashes[:-1]]
            # The texts of one hash in their order.
            tied = ~begin
            tied[:-1] |= tied[1:]
            places = np.flatnonzero(tied)
            text[places] = np.sort((np.cumsum(begin[places]) << 32) + text[places]) & 0xFFFFFFFF
            new = begin | np.r_[True, text[1:] != text[:-1]]
            n_runs = np.diff(np.r_[np.flatnonzero(begin), len(begin)])
            text, hashes, begin = text[new], hashes[new], begin[new]
            # A hash of several texts here is settled: two rows tell the others about it, the
            # first one with the number of its runs that no other row stands for.
            at = np.flatnonzero(begin)
            nth = np.arange(len(hashes)) - np.repeat(at, np.diff(np.r_[at, len(hashes)]))
            settled = nth > 1
            n = np.zeros(len(hashes), np.int32)
            n[at] = n_runs
            yield from _packed(hashes[settled], rows[text[settled]], None, n_blocks)
            yield from _packed(hashes[~settled], rows[text[~settled]], n[~settled], n_blocks)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple[int, bytes, bytes, bytes]] = []
        held = 0
        for batch in batches:
            for pack in zip(*(c.to_pylist() for c in batch.columns)):
                # Whole blocks: equal hashes are met together.
                if held > AT_ONCE and pack[0] != rest[-1][0]:
                    yield from _met(rest, crowded)
                    rest, held = [], 0
                rest.append(pack)
                held += len(pack[1]) // 8
        if rest:
            yield from _met(rest, crowded)

    packs = heads.mapInArrow(file, "block int, hashes binary, rows binary, n binary")
    met = packs.repartition("block").sortWithinPartitions("block").mapInArrow(meet, "row long, hash long")
    return met.groupBy("row").agg(F.collect_list("hash").alias("hashes"))


def _packed(hashes: np.ndarray, rows: np.ndarray, n: np.ndarray | None, n_blocks: np.uint64) -> Iterator[pa.RecordBatch]:
    """A row for each block: its hashes, their texts' rows, and numbers of runs. Without
    numbers, they are settled, need no company and are dealt by their text."""
    if not len(hashes):
        return
    block = ((hashes if n is not None else rows ^ hashes).view(np.uint64) % n_blocks).astype(np.uint16 if n_blocks <= 1 << 16 else np.int32)
    order = np.argsort(block, kind="stable")
    block, hashes, rows = block[order], hashes[order], rows[order]
    begins = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    offsets = np.r_[begins, len(block)]
    packs = [pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer((offsets * 8).astype(np.int32)), pa.py_buffer(c)]) for c in (hashes, rows)]
    if n is not None:
        packs.append(pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(n[order])]))
    else:
        packs.append(pa.nulls(len(begins), pa.binary()))
    yield pa.RecordBatch.from_arrays([pa.array(block[begins].astype(np.int32)), *packs], ["block", "hashes", "rows", "n"])


def _met(packs: list[tuple[int, bytes, bytes, bytes]], crowded: int) -> Iterator[pa.RecordBatch]:
    """(row, hash) of packs of whole blocks: hashes that several texts have."""
    settled = [p for p in packs if p[3] is None]
    packs = [p for p in packs if p[3] is not None]
    hashes, rows = (np.frombuffer(b"".join(p[k] for p in packs), np.int64) for k in (1, 2))
    n = np.frombuffer(b"".join(p[3] for p in packs), np.int32)
    order = np.argsort(hashes)
    hashes, rows, n = hashes[order], rows[order], n[order]
    at = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.empty(0, np.int64)
    if len(at):
        shared = np.minimum.reduceat(rows, at) < np.maximum.reduceat(rows, at)
        many = hashes[at][shared & (np.add.reduceat(n, at, dtype=np.int64) > crowded)]
        keep = np.repeat(shared, np.diff(np.r_[at, len(hashes)]))
        hashes, rows = hashes[keep], rows[keep]
    else:
        many = hashes
    hashes, rows = (np.concatenate([c, np.frombuffer(b"".join(p[k] for p in settled), np.int64)]) for k, c in ((1, hashes), (2, rows)))
    # A text's hashes stand together, and so go on together.
    order = np.argsort(rows)
    yield pa.RecordBatch.from_arrays([pa.array(rows[order]), pa.array(hashes[order])], ["row", "hash"])
    if len(many):
        yield pa.RecordBatch.from_arrays([pa.nulls(len(many), pa.int64()), pa.array(many)], ["row", "hash"])


def _among(shared: DataFrame, some: np.ndarray) -> DataFrame:
    """(row, hashes): the texts that have one of some hashes, with those."""
    some = np.sort(some)

    def among(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            lists = part.column(1)
            hashes, rows = lists.flatten().to_numpy(), np.repeat(part.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))
            keep = some[np.minimum(np.searchsorted(some, hashes), len(some) - 1)] == hashes
            hashes, rows = hashes[keep], rows[keep]
            if len(rows):
                at = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[at, len(rows)], pa.int32()), pa.array(hashes))
                yield pa.RecordBatch.from_arrays([pa.array(rows[at]), lists], ["row", "hashes"])

    return shared.select("row", "hashes").mapInArrow(among, "row long, hashes array<long>")


def _followed_runs(
    part: pa.RecordBatch, length: int, left_out: np.ndarray
) -> Iterator[tuple[bytes | np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, text, start, count, hash) of runs under a hash that other texts have."""
    hashes = np.setdiff1d(part.column(3).flatten().to_numpy(), left_out)
    if not len(hashes):
        return
    data, offsets = buffers(part.column(2))
    raw = data.tobytes() if len(data) < 1 << 26 else data
    for text, start, count, h in runs(data, offsets, length):
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        keep = hashes[at] == h
        yield raw, offsets, text[keep], start[keep], count[keep], h[keep]


def _digest(segment: bytes, group: bytes) -> bytes:
    """16 bytes that stand for a segment of a group (a hash, or what it was dealt by)."""
    return hashlib.blake2b(group + segment, digest_size=16).digest()


def _group_bytes(groups: np.ndarray) -> list[bytes]:
    raw = groups.astype("<i8").tobytes()
    return [raw[i : i + 8] for i in range(0, len(raw), 8)]


def _keys(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Digests as two columns of longs."""
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _key(segment: bytes, group: int) -> tuple[int, int]:
    """:func:`_digest` as two longs."""
    return struct.unpack("<qq", _digest(segment, group.to_bytes(8, "little", signed=True)))


def _segments(followed: DataFrame, length: int, left_out: np.ndarray = NONE) -> DataFrame:
    """(grp, hash, segment, low, high): segments under the followed hashes, with the first
    and last document that a task has seen each in. They are grouped by their hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ords = part.column(1).to_numpy()
            seen: dict[bytes, list] = {}
            for raw, _, text, start, count, h in _followed_runs(part, length, left_out):
                for t, s, c, k in zip(text.tolist(), start.tolist(), count.tolist(), h.tolist()):
                    segment = bytes(raw[s : s + c + length - 1])
                    o = ords[t]
                    found = seen.get(segment)
                    if found is None:
                        seen[segment] = [k, o, o]
                    elif o < found[1]:
                        found[1] = o
                    elif o > found[2]:
                        found[2] = o
            if seen:
                hashes, low, high = zip(*seen.values())
                columns = [pa.array(hashes, pa.int64()), pa.array(list(seen), pa.binary()), pa.array(low, pa.int64()), pa.array(high, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["hash", "segment", "low", "high"])

    found = followed.select("row", "ord", "text", "hashes").mapInArrow(cut, "hash long, segment binary, low long, high long")
    return found.select(F.col("hash").alias("grp"), "*")


def _merged(segments: DataFrame, length: int) -> DataFrame:
    """(key, key2, first, last, least): for each segment that a later text has too, or has
    in part, the earliest document of its strings, a row per stretch that has one."""
    dealt = segments.select("grp", "hash", "segment", "low", "high").repartition("grp").sortWithinPartitions("grp")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, part]).combine_chunks() if rest is not None else part
            groups = table["grp"].to_numpy()
            cuts = np.flatnonzero(groups[1:] != groups[:-1]) + 1
            # Whole groups, in bins of bounded size.
            if len(cuts):
                yield from _bins(table.slice(0, int(cuts[-1])), length)
                rest = table.slice(int(cuts[-1]))
            else:
                rest = table
        if rest is not None and len(rest):
            yield from _bins(rest, length)

    return dealt.mapInArrow(merge, "key long, key2 long, first int, last int, least long")


_PART = ["grp", "hash", "a", "b", "at", "segment", "low", "high", "key", "key2", "up", "up2", "shift"]
_PART_SCHEMA = (
    "grp long, hash long, a int, b int, at int, segment binary, low long, high long,"
    " key long, key2 long, up long, up2 long, shift int"
)


def _refined(segments: DataFrame, length: int) -> DataFrame:
    """As :func:`_merged`, for segments of crowded hashes."""
    both = [F.min("low").alias("low"), F.max("high").alias("high")]
    span = length - PIECE_BYTES
    level = segments.groupBy("grp", "hash", "segment").agg(*both)
    level = level.select("grp", "hash", F.lit(0).alias("a"), F.lit(span).alias("b"), F.lit(-1).alias("at"), "segment", "low", "high")
    level = materialize(level, "suffix-level")
    found, links = [], []

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for part in zip(*(c.to_pylist() for c in batch.columns)) for r in _halves(*part, length)]
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.binary(), *[pa.int64()] * 6, pa.int32()]
            for low in range(0, len(rows), 10_000):
                columns = zip(*rows[low : low + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _PART)

    while True:
        made = materialize(level.mapInArrow(split, _PART_SCHEMA), "suffix-halves")
        links.append(made.select("key", "key2", "up", "up2", "shift"))
        # Equal segments of a group are one, map-side first.
        parts = made.groupBy("grp", "hash", "a", "b", "at", "segment").agg(*both)
        parts = materialize(parts, "suffix-level")
        crowded = materialize(parts.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("grp"), "suffix-crowded")
        found.append(_merged(parts.join(crowded, "grp", "left_anti"), length))
        if crowded.isEmpty():
            break
        level = parts.join(crowded, "grp", "left_semi").select("grp", "hash", "a", "b", "at", "segment", "low", "high")
    # What was found in a part holds in all that it was cut from.
    out = found[-1]
    for k in range(len(links) - 1, -1, -1):
        above = materialize(out, "suffix-found").join(links[k], ["key", "key2"])
        moved = [(F.col(c) + F.col("shift")).cast("int").alias(c) for c in ("first", "last")]
        out = above.select(F.col("up").alias("key"), F.col("up2").alias("key2"), *moved, "least")
        if k:
            out = out.unionByName(found[k - 1])
    return out


def _halves(grp: int, hash_: int, a: int, b: int, at: int, segment: bytes, low: int, high: int, length: int) -> Iterator[tuple]:
    """The parts of a segment by half of the numbers a..b of bytes before the piece."""
    up = _key(segment, grp)
    span = length - PIECE_BYTES
    last = len(segment) - length
    # A string's piece is the first one in it; a part of a segment has one, at ``at``.
    pieces = [at] if at >= 0 else _places(segment, hash_)
    halves = [(a, (a + b) // 2), ((a + b) // 2 + 1, b)] if a < b else [(a, b)]
    before = -1
    for piece in pieces:
        for from_, to in halves:
            begin, end = max(before + 1, piece - to, 0), min(last, piece - from_)
            if begin > end:
                continue
            part = segment[begin : end + length]
            common = segment[piece - from_ : piece + PIECE_BYTES + span - to]
            name = hash_.to_bytes(8, "little", signed=True) + bytes((from_, to)) + common
            group = int.from_bytes(hashlib.blake2b(name, digest_size=8).digest(), "little", signed=True)
            yield (group, hash_, from_, to, piece - begin, part, low, high, *_key(part, group), *up, begin)
        before = piece


def _places(segment: bytes, hash_: int) -> list[int]:
    """Where the piece of a hash stands in a segment."""
    n = len(segment)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = np.frombuffer(segment, np.uint8)
    eight = np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1)).copy().view(np.uint64).ravel()
    return np.flatnonzero(_piece_hashes(eight, n).view(np.int64) == hash_).tolist()


def _may_share(segments: list[bytes], hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) start of the strings that each segment can share with another one of
    its hash; the last is before the first where there are none.

    A shared string holds the least piece at one place in both. Strings with from a to b
    bytes before the piece all hold the a bytes before it and those behind it that the
    b-th one has; a segment that agrees with no other in these shares none of them.
    """
    span = length - PIECE_BYTES
    sizes = np.array([len(s) for s in segments])
    ends = np.cumsum(sizes)
    joined = np.frombuffer(b"".join(segments) + bytes(8), np.uint8)
    n = len(joined) - 8
    eight = np.lib.stride_tricks.as_strided(joined, (n + 1, 8), (1, 1)).copy().view(np.uint64).ravel()
    pieces = _piece_hashes(eight, n)
    segment = np.repeat(np.arange(len(segments)), sizes)[: len(pieces)]
    at = np.flatnonzero(pieces.view(np.int64) == hashes[segment])
    at = at[at + PIECE_BYTES <= ends[segment[at]]]
    of = segment[at]
    begin = ends[of] - sizes[of]

    bounds = [k * (span + 1) // SHARE_PARTS for k in range(SHARE_PARTS + 1)]
    first, last = sizes.copy(), np.full(len(segments), -1)
    for part, (a, b) in enumerate((x, y - 1) for x, y in zip(bounds[:-1], bounds[1:]) if x < y):
        whole = np.flatnonzero((at - a >= begin) & (at + PIECE_BYTES + span - b <= ends[of]))
        start, owner, size = at[whole] - a, of[whole], a + PIECE_BYTES + span - b
        key = mix(hashes[owner].view(np.uint64) + np.uint64(part + 1))
        for k in [*range(0, size - 8, 8), size - 8]:
            key = mix(key ^ eight[start + k])
        order = np.argsort(key)
        keys, owners = key[order], owner[order]
        shares = np.zeros(len(segments), bool)
        if len(keys):
            # All of several owners' equal keys.
            equal = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            several = np.minimum.reduceat(owners, equal) < np.maximum.reduceat(owners, equal)
            shares[owners[np.repeat(several, np.diff(np.r_[equal, len(keys)]))]] = True
        mine = whole[shares[owner]]
        place = at[mine] - begin[mine]
        np.minimum.at(first, of[mine], np.maximum(place - b, 0))
        np.maximum.at(last, of[mine], place - a)
    return first, np.minimum(last, sizes - length)


def _bins(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    groups, hashes = table["grp"].to_numpy(), table["hash"].to_numpy()
    segments = table["segment"].to_pylist()
    low, high = table["low"].to_numpy(), table["high"].to_numpy()
    # Equal segments of a group (from different tasks) are one, with its range.
    known: dict[tuple[int, bytes], int] = {}
    which = np.fromiter((known.setdefault(k, len(known)) for k in zip(groups.tolist(), segments)), np.int64, len(segments))
    firsts = np.flatnonzero(np.r_[True, which[1:] > np.maximum.accumulate(which)[:-1]])
    lows, highs = low[firsts], high[firsts]
    np.minimum.at(lows, which, low)
    np.maximum.at(highs, which, high)
    low, high = lows, highs
    segments, hashes, groups = [segments[i] for i in firsts.tolist()], hashes[firsts], groups[firsts]
    out = _Earliest(segments, _group_bytes(groups), length)
    border = np.r_[True, groups[1:] != groups[:-1]]
    begins, group = np.flatnonzero(border), np.cumsum(border) - 1
    first, last = _may_share(segments, hashes, length)
    merged = first <= last
    # The others share no string: all their strings are their own earliest owner's.
    alone = np.flatnonzero(~merged & (low < high))
    out.add(alone, np.ones(len(alone), np.int64), np.zeros(len(alone), np.int64), low[alone])
    filled = np.cumsum(np.where(merged, last - first + length, 0))[np.r_[begins[1:] - 1, len(groups) - 1]]
    # Bins of whole groups, of about as many bytes each.
    bin_of = (filled // BIN_BYTES)[group]
    at = np.flatnonzero(merged)
    for bin_ in np.split(at, np.flatnonzero(np.diff(bin_of[at])) + 1) if len(at) else []:
        # Only the strings that can be shared are merged.
        trimmed = [segments[i][f:t] for i, f, t in zip(bin_.tolist(), first[bin_].tolist(), (last[bin_] + length).tolist())]
        shared, n_shared = _earliest_joined(trimmed, low[bin_], length)
        n = out.n_starts[bin_]
        begin = np.cumsum(n) - n
        found = np.repeat(low[bin_], n)
        found[_places_in(begin + first[bin_], n_shared)] = shared
        # What is not earlier than the segment's last user takes nothing.
        takes = np.minimum.reduceat(found, begin) < high[bin_]
        new = np.r_[True, found[1:] != found[:-1]]
        new[begin] = True
        new &= np.repeat(takes, n)
        of = np.repeat(np.arange(len(bin_)), n)[new]
        out.add(bin_[takes], np.bincount(of, minlength=len(bin_))[takes], np.flatnonzero(new) - begin[of], found[new])
    yield from out.batches()


class _Earliest:
    """Rows (key, key2, from, to, least): stretches of starts with one earliest owner."""

    def __init__(self, segments: list[bytes], named: list[bytes], length: int):
        self.segments, self.named = segments, named
        self.n_starts = np.array([len(s) for s in segments]) - length + 1
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, which: np.ndarray, n: np.ndarray, first: np.ndarray, least: np.ndarray) -> None:
        """``n`` stretches of each of the segments ``which``, all from their ``first`` start."""
        if len(which):
            last = np.r_[first[1:] - 1, 0]
            last[np.cumsum(n) - 1] = self.n_starts[which] - 1
            self.parts.append((which, n, first, last, least))

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            which, n, first, last, least = (np.concatenate(c) for c in zip(*self.parts))
            digests = [_digest(self.segments[i], self.named[i]) for i in which.tolist()]
            columns = [pa.array(np.repeat(k, n), pa.int64()) for k in _keys(digests)]
            columns += [pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(least, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "key2", "first", "last", "least"])


def _found(followed: DataFrame, mins: DataFrame, length: int) -> DataFrame:
    """(row, span): removed stretches of each text, start and end packed in a long."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows, ords = part.column(0).to_numpy(), part.column(1).to_numpy()
            for raw, offsets, text, start, count, h in _followed_runs(part, length, NONE):
                ends = (start + count + length - 1).tolist()
                digests = [_digest(bytes(raw[s:e]), k) for s, e, k in zip(start.tolist(), ends, _group_bytes(h))]
                columns = [pa.array(k, pa.int64()) for k in _keys(digests)]
                columns += [pa.array(rows[text]), pa.array(ords[text]), pa.array((start - offsets[text]).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "key2", "row", "ord", "start"])

    placed = followed.select("row", "ord", "text", "hashes").mapInArrow(place, "key long, key2 long, row long, ord long, start long")
    # A segment that very many texts have is a hot key; Spark splits its side.
    met = placed.join(mins, ["key", "key2"])

    found = met.where(F.col("least") < F.col("ord"))
    begin = (F.col("start") + F.col("first")).cast("long")
    span = F.shiftleft(begin, 32).bitwiseOR(F.col("start") + F.col("last") + F.lit(length))
    return found.select("row", span.alias("span"))
