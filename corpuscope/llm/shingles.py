"""Word shingles of whole texts as 64-bit hashes, in numpy over Arrow buffers.

Words are cut at space and the ASCII controls 9 to 13. A shingle is ``WORDS`` words in
a row; a shorter text that has a word is one shingle. Texts are never cut: long ones
are worked through in pieces of about ``PIECE`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
PIECE = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_K1 = np.uint64(0xBF58476D1CE4E5B9)
_K2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits under which every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _K1
    x = (x ^ (x >> np.uint64(27))) * _K2
    return x ^ (x >> np.uint64(31))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_P, _P_INVERSE)):
            steps = np.full(n, base)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column; nulls count as empty."""
    column = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)), offsets.astype(np.int64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of words before each text (one more entry)."""
    hashes, starts = [], []
    first, last = int(offsets[0]), int(offsets[-1])
    at = first
    while at < last:
        end = min(at + PIECE, last)
        while True:
            piece = data[at:end]
            space = (piece == 32) | ((piece >= 9) & (piece <= 13))
            edge = np.zeros(len(piece) + 1, bool)
            inner = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end, "right")]
            edge[inner - at] = True
            if end < last and not (edge[-1] or space[-1]):
                # A word may go on behind the piece: end it at its last break, or
                # take more if it has none.
                breaks = np.flatnonzero(space | edge[:-1])
                if len(breaks) and breaks[-1] > 0:
                    end = at + int(breaks[-1]) + (1 if space[breaks[-1]] else 0)
                    piece, space, edge = piece[: end - at], space[: end - at], edge[: end - at + 1]
                else:
                    end = min(end + PIECE, last)
                    continue
            break
        before = np.r_[True, space[:-1]] | edge[:-1]
        after = np.r_[space[1:], True] | edge[1:]
        begins = np.flatnonzero(~space & before)
        ends = np.flatnonzero(~space & after) + 1
        if len(begins):
            up, down = _powers(len(piece))
            sums = np.empty(len(piece) + 1, np.uint64)
            sums[0] = 0
            np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=sums[1:])
            hashes.append(mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64)))
            starts.append(begins + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle in order, and the number of shingles before each text."""
    words, bounds = word_hashes(data, offsets)
    counts = np.diff(bounds)
    shingles = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    ends = np.cumsum(shingles)
    total = int(ends[-1]) if len(ends) else 0
    out_bounds = np.r_[0, ends]
    if not total:
        return np.empty(0, np.uint64), out_bounds
    owner = np.repeat(np.arange(len(counts)), shingles)
    at = np.arange(total) - out_bounds[owner] + bounds[owner]
    limit = bounds[owner + 1]
    z = np.full(total, np.uint64(0x2545F4914F6CDD1D))
    for k in range(n):
        inside = at + k < limit
        if inside.all():
            z = mix(z * _P ^ words[at + k])
        else:
            z[inside] = mix(z[inside] * _P ^ words[at[inside] + k])
    return z, out_bounds


def in_pieces(column: pa.Array, most: int = 4 * PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of runs of rows of about ``most`` bytes."""
    data, offsets = buffers(column)
    row = 0
    while row < len(column):
        to = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        to = min(max(to, row + 1), len(column))
        yield row, to, data, offsets[row : to + 1]
        row = to


def text_sets(column: pa.Array, n: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, data, offsets in in_pieces(column):
        hashes, bounds = shingle_hashes(data, offsets, n)
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield np.unique(hashes[a:b])
