"""Hashes of all substrings of given lengths, a batch of texts at a time.

To ask which of many texts contain, or end with, which of many others, spelling out
substrings takes memory that grows with the square of a text's length. Here a substring
is its length and two rolling hashes of 62 bits, and only lengths that occur on the other
side are made: a text of n characters gives at most n rows per length, each of a few
bytes, one length at a time. Built-in expressions cannot roll a hash along a text, hence
the Arrow function (numpy over whole batches).

Hashes are polynomials over the code points modulo the prime 2^31 - 1, four of them,
paired. Whoever joins on them looks at the texts of what it found, so equal hashes of
different substrings are noticed.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("n", "k1", "k2")
_PRIME = (1 << 31) - 1
_BASES = (1_103_515_245, 1_664_525_037, 747_796_405, 277_803_737)
# Characters that are worked on at once.
_AT_ONCE = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo the prime, by doubling."""
    out = np.ones(n, np.int64)
    done, step = 1, base % _PRIME
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step % _PRIME
        done += more
        step = step * step % _PRIME
    return out


class Rolling:
    """Prefix hashes of some texts, laid out one after the other."""

    def __init__(self, texts: Sequence[str]):
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        self.sizes = np.array([len(c) for c in codes], np.int64)
        self.ends = np.cumsum(self.sizes)
        points = np.concatenate([*codes, np.empty(0, np.uint32)]).astype(np.int64) + 1
        n = len(points) + 1
        self.sums, self.back = [], []
        for base in _BASES:
            weighed = np.cumsum(points * _powers(base, n)[:-1] % _PRIME) % _PRIME
            self.sums.append(np.r_[0, weighed])
            self.back.append(_powers(pow(base, -1, _PRIME), n))
        self.row = np.repeat(np.arange(len(texts)), self.sizes)
        self.left = self.ends[self.row] - np.arange(len(points))  # characters from each on

    def keys(self, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [(s[starts + n] - s[starts]) % _PRIME * b[starts] % _PRIME for s, b in zip(self.sums, self.back)]
        return parts[0] << 31 | parts[1], parts[2] << 31 | parts[3]

    def substrings(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, start) of every substring of ``n`` characters; one of none for each row."""
        if n == 0:
            return np.arange(len(self.sizes)), self.ends - self.sizes
        starts = np.flatnonzero(self.left >= n)
        return self.row[starts], starts

    def suffixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.flatnonzero(self.sizes >= n)
        return rows, self.ends[rows] - n


def _in_pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    low, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > _AT_ONCE:
            yield low, i
            low, size = i, 0
        size += len(text)
    if low < len(texts):
        yield low, len(texts)


def window_keys(rows: DataFrame, text: str, id_col: str, lengths: Sequence[int] | None, suffixes: bool = False) -> DataFrame:
    """``id, n, k1, k2`` for each substring (or suffix) of a text that has one of the
    ``lengths``; for the whole texts alone where ``lengths`` is None."""
    wanted = None if lengths is None else sorted(set(lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for low, high in _in_pieces(texts):
                ids = batch.column(0).slice(low, high - low)
                rolling = Rolling(texts[low:high])
                own = np.unique(rolling.sizes).tolist()
                longest = own[-1] if own else -1
                for n in own if wanted is None else wanted:
                    if n > longest:
                        break
                    if wanted is None:
                        at = np.flatnonzero(rolling.sizes == n)
                        starts = rolling.ends[at] - n
                    else:
                        at, starts = (rolling.suffixes if suffixes else rolling.substrings)(n)
                    k1, k2 = rolling.keys(starts, n)
                    columns = [ids.take(pa.array(at)), pa.array(np.full(len(at), n, np.int32)), pa.array(k1), pa.array(k2)]
                    yield pa.RecordBatch.from_arrays(columns, ["id", *KEYS])

    kept = rows.where(F.col(text).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return kept.mapInArrow(run, "id long, n int, k1 long, k2 long")


def lengths_of(texts: DataFrame, text: str) -> list[int]:
    """The lengths that occur: no more numbers than the longest text has characters."""
    found = texts.select(F.length(text).alias("n")).where("n IS NOT NULL").distinct()
    return sorted(r.n for r in found.collect())


# Send the helpers with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
