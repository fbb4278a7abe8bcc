"""Bracket matching and span nesting over an array column.

Running sums over an array are the one thing Spark SQL cannot do inside a row in
linear time, so these two Arrow UDFs do them with numpy, many files at once and
without a Python loop. They take a batch in pieces of a bounded number of tokens,
as work and results are many times the size of what Spark sends. Everything around
them (lexing, classification, scoring) is built-in expressions. Doing it inside the
row matters at scale: exploding tokens and running windows over them would shuffle
and sort several times the size of the corpus.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Token classes, as computed by ``operators.structure.token_classes``.
OPEN, CLOSE, SEMI, COMMA, DECLARE, STATEMENT = 1, -1, 2, 3, 4, 5
# Brackets and words that matter to signatures: a brace that may open a body (no type
# literal), a parenthesis, a word that begins another declaration, an arrow, and a
# closing parenthesis before ":".
BODY, PAREN, BEGIN, ARROW, TYPED = -2, -3, -4, -5, -6
# Tokens, or nodes, that are worked on at once; a file of more is a piece of its own.
_AT_ONCE = 1 << 16


def _int_arrays(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.ArrayType(T.IntegerType())) for name in names])


SCOPE_FIELDS = ("match", "parent", "stop", "head", "paren", "body", "typed")
SCOPE_TYPE = _int_arrays(*SCOPE_FIELDS)
NEST_TYPE = _int_arrays("inner", "depth", "outer")


def _pick(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """values[at], and -1 where ``at`` is negative."""
    if not len(values):
        return np.full(len(at), -1, dtype=np.int64)
    return np.where(at >= 0, values[np.maximum(at, 0)], -1)


def match_brackets(cls: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """For the token classes of several files, file r being starts[r]:starts[r+1].

    All results are positions within the token's own file:

    match   the partner bracket (the last token for an unclosed one, -1 for
            tokens that are not brackets)
    parent  the innermost enclosing open bracket, -1 at top level
    stop    the next separator or statement keyword on the same level, or the
            bracket closing it (the token count when there is none)
    head    the previous ``;`` or statement keyword on the same level, else -1
    paren   the ``(`` at or after the token on the same level that opens a parameter
            list (no function type), within the same statement, else -1
    body    the ``{`` after the token on the same level that opens a body, within the
            same statement, else -1
    typed   the ``)`` before the token on the same level that has a type behind it,
            within the same statement, else -1
    """
    n = len(cls)
    if n == 0:
        return (np.zeros(0, dtype=np.int64),) * len(SCOPE_FIELDS)
    lengths = np.diff(starts)
    row = np.repeat(np.arange(len(lengths)), lengths)
    first, end = starts[:-1][row], starts[1:][row]
    pos = np.arange(n, dtype=np.int64)
    is_open = (cls == OPEN) | (cls == BODY) | (cls == PAREN)
    is_close = (cls == CLOSE) | (cls == TYPED)
    bracket = is_open | is_close
    balance = np.cumsum(is_open.astype(np.int64) - is_close)
    before = np.concatenate([[0], balance])[starts[:-1]]
    # Opens up to and including the token, closes strictly before it.
    level = balance + is_close - before[row]
    inside = level - bracket
    low = min(level.min(), inside.min())
    span = max(level.max(), inside.max()) - low + 1
    width = n + 1

    match = np.full(n, -1, dtype=np.int64)
    match[is_open] = end[is_open] - 1
    group = row * span + (level - low)
    brackets = np.flatnonzero(bracket)
    brackets = brackets[np.argsort(group[brackets], kind="stable")]
    left, right = brackets[:-1], brackets[1:]
    pairs = is_open[left] & is_close[right] & (group[left] == group[right])
    match[left[pairs]] = right[pairs]
    match[right[pairs]] = left[pairs]

    opens = np.flatnonzero(is_open)
    opens = opens[np.argsort(group[opens], kind="stable")]
    around = row * span + (inside - low)
    at = np.searchsorted(group[opens] * width + opens, around * width + pos, side="left") - 1
    parent = _pick(opens, at)
    parent = np.where((inside > 0) & (_pick(group, parent) == around), parent, -1)

    home = np.where(parent >= 0, parent, n + row)

    def on_level(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        marks = marks[np.argsort(home[marks], kind="stable")]
        return marks, home[marks] * width + marks

    query = home * width + pos
    stop = np.where(parent >= 0, match[np.maximum(parent, 0)], end)
    marks, keys = on_level(np.flatnonzero(cls >= SEMI))
    if len(marks):
        at = np.searchsorted(keys, query, side="right")
        found = marks[np.minimum(at, len(marks) - 1)]
        stop = np.where((at < len(marks)) & (home[found] == home), found, stop)
    marks, keys = on_level(np.flatnonzero((cls >= SEMI) & (cls != COMMA)))
    head = _pick(marks, np.searchsorted(keys, query, side="left") - 1)
    head = np.where((head >= 0) & (home[np.maximum(head, 0)] == home), head, -1)

    # A statement ends at ``;``, at a keyword, or where another declaration begins.
    bounds = (cls >= SEMI) & (cls != COMMA) | (cls == BEGIN)

    def near(wanted: np.ndarray, side: str, step: int) -> np.ndarray:
        """The nearest wanted token in the statement: ahead (step 0) or behind (-1)."""
        marks, keys = on_level(np.flatnonzero(bounds | wanted))
        if not len(marks):
            return np.full(n, -1, dtype=np.int64)
        at = np.searchsorted(keys, query, side=side) + step
        found = marks[np.clip(at, 0, len(marks) - 1)]
        usable = (at >= 0) & (at < len(marks)) & (home[found] == home) & wanted[found]
        return np.where(usable, found, -1)

    after = np.append(cls[1:], 0)
    after[end - 1] = 0  # nothing stands behind a file's last token
    lists = (cls == PAREN) & (after[match] != ARROW)
    paren, body, typed = near(lists, "left", 0), near(cls == BODY, "right", 0), near(cls == TYPED, "left", -1)

    def local(index: np.ndarray) -> np.ndarray:
        return np.where(index >= 0, index - first, -1)

    return local(match), local(parent), stop - first, local(head), local(paren), local(body), local(typed)


def nest_spans(
    pos: np.ndarray, end: np.ndarray, weight: np.ndarray, starts: np.ndarray
) -> tuple[np.ndarray, ...]:
    """For the nodes of several files, each file's sorted by ``pos``; ``end`` >= 0
    marks a function's span:

    inner  sum of ``weight`` over the nodes inside a function (0 for others)
    depth  number of functions around the node
    outer  the innermost function around the node, as an index into its file's
           nodes, -1 when none
    """
    n = len(pos)
    if n == 0:
        return (np.zeros(0, dtype=np.int64),) * 3
    lengths = np.diff(starts)
    row = np.repeat(np.arange(len(lengths)), lengths)
    # Lay the files out one after the other on one axis; spans stay inside theirs.
    width = int(max(pos.max(), end.max())) + 2
    start, stop = row * width + pos, row * width + end
    is_fn = end >= 0
    fns = np.flatnonzero(is_fn)
    index = np.arange(n)
    total = np.concatenate([[0], np.cumsum(weight)])
    last = np.maximum(np.searchsorted(start, stop, side="right"), index + 1)
    inner = np.where(is_fn, total[last] - total[index + 1], 0)
    depth = np.searchsorted(start[fns], start, side="left") - np.searchsorted(
        np.sort(stop[fns]), start, side="left"
    )
    axis = int(start.max()) + 2
    ranked = fns[np.argsort(depth[fns], kind="stable")]
    at = np.searchsorted(
        depth[ranked] * axis + start[ranked], (depth - 1) * axis + start, side="left"
    )
    outer = np.where(depth > 0, _pick(ranked, at - 1), -1)
    return inner, depth, np.where(outer >= 0, outer - starts[:-1][row], -1)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values (int64) of a list column and the bounds of each row in them."""
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return values.astype(np.int64), offsets - offsets[0]


def _pieces(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """(low, high): runs of files that hold at most ``_AT_ONCE`` values, or one file.
    A batch without files is one empty run."""
    low, n = 0, len(starts) - 1
    while True:
        fits = int(np.searchsorted(starts, starts[low] + _AT_ONCE, side="right")) - 1
        high = min(n, max(fits, low + 1))
        yield low, high
        low = high
        if low >= n:
            return


def _struct_of_lists(names: list[str], starts: np.ndarray, values: tuple[np.ndarray, ...]) -> pa.Array:
    offsets = pa.array(starts.astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in values]
    return pa.StructArray.from_arrays(lists, names=names)


@F.arrow_udf(SCOPE_TYPE)
def _scope_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for classes in batches:
        bounds = classes.offsets.to_numpy(zero_copy_only=False)
        for low, high in _pieces(bounds):
            cls, starts = _lists(classes.slice(low, high - low))
            yield _struct_of_lists(list(SCOPE_FIELDS), starts, match_brackets(cls, starts))


@F.arrow_udf(NEST_TYPE)
def _nest_udf(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for columns in batches:
        bounds = columns[0].offsets.to_numpy(zero_copy_only=False)
        for low, high in _pieces(bounds):
            lists = [_lists(column.slice(low, high - low)) for column in columns]
            starts = lists[0][1]
            spans = nest_spans(*(values for values, _ in lists), starts)
            yield _struct_of_lists(["inner", "depth", "outer"], starts, spans)


# Marked so that Catalyst never copies the call into a pushed-down filter or a
# lambda: each runs exactly once per row.
scope_index = _scope_udf.asNondeterministic()
nest_index = _nest_udf.asNondeterministic()

# Send the helpers with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
