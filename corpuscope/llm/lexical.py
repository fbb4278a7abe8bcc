"""Ranked lexical search: accumulators of short lists inside document-at-a-time skipping.

Each task files its documents in blocks: the postings of the queries' terms, list by
list, documents in ascending order. Once the collection's counts are known, a query runs
over a block in two steps. Its short lists are added up term at a time; their sums are
one iterator over the block, with a greatest value for every window of documents. Its
long lists keep a greatest impact for every window too. Then windows are visited in
document order: one whose bounds, together, stay below the query's ``top``-th score so
far is skipped; in the others only documents that can still reach that score get the
impacts of the long lists added. Scores are whole numbers and a bound equal to the
score is never skipped, so the result is that of scoring every document.

A task keeps ``top`` documents per query over all its blocks and returns only those;
they are ranked in two steps. Queries are taken in batches of bounded size, the only
thing that goes to every task.

Defined results: a null text has no terms; documents and queries without terms match
nothing; null ids come last among equal scores; repeated rows, of documents or queries,
count each; a query returns no row if nothing matches; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.session import materialize

TOP = 20
# A block has at most so many documents, and closes early at so many postings.
BLOCK_DOCS = 4096
BLOCK_POSTINGS = 1 << 20
# Documents of a window, and the share of a block from which a list is a long one.
WINDOW = 128
LONG_SHARE = 8
# Groups of tasks whose rows are ranked before they meet.
GROUPS = 64
# Text of the queries that are run at once.
BATCH_BYTES = 16 << 20
# Texts are read in slices of about this many bytes, cut between terms.
SLICE = 1 << 20

# Bytes of a term stay (upper-case letters as lower-case ones); all others end it.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def term_slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a whole text, in order, in lists of bounded length."""
    low = 0
    while low < len(text):
        part = text[low : low + SLICE].translate(_TABLE)
        if low + SLICE < len(text):
            cut = part.rfind(b" ") + 1
            if not cut:  # one term is longer than a slice
                part = text[low:].translate(_TABLE)
                cut = part.find(b" ") + 1 or len(part)
            part = part[:cut]
        yield part.split()
        low += len(part)


def _packed(values, kind) -> bytes:
    return np.asarray(values, kind).tobytes()


class _Filing:
    """Documents of a block in the making."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.ids, self.lengths, self.terms, self.tfs = [], [], [], []
        self.postings = 0

    def add(self, id_, text: bytes) -> None:
        counts: Counter = Counter()
        n = 0
        for terms in term_slices(text):
            n += len(terms)
            counts.update(map(self.vocabulary.get, terms))
        if not n:
            return
        counts.pop(None, None)
        self.ids.append(id_)
        self.lengths.append(n)
        self.terms.append(np.fromiter(counts.keys(), np.int32, len(counts)))
        self.tfs.append(np.fromiter(counts.values(), np.int64, len(counts)))
        self.postings += len(counts)

    @property
    def full(self) -> bool:
        return len(self.ids) >= BLOCK_DOCS or self.postings >= BLOCK_POSTINGS

    def batch(self, id_type: pa.DataType) -> pa.RecordBatch:
        """The block's lists; its documents in ascending order of their ids."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] if self.ids[i] is not None else 0))
        docs = np.repeat(np.arange(len(order)), [len(self.terms[i]) for i in order])
        terms = np.concatenate([self.terms[i] for i in order])
        tfs = np.concatenate([self.tfs[i] for i in order])
        by_term = np.argsort(terms, kind="stable")
        names, starts = np.unique(terms[by_term], return_index=True)
        blobs = [
            _packed([self.lengths[i] for i in order], np.int64), _packed(names, np.int32),
            _packed(np.r_[starts, len(terms)], np.int64), _packed(docs[by_term], np.int32), _packed(tfs[by_term], np.int64),
        ]
        columns = [pa.array([[self.ids[i] for i in order]], pa.list_(id_type))]
        columns += [pa.array([len(order)]), pa.array([sum(self.lengths)]), *[pa.array([b], pa.binary()) for b in blobs]]
        self.clear()
        return pa.RecordBatch.from_arrays(columns, _BLOCK)


_BLOCK = ["ids", "n_docs", "n_terms", "lengths", "terms", "starts", "docs", "tfs"]


def file_blocks(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored blocks of all documents that have a term; lists for the vocabulary's terms."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).where("text IS NOT NULL")
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filing, id_type = _Filing(vocabulary), None
        for batch in batches:
            id_type = batch.column(0).type
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                filing.add(id_, text.as_py())
                if filing.full:
                    yield filing.batch(id_type)
        if filing.ids:
            yield filing.batch(id_type)

    schema = f"ids array<{kind}>, n_docs long, n_terms long, lengths binary, terms binary, starts binary, docs binary, tfs binary"
    return materialize(source.mapInArrow(run, schema), "lexical-blocks")


def _frequencies(blocks: DataFrame, size: int) -> np.ndarray:
    """The number of documents that hold each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for terms, starts in zip(*[batch.column(i).to_pylist() for i in (0, 1)]):
                total[np.frombuffer(terms, np.int32)] += np.diff(np.frombuffer(starts, np.int64))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["term", "df"])

    parts = blocks.select("terms", "starts").mapInArrow(run, "term long, df long")
    out = np.zeros(size, np.int64)
    for r in parts.groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row per term of the queries
        out[r.term] = r.df
    return out


def length_norms(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """100 - 25 + (25 * length * n) div total, whole numbers of any size between."""
    if 25 * int(lengths.max(initial=0)) * n < 1 << 63:
        return 75 + 25 * lengths * n // total
    return np.array([75 + 25 * x * n // total for x in lengths.tolist()], np.int64)


class _Lists:
    """A block's lists with their impacts, and window bounds of the long ones."""

    def __init__(self, row: dict, weights: np.ndarray, n: int, total: int):
        self.ids = row["ids"]
        lengths = np.frombuffer(row["lengths"], np.int64)
        self.size = len(lengths)
        self.terms = np.frombuffer(row["terms"], np.int32)
        self.starts = np.frombuffer(row["starts"], np.int64)
        self.docs = np.frombuffer(row["docs"], np.int32)
        tfs = np.frombuffer(row["tfs"], np.int64)
        norms = length_norms(lengths, n, total)
        lens = np.diff(self.starts)
        self.impacts = np.repeat(weights[self.terms], lens) * (1_000_000_000 * tfs // (1000 * tfs + 12 * norms[self.docs]))
        self.is_long = lens * LONG_SHARE > self.size
        self.edges = np.arange(0, self.size, WINDOW)
        self._bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def places(self, terms: np.ndarray) -> np.ndarray:
        """The list of each term, or -1."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(len(terms), -1)

    def bounds(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """(greatest impact, first posting) of a list in every window, one more posting."""
        if at not in self._bounds:
            low, high = int(self.starts[at]), int(self.starts[at + 1])
            first = low + np.searchsorted(self.docs[low:high], np.r_[self.edges, self.size])
            most = np.zeros(len(self.edges), np.int64)
            full = np.flatnonzero(np.diff(first))
            if len(full):
                most[full] = np.maximum.reduceat(self.impacts[:high], first[:-1][full])
            self._bounds[at] = most, first
        return self._bounds[at]

    def search(self, terms: np.ndarray, times: np.ndarray, best: _Best) -> None:
        """Adds to ``best`` every document that belongs to the query's top."""
        at = self.places(terms)
        times, at = times[at >= 0], at[at >= 0]
        if not len(at):
            return
        sums = np.zeros(self.size, np.int64)
        for i, k in zip(at[~self.is_long[at]].tolist(), times[~self.is_long[at]].tolist()):
            part = slice(int(self.starts[i]), int(self.starts[i + 1]))
            sums[self.docs[part]] += k * self.impacts[part]
        long = [(*self.bounds(i), k) for i, k in zip(at[self.is_long[at]].tolist(), times[self.is_long[at]].tolist())]
        ceiling = sum((k * most for most, _, k in long), np.zeros(len(self.edges), np.int64))
        bound = np.maximum.reduceat(sums, self.edges) + ceiling
        for w in np.flatnonzero(bound >= max(best.floor, 1)).tolist():
            # The floor may have risen since.
            if bound[w] < best.floor:
                continue
            low = w * WINDOW
            scores = sums[low : low + WINDOW].copy()
            hopeful = scores + ceiling[w] >= best.floor
            for _, first, k in long:
                part = slice(int(first[w]), int(first[w + 1]))
                scores[self.docs[part] - low] += k * self.impacts[part]
            found = np.flatnonzero(hopeful & (scores >= max(best.floor, 1)))
            if len(found):
                best.add(scores[found], [self.ids[low + i] for i in found.tolist()])


class _Best:
    """The greatest scores of one query so far; equal ones by ascending id, null last."""

    def __init__(self, top: int):
        self.top, self.rows = top, []
        self.floor = 0  # scores below it are out

    def add(self, scores: np.ndarray, ids: list) -> None:
        self.rows += [(-s, i is None, i if i is not None else 0) for s, i in zip(scores.tolist(), ids)]
        self.rows.sort()
        del self.rows[self.top :]
        if len(self.rows) == self.top:
            self.floor = -self.rows[-1][0]


def search(
    docs: DataFrame,
    queries: DataFrame,
    top: int = TOP,
    batch_bytes: int = BATCH_BYTES,
    query_id: str = "item_id",
    query_text: str = "text",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(query id, rank, id, score) of the ``top`` documents of each query row."""
    asked = queries.select(
        F.monotonically_increasing_id().alias("row"), F.col(query_id).alias("query"), F.col(query_text).cast("binary").alias("text")
    )
    asked = materialize(asked, "lexical-queries")
    total = asked.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    batches = max(1, -(-total // batch_bytes))
    out = None
    for b in range(batches):
        rows = asked.where(F.pmod(F.xxhash64("row"), F.lit(batches)) == b).where("text IS NOT NULL").collect()
        found = _batch(docs, [(r.row, bytes(r.text)) for r in rows], top, id_col, text_col)
        out = found if out is None else out.union(found)
    out = out.withColumnRenamed("query", "row").join(asked.select("row", "query"), "row")
    return out.select(F.col("query").alias(query_id), "rank", F.col("id").alias(id_col), "score")


def _batch(docs: DataFrame, rows: list[tuple[int, bytes]], top: int, id_col: str, text_col: str) -> DataFrame:
    """(query, id, score, rank) of the queries given as (row, text)."""
    vocabulary: dict[bytes, int] = {}
    wanted = []
    for row, text in rows:
        counts = Counter(t for terms in term_slices(text) for t in terms)
        terms = np.array([vocabulary.setdefault(t, len(vocabulary)) for t in counts], np.int32)
        wanted.append((row, terms, np.array(list(counts.values()), np.int64)))
    blocks = file_blocks(docs, vocabulary, id_col, text_col)
    n, total = (int(x or 0) for x in blocks.agg(F.sum("n_docs"), F.sum("n_terms")).head())
    dfs = _frequencies(blocks, len(vocabulary)).tolist()
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for df in dfs], np.int64)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(top) for _ in wanted]
        id_type = None
        for part in parts:
            id_type = part.schema.field("ids").type.value_type
            for i in range(len(part)):
                lists = _Lists({name: part.column(name)[i].as_py() for name in part.schema.names}, weights, n, total)
                for (_, terms, times), mine in zip(wanted, best):
                    lists.search(terms, times, mine)
        for (row, _, _), mine in zip(wanted, best):
            if mine.rows:
                ids = [None if none else i for _, none, i in mine.rows]
                columns = [pa.array([row] * len(ids)), pa.array(ids, id_type), pa.array([-s for s, _, _ in mine.rows])]
                yield pa.RecordBatch.from_arrays(columns, ["query", "id", "score"])

    found = blocks.select("ids", "lengths", "terms", "starts", "docs", "tfs").mapInArrow(run, f"query long, id {kind}, score long")
    found = materialize(found, "lexical-found")
    # Each task has sent ``top`` rows a query at most; tasks are ranked in groups first.
    group = F.pmod(F.spark_partition_id(), F.lit(GROUPS))
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    for keys in (["query", "group"], ["query"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        found = (found.withColumn("group", group) if "group" in keys else found).withColumn("rank", place).where(F.col("rank") <= top)
        found = found.drop("group") if "group" not in keys else found.drop("rank")
    return found.select("query", "id", "score", "rank")
