"""N-gram Jaccard join by chosen paths.

Sets are the word shingles of whole texts, embedded as min-hash tokens. Each run starts
from one node that holds all sets and splits nodes recursively: a node chooses one
token position, or two in one case of four, and its sets go to the child named by their
token there. Nodes of few sets are compared by brute force; runs repeat until a pair at
the threshold is found with the target recall. A node still large at the deepest level
is compared block against block, in many tasks, so no pair is given up and none is
emitted as a row before it is verified.

A pair that meets in several nodes is looked at in the least of them only. Pairs whose
sketches are far below the threshold stop there; all others are verified on the exact
sets. Equal texts are one class and are joined once, by their digest.

Defined results: texts without a word (null, empty, blank) link with nothing and are
classes of their own; a text of fewer than five words is one shingle; null ids keep
their row, with the least id of the group as class; repeated rows are copies of each
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import bucketed
from corpuscope.llm.components import components
from corpuscope.llm.shingles import in_pieces, mix, shingle_hashes, text_sets
from corpuscope.session import materialize

SIMILARITY = 0.8
TARGET_RECALL = 0.9999
POSITIONS = 64
DEPTH = 4
# A node of at most so many sets is compared at once; larger ones after the last level
# are compared in blocks of this many.
SMALL_NODE = 256
# Sketches may fall short of the threshold by so many standard deviations.
SKETCH_SLACK = 5.0
_SEED = np.uint64(0xA0761D6478BD642F)


def runs_needed(similarity: float, depth: int, target: float, positions: int = POSITIONS) -> int:
    """Runs after which a pair at the threshold has met with the target probability.

    A pair is lost in one run if no path down to ``depth`` keeps it: the chance is that
    of extinction of a branching process whose nodes keep a pair in one chosen position
    with the share of positions in which the pair's sketches agree. All runs choose from
    the same positions, so the miss of all is averaged over that share, not the loss of one.
    """
    agreed = np.arange(positions + 1)
    weight = np.array([math.comb(positions, k) * similarity**k * (1.0 - similarity) ** (positions - k) for k in agreed.tolist()])
    share, lost = agreed / positions, np.zeros(positions + 1)
    for _ in range(depth):
        gone = 1.0 - share + share * lost
        lost = 0.75 * gone + 0.25 * gone * gone
    if weight[0] >= 1.0 - target:
        raise ValueError("too few positions for this recall at so low a similarity")
    runs = 1
    while float(weight @ lost**runs) > 1.0 - target:
        runs += 1
    return runs


def sketches(column: pa.Array, positions: int = POSITIONS) -> np.ndarray:
    """(texts, positions) min-hash tokens of 32 bits; all ones for a text without words."""
    masks = mix(np.arange(1, positions + 1, dtype=np.uint64) * _SEED)
    out = np.full((len(column), positions), 0xFFFFFFFF, np.uint32)
    for a, b, data, offsets in in_pieces(column):
        hashes, bounds = shingle_hashes(data, offsets)
        full = np.flatnonzero(np.diff(bounds))
        if len(full) == 0:
            continue
        firsts = bounds[:-1][full]
        for k in range(positions):
            least = np.minimum.reduceat((hashes ^ masks[k]) * (masks[k] | np.uint64(1)), firsts)
            out[a + full, k] = (least >> np.uint64(32)).astype(np.uint32)
    return out


def _chosen(nodes: np.ndarray, positions: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, position) of the one or two positions that each node splits on."""
    draw = mix(nodes ^ _SEED)
    first = (draw >> np.uint64(8)) % np.uint64(positions)
    # The second differs from the first.
    second = (first + np.uint64(1) + (draw >> np.uint64(24)) % np.uint64(positions - 1)) % np.uint64(positions)
    twice = np.flatnonzero((draw & np.uint64(3)) == 0)
    return [(np.arange(len(nodes)), first.astype(np.int64)), (twice, second[twice].astype(np.int64))]


def _children(nodes: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) for every child that the row's set goes to; ``tokens`` row by row."""
    rows, made = [], []
    for at, position in _chosen(nodes, tokens.shape[1]):
        token = tokens[at, position].astype(np.uint64)
        made.append(mix(mix(nodes[at] + position.astype(np.uint64) + np.uint64(1)) ^ token))
        rows.append(at)
    return np.concatenate(rows), np.concatenate(made)


def _tokens(column: pa.Array, positions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), positions)


def link(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    target_recall: float = TARGET_RECALL,
    depth: int = DEPTH,
    small: int = SMALL_NODE,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """(id, text_class, class_id, n_links, kept[, columns named in keep]) of every row.

    ``text_class`` is the least id among equal texts, ``class_id`` the least id that
    links reach; ``n_links`` counts the other documents linked directly, copies
    included; ``kept`` marks one row of each class.
    """
    base = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"),
        F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.lit(0).alias("none")).alias("kept"),
    )
    base = bucketed(base.withColumn("digest", F.sha2("text", 256)), "row", "jaccard_texts")
    kind = base.schema["id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = sketches(part.column(2))
            blank = (found == 0xFFFFFFFF).all(axis=1)
            column = pa.array([None if b else s.tobytes() for b, s in zip(blank, found)], pa.binary())
            # One byte of each token tells sketches apart: chance agreement is 1/256.
            marks = pa.array([None if b else s.tobytes() for b, s in zip(blank, found.astype(np.uint8))], pa.binary())
            columns = [part.column(0), part.column(1), part.column(3), column, marks]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "digest", "sketch", "marks"])

    source = base.select("row", "id", "text", "digest")
    rows = materialize(source.mapInArrow(sketch, f"row long, id {kind}, digest string, sketch binary, marks binary"), "jaccard-rows")
    classes = rows.where(F.col("sketch").isNotNull()).groupBy("digest").agg(
        F.min("row").alias("rep"), F.count("*").alias("n"), F.min_by(F.struct("sketch", "marks"), "row").alias("s")
    )
    classes = materialize(classes.select("digest", "rep", "n", "s.*"), "jaccard-classes")
    met = _nodes(classes, similarity, target_recall, depth, small)
    candidates = materialize(_candidates(met, classes, similarity, small), "jaccard-candidates")
    links = materialize(_verified(candidates, base, classes, similarity), "jaccard-links")
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(links.where("root <> rep").select(F.col("rep").alias("a"), F.col("root").alias("b")))

    reps = classes.select("digest", "rep", "n").join(counts, "rep", "left")
    reps = reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    # Hot digests (a third of all rows may be one text): Spark splits that side.
    wordy = F.when(F.col("sketch").isNotNull(), F.col("digest"))
    joined = rows.select("row", "id", wordy.alias("digest")).join(reps, "digest", "left")
    joined = joined.select(
        "row", "id", F.coalesce("rep", "row").alias("rep"), F.coalesce("root", "rep", "row").alias("root"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).cast("long").alias("n_links"),
    )
    joined = materialize(joined, "jaccard-joined")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least")
    by_rep = joined.groupBy("rep").agg(F.min("id").alias("text_class"))
    by_root = joined.groupBy("root").agg(least)
    out = joined.join(by_rep, "rep").join(by_root, "root")
    out = out.select(
        F.col("id").alias(id_col), "row", "text_class", F.col("least.id").alias("class_id"), "n_links",
        (F.col("row") == F.col("least.row")).alias("kept"),
    )
    if not keep:
        return out.drop("row")
    carried = base.select("row", *[F.col(f"kept.c{i}").alias(f"__keep{i}") for i in range(len(keep))])
    out = out.join(carried, "row").drop("row")
    return out.select("*", *[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)]).drop(*[f"__keep{i}" for i in range(len(keep))])


def _nodes(classes: DataFrame, similarity: float, target: float, depth: int, small: int) -> DataFrame:
    """(rep, node, size): the nodes in which each set is compared."""
    runs = runs_needed(similarity, depth, target)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        for part in batches:
            tokens = _tokens(part.column(1), POSITIONS)
            reps = part.column(0).to_numpy()
            for root in roots:
                at, made = _children(np.full(len(reps), root), tokens)
                yield pa.RecordBatch.from_arrays([pa.array(reps[at]), pa.array(made.view(np.int64))], ["rep", "node"])

    def deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            nodes = part.column(1).to_numpy().view(np.uint64)
            at, made = _children(nodes, _tokens(part.column(2), POSITIONS))
            yield pa.RecordBatch.from_arrays([pa.array(part.column(0).to_numpy()[at]), pa.array(made.view(np.int64))], ["rep", "node"])

    live = materialize(classes.select("rep", "sketch").mapInArrow(first, "rep long, node long"), "jaccard-level")
    final = []
    for level in range(1, depth + 1):
        # Sizes aggregate map-side; most nodes hold one set and go no further.
        sizes = live.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        sized = materialize(live.join(sizes, "node").select("rep", "node", "size"), "jaccard-sized")
        if level == depth:
            final.append(sized)
            break
        final.append(sized.where(F.col("size") <= small))
        large = sized.where(F.col("size") > small)
        grown = large.select("rep", "node").join(classes.select("rep", "sketch"), "rep")
        live = materialize(grown.select("rep", "node", "sketch").mapInArrow(deeper, "rep long, node long"), "jaccard-level")
    out = final[0]
    for more in final[1:]:
        out = out.union(more)
    return out


def _candidates(met: DataFrame, classes: DataFrame, similarity: float, small: int) -> DataFrame:
    """(grp, rep, n, partners): sets of a node (or pair of blocks) that need an exact look."""
    # A set is in at most a few dozen nodes: runs times the children of a path.
    places = met.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("node", "size"))).alias("places"))
    rows = places.join(classes.select("rep", "n", "marks"), "rep")
    rows = rows.withColumn("nodes", F.transform("places", lambda p: p["node"]))
    rows = rows.select("rep", "n", "marks", "nodes", F.explode("places").alias("place"))
    blocks = F.ceil(F.col("place.size") / F.lit(small)).cast("int")
    mine = F.pmod(F.xxhash64("rep", "place.node"), blocks).cast("int")
    rows = rows.select("rep", "n", "marks", "nodes", F.col("place.node").alias("node"), blocks.alias("blocks"), mine.alias("block"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("grp"),
        (F.col("block") > F.col("other")).alias("late"), (F.col("block") == F.col("other")).alias("same"),
        "node", "rep", "n", "marks", "nodes",
    )
    dealt = rows.repartition("grp").sortWithinPartitions("grp", "rep")
    least = similarity - SKETCH_SLACK * math.sqrt(similarity * (1 - similarity) / POSITIONS)

    def compare(part: pa.Table) -> pa.RecordBatch | None:
        reps = part["rep"].to_numpy()
        marks = np.frombuffer(b"".join(part["marks"].to_pylist()), np.uint8).reshape(len(reps), POSITIONS)
        same = (marks[:, None, :] == marks[None, :, :]).sum(axis=2, dtype=np.int16) / POSITIONS if len(reps) <= 64 else _agreement(marks)
        close = (same - 1 / 256) / (1 - 1 / 256) >= least
        close &= reps[:, None] < reps[None, :]
        if not part["same"][0].as_py():
            late = part["late"].to_numpy()
            close &= late[:, None] != late[None, :]
        i, j = np.nonzero(close)
        if len(i) == 0:
            return None
        node = part["node"][0].as_py()
        nodes = [frozenset(x) for x in part["nodes"].to_pylist()]
        # Only the least common node of a pair looks at it.
        here = [min(nodes[a] & nodes[b]) == node for a, b in zip(i.tolist(), j.tolist())]
        i, j = i[here], j[here]
        if len(i) == 0:
            return None
        used = np.unique(np.r_[i, j])
        partners = [reps[j[i == u]].tolist() for u in used.tolist()]
        columns = [np.full(len(used), part["grp"][0].as_py()), reps[used], part["n"].to_numpy()[used]]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(partners, pa.list_(pa.int64()))], ["grp", "rep", "n", "partners"])

    return dealt.mapInArrow(by_group("grp", compare), "grp long, rep long, n long, partners array<long>")


def _agreement(marks: np.ndarray) -> np.ndarray:
    """Share of equal marks of every two rows, a position at a time."""
    same = np.zeros((len(marks), len(marks)), np.int16)
    for k in range(marks.shape[1]):
        same += marks[:, k, None] == marks[None, :, k]
    return same / marks.shape[1]


def by_group(key: str, work):
    """A mapInArrow function over rows sorted by ``key``: ``work`` gets each group's rows
    as a table and gives a batch or None. One group is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, part]) if rest is not None and len(rest) else part
            keys = table[key].to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            bounds = [0, *cuts.tolist()]
            table = table.combine_chunks()
            for a, b in zip(bounds[:-1], bounds[1:]):
                made = work(table.slice(a, b - a))
                if made is not None:
                    yield made
            rest = table.slice(bounds[-1])
        if rest is not None and len(rest):
            made = work(rest)
            if made is not None:
                yield made

    return run


def _verified(candidates: DataFrame, base: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(rep, links, root) per group: documents linked by exact sets, and a common root."""
    needed = candidates.select(F.col("rep").alias("row")).distinct()
    # Only texts with candidates become sets; a class is read from its first row.
    texts = base.select("row", "text").join(needed, "row").select(F.col("row").alias("rep"), "text")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            sets = pa.array([s.tobytes() for s in text_sets(part.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), sets], ["rep", "hashes"])

    sets = texts.select("rep", "text").mapInArrow(to_sets, "rep long, hashes binary")
    dealt = candidates.join(sets, "rep").repartition("grp").sortWithinPartitions("grp", "rep")

    def verify(part: pa.Table) -> pa.RecordBatch | None:
        reps, n = part["rep"].to_numpy(), part["n"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in part["hashes"].to_pylist()]
        at = {r: i for i, r in enumerate(reps.tolist())}
        pairs = [(i, at[p]) for i, ps in enumerate(part["partners"].to_pylist()) for p in ps]
        left, right = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        common = _common(sets, left, right)
        sizes = np.array([len(s) for s in sets])
        whole = sizes[left] + sizes[right] - common
        # Whole numbers: common / whole >= similarity, safe from rounding at the edge.
        linked = common * 1_000_000 >= round(similarity * 1_000_000) * whole
        if not linked.any():
            return None
        left, right = left[linked], right[linked]
        links = np.bincount(left, n[right], len(reps)) + np.bincount(right, n[left], len(reps))
        root = list(range(len(reps)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(left.tolist(), right.tolist()):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        used = np.flatnonzero(links)
        roots = reps[[find(u) for u in used.tolist()]]
        columns = [reps[used], links[used].astype(np.int64), roots]
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["rep", "links", "root"])

    return dealt.select("grp", "rep", "n", "partners", "hashes").mapInArrow(by_group("grp", verify), "rep long, links long, root long")


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of the given pairs of sorted sets."""
    if len(left) <= 2 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left.tolist(), right.tolist())])
    # Many pairs of few sets: a membership matrix, a slice of the hashes at a time.
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, index, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = uses > 1
    column = np.cumsum(shared) - 1
    keep = shared[index]
    owner, index = owner[keep], column[index[keep]]
    order = np.argsort(index, kind="stable")
    owner, index = owner[order], index[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(index, (low, low + columns))
        member = np.zeros((len(sets), columns), np.float32)
        member[owner[a:b], index[a:b] - low] = 1.0
        total += member @ member.T
    return np.rint(total[left, right]).astype(np.int64)
