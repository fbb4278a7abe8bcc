"""Subword lattice likelihood: the summed probability of all segmentations of a text.

The pieces are those of an existing public vocabulary. Its own scores are merge ranks, no
probabilities of a unigram model; they serve as first weights only: expectation maximisation over the segmentations of all training words
turns them into piece probabilities, one set per class of documents (the label column,
rare labels pooled). A word's probability is the sum over its lattice: every path of
pieces (forward recursion in log space), and one edge over the whole word with its
discounted count, which the paths share the rest of. A text's probability is the
product over its words and its end, summed over the classes by their share; the label
of a scored document is never looked at.

A word unigram with additive smoothing serves as the base. Its counts are exact for
every word. Both models read one table of words: the most frequent words, bounded in
number and length, go to the workers; all others meet their row in a join.

Defined results: a null text is an empty one (only the end is scored); repeated rows
are scored each; null ids are training rows; null labels are pooled; an empty table
gives an empty result; without a training row the vocabulary's own weights hold.
"""

from __future__ import annotations

import copy
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.llm import lattice
from corpuscope.llm.langid import labelled_words, piece_uses
from corpuscope.session import materialize

EM_ROUNDS = 2
# Weight of the vocabulary's own scores against the corpus, in pieces.
PRIOR_STRENGTH = 1_000.0
# Taken off every word count for the paths of pieces.
DISCOUNT = 0.6
# Classes besides the pooled one: the most frequent labels.
MAX_CLASSES = 15
# Bound of the word table given to every worker: so many words of so many bytes.
HOT_WORDS = 262_144
HOT_BYTES = 64
CHARS_AT_ONCE = 1_000_000
LN10 = math.log(10.0)


def tokens(text: bytes) -> list[bytes]:
    """Words of a text: A-Z in lower case, cut at space and the ASCII controls 9 to 13."""
    return text.lower().split()


class Model:
    """Classes with their figures, the table of words, and its most frequent rows."""

    def __init__(self, rows: DataFrame, vocabulary: str, rounds: int, hot_words: int):
        """``rows``: training rows (label, text)."""
        vocab = lattice.pieces(vocabulary)
        self.vocabulary = vocabulary
        labels = rows.groupBy("label").count()
        # At most one row per class comes back, however many labels there are.
        named = labels.where(F.col("label").isNotNull()).orderBy(F.desc("count"), "label").limit(MAX_CLASSES).collect()
        self.n_docs = rows.count()
        kept = {r["label"]: r["count"] for r in named}
        pooled = self.n_docs - sum(kept.values())
        sizes = [*kept.items()] + ([(None, pooled)] if pooled or not kept else [])
        self.classes = len(sizes)
        group = F.lit(self.classes - 1)
        for k, (label, _) in enumerate(sizes):
            if label is not None:
                group = F.when(F.col("label") == label, F.lit(k)).otherwise(group)
        grouped = rows.select(group.cast("string").alias("lang"), "text")
        words = materialize(labelled_words(grouped, bytes.lower), "lm-words")
        self.log_share = np.log((np.array([n for _, n in sizes], float) + 1.0) / (self.n_docs + self.classes))
        self.ends = np.array([n for _, n in sizes], float)
        seen = {r["lang"]: r for r in words.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
        mass = np.array([float(seen[str(k)]["n"]) if str(k) in seen else 0.0 for k in range(self.classes)])
        types = np.array([float(seen[str(k)]["v"]) if str(k) in seen else 0.0 for k in range(self.classes)])
        # Of all tokens of a class, with its ends: the whole (one more for unseen), and
        # what the discount leaves for the paths of pieces.
        self.whole = mass + self.ends + 1.0
        self.log_rest = np.log((DISCOUNT * types + 1.0) / self.whole)
        prior = vocab.prior()
        by_class = {str(k): lattice.fit_counts(np.zeros(vocab.size), prior, 1.0)[:, None] for k in range(self.classes)}
        for _ in range(rounds):
            uses = {k: np.zeros(vocab.size) for k in by_class}
            for k, piece, n in piece_uses(words, by_class, vocabulary).collect():  # a row per class and piece
                uses[k][piece] = n
            by_class = {k: lattice.fit_counts(u, prior, PRIOR_STRENGTH)[:, None] for k, u in uses.items()}
        self.log_p = np.concatenate([by_class[str(k)] for k in range(self.classes)], axis=1)
        self.words = materialize(self._table(words), "lm-table")
        totals = self.words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).head()
        self.train_tokens = (totals["n"] or 0) + self.n_docs
        self.types = totals["v"] + (1 if self.n_docs else 0)
        self.smooth = math.log10(self.train_tokens + 0.5 * (self.types + 1))
        self.hot = self._hot(hot_words)

    def scores(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Log10 probability of each word in each class; ``counts`` is (words, classes)."""
        order, paths = lattice.word_scores(lattice.pieces(self.vocabulary), words, self.log_p)
        at = {w: i for i, w in enumerate(order)}
        paths = paths[[at[w] for w in words]] + self.log_rest
        with np.errstate(divide="ignore"):
            edge = np.log(np.maximum(counts - DISCOUNT, 0.0) / self.whole)
        return np.logaddexp(paths, edge) / LN10

    def _slim(self) -> Model:
        """What workers need: no tables."""
        slim = copy.copy(self)
        slim.words = slim.hot = None
        return slim

    def _table(self, words: DataFrame) -> DataFrame:
        """(word, n, scores): the count over all classes, and the score in each."""
        per_class = [F.coalesce(F.sum(F.when(F.col("lang") == str(k), F.col("n"))), F.lit(0)) for k in range(self.classes)]
        counts = words.groupBy("word").agg(F.sum("n").alias("n"), F.array(*per_class).alias("counts"))
        slim = self._slim()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                found = [w.encode() for w in part.column(0).to_pylist()]
                by_class = np.array(part.column(2).flatten()).reshape(len(found), -1).astype(float)
                scores = slim.scores(found, by_class)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(scores.ravel()), scores.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["word", "n", "scores"])

        return counts.mapInArrow(run, "word string, n long, scores array<double>")

    def _hot(self, most: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The most frequent words: those above the lowest threshold that admits at most
        ``most`` of them, found on a histogram of a few hundred rows."""
        step = F.floor(F.log2("n") * 8)
        short = self.words.where(F.octet_length("word") <= HOT_BYTES)
        histogram = short.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
        admitted, least = 0, None
        for row in histogram:
            admitted += row["count"]
            if admitted > most:
                break
            least = row["step"]
        if least is None:
            return [], np.empty(0), np.empty((0, self.classes))
        rows = short.where(step >= least).toArrow().combine_chunks()
        words = [w.encode() for w in rows.column("word").to_pylist()]
        scores = np.array(rows.column("scores").combine_chunks().flatten()).reshape(len(words), -1)
        return words, np.array(rows.column("n"), dtype=float), scores

    def end_scores(self) -> np.ndarray:
        return np.log10((self.ends + 1.0) / self.whole)


def fit(
    docs: DataFrame,
    train: Column | None = None,
    vocabulary: str = lattice.VOCABULARY,
    rounds: int = EM_ROUNDS,
    hot_words: int = HOT_WORDS,
    text_col: str = "text",
    label_col: str | None = "lang",
) -> Model:
    """Learns from every row where ``train`` holds. Without a label column there is one
    class."""
    rows = docs.where(F.lit(True) if train is None else train)
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    return Model(rows.select(label.alias("label"), F.col(text_col).alias("text")), vocabulary, rounds, hot_words)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    classes, smooth = model.classes, model.smooth
    shared = docs.sparkSession.sparkContext.broadcast(model.hot)
    base_end = math.log10(model.n_docs + 0.5) - smooth
    known_end = int(model.n_docs > 0)
    ends = model.end_scores()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, scores = shared.value
        index = {w: i for i, w in enumerate(words)}
        # One column for the base, then one per class; the last row is for other words.
        rows_of = np.zeros((len(words) + 1, 2 + classes))
        rows_of[:-1, 0] = 1.0
        rows_of[:-1, 1] = np.log10(n + 0.5) - smooth
        rows_of[:-1, 2:] = scores
        other = len(words)
        for part in batches:
            for at, texts in _chunks(part.column(1).to_pylist()):
                lists = [tokens(t or b"") for t in texts]
                sizes = np.array([len(x) for x in lists], np.int64)
                flat = list(chain.from_iterable(lists))
                found = np.fromiter((index.get(w, other) for w in flat), np.int64, len(flat))
                sums = np.zeros((len(texts), 2 + classes))
                full = np.flatnonzero(sizes)
                if len(full):
                    firsts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    sums[full] = np.add.reduceat(rows_of[found], firsts, axis=0)
                rare = [Counter() for _ in texts]
                owner = np.repeat(np.arange(len(texts)), sizes)
                for i in np.flatnonzero(found == other).tolist():
                    rare[owner[i]][flat[i]] += 1
                lists_of = pa.FixedSizeListArray.from_arrays(pa.array((sums[:, 2:] + ends).ravel()), classes)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).slice(at, len(texts)),
                        pa.array(sizes + 1, pa.int64()),
                        pa.array(sums[:, 0].astype(np.int64) + known_end),
                        pa.array(sums[:, 1] + base_end),
                        lists_of.cast(pa.list_(pa.float64())),
                        pa.array([[w.decode() for w in r] for r in rare], pa.list_(pa.string())),
                        pa.array([list(r.values()) for r in rare], pa.list_(pa.int32())),
                    ],
                    ["id", "n_tokens", "known", "base", "classes", "words", "times"],
                )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, n_tokens long, known long, base double, classes array<double>, words array<string>, times array<int>"
    )
    # A row of its own key: ids may repeat or be null.
    rows = materialize(source.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w"))
    rare = rare.select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    # No key is hot: these words are rare, or longer than a worker's table admits.
    met = rare.join(model.words, "word", "left")
    met = met.mapInArrow(_unseen(model._slim()), met.select("row", "times", "n", "scores").schema)
    adds = [F.sum(F.col("times") * F.col("scores")[k]).alias(f"s{k}") for k in range(classes)]
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * (F.log10(F.col("n") + 0.5) - F.lit(smooth))).alias("more_base"),
        *adds,
    )
    joined = rows.drop("words", "times").join(sums, "row", "left")
    by_class = [
        F.col("classes")[k] + F.coalesce(f"s{k}", F.lit(0.0)) + F.lit(float(model.log_share[k]) / LN10)
        for k in range(classes)
    ]
    top = F.greatest(*by_class) if classes > 1 else by_class[0]
    total = sum((F.pow(F.lit(10.0), c - F.col("top")) for c in by_class), F.lit(0.0))
    return joined.withColumn("top", top).select(
        F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("top") + F.log10(total)).alias("score"),
    )


def _unseen(model: Model):
    """Fills in the scores of words that no training row has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            column = {n: part.column(n) for n in part.schema.names}
            lists = column["scores"]
            gone = np.array(lists.is_null())
            scores = np.zeros((len(gone), model.classes))
            scores[~gone] = np.array(lists.flatten()).reshape(-1, model.classes)
            if gone.any():
                words = [w.encode() for w in column["word"].filter(pa.array(gone)).to_pylist()]
                distinct = list(dict.fromkeys(words))
                found = model.scores(distinct, np.zeros((len(distinct), model.classes)))
                at = {w: i for i, w in enumerate(distinct)}
                scores[gone] = found[[at[w] for w in words]]
            made = pa.FixedSizeListArray.from_arrays(pa.array(scores.ravel()), model.classes).cast(pa.list_(pa.float64()))
            columns = [column["row"], column["times"], column["n"].fill_null(0), made]
            yield pa.RecordBatch.from_arrays(columns, ["row", "times", "n", "scores"])

    return run


def _chunks(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes | None]]]:
    chunk, chars, at = [], 0, 0
    for i, text in enumerate(texts):
        chunk.append(text)
        chars += len(text or b"")
        if chars >= CHARS_AT_ONCE:
            yield at, chunk
            chunk, chars, at = [], 0, i + 1
    if chunk:
        yield at, chunk
