"""Language identification by segmentation-marginalised subword unigrams.

Each language has its own probabilities over one fixed public vocabulary, learned by
expectation maximisation over the segmentations of its words. A text's score is the
product over its words of the summed probability of all segmentations (a forward
pass), times the share of the language among the labelled documents.

Defined results: a null text, or one without a letter, is ``und`` with score 0. With
no labelled document every text is ``und``. All columns of the input stay; a column
named like an output is replaced. Repeated rows get equal predictions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from corpuscope.llm import lattice
from corpuscope.session import materialize

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
# The classifier is fitted on about this many labelled documents at most, drawn by a
# hash of id and text; every document is classified.
MAX_TRAIN_DOCS = 10_000
# Languages learned at most.
MAX_LANGS = 128
EM_ROUNDS = 2
# Weight of the vocabulary's own scores, in pieces.
PRIOR_STRENGTH = 300.0
# Distinct words counted in a worker before the counts are handed on.
COUNTED_AT_ONCE = 200_000
# Documents and characters scored at once in a worker.
DOCS_AT_ONCE = 256
CHARS_AT_ONCE = 1_000_000


def _fold(word: bytes) -> bytes:
    return word.decode("utf-8").lower().encode()


def _words(text: bytes) -> list[bytes]:
    """White-space separated words; ASCII letters are lower-cased here, others in _fold."""
    return text.lower().split()


def labelled_words(labelled: DataFrame, fold: Callable[[bytes], bytes] = _fold) -> DataFrame:
    """(lang, word, n) summed over the labelled documents (columns lang, text)."""
    source = labelled.select("lang", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def batch() -> pa.RecordBatch:
            langs = pa.array([lang for lang, counts in seen.items() for _ in counts], pa.string())
            words = pa.array(list(chain.from_iterable(seen.values())), pa.binary()).cast(pa.string())
            n = pa.array(list(chain.from_iterable(c.values() for c in seen.values())), pa.int64())
            return pa.RecordBatch.from_arrays([langs, words, n], ["lang", "word", "n"])

        for part in batches:
            for lang, text in zip(part.column(0).to_pylist(), part.column(1)):
                words = _words(text.as_py() or b"")
                seen.setdefault(lang, Counter()).update(words if fold is bytes.lower else map(fold, words))
                if sum(map(len, seen.values())) >= COUNTED_AT_ONCE:
                    yield batch()
                    seen.clear()
        if seen:
            yield batch()

    partial = source.mapInArrow(run, "lang string, word string, n long")
    return partial.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def piece_uses(words: DataFrame, models: dict[str, np.ndarray], vocabulary: str) -> DataFrame:
    """(lang, piece, uses): expected uses under the current models, over all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = lattice.pieces(vocabulary)
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            groups: dict[str, dict[str, int]] = {}
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                groups.setdefault(lang, {})[word] = n
            for lang, counts in groups.items():
                uses = total.setdefault(lang, np.zeros(vocab.size))
                for block in lattice.in_blocks(list(counts)):
                    weights = np.array([counts[w] for w in block], float)
                    uses += lattice.Lattice(vocab, block).expected(models[lang], weights, vocab.size)[0]
        for lang, uses in total.items():
            at = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(uses[at], pa.float64())],
                ["lang", "piece", "uses"],
            )

    partial = words.select("lang", "word", "n").mapInArrow(run, "lang string, piece int, uses double")
    return partial.groupBy("lang", "piece").agg(F.sum("uses").alias("uses"))


class Model:
    """Languages, log prior of each, and (pieces, languages) log probabilities."""

    def __init__(self, langs: list[str], log_prior: np.ndarray, log_p: np.ndarray, vocabulary: str):
        self.langs, self.log_prior, self.log_p, self.vocabulary = langs, log_prior, log_p, vocabulary


def fit(
    docs: DataFrame,
    train: Column | None = None,
    vocabulary: str = lattice.VOCABULARY,
    max_docs: int = MAX_TRAIN_DOCS,
    max_langs: int = MAX_LANGS,
    rounds: int = EM_ROUNDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Model:
    """Learns from the rows where ``train`` holds and text and label are not null.

    At most ``max_langs`` languages are learned, those with the most rows (of equal ones
    the first by name); rows of other labels teach nothing. So the model, and what reaches
    the driver, one row per language and piece, are of bounded size.
    """
    rows = docs.where(F.lit(True) if train is None else train)
    rows = rows.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    shares = rows.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    shares.sort(key=lambda r: r["lang"].encode())
    vocab = lattice.pieces(vocabulary)
    if not shares:
        return Model([], np.empty(0), np.empty((vocab.size, 0)), vocabulary)
    langs = [r["lang"] for r in shares]
    sizes = np.array([r["count"] for r in shares], float)
    # The same share of every language would starve a rare one; each may give as many.
    per_lang = max_docs // len(langs)
    share = {r["lang"]: min(1.0, per_lang / r["count"]) for r in shares}
    draw = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1_000_000)) / F.lit(1e6)
    wanted = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in share.items()))
    sample = rows.where(draw < F.element_at(wanted, F.col(lang_col)))
    words = materialize(
        labelled_words(sample.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))), "langid-words"
    )
    prior = vocab.prior()
    models = {lang: lattice.fit_counts(np.zeros(vocab.size), prior, 1.0)[:, None] for lang in langs}
    for _ in range(rounds):
        uses = {lang: np.zeros(vocab.size) for lang in langs}
        for lang, piece, n in piece_uses(words, models, vocabulary).collect():
            uses[lang][piece] = n
        models = {lang: lattice.fit_counts(uses[lang], prior, PRIOR_STRENGTH)[:, None] for lang in langs}
    log_p = np.concatenate([models[lang] for lang in langs], axis=1)
    return Model(langs, np.log(sizes / sizes.sum()), log_p, vocabulary)


def predict(
    docs: DataFrame, model: Model, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``docs`` with the likeliest language and its posterior probability added."""
    kept = docs.drop(*out)
    spark = docs.sparkSession
    # Bounded by vocabulary size times ``max_langs``: about a quarter megabyte a language.
    shared = spark.sparkContext.broadcast(model)
    # The text stands once more in front, as bytes: words are cut without decoding.
    source = kept.select(F.col(text_col).cast("binary").alias("__text"), *[F.col(f"`{c}`") for c in kept.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        memo = lattice.Memo(lattice.pieces(m.vocabulary), m.log_p, _fold)
        for batch in batches:
            labels, scores = [], []
            texts = batch.column(0).to_pylist()
            for chunk in _chunks(texts):
                found = _posterior(chunk, m, memo)
                labels += found[0]
                scores += found[1]
            columns = [*batch.columns[1:], pa.array(labels, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[1:], *out])

    schema = StructType([*kept.schema.fields, StructField(out[0], StringType()), StructField(out[1], DoubleType())])
    return source.mapInArrow(run, schema)


def _chunks(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    chunk, chars = [], 0
    for text in texts:
        chunk.append(text)
        chars += len(text or b"")
        if len(chunk) >= DOCS_AT_ONCE or chars >= CHARS_AT_ONCE:
            yield chunk
            chunk, chars = [], 0
    if chunk:
        yield chunk


def _posterior(texts: list[bytes | None], m: Model, memo: lattice.Memo) -> tuple[list[str], list[float]]:
    lists = [_words(t) if t and m.langs and _LETTER.search(t.decode("utf-8")) else [] for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    full = np.flatnonzero(sizes)
    labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if len(full) == 0:
        return labels, scores
    per_word = memo.lookup(list(chain.from_iterable(lists)))
    firsts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    total = np.add.reduceat(per_word, firsts, axis=0) + m.log_prior
    total -= total.max(axis=1, keepdims=True)
    share = np.exp(total)
    share /= share.sum(axis=1, keepdims=True)
    best = share.argmax(axis=1)
    for row, k, p in zip(full.tolist(), best.tolist(), share.max(axis=1).tolist()):
        labels[row], scores[row] = m.langs[k], p
    return labels, scores
