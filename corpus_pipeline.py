"""From raw documents to training tokens: five stages, each one operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm import bpe, jaccard_join, langid, mixing, suffix_dedup
from corpuscope.llm.common import table
from corpuscope.session import drop, materialize, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


# The scratch folder of the stage that ran last, by application.
_LAST: dict[str, str] = {}


def _stage(function: Callable) -> Callable:
    """A stage whose stored tables go once its result has been stored: when the next one
    begins, as that is given what was written and read again."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        if app in _LAST:
            drop(spark, _LAST.pop(app))
        with scratch(spark, f"stage-{function.__name__}") as folder:
            _LAST[app] = folder
            return function(spark, docs, sf_dir)

    return run_stage


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS[:-1], F.length("text").cast("long").alias("n_chars"))


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in which no language can be told: those without a letter.

    A text that several learned languages could have is clean and stays, whatever its
    score; the score compares the learned languages only, so a text in another language,
    or gibberish, mostly gets nearly 1 for one of them and stays, too. Null texts go;
    repeated rows are told alike; null labels teach nothing; no rows give none.
    """
    found = langid.predict(docs, langid.fit(docs), out=("__lang", "__score"))
    return found.where(F.col("__lang") != langid.UNKNOWN).select(*COLUMNS)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies: the least id, and of
    repeated rows one. Null ids come last; a text without a word is a group of its own."""
    return jaccard_join.link(docs, keep=COLUMNS[1:]).where("kept").select(*COLUMNS)


@_stage
def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has; documents of nothing else go.

    Documents are earlier by id, a null id comes last; rows of one id take nothing from
    each other. A null text becomes an empty one."""
    left = suffix_dedup.remove_repeats(docs, with_text=True, keep=("lang", "source"))
    return _columns(left.where((F.col("text") != "") | (F.col("n_removed") == 0)))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, keeps, cuts or drops documents to each source's budget of words.

    A null source is a source of its own; repeated rows count each; a document without
    words comes along with its source's whole passes; no rows give none."""
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    mixed = mixing.mix(rows, row_col="__row")
    return _columns(mixing.take(rows, mixed, "__row"))


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE ids of every document that is left, checked by decoding; a row each."""
    return bpe.round_trip(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", remove_repeats),
    ("source_mixing", mix_sources),
    ("bpe_encoding", encode),
]

# The first three stages are no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is stored and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
