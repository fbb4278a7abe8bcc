"""Obfuscation patterns: detection, rewriting and decoded payloads."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope import rules
from corpuscope.functions import text
from corpuscope.functions.arrays import explode_structs, explode_values, let
from corpuscope.operators.tokens import bundle_pieces

Rule = Callable[[Column], Column]


@dataclass(frozen=True)
class Pattern:
    """A named rule: both callables map the content column to a column."""

    name: str
    confidence: float
    detect: Rule
    rewrite: Rule


def _matches(*shapes: str) -> Rule:
    return lambda c: reduce(or_, [c.rlike(s) for s in shapes])


def _unbundle(content: Column) -> Column:
    pieces = F.transform(
        bundle_pieces(content),
        lambda p, i: F.concat(
            F.lit(rules.MODULE_HEAD), i, F.lit(rules.MODULE_OPEN), i, F.lit("("), p
        ),
    )
    return F.when(content.rlike(rules.WEBPACK_WRAPPER), F.array_join(pieces, "\n\n")).otherwise(
        content
    )


def _unglify(content: Column) -> Column:
    return let(
        text.reflow_uglify(content),
        lambda t: text.apply_rename_pairs(t, text.frequent_letters(t)),
    )


def _unconfuse(content: Column) -> Column:
    return text.decode_base64_calls(text.decode_char_codes(content))


def _many_hex(content: Column) -> Column:
    return F.regexp_count(content, F.lit(rules.HEX_ESCAPE)) > rules.HEX_MIN_COUNT


def _has_eval(content: Column) -> Column:
    return content.rlike(rules.EVAL_CALL) & _matches(*rules.EVAL_COMPANIONS)(content)


def default_patterns() -> list[Pattern]:
    """The six built-in patterns, in registration order."""
    rows: list[tuple[str, Rule, Rule]] = [
        ("webpack", _matches(rules.WEBPACK_MARKERS), _unbundle),
        ("uglify", _matches(*rules.UGLIFY_SHAPES), _unglify),
        ("terser", _matches(*rules.TERSER_SHAPES), text.reflow_terser),
        ("jsconfuser", _matches(*rules.JSCONFUSER_SHAPES), _unconfuse),
        ("custom_hex", _many_hex, text.decode_hex_escapes),
        ("eval_obfuscation", _has_eval, text.mark_eval_payloads),
    ]
    return [Pattern(name, rules.CONFIDENCE[name], find, fix) for name, find, fix in rows]


def register_pattern(
    name: str,
    confidence: float,
    detect: Rule,
    rewrite: Rule,
    patterns: Sequence[Pattern] | None = None,
) -> list[Pattern]:
    """``patterns`` (the built-in ones by default) plus one more rule."""
    base = list(default_patterns() if patterns is None else patterns)
    return [*base, Pattern(name, confidence, detect, rewrite)]


def _hits(chosen: Sequence[Pattern]) -> Column:
    """What a content shows of the given patterns, in their order."""
    return F.array_compact(
        F.array(
            *[
                F.when(
                    p.detect(F.col("content")),
                    F.struct(F.lit(p.name).alias("pattern"), F.lit(p.confidence).alias("confidence")),
                )
                for p in chosen
            ]
        )
    )


def detect_obfuscation(
    files: DataFrame, patterns: Sequence[Pattern] | None = None
) -> DataFrame:
    """``path, pattern, confidence``: one row per pattern a file shows."""
    chosen = default_patterns() if patterns is None else patterns
    return explode_structs(files, _hits(chosen), ["path"], "pattern")


def ranked_patterns(files: DataFrame, patterns: Sequence[Pattern] | None = None) -> DataFrame:
    """``path, pattern, confidence, rank``: the patterns a file shows, by falling confidence.

    Equal confidence goes by the order of the rules, as in :func:`deobfuscate`. The order
    is known before any file is read, so ranks are places in the row: no shuffle.
    """
    chosen = sorted(default_patterns() if patterns is None else patterns, key=lambda p: -p.confidence)
    rows = explode_structs(files, _hits(chosen), ["path"], "pattern", pos="__place")
    return rows.select("path", "pattern", "confidence", (F.col("__place") + 1).alias("rank"))


def deobfuscate(files: DataFrame, patterns: Sequence[Pattern] | None = None) -> DataFrame:
    """``seq, path, ext, content, applied``: content after the rewrites that apply.

    Detection looks at the original text; rewrites then run by falling confidence.
    """
    chosen = sorted(
        default_patterns() if patterns is None else patterns, key=lambda p: -p.confidence
    )
    out = files.select(
        "*", F.array(*[F.coalesce(p.detect(F.col("content")), F.lit(False)) for p in chosen]).alias("__hit")
    )
    for i, pattern in enumerate(chosen):
        rewritten = pattern.rewrite(F.col("content"))
        out = out.withColumn(
            "content", F.when(F.col("__hit")[i], rewritten).otherwise(F.col("content"))
        )
    names = F.array(*[F.lit(p.name) for p in chosen])
    applied = F.filter(F.zip_with(names, "__hit", lambda n, h: F.when(h, n)), lambda n: n.isNotNull())
    return out.withColumn("applied", applied).drop("__hit")


def extract_eval_payloads(files: DataFrame) -> DataFrame:
    """``path, idx, payload``: literal eval arguments, as text only."""
    found = F.regexp_extract_all("content", F.lit(rules.EVAL_LITERAL), F.lit(1))
    return explode_values(files, found, ["path"], "idx", "payload")


def encoded_payloads(files: DataFrame) -> DataFrame:
    """``path, kind, payload, decoded``: every encoded literal with its plain text.

    All four families come from one pass over the content.
    """

    def family(kind: str, pattern: str, group: int, decode: Rule) -> Column:
        return F.transform(
            F.regexp_extract_all("content", F.lit(pattern), F.lit(group)),
            lambda m: F.struct(
                F.lit(kind).alias("kind"), m.alias("payload"), decode(m).alias("decoded")
            ),
        )

    rows = F.concat(
        family("char_codes", rules.CHAR_CODES, 1, text.char_code_text),
        family("base64", rules.BASE64_CALL, 1, text.base64_text),
        family("hex_escape", rules.HEX_ESCAPE, 0, text.hex_escape_text),
        family("eval", rules.EVAL_LITERAL, 1, lambda m: m),
    )
    return explode_structs(files, rows, ["path"], "kind")


def _frequency(words: Column) -> Column:
    """``array<struct<ident, n, first_pos>>`` of an array of one-letter words.

    At most 52 entries; each is counted by one pass over the words.
    """

    def histogram(found: Column) -> Column:
        return F.transform(
            F.array_distinct(found),
            lambda w: F.struct(
                w.alias("ident"),
                F.size(F.filter(found, lambda x: x == w)).cast("bigint").alias("n"),
                (F.array_position(found, w) - 1).cast("int").alias("first_pos"),
            ),
        )

    return let(words, histogram)


def identifier_frequency(files: DataFrame) -> DataFrame:
    """``path, ident, n, first_pos``: one-letter words per file, counted inside the row."""
    found = _frequency(text.one_letter_words(F.col("content")))
    return explode_structs(files, found, ["path"], "ident")


def file_renames(files: DataFrame, k: int = rules.RENAME_TOP) -> DataFrame:
    """``path, ident, new_name, rank``: every file's own map, without a shuffle."""
    rows = explode_structs(files, text.frequent_letters(F.col("content"), k), ["path"], "ident", pos="__place")
    return rows.select("path", "ident", "new_name", (F.col("__place") + 1).alias("rank"))


def rename_map(freq: DataFrame, k: int = rules.RENAME_TOP) -> DataFrame:
    """``path, ident, new_name, rank`` for the k most frequent words of a given frequency
    table, such as one summed over several files. A file's own map needs no table:
    :func:`file_renames`."""
    order = Window.partitionBy("path").orderBy(F.desc("n"), "first_pos")
    names = F.array(*[F.lit(n) for n in rules.MEANINGFUL_NAMES])
    ranked = freq.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return (
        ranked.where(F.col("n") > rules.RENAME_MIN_COUNT)
        .withColumn("new_name", F.get(names, F.col("rank") - 1))
        .where(F.col("new_name").isNotNull())
        .select("path", "ident", "new_name", "rank")
    )


def apply_renames(files: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """Files with each mapped word replaced, in rank order.

    Without a table every file's own map is used, inside the row. A given table of maps
    is joined on the path.
    """
    if renames is None:
        renamed = text.apply_rename_pairs(F.col("content"), text.frequent_letters(F.col("content")))
        return files.withColumn("content", F.coalesce(renamed, F.col("content")))
    pairs = renames.groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("rank", "ident", "new_name"))).alias("__pairs")
    )
    joined = files.join(pairs, "path", "left")
    renamed = text.apply_rename_pairs(F.col("content"), F.col("__pairs"))
    return joined.withColumn("content", F.coalesce(renamed, F.col("content"))).drop("__pairs")
