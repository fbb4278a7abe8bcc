"""Column functions that rewrite source text, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscope.functions.arrays import let
from corpuscope.rules import (
    BASE64_CALL,
    CHAR_CODES,
    EVAL_LITERAL,
    EVAL_MARKED,
    HEX_ESCAPE,
    MEANINGFUL_NAMES,
    NOT_EOL,
    ONE_LETTER_WORD,
    RENAME_MIN_COUNT,
    RENAME_TOP,
    WORD_END,
    WORD_START,
    WS,
)


def replace_each(text: Column, pattern: str, rewrite: Callable[[Column], Column]) -> Column:
    """Replace every match of ``pattern`` by ``rewrite(match)``.

    Matches and the text between them are taken by the same pattern, then
    interleaved; texts without a match pass through untouched.
    """

    def rebuild(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1))
        pieces = F.zip_with(
            F.split(t, pattern, -1),
            F.transform(found, rewrite),
            lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))),
        )
        return F.when(t.rlike(pattern), F.array_join(pieces, "")).otherwise(t)

    return let(text, rebuild)


def _units_to_text(codes: Column) -> Column:
    """UTF-16 code units (ints) to text; unpaired surrogates become U+FFFD."""

    def paired(units: Column) -> Column:
        def fix(u: Column, i: Column) -> Column:
            nxt, prev = F.get(units, i + 1), F.get(units, i - 1)
            lone_high = u.between(0xD800, 0xDBFF) & ~F.coalesce(
                nxt.between(0xDC00, 0xDFFF), F.lit(False)
            )
            lone_low = u.between(0xDC00, 0xDFFF) & ~F.coalesce(
                prev.between(0xD800, 0xDBFF), F.lit(False)
            )
            return F.lpad(F.hex(F.when(lone_high | lone_low, 0xFFFD).otherwise(u)), 4, "0")

        return F.array_join(F.transform(units, fix), "")

    return F.decode(F.unhex(let(codes, paired)), "UTF-16BE")


def char_code_text(codes: Column) -> Column:
    """Comma-separated decimal codes to text."""
    numbers = F.transform(
        F.split(codes, "," + WS + "*"),
        lambda c: F.coalesce(F.trim(c).try_cast("decimal(38,0)") % 65536, F.lit(0)).cast("int"),
    )
    return _units_to_text(numbers)


def base64_text(literal: Column) -> Column:
    """Base64 to UTF-8 text, padding optional; null when it cannot be decoded."""
    body = F.regexp_replace(literal, "=.*$", "")
    usable = F.when(F.length(body) % 4 == 1, F.left(body, F.length(body) - 1)).otherwise(body)
    return F.make_valid_utf8(F.try_to_binary(usable, F.lit("base64")).cast("string"))


def hex_escape_text(escape: Column) -> Column:
    """``\\xHH`` to its character."""
    return F.decode(F.unhex(F.substring(escape, 3, 2)), "ISO-8859-1")


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def decode_char_codes(text: Column) -> Column:
    return replace_each(
        text, _bare(CHAR_CODES), lambda m: _quoted(char_code_text(F.regexp_extract(m, CHAR_CODES, 1)))
    )


def decode_base64_calls(text: Column) -> Column:
    return replace_each(
        text,
        _bare(BASE64_CALL),
        lambda m: F.coalesce(_quoted(base64_text(F.regexp_extract(m, BASE64_CALL, 1))), m),
    )


def decode_hex_escapes(text: Column) -> Column:
    return replace_each(text, HEX_ESCAPE, hex_escape_text)


def mark_eval_payloads(text: Column) -> Column:
    """Put a literal eval argument between marker comments. Nothing is executed."""
    return F.regexp_replace(text, EVAL_LITERAL, EVAL_MARKED)


def _bare(pattern: str) -> str:
    """The pattern with its one capturing group made non-capturing."""
    at = next(
        i
        for i, c in enumerate(pattern)
        if c == "(" and pattern[i + 1] != "?" and (i == 0 or pattern[i - 1] != "\\")
    )
    return pattern[: at + 1] + "?:" + pattern[at + 1 :]


def _swap(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def reflow_uglify(text: Column) -> Column:
    out = _swap(text, ";", ";\n")
    out = _swap(out, "{", "{\n")
    out = _swap(out, "}", "\n}\n")
    return _swap(out, ",", ",\n")


def reflow_terser(text: Column) -> Column:
    out = F.regexp_replace(text, "([;}])", "$1\n")
    out = _swap(out, "{", "{\n")
    return _swap(out, "}", "\n}\n")


def one_letter_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ONE_LETTER_WORD), F.lit(1))


def frequent_letters(text: Column, k: int = RENAME_TOP) -> Column:
    """``array<struct<ident, new_name>>``: the k most frequent one-letter words
    that pass the count limit, in rank order, ties by first appearance."""

    def rank(words: Column) -> Column:
        counted = F.transform(
            F.array_distinct(words),
            lambda w: F.struct(
                (-F.size(F.filter(words, lambda x: x == w))).alias("minus_n"),
                F.array_position(words, w).alias("first"),
                w.alias("ident"),
            ),
        )
        return F.slice(F.array_sort(counted), 1, k)

    names = F.array(*[F.lit(n) for n in MEANINGFUL_NAMES])
    named = F.transform(
        let(one_letter_words(text), rank),
        lambda r, i: F.struct(
            r.ident.alias("ident"),
            F.get(names, i).alias("new_name"),
            (-r.minus_n > RENAME_MIN_COUNT).alias("often"),
        ),
    )
    kept = F.filter(named, lambda r: r.often & r.new_name.isNotNull())
    return F.transform(kept, lambda r: F.struct(r.ident.alias("ident"), r.new_name.alias("new_name")))


def apply_rename_pairs(text: Column, renames: Column) -> Column:
    """Whole-word replacement of each ``ident`` by its ``new_name``, in order."""
    return F.aggregate(
        renames,
        text,
        lambda acc, r: F.regexp_replace(
            acc, F.concat(F.lit(WORD_START), r.ident, F.lit(WORD_END)), r.new_name
        ),
    )


_BLOCK_OR_LINE_COMMENT = r"/\*[\s\S]*?\*/|//" + NOT_EOL + "*"


def strip_comments(text: Column) -> Column:
    """Remove block and line comments, also those that stand inside strings."""
    return F.regexp_replace(text, _BLOCK_OR_LINE_COMMENT, "")


_INDENT = r"(?<![^\n\r\x{2028}\x{2029}])[ \t]+"


def halve_indent(text: Column) -> Column:
    """Leading blanks and tabs of each line become half as many blanks."""
    return replace_each(
        text, _INDENT, lambda m: F.repeat(F.lit(" "), F.floor(F.length(m) / 2).cast("int"))
    )


# --- fixed values: string repair rules ------------------------------------------
_JOIN_TEMPLATES = r"`([^`]+)`" + WS + r"*\+" + WS + r"*`([^`]*)`"
_JOIN_TEMPLATE_LINES = r"`([^`]+)`" + WS + r"*\n" + WS + r"*`([^`]*)`"
_PAIR = r"(?:\\" + NOT_EOL + r"|[^\\])"
_ESCAPED_QUOTE = r"""(["'`])((?:(?!\\\\{q}\1)""" + _PAIR + r""")*+)\\\\{q}\1"""
_SPLIT_STRINGS = r"""(["'])([^"']*)\1""" + WS + r"*\n" + WS + r"""*\1([^"']*)\1"""
_SPLIT_IN_LIST = r"""(\[|\{)([^\[\]{}]*?)("[^"]*?)\n""" + WS + r"""*("[^"]*?)"([,}\]])"""
_PLUS_THREE = r"""(['"`])""" + WS + r"*\+" + WS + r"*\1" + WS + r"*\+" + WS + r"""*(['"`])"""
_PLUS_TWO = r"""(['"`])""" + WS + r"*\+" + WS + r"""*(['"`])"""


def _unescape_rule(quote: str) -> Callable[[Column], Column]:
    pattern = _ESCAPED_QUOTE.replace("{q}", quote)

    def apply(t: Column) -> Column:
        fixed = F.regexp_replace(t, pattern, "$1$2" + quote + "$1")
        return F.when(t.contains("\\\\" + quote), fixed).otherwise(t)

    return apply


def normalise_strings(text: Column) -> Column:
    """Repair split and concatenated string literals, rule by rule.

    The doubly escaped quote rule consumes escape pairs possessively: it finds
    the same match as a lazy group would, without recursion per character, so
    any length works. It runs only on texts that hold the sequence at all.
    """
    out = F.regexp_replace(text, _JOIN_TEMPLATES, "`$1$2`")
    out = F.regexp_replace(out, _JOIN_TEMPLATE_LINES, "`$1$2`")
    for quote in ('"', "'"):
        out = let(out, _unescape_rule(quote))
    for digits in (1, 2, 3):
        pattern = r"\\[uU]([0-9a-fA-F]{" + str(digits) + r"})(?![0-9a-fA-F])"
        out = F.regexp_replace(out, pattern, r"\\u" + "0" * (4 - digits) + "$1")
    out = F.regexp_replace(out, _SPLIT_STRINGS, "$1$2$3$1")
    out = F.regexp_replace(out, _SPLIT_IN_LIST, '$1$2$3$4"$5')
    out = F.regexp_replace(out, _PLUS_THREE, "$1$2")
    return F.regexp_replace(out, _PLUS_TWO, "$1$2")


_FENCE = "```"


def first_markdown_section(response: Column) -> Column:
    """Lines up to the first heading outside a code fence that is not the first line.

    One running pass over the lines with a constant-size state.
    """
    blank = "^" + WS + "*"
    edges = "^" + WS + "+|" + WS + "+$"

    def cut(lines: Column) -> Column:
        start = F.struct(
            F.lit(0).alias("i"), F.lit(False).alias("in_code"), F.lit(-1).alias("cut")
        )

        def step(acc: Column, line: Column) -> Column:
            fence = line.rlike(blank + _FENCE)
            heading = (acc.i > 0) & ~acc.in_code & line.rlike(blank + "#")
            return F.struct(
                (acc.i + 1).alias("i"),
                (acc.in_code != fence).alias("in_code"),
                F.when((acc.cut < 0) & ~fence & heading, acc.i).otherwise(acc.cut).alias("cut"),
            )

        at = F.aggregate(lines, start, step, lambda acc: acc.cut)
        keep = let(at, lambda c: F.when(c >= 0, F.slice(lines, 1, c)).otherwise(lines))
        return F.array_join(keep, "\n")

    return F.regexp_replace(let(F.split(response, "\n", -1), cut), edges, "")
