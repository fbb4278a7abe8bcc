"""Lexing and dependency extraction, inside the row: no shuffle, no explode.

Strings, template texts, comments and regex literals are consumed as whole tokens, so
keywords inside them do not count. Code in a template's ``${}`` and in JSX is laid open
first (``functions.modes``): it stands between the tokens ``OPEN`` and ``CLOSE``, and
tags and the text between them are no tokens. Known limits against a full parser: a
regex literal right after ``)`` or ``}``. Identifiers may use any letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.arrays import built_once, explode_structs, explode_values, let
from corpuscope.functions.modes import OPEN, laid_open
from corpuscope.rules import (
    PARSEABLE_EXTENSIONS,
    WEBPACK_SPLIT,
    WEBPACK_WRAPPER,
)

# Possessive repetition keeps the Java matcher off the call stack for literals of
# any length. The first alternative that fits wins.
_COMMENT = r"//[^\n]*+|/\*[\s\S]*?\*/"
_STRINGS = (
    r'"(?:\\[\s\S]|[^"\\\n])*+"'
    r"|'(?:\\[\s\S]|[^'\\\n])*+'"
    r"|`(?:\\[\s\S]|[^`\\])*+`"
)
# A regex literal stands behind one of these; the two are matched as one token, with any
# white space between them, and split afterwards.
_BEFORE_REGEX = r"(?:\A|&&|\|\||\?\?|=>|[(,=:\[!&|?{;+\-~^%" + OPEN + r"]|(?<![\w$.])(?:return|typeof|case)(?![\w$]))"
_LITERAL = r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\[\n])++/[A-Za-z]*+"
_REGEX = _BEFORE_REGEX + r"\s*+" + _LITERAL
ID_START = r"[\p{L}\p{Nl}_$]"
ID_PART = r"[\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}$\x{200c}\x{200d}]"
_WORDS = f"{ID_START}{ID_PART}*+"
_MARKS = r"=>|&&|\|\||\?\?|\?\.(?!\d)|\.\.\.|\d[\w.]*+"
_OTHER = r"[^\s\w\p{L}\p{Nl}\x{a0}\x{feff}\x{2028}\x{2029}]"
# Group 1 is the token; a comment matches outside of it and so yields "".
TOKEN_RE = f"{_COMMENT}|(" + "|".join((_REGEX, _STRINGS, _WORDS, _MARKS, _OTHER)) + ")"

# Tokens are joined with this separator to match whole statements by one regex.
SEP = "\x01"
_STRING_TOKEN = r"""["'][^\x01]*+(?<=["'])(?=\x01)"""
_FROM = (
    r"\x01(?:import|export)\x01(?:" + ID_PART + r"|[*{},\x01])*+"
    r"(?:(?<=\x01from\x01)|(?<=\x01import\x01))" + _STRING_TOKEN
)
_CALL = (
    r"(?=\x01(?:require|__webpack_require__)\x01\(\x01[\"'])"
    r"(?<!\x01\.)(?<!\x01\?\.)(?<!\x01new)"
    r"\x01[\w$]++\x01\(\x01" + _STRING_TOKEN + r"(?:\x01,)?\x01\)"
)
# ``import name = require("x")`` is consumed by itself and dropped.
_ASSIGNED = r"\x01import\x01" + ID_PART + r"++\x01=(?=\x01(?:require|__webpack_require__)\x01\()\x01[\w$]++\x01\("
DEPENDENCY_RE = f"{_ASSIGNED}|{_FROM}|{_CALL}"


def is_parseable(ext: str = "ext") -> Column:
    return F.lower(F.col(ext)).isin(*PARSEABLE_EXTENSIONS)


def only_parseable(files: DataFrame) -> DataFrame:
    """Files that can hold code; HTML yields no dependencies."""
    return files.where(is_parseable())


def tokenize(content: Column) -> Column:
    """Tokens of a source text in order, comments dropped."""
    found = F.array_remove(F.regexp_extract_all(content, F.lit(TOKEN_RE), F.lit(1)), "")

    # Of all tokens only a regex literal with what stands before it has a slash inside
    # and no quote in front.
    def has_literal(t: Column) -> Column:
        return (F.length(t) > 1) & (F.instr(t, "/") > 0) & ~F.substring(t, 1, 1).isin('"', "'", "`", "/")

    def parts(t: Column) -> Column:
        at = F.instr(t, "/")
        before = F.regexp_replace(t.substr(F.lit(1), at - 1), r"\s+$", "")
        both = F.array_remove(F.array(before, t.substr(at, F.length(t))), "")
        return F.when(has_literal(t), both).otherwise(F.array(t))

    def split(toks: Column) -> Column:
        return F.when(F.exists(toks, has_literal), F.flatten(F.transform(toks, parts))).otherwise(toks)

    return let(found, split)


def with_tokens(files: DataFrame) -> DataFrame:
    """Add ``toks``: empty for files that cannot hold code."""
    empty = F.array().cast("array<string>")
    source = F.when(is_parseable(), F.col("content"))
    laid = files.withColumn("__laid", laid_open(source))
    toks = F.when(is_parseable() & F.col("content").isNotNull(), tokenize(F.coalesce("__laid", "content")))
    return laid.withColumn("toks", F.coalesce(toks, empty)).drop("__laid")


@built_once
def dependency_structs(toks: str) -> Column:
    """``array<struct<specifier, kind>>`` in source order, repeats kept."""
    text = F.concat(F.lit(SEP), F.array_join(toks, SEP), F.lit(SEP))
    found = F.regexp_extract_all(text, F.lit(DEPENDENCY_RE), F.lit(0))
    found = F.filter(found, lambda m: ~m.endswith("\x01("))

    def describe(m: Column) -> Column:
        literal = F.regexp_extract(m, r"[\"']([^\x01]*)[\"'](?:\x01,)?(?:\x01\))?$", 1)
        word = F.regexp_extract(m, r"^.*\x01(import|export|require|__webpack_require__)\x01", 1)
        kind = (
            F.when(word == "import", "import")
            .when(word == "export", "reexport")
            .otherwise("require")
        )
        return F.struct(literal.alias("specifier"), kind.alias("kind"))

    return F.transform(found, describe)


def code_tokens(files: DataFrame) -> DataFrame:
    """``path, pos, tok``."""
    return explode_values(with_tokens(files), F.col("toks"), ["path"], "pos", "tok")


def extract_dependencies(files: DataFrame) -> DataFrame:
    """``path, specifier, kind, ord``: one row per import, re-export or require."""
    listed = with_tokens(files).select("path", dependency_structs("toks").alias("deps"))
    return explode_structs(listed, F.col("deps"), ["path"], "specifier", pos="ord").select(
        "path", "specifier", "kind", "ord"
    )


def bundle_pieces(content: Column) -> Column:
    """Module sources inside an old-style bundle wrapper; empty without one."""
    wrapped = F.regexp_extract_all(content, F.lit(WEBPACK_WRAPPER), F.lit(2))
    return F.when(F.size(wrapped) > 0, F.split(wrapped[0], WEBPACK_SPLIT, -1)).otherwise(
        F.array(content)
    )


def split_bundle_modules(files: DataFrame) -> DataFrame:
    """``path, module_idx, module_code``; a file without a wrapper stays whole."""
    return explode_values(
        files, bundle_pieces(F.col("content")), ["path"], "module_idx", "module_code"
    )
