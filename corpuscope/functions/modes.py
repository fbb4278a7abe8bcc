"""Code inside templates and JSX, laid open for the lexer.

What a character means depends on where it stands: text of a template, code in its
``${}``, a tag, text between tags, or code in braces there, nested to any depth. A regex
cannot tell; a scanner with a stack of modes can, in one pass. It writes the same source
anew so that a lexer without modes reads it rightly:

    `a ${x} b`                becomes   `a `[x]` b`
    <p k="v" f={g}>t {h}</p>  becomes   [[g][h]]

where the brackets are ``OPEN`` and ``CLOSE``, characters that code does not use. Text
between tags, tags and attribute names go; all other code stays as it is, to the letter.
A source that ends inside a template or an element stays as it is, too.

Only files that hold ``${``, ``</`` or ``/>`` are sent to this Arrow function.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "\ue000", "\ue001"
# Characters of results that are held before they go back to Spark.
_AT_ONCE = 1 << 20

_CODE = re.compile(
    r"""(?P<skip>\s++|//[^\n]*+|/\*[\s\S]*?\*/)
    |(?P<string>"(?:\\[\s\S]|[^"\\\n])*+"|'(?:\\[\s\S]|[^'\\\n])*+')
    |(?P<word>[\w$\u200c\u200d]++)
    |(?P<mark>[`{}</])
    |(?P<op>=>|&&|\|\||\?\?|\.\.\.|[\s\S])""",
    re.X,
)
_LITERAL = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\[\n])++/[A-Za-z]*+")
_TEMPLATE = re.compile(r"(?:\\[\s\S]|[^`\\$]|\$(?!\{))*+")
_ATTRIBUTES = re.compile(r"""(?:[^"'{}<>/]|"[^"]*+"|'[^']*+'|//[^\n]*+|/\*[\s\S]*?\*/|/(?!>))*+""")
_TEXT = re.compile(r"[^{<]*+")
_CLOSING = re.compile(r"</\s*[\w$.:-]*\s*>")
_TAG = re.compile(r"<\s*([A-Za-z_$][\w$.:-]*|(?=>))")
# Behind the name of a tag: its end, an attribute, or spread attributes.
_TAG_GOES_ON = re.compile(r"\s*/?>|\s+(?!extends\b)[A-Za-z_$][\w$:-]*\s*(?:=\s*[\"'{]|/?>|\s[A-Za-z_$]|\{)|\s*\{")
# What a regex literal, or an element, may stand behind ("" is the start of the code).
_BEFORE_LITERAL = {"", OPEN, *"(,=:[!&|?{;+-~^%", "&&", "||", "??", "=>", "return", "typeof", "case"}
_BEFORE_ELEMENT = {"", OPEN, *"(,=:[!?{;", "&&", "||", "??", "=>", "...", "return", "default", "case", "yield", "await", "else", "do"}


def lay_open(source: str) -> str:
    """The source with code in templates and elements between ``OPEN`` and ``CLOSE``."""
    out: list[str] = []
    # Frames are [mode, open braces]; the last one is where the scanner stands.
    stack: list[list] = [["code", 0]]
    at, n, prev = 0, len(source), ""
    copied = 0  # code up to here is written
    last: dict[str, int] = {}  # where an ending stands for the last time
    while at < n:
        frame = stack[-1]
        mode = frame[0]
        if mode == "code":
            found = _CODE.match(source, at)
            kind, text = found.lastgroup, found.group()
            at = found.end()
            if kind != "mark":
                if kind != "skip":
                    prev = '"' if kind == "string" else text
                continue
            start = at - 1
            if text == "{":
                frame[1] += 1
            elif text == "}":
                if frame[1] == 0 and len(stack) > 1:
                    out += [source[copied:start], CLOSE]
                    stack.pop()
                    continue
                frame[1] = max(0, frame[1] - 1)
            elif text == "`":
                out.append(source[copied:start])
                stack.append(["template", 0])
                continue
            elif text == "/":
                literal = _LITERAL.match(source, start) if prev in _BEFORE_LITERAL else None
                if literal:
                    at, text = literal.end(), '"'
            elif prev in _BEFORE_ELEMENT:
                tag = _element(source, start, last)
                if tag:
                    out += [source[copied:start], OPEN]
                    stack.append(["tag", 0])
                    at = tag
                    continue
            prev = text
        elif mode == "template":
            text = _TEMPLATE.match(source, at).group()
            out.append(f"`{text}`")
            at += len(text)
            if source.startswith("`", at):
                stack.pop()
                at, prev, copied = at + 1, "`", at + 1
            else:
                out.append(OPEN)
                stack.append(["code", 0])
                at, prev, copied = at + 2, OPEN, at + 2
        elif mode == "tag":
            at = _ATTRIBUTES.match(source, at).end()
            if source.startswith("/>", at):
                stack.pop()
                out.append(CLOSE)
                at, prev, copied = at + 2, CLOSE, at + 2
            elif source.startswith(">", at):
                frame[0] = "children"
                at += 1
            elif source.startswith("{", at):
                out.append(OPEN)
                stack.append(["code", 0])
                at, prev, copied = at + 1, OPEN, at + 1
            else:
                at += 1  # a type argument or a stray quote
        else:
            at = _TEXT.match(source, at).end()
            closing = _CLOSING.match(source, at)
            if closing:
                stack.pop()
                out.append(CLOSE)
                at, prev, copied = closing.end(), CLOSE, closing.end()
            elif source.startswith("{", at):
                out.append(OPEN)
                stack.append(["code", 0])
                at, prev, copied = at + 1, OPEN, at + 1
            else:
                tag = _TAG.match(source, at)
                if tag:
                    out.append(OPEN)
                    stack.append(["tag", 0])
                at = tag.end() if tag else at + 1
    if len(stack) > 1:
        return source
    return "".join([*out, source[copied:]]) if out else source


def _element(source: str, start: int, last: dict[str, int]) -> int | None:
    """Where the tag's name ends, if an element begins here and not a comparison or a
    type parameter. An element has an ending behind it; <T>(x) has none of its name."""
    tag = _TAG.match(source, start)
    if not tag or not _TAG_GOES_ON.match(source, tag.end()):
        return None
    ending = "</" + tag.group(1)
    for text in (ending, "/>"):
        if text not in last:
            last[text] = source.rfind(text)
    closed = last[ending] >= tag.end()
    open_ = source.startswith(">", tag.end())
    return tag.end() if closed or (not open_ and last["/>"] >= tag.end()) else None


def needs_modes(content: Column) -> Column:
    return F.contains(content, F.lit("${")) | F.contains(content, F.lit("</")) | F.contains(content, F.lit("/>"))


@F.arrow_udf(T.StringType())
def _lay_open(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for contents in batches:
        laid, size = [], 0
        for content in contents:
            laid.append(lay_open(content.as_py()) if content.is_valid else None)
            size += len(laid[-1] or "")
            if size >= _AT_ONCE:
                yield pa.array(laid, pa.string())
                laid, size = [], 0
        yield pa.array(laid, pa.string())


# Marked so that Catalyst never copies the call: it runs once per row.
_laid_open = _lay_open.asNondeterministic()


def laid_open(content: Column) -> Column:
    """The content with its modes resolved; null where it needs none."""
    return _laid_open(F.when(needs_modes(content), content))


# Send the scanner with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
