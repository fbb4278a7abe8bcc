"""Code structure inside the row: constructs, function spans, symbols.

``with_structure`` adds one array, ``nodes``, ordered by position. Each node is
``struct<pos, kind, end, name, exported, inner, depth, outer>``:

pos       index of the construct's first token (its id within the file)
kind      a key of ``rules.NODE_WEIGHTS``, a function kind, or ``export_default``
end       last token of a function's span, -1 for other kinds
name      the name it is listed under, null when it has none
exported  whether an inline ``export`` precedes it
inner     twice the summed in-function weight below a function
depth     number of functions around it
outer     index (in the array) of the innermost function around it, else -1
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions import scope
from corpuscope.functions.arrays import between, built_once, explode_structs, indexes, let
from corpuscope.functions.modes import CLOSE, OPEN
from corpuscope.operators.tokens import ID_PART, ID_START, with_tokens
from corpuscope.rules import FUNCTION_KINDS, NODE_WEIGHTS

_NODE = "array<struct<pos:int,kind:string,end:int,name:string,exported:boolean>>"

_WORD = f"^{ID_START}{ID_PART}*$"
_DECLARE = ("var", "let", "const")
_STATEMENT = ("return", "if", "for", "while", "throw", "switch", "try", "do", "import", "export")
_CONTROL = ("if", "for", "while", "switch", "with", "catch", "function")
# A word before "(" that does not make it a call.
_NOT_CALLEE = _CONTROL + (
    "return", "typeof", "void", "delete", "in", "of", "case", "throw", "new", "do", "else",
    "yield", "await", "instanceof", "async", "export", "default", "extends",
)
# After one of these tokens an expression continues, so ``function`` or ``class``
# is no declaration.
_EXPRESSION_BEFORE = (
    "=", "(", ",", ":", "[", "?", "!", "~", "+", "-", "*", "/", "%", "&", "|", "^", "<", ">",
    "&&", "||", "??", "=>", "...", ".", "?.", "return", "typeof", "void", "new", "delete", "in",
    "of", "instanceof", "case", "throw", "yield", "await", "extends", OPEN,
)
# Before an opening brace, one of these makes it an object literal.
_OBJECT_BEFORE = (
    "=", "(", ",", ":", "[", "?", "&&", "||", "??", "!", "+", "...", "return", "default",
    "yield", "await", "throw", "typeof", "in", "of", OPEN,
)
_CANDIDATES = (
    "if", "?", "&&", "||", "switch", "case", "while", "do", "for", "try", "catch", "await",
    "class", "function", "=>", "export", "(",
)
# Before an opening brace, one of these makes it part of a type or an expression.
_TYPE_BEFORE = (":", "|", "&", "is", "<", ",", "=>", "extends", "?")
# A word that begins another declaration, so that a signature before it has ended.
_BEGINS = ("function", "class", "interface", "declare", "abstract", "enum", "namespace")


def _is(value: Column, *options: str) -> Column:
    return F.coalesce(value.isin(*options), F.lit(False))


def _word(value: Column) -> Column:
    return F.coalesce(value.rlike(_WORD), F.lit(False))


@built_once
def token_classes(toks: str) -> Column:
    """One small code per token of column ``toks``, the input of ``scope_index``.

    The column is named several times, so Catalyst keeps it computed once. No
    ``let`` here: a Python UDF is not planned when its argument holds a lambda
    that uses another lambda's variable.
    """

    def classify(t: Column, i: Column) -> Column:
        inert = _is(F.get(toks, i - 1), ".", "?.") | _is(F.get(toks, i + 1), ":")
        # Most tokens are none of these: one set lookup lets them go.
        return (
            F.when(~t.isin("(", "[", "{", ")", "]", "}", OPEN, CLOSE, ";", ",", "=>", *_DECLARE, *_STATEMENT, *_BEGINS), 0)
            .when(t == "(", scope.PAREN)
            .when(t == "{", F.when(_is(F.get(toks, i - 1), *_TYPE_BEFORE), scope.OPEN).otherwise(scope.BODY))
            .when(t.isin("[", OPEN), scope.OPEN)
            .when((t == ")") & _is(F.get(toks, i + 1), ":"), scope.TYPED)
            .when(t.isin(")", "]", "}", CLOSE), scope.CLOSE)
            .when(t == "=>", scope.ARROW)
            .when(t.isin(*_BEGINS), F.when(inert | _is(F.get(toks, i + 1), "(", ",", ")", "="), 0).otherwise(scope.BEGIN))
            .when(t == ";", scope.SEMI)
            .when(t == ",", scope.COMMA)
            .when(t.isin(*_DECLARE), F.when(inert, 0).otherwise(scope.DECLARE))
            .when(t.isin(*_STATEMENT), F.when(inert, 0).otherwise(scope.STATEMENT))
            .otherwise(0)
            .cast("tinyint")
        )

    return F.transform(toks, classify)


def _node(pos: Column, kind: Column, end=None, name=None, exported=None) -> Column:
    return F.struct(
        pos.cast("int").alias("pos"),
        kind.alias("kind"),
        F.coalesce(end if end is not None else F.lit(-1), F.lit(-1)).cast("int").alias("end"),
        (name if name is not None else F.lit(None)).cast("string").alias("name"),
        (exported if exported is not None else F.lit(False)).alias("exported"),
    )


class _File:
    """Expressions over one file's tokens and their scope.

    ``env`` is a lambda variable bound by ``let``. The token array must be bound
    that way: a column referenced inside a lambda may be replaced by the
    expression that computes it, which would then run once per element.
    """

    def __init__(self, env: Column) -> None:
        self.toks = env.toks
        self._scope = env.scope

    def tok(self, i: Column) -> Column:
        return F.get(self.toks, i)

    def match(self, i: Column) -> Column:
        return F.get(self._scope.match, i)

    def parent(self, i: Column) -> Column:
        return F.get(self._scope.parent, i)

    def stop(self, i: Column) -> Column:
        return F.get(self._scope.stop, i)

    def head(self, i: Column) -> Column:
        return F.get(self._scope.head, i)

    def simple_kind(self, i: Column) -> Column:
        """The kind of a construct that needs no span, or null."""
        t, prev, nxt = self.tok(i), self.tok(i - 1), self.tok(i + 1)
        do_tail = _is(prev, "}") & _is(self.tok(self.match(i - 1) - 1), "do")
        header = F.when(_is(nxt, "("), i + 1).when(_is(nxt, "await") & _is(self.tok(i + 2), "("), i + 2)
        classic = let(
            header,
            lambda h: F.exists(
                between(h + 1, self.match(h) - 1), lambda j: _is(self.tok(j), ";") & (self.parent(j) == h)
            ),
        )
        return (
            F.when((t == "if") & _is(nxt, "("), "if")
            .when(
                (t == "?") & ~_is(nxt, ":", ")", ",", ";", "=", "]", "}", "?", "|"),
                "ternary",
            )
            .when(t.isin("&&", "||"), F.when(~_is(nxt, "="), "logical"))
            .when((t == "switch") & _is(nxt, "("), "switch")
            .when((t == "case") & ~_is(nxt, ":"), "case")
            .when((t == "while") & _is(nxt, "(") & ~do_tail, "while")
            .when((t == "do") & ~_is(nxt, ":", ",", ")", "=", "("), "do_while")
            .when((t == "for") & header.isNotNull(), F.when(classic, "for").otherwise("for_each"))
            .when((t == "try") & _is(nxt, "{"), "try")
            .when((t == "catch") & _is(prev, "}") & _is(nxt, "(", "{"), "catch")
            .when(
                (t == "await") & ~_is(prev, "for") & ~_is(nxt, ":", ",", ")", ";", "=", ".", "=>"),
                "await",
            )
        )

    def export_and_class(self, i: Column) -> Column:
        """Nodes for ``export default`` and for class declarations, else null."""
        t, prev, nxt = self.tok(i), self.tok(i - 1), self.tok(i + 1)
        named = _word(nxt) & ~_is(nxt, "extends", "implements")
        class_decl = (
            (t == "class") & ~_is(prev, *_EXPRESSION_BEFORE) & (named | _is(prev, "default"))
        )
        exported = _is(prev, "export") | (_is(prev, "abstract") & _is(self.tok(i - 2), "export"))
        return F.when(
            (t == "export") & _is(nxt, "default"),
            _node(i, F.lit("export_default"), name=F.lit("default")),
        ).when(class_decl, _node(i, F.lit("class_decl"), name=F.when(named, nxt), exported=exported))

    def _found(self, index: Column) -> Column:
        return F.when(index >= 0, index)

    def paren(self, i: Column) -> Column:
        """The ``(`` of the parameter list at or after ``i``, past type parameters; or null."""
        return self._found(F.get(self._scope.paren, i))

    def body_open(self, close: Column) -> Column:
        """The ``{`` of a body after a parameter list, past a return type; or null."""
        after = self.tok(close + 1)
        return F.when(_is(after, "{"), close + 1).when(
            _is(after, ":"), self._found(F.get(self._scope.body, close + 1))
        )

    def assigned_name(self, start: Column) -> Column:
        """Name of the variable whose initialiser starts at ``start``, else null."""
        target, before = self.tok(start - 2), self.tok(start - 3)

        def resolve(head: Column) -> Column:
            declared = _is(self.tok(head), *_DECLARE)
            return F.when(
                _word(target) & (_is(before, *_DECLARE) | (_is(before, ",") & declared)), target
            ).when(declared & _is(self.tok(head + 2), ":") & _word(self.tok(head + 1)), self.tok(head + 1))

        return F.when(_is(self.tok(start - 1), "="), let(self.head(start), resolve))

    def function_node(self, i: Column) -> Column:
        """A ``function`` keyword as declaration or expression, null without a body."""
        name_at = F.when(_is(self.tok(i + 1), "*"), i + 2).otherwise(i + 1)
        start = F.when(_is(self.tok(i - 1), "async"), i - 1).otherwise(i)
        parts = F.struct(
            start.alias("start"),
            F.when(_word(self.tok(name_at)), self.tok(name_at)).alias("name"),
            self.body_open(self.match(self.paren(name_at))).alias("body"),
        )

        def build(p: Column) -> Column:
            prev = self.tok(p.start - 1)
            declares = ~_is(prev, *_EXPRESSION_BEFORE) & (p.getField("name").isNotNull() | _is(prev, "default"))
            declaration = _node(
                p.start, F.lit("fn_decl"), self.match(p.body), p.getField("name"), _is(prev, "export")
            )
            expression = _node(p.start, F.lit("fn_expr"), self.match(p.body), self.assigned_name(p.start))
            return F.when(p.body.isNotNull(), F.when(declares, declaration).otherwise(expression))

        usable = _is(self.tok(i + 1), "(", "*") | _word(self.tok(i + 1))
        return F.when(usable, let(parts, build))

    def arrow_node(self, i: Column) -> Column:
        """An arrow function; null for a function type."""
        prev = self.tok(i - 1)
        typed_close = self._found(F.get(self._scope.typed, i))
        typed = _is(self.tok(i - 2), ":") & _is(self.tok(i - 3), ")") & ~_is(self.tok(self.match(i - 3) - 1), "?")
        first = (
            F.when(_is(prev, ")"), self.match(i - 1))
            .when(typed, self.match(i - 3))
            .when(_word(prev), i - 1)
            .otherwise(self.match(typed_close))
        )

        def start_of(p: Column) -> Column:
            return F.when(_is(self.tok(p - 1), "async"), p - 1).otherwise(p)

        end = F.when(_is(self.tok(i + 1), "{"), self.match(i + 1)).otherwise(self.stop(i) - 1)

        def build(s: Column) -> Column:
            around = self.parent(s)
            before = self.tok(s - 1)
            in_interface = _is(self.tok(around - 2), "interface") | (
                _is(self.tok(around - 1), "=") & _is(self.tok(around - 3), "type")
            )
            annotates = _is(before, ":") & (
                (_is(self.tok(around), "(") & (_is(self.tok(s - 3), "(", ",", "...") | _is(self.tok(s - 2), "?")))
                | in_interface
                | (_is(self.tok(s - 3), *_DECLARE))
            )
            alias = _is(before, "=") & _is(self.tok(s - 3), "type")
            is_type = annotates | alias | _is(before, "|", "<")
            node = _node(s, F.lit("arrow"), F.greatest(end, i), self.assigned_name(s))
            return F.when(s.isNotNull() & ~is_type, node)

        return let(let(first, start_of), build)

    def method_node(self, p: Column) -> Column:
        """An object-literal method, seen from the ``(`` of its parameters; or null."""
        modifiers = ("get", "set", "async", "*")
        key = F.when(_is(self.tok(p - 1), "]"), self.match(p - 1)).otherwise(p - 1)

        def skip(i: Column) -> Column:
            return F.when(_is(self.tok(i), *modifiers), i - 1).otherwise(i)

        def build(k: Column) -> Column:
            before = let(let(k - 1, skip), skip)
            around = self.parent(p)
            in_object = _is(self.tok(around), "{") & _is(self.tok(around - 1), *_OBJECT_BEFORE)
            computed = F.when((p - 1 == k + 2) & _word(self.tok(k + 1)), self.tok(k + 1))
            name = F.when(_is(self.tok(k), "["), computed).when(_word(self.tok(k)), self.tok(k))
            body = self.body_open(self.match(p))
            valid = _is(self.tok(before), "{", ",") & in_object & ~_is(self.tok(k), *_CONTROL)
            return F.when(valid & body.isNotNull(), _node(k, F.lit("method"), self.match(body), name))

        after = self.tok(self.match(p) + 1)
        return F.when(_is(after, "{", ":"), let(key, build))

    def callback_call(self, fn: Column) -> Column:
        """Position of the call that takes function node ``fn`` as a whole argument."""
        before = self.tok(fn.pos - 1)
        paren = F.when(_is(before, "("), fn.pos - 1).when(_is(before, ","), self.parent(fn.pos))

        def build(o: Column) -> Column:
            callee = self.tok(o - 1)
            after_body = _is(callee, "}") & _is(self.tok(self.match(o - 1) - 1), ")")
            dotted = _is(self.tok(o - 2), ".")
            # Behind a dot any word is a name: p.catch(e => 1).
            named = _word(callee) & (dotted | ~_is(callee, *_NOT_CALLEE))
            callable_ = named | _is(callee, ")", "]", ">") | after_body
            twice = dotted & _is(self.tok(o - 4), ".")
            constructed = (
                _is(self.tok(o - 2), "new")
                | (dotted & _is(self.tok(o - 4), "new"))
                | (twice & _is(self.tok(o - 6), "new"))
            )
            optional = (
                _is(callee, "?.")
                | _is(self.tok(o - 2), "?.")
                | (dotted & _is(self.tok(o - 4), "?."))
                | (twice & _is(self.tok(o - 6), "?."))
            )
            declares = _is(self.tok(o - 2), "function")
            whole = _is(self.tok(fn.end + 1), ",", ")")
            valid = _is(self.tok(o), "(") & callable_ & whole & ~constructed & ~optional & ~declares
            return F.when(valid, o)

        return F.when(fn.kind.isin("fn_expr", "arrow"), let(paren, build))

    def candidates(self) -> Column:
        def wanted(i: Column) -> Column:
            t = self.tok(i)
            opens_body = F.when(t == "(", _is(self.tok(self.match(i) + 1), "{", ":")).otherwise(True)
            return t.isin(*_CANDIDATES) & opens_body & ~_is(self.tok(i - 1), ".", "?.", "#")

        return F.filter(indexes(self.toks), wanted)

    def classify(self, i: Column) -> Column:
        t = self.tok(i)
        simple = let(self.simple_kind(i), lambda k: F.when(k.isNotNull(), _node(i, k)))
        return (
            F.when(t == "function", self.function_node(i))
            .when(t == "=>", self.arrow_node(i))
            .when(t == "(", self.method_node(i))
            .when(t.isin("class", "export"), self.export_and_class(i))
            .otherwise(simple)
        )


def weight_twice(kind: Column, slot: int) -> Column:
    """Twice a node's weight (an integer): slot 0 in the file, 1 in a function."""
    by_weight: dict[int, list[str]] = {}
    for name, weights in NODE_WEIGHTS.items():
        if weights[slot]:
            by_weight.setdefault(int(weights[slot] * 2), []).append(name)
    result = F.lit(0)
    for twice, names in by_weight.items():
        result = F.when(kind.isin(*names), twice).otherwise(result)
    return result


def _found_nodes(env: Column) -> Column:
    file = _File(env)
    own = F.filter(F.transform(file.candidates(), file.classify), lambda n: n.isNotNull())

    def with_calls(nodes: Column) -> Column:
        # Distinct over plain positions: over structs Spark compares all pairs.
        calls = F.array_distinct(F.array_compact(F.transform(nodes, file.callback_call)))
        listed = F.transform(calls, lambda o: _node(o, F.lit("callback_call")))
        return F.array_sort(F.concat(nodes, listed.cast(_NODE)))

    return let(own.cast(_NODE), with_calls)


@built_once
def _nodes_in(toks: str, scope_index: str) -> Column:
    return let(F.struct(F.col(toks).alias("toks"), F.col(scope_index).alias("scope")), _found_nodes)


@built_once
def _nested_nodes(found: str, nest: str) -> Column:
    nested = F.arrays_zip(f"{nest}.inner", f"{nest}.depth", f"{nest}.outer")
    return F.zip_with(
        found,
        nested,
        lambda n, x: F.struct(
            n.pos.alias("pos"),
            n.kind.alias("kind"),
            n.end.alias("end"),
            n.getField("name").alias("name"),
            n.exported.alias("exported"),
            x.inner.alias("inner"),
            x.depth.alias("depth"),
            x.getField("outer").alias("outer"),
        ),
    )


def with_structure(files: DataFrame) -> DataFrame:
    """Add ``toks`` and ``nodes`` to ``seq, path, ext, content``. No shuffle."""
    scoped = with_tokens(files).withColumn("scope", scope.scope_index(token_classes("toks")))
    nodes = scoped.withColumn("found", _nodes_in("toks", "scope")).withColumn(
        "nest",
        scope.nest_index(
            F.transform("found", lambda n: n.pos),
            F.transform("found", lambda n: n.end),
            F.transform("found", lambda n: weight_twice(n.kind, 1)),
        ),
    )
    return nodes.withColumn("nodes", _nested_nodes("found", "nest")).drop("scope", "found", "nest")


@built_once
def export_names(nodes: str) -> Column:
    kept = F.filter(nodes, lambda n: (n.kind == "export_default") | (n.exported & n.getField("name").isNotNull()))
    return F.transform(kept, lambda n: n.getField("name"))


def _names_of(nodes: str, kinds: tuple[str, ...]) -> Column:
    # An exported declaration is listed once for the export, once for itself.
    kept = F.filter(nodes, lambda n: n.kind.isin(*kinds) & n.getField("name").isNotNull())
    return F.flatten(
        F.transform(
            kept,
            lambda n: F.when(n.exported, F.array(n.getField("name"), n.getField("name"))).otherwise(F.array(n.getField("name"))),
        )
    )


@built_once
def function_names(nodes: str) -> Column:
    return _names_of(nodes, FUNCTION_KINDS)


@built_once
def class_names(nodes: str) -> Column:
    return _names_of(nodes, ("class_decl",))


def module_symbols(files: DataFrame) -> DataFrame:
    """``path, exports, functions, classes``."""
    return with_structure(files).select(
        "path",
        export_names("nodes").alias("exports"),
        function_names("nodes").alias("functions"),
        class_names("nodes").alias("classes"),
    )


def _ancestors(nodes: Column, n: Column) -> Column:
    """Positions of the functions around a node, innermost first."""

    def step(acc: Column, _: Column) -> Column:
        outer = F.get(nodes, acc.at).getField("outer")
        return F.struct(
            outer.alias("at"),
            F.array_append(acc.ids, F.get(nodes, acc.at).pos.cast("bigint")).alias("ids"),
        )

    start = F.struct(n.getField("outer").alias("at"), F.array().cast("array<bigint>").alias("ids"))
    return F.aggregate(between(F.lit(1), n.depth), start, step, lambda acc: acc.ids)


def code_nodes(files: DataFrame) -> DataFrame:
    """``path, node_id, kind, fn_ancestors``: the long form of ``nodes``."""

    def list_rows(nodes: Column) -> Column:
        return F.transform(
            F.filter(nodes, lambda n: n.kind != "export_default"),
            lambda n: F.struct(
                n.pos.cast("bigint").alias("node_id"),
                n.kind.alias("kind"),
                _ancestors(nodes, n).alias("fn_ancestors"),
            ),
        )

    rows = let(F.col("nodes"), list_rows)
    return explode_structs(with_structure(files), rows, ["path"], "node_id")
