"""Lexer, dependencies, structure, complexity."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscope.functions import scope
from corpuscope.functions.modes import CLOSE, OPEN, _lay_open, lay_open
from corpuscope.functions.scope import match_brackets, nest_spans
from corpuscope.operators import complexity, modules, structure, tokens

NESTED = "function f1() { if (a) {} function f3() { a && b; const f5 = function() { if (x) {} } } }"


def test_dependencies_of_every_form(files):
    code = """import a, {b} from "x"; import "side"
export * from 'y'; export {q as r} from "z"
import type T from "ty"
// import no from "no"
const s = "import x from 'bad'", t = `require("no")`;
const r = require("rq"); foo.require("no"); require("a", "b"); import("dyn"); __webpack_require__('w');
import eq = require("eq"); new require("no"); a?.require("no"); require(12); require(`no`);
require("rq");
"""
    rows = tokens.extract_dependencies(files(("/a.ts", code), ("/b.html", code))).orderBy("ord").collect()
    assert [(r.specifier, r.kind) for r in rows] == [
        ("x", "import"), ("side", "import"), ("y", "reexport"), ("z", "reexport"), ("ty", "import"),
        ("rq", "require"), ("w", "require"), ("rq", "require"),
    ]
    assert {r.path for r in rows} == {"/a.ts"}


def test_tokens_swallow_literals(files):
    code = "x = /[\"'{(]/g.test(y) / 2; // if\n/* for */ s = 'a\\'b' + `c ${d}`; z ?? w?.v; q ? .5 : 1"
    toks = [r.tok for r in tokens.code_tokens(files(("/a.js", code))).orderBy("pos").collect()]
    assert toks[:9] == ["x", "=", "/[\"'{(]/g", ".", "test", "(", "y", ")", "/"]
    assert "'a\\'b'" in toks and "if" not in toks and "for" not in toks
    at = toks.index("`c `")
    assert toks[at : at + 5] == ["`c `", OPEN, "d", CLOSE, "``"]
    assert "??" in toks and "?." in toks and "?" in toks


def test_one_megabyte_literal(files):
    big = "import 'm'; var s = '" + "x\\'" * 400_000 + "'; if (a) {}"
    row = modules.module_table(files(("/big.js", big))).collect()[0]
    assert row.dependencies == ["m"] and row.complexity == 1 and row.size == len(big)


def _kinds(files, code):
    nodes = structure.with_structure(files(("/a.ts", code))).select(F.inline("nodes")).collect()
    return [(n["kind"], n["name"]) for n in nodes]


@pytest.mark.parametrize(
    "code, kinds",
    [
        ("if (a) {} else if (b) {}", ["if", "if"]),
        ("a ? b : c; function f(x?: number) {}", ["ternary", "fn_decl"]),
        ("a && b || c ?? d; a ||= 1", ["logical", "logical"]),
        ("switch (a) { case 1: break; default: }", ["switch", "case"]),
        ("while (a) {} do { b } while (c)", ["while", "do_while"]),
        ("for (let i = 0; i < 2; i++) {} for (const k in o) {} for (const v of o) {}", ["for", "for_each", "for_each"]),
        ("for await (const v of o) { await v }", ["for_each", "await"]),
        ("try { a } catch { b }; p.catch(e)", ["try", "catch"]),
        ("x.map(function (e) {}); y.then(1, z => z)", ["callback_call", "fn_expr", "callback_call", "arrow"]),
        ("new P(() => 1); a?.b(() => 1); (() => 1)()", ["arrow", "arrow", "arrow"]),
        ("p.catch(e => 1).finally(() => 2); a.if(() => 3)", ["callback_call", "arrow", "callback_call", "arrow", "callback_call", "arrow"]),
        ("!function (a) {}(this, function () {})", ["fn_expr", "callback_call", "fn_expr"]),
        ("class A {}; const B = class {}; export default class {}", ["class_decl", "export_default", "class_decl"]),
        ("class A { m() {} get x() {} }", ["class_decl"]),
        ("o = { m() {}, get x() {}, async *y() {}, 'k'() {}, v: 1 }", ["method"] * 4),
        ("type F = (a: number) => void; function g(cb: (e) => void) {}", ["fn_decl"]),
        ("o.if; o.for; x = { if: 1, case: 2, class: 3 }", []),
    ],
)
def test_constructs(files, code, kinds):
    assert [k for k, _ in _kinds(files, code)] == kinds


def test_symbols_keep_the_double_entry(files):
    code = """export function a() {} export class B {} export default function c() {}
const d = () => 1, e = function () {}; let f: T<U> = async (x) => x; var g = 1, h = y => y;
i = function () {}; const o = { j() {}, ['k']() {} };"""
    row = structure.module_symbols(files(("/a.ts", code))).collect()[0]
    assert row.exports == ["a", "B", "default"]
    assert row.functions == ["a", "a", "c", "d", "e", "f", "h", "j"]
    assert row.classes == ["B", "B"]


def test_golden_complexity(files):
    df = files(("/b.js", NESTED))
    nodes = structure.code_nodes(df)
    assert sorted(r.complexity for r in complexity.function_complexity(nodes).collect()) == [2, 5, 11]
    assert complexity.module_complexity(nodes).collect()[0].complexity == 21
    assert modules.module_table(df).collect()[0].complexity == 21


def test_scores_beyond_a_bigint_agree(files):
    deep = "function f() { " * 70 + "if (a) {}" + " }" * 70
    df = files(("/deep.js", deep))
    nodes = structure.code_nodes(df)
    most = 2**63 - 1
    assert modules.module_table(df).collect()[0].complexity == most
    assert complexity.module_complexity(nodes).collect()[0].complexity == most
    scores = sorted(r.complexity for r in complexity.function_complexity(nodes).collect())
    assert len(scores) == 70 and scores[0] == 2 and scores[-1] == most and None not in scores


def test_long_form_golden(spark):
    nodes = spark.createDataFrame(
        [("p", 1, "fn_decl", []), ("p", 2, "if", [1]), ("p", 3, "fn_decl", [1]), ("p", 4, "logical", [3, 1]),
         ("p", 5, "fn_expr", [3, 1]), ("p", 6, "if", [5, 3, 1])],
        "path string, node_id long, kind string, fn_ancestors array<long>",
    )
    scores = {r.fn_id: r.complexity for r in complexity.function_complexity(nodes).collect()}
    assert scores == {1: 11, 3: 5, 5: 2}
    assert complexity.module_complexity(nodes).collect()[0].complexity == 21


_tree = st.recursive(
    st.sampled_from(["if", "logical", "case", "try"]),
    lambda kids: st.lists(kids, max_size=4),
    max_leaves=12,
)
_TEXT = {"if": "if (a) {}", "logical": "a && b;", "case": "switch (a) { case 1: }", "try": "try {} catch (e) {}"}
_TOP = {"if": 1, "logical": 0.5, "case": 1, "try": 1}
_FN = {"if": 1, "logical": 0.5, "case": 1, "try": 1}


def _render(node):
    if isinstance(node, str):
        return _TEXT[node]
    return "function f() { " + " ".join(_render(k) for k in node) + " }"


def _leaves(node):
    return [node] if isinstance(node, str) else [x for k in node for x in _leaves(k)]


def _functions(node):
    return [] if isinstance(node, str) else [node] + [g for k in node for g in _functions(k)]


def _score(fn):
    inside = [g for k in fn for g in _functions(k)]
    return int(1 + sum(_FN[x] for x in _leaves(fn)) + sum(_score(g) for g in inside) + 0.5)


def test_closed_form_equals_recursion(files):
    """The direct way: every function scanned again inside each enclosing one."""
    samples = []

    @settings(max_examples=60, database=None)
    @given(st.lists(_tree, max_size=4))
    def collect(forest):
        samples.append(forest)

    collect()
    df = files(*[(f"/{i}.js", "\n".join(map(_render, f))) for i, f in enumerate(samples)])
    got = {r.path: r.complexity for r in modules.module_table(df).collect()}
    for i, forest in enumerate(samples):
        top = sum(_TOP[x] for t in forest for x in _leaves(t))
        score = int(top + sum(_score(g) for t in forest for g in _functions(t)) + 0.5)
        assert got[f"/{i}.js"] == score, forest


_OPENS, _CLOSES = (scope.OPEN, scope.BODY, scope.PAREN), (scope.CLOSE, scope.TYPED)


def _brute(cls):
    """Stack-based bracket matching of one file, and scans along the levels."""
    n, stack = len(cls), []
    match, parent = [-1] * n, [-1] * n
    for i, c in enumerate(cls):
        if c in _CLOSES and stack:
            match[i] = stack.pop()
            match[match[i]] = i
        parent[i] = stack[-1] if stack else -1
        if c in _OPENS:
            stack.append(i)
    for i, c in enumerate(cls):
        if c in _OPENS and match[i] < 0:
            match[i] = n - 1

    def scan(i, wanted, step, ends=()):
        j = i
        while 0 <= j < n:
            if parent[j] == parent[i] and (j != i or not step):
                if wanted(j):
                    return j
                if cls[j] in ends:
                    return -1
            j += step or 1
            step = step or 1
        return -1

    def in_statement(i, wanted, step):
        """The next wanted token on the level, this one included where step is 0."""
        return scan(i, wanted, step, (scope.SEMI, scope.DECLARE, scope.STATEMENT, scope.BEGIN))

    def is_list(j):
        after = cls[match[j] + 1] if match[j] + 1 < n else 0
        return cls[j] == scope.PAREN and after != scope.ARROW

    ends = [scan(i, lambda j: cls[j] in (2, 3, 4, 5), 1) for i in range(n)]
    stop = [e if e >= 0 else (match[parent[i]] if parent[i] >= 0 else n) for i, e in enumerate(ends)]
    head = [scan(i, lambda j: cls[j] in (2, 4, 5), -1) for i in range(n)]
    paren = [in_statement(i, is_list, 0) for i in range(n)]
    body = [in_statement(i, lambda j: cls[j] == scope.BODY, 1) for i in range(n)]
    typed = [in_statement(i, lambda j: cls[j] == scope.TYPED, -1) for i in range(n)]
    return match, parent, stop, head, paren, body, typed


def _balanced(cls):
    depth = 0
    for c in cls:
        depth += (c in _OPENS) - (c in _CLOSES)
        if depth < 0:
            return False
    return True


_CLASSES = [0, scope.SEMI, scope.COMMA, scope.DECLARE, scope.STATEMENT, scope.BEGIN, scope.ARROW, *_OPENS, *_CLOSES]


@settings(max_examples=300, deadline=None, database=None)
@given(st.lists(st.lists(st.sampled_from(_CLASSES), max_size=16).filter(_balanced), max_size=5))
def test_match_brackets(batch):
    starts = np.cumsum([0] + [len(c) for c in batch])
    flat = np.array([x for c in batch for x in c], dtype=np.int64)
    got = match_brackets(flat, starts)
    want = [[x for c in batch for x in _brute(c)[k]] for k in range(len(scope.SCOPE_FIELDS))]
    assert [list(g) for g in got] == want


@settings(max_examples=100, deadline=None, database=None)
@given(st.lists(st.lists(st.sampled_from(["(", ")", "x"]), max_size=12), max_size=4))
def test_nest_spans(batch):
    pos, end, weight, sizes, want = [], [], [], [], []
    for text in batch:
        spans, stack = {}, []
        for i, c in enumerate(text):
            if c == "(":
                stack.append(i)
            elif c == ")" and stack:
                spans[stack.pop()] = i
        nodes = [i for i, c in enumerate(text) if c == "x" or i in spans]
        for i in nodes:
            around = [j for j in spans if j < i <= spans[j]]
            inside = sum(1 for k in nodes if k not in spans and i in spans and i < k <= spans[i])
            want.append((inside, len(around), nodes.index(max(around)) if around else -1))
        pos += nodes
        end += [spans.get(i, -1) for i in nodes]
        weight += [0 if i in spans else 1 for i in nodes]
        sizes.append(len(nodes))
    arrays = [np.array(a, dtype=np.int64) for a in (pos, end, weight)]
    got = nest_spans(*arrays, np.cumsum([0] + sizes))
    assert list(zip(*map(list, got))) == want


def test_unbalanced_code_does_not_leak(files):
    df = files(("/a.js", "}}} {{{ (a => "), ("/b.js", NESTED), ("/c.js", ""), ("/d.js", None))
    got = {r.path: r.complexity for r in modules.module_table(df).collect()}
    assert got["/b.js"] == 21 and got["/c.js"] == 0 and got["/d.js"] == 0


def test_utf16_size(files):
    assert modules.module_table(files(("/a.js", "a😀é"))).collect()[0]["size"] == 4


def test_code_operators_do_not_shuffle(files):
    plan = modules.module_table(files(("/a.js", NESTED)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


# --- no fixed distances: long signatures, overloads, object types, other letters --------


def _listed(files, code):
    return structure.module_symbols(files(("/p/a.ts", code))).head()["functions"]


LONG_TYPE = "Promise<Map<" + ", ".join(f"T{i}" for i in range(60)) + ">>"


@pytest.mark.parametrize(
    "code, functions",
    [
        (f"function f(a): {LONG_TYPE} {{ if (x) {{}} }}", ["f"]),
        ("function f<" + ", ".join(f"T{i} extends U" for i in range(40)) + ">(a) { if (x) {} }", ["f"]),
        ("function f(a: string): void; function f(a: any) { if (x) {} }", ["f"]),
        ("declare function f(a: string): void; if (q) { if (x) {} }", []),
        ("function f(a): { a: number } { if (x) {} }", ["f"]),
        ("function f(a): a is { k: 1 } { if (x) {} }", ["f"]),
        ("function café() { if (x) {} }", ["café"]),
    ],
)
def test_signatures_of_any_length(files, code, functions):
    assert _listed(files, code) == functions


def test_a_long_typed_arrow_is_found(files):
    types = ", ".join(f"A{i}" for i in range(50))
    got = structure.code_nodes(files(("/p/a.ts", f"const f = (a: X): Map<{types}> => {{ if (a) {{}} }}"))).collect()
    assert sorted(r["kind"] for r in got) == ["arrow", "if"]


def test_a_regex_literal_after_many_blanks(files):
    code = "x =" + " " * 300 + "/['\"]/; if (a) {}"
    got = structure.code_nodes(files(("/p/a.ts", code))).collect()
    assert [r["kind"] for r in got] == ["if"]


def test_imports_with_any_name(files):
    name = "n" * 500
    code = f"import déjà from 'lib-a'; import {name} = require('lib-b'); const ñ = require('lib-c');"
    got = [(r["specifier"], r["kind"]) for r in tokens.extract_dependencies(files(("/p/a.ts", code))).orderBy("ord").collect()]
    assert got == [("lib-a", "import"), ("lib-c", "require")]


# --- modes ------------------------------------------------------------------------

_PLAIN = ["x", "f(a)", "{ k: 1 }", "'a`${'", "/[`{<]/", "a < b", "// `${ <p>\n", "/* </p> */", "if (a) { b }", "q ? 1 : 2"]


def _nested(inner):
    """(source, what it becomes) of templates and elements around code."""
    text = st.sampled_from(["", "t", "it's", "//", "\\`", "$", "$x", "}", "<p>", "/"])
    words = st.sampled_from(["", " t ", " it's ", " // ", " ` ", " $ ", " if (a) "])
    name = st.sampled_from(["p", "a.b", "x-y", "Foo"])

    def template(parts):
        source, want = "", []
        for t, code in parts[:-1]:
            source += t + "${" + code[0] + "}"
            want.append(f"`{t}`{OPEN}{code[1]}{CLOSE}")
        return f"`{source}{parts[-1][0]}`", "".join(want) + f"`{parts[-1][0]}`"

    def build_element(draw):
        tag, attributes, children = draw
        head = f"<{tag}" + "".join(f' k{i}="v>" m={{{c[0]}}}' for i, c in enumerate(attributes))
        want = "".join(OPEN + c[1] + CLOSE for c in attributes)
        if children is None:
            return f"({head} />)", f"({OPEN}{want}{CLOSE})"
        body = "".join(w + "{" + c[0] + "}" for w, c in children)
        want += "".join(OPEN + c[1] + CLOSE for _, c in children)
        return f"({head}>{body}</{tag}>)", f"({OPEN}{want}{CLOSE})"

    templates = st.lists(st.tuples(text, inner), min_size=1, max_size=3).map(template)
    kids = st.none() | st.lists(st.tuples(words, inner), max_size=3)
    elements = st.tuples(name, st.lists(inner, max_size=2), kids).map(build_element)
    several = st.lists(inner, min_size=1, max_size=3).map(lambda cs: ("; ".join(c[0] for c in cs), "; ".join(c[1] for c in cs)))
    return templates | elements | several


_MODES = st.recursive(st.sampled_from(_PLAIN).map(lambda c: (c, c)), _nested, max_leaves=12)


@settings(max_examples=500, deadline=None, database=None)
@given(_MODES)
def test_modes_at_any_depth(pair):
    assert lay_open(pair[0]) == pair[1]


def test_modes_leave_other_code_alone():
    for code in (
        "a < b && c > d", "f<T>(x)", "const g = <T,>(x: T) => x", "const h = <T extends U>(x: T) => x; a = '</p>'",
        "x = <T>(y) => y; '/>'", "if (a <b/> c) {}", "`never ends ${x", "return <p>{x", "let r = /`${/; s = '`'", "}}}{", "a = b / c / `d`",
    ):
        assert lay_open(code) == code, code
    deep = "`${" * 3000 + "x" + "}`" * 3000
    assert lay_open(deep) == f"``{OPEN}" * 3000 + "x" + f"{CLOSE}``" * 3000


@pytest.mark.parametrize(
    "code, score, deps",
    [
        ("styled`${p => p.a ? 1 : 2}`", 3, []),
        ("`${require('lib')}`", 0, ["lib"]),
        ("x = <a>http://x.y {b ? 1 : 2}</a>; if (q) {}", 2, []),
        ("`a ${`b ${c ? require('in') : 2} it's`} if (x) {}`; if (y) {}", 2, ["in"]),
        ("const A = () => <ul>{xs.map(x => <li key={x}>{x && 'y'} don't</li>)}</ul>;", 7, []),
        ("return <p title='// no' on={() => { if (a) {} }}/>; require('end')", 3, ["end"]),
        ("f(`${() => 1}`); g(<p on={() => 1}/>)", 2, []),
        ("x => /[`'\"]/.test(x) ? 1 : 2; require('after')", 3, ["after"]),
    ],
)
def test_code_in_templates_and_elements(files, code, score, deps):
    row = modules.module_table(files(("/a.tsx", code))).collect()[0]
    assert (row.complexity, row.dependencies) == (score, deps)


def test_a_batch_of_files_is_worked_on_in_pieces():
    one = [scope.BODY, 0, scope.SEMI, scope.PAREN, 0, scope.CLOSE, scope.CLOSE] * 30
    sizes = [(7 * i) % 211 for i in range(4000)] + [0, 0, 200_000, 0]
    files = [(one * 1000)[:n] for n in sizes]
    batch = pa.array(files, pa.list_(pa.int8()))
    starts = np.cumsum([0, *sizes])
    wanted = match_brackets(np.concatenate([np.array(f, np.int64) for f in files]), starts)
    got = []
    tracemalloc.start()
    for piece in scope._scope_udf.func(iter([batch.slice(0, 4000)])):
        got.append(piece)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 40e6  # in one piece: over 100 MB
    got += scope._scope_udf.func(iter([batch.slice(4000)]))
    assert [len(p) for p in got][-3:] == [2, 1, 1]
    for name, values in zip(scope.SCOPE_FIELDS, wanted):
        found = np.concatenate([np.concatenate([[], *p.field(name).to_pylist()]) for p in got])
        assert (found == values).all()
    lists = [pa.array(rows, pa.list_(pa.int32())) for rows in ([[0, 2], [], [1]] * 40_000, [[5, -1], [], [4]] * 40_000, [[1, 2], [], [3]] * 40_000)]
    spans = list(scope._nest_udf.func(iter([tuple(lists)])))
    assert len(spans) == 2 and sum(map(len, spans)) == 120_000
    rows = [row for p in spans for row in p.to_pylist()]
    assert rows[:3] * 40_000 == rows and rows[0] == {"inner": [2, 0], "depth": [0, 1], "outer": [-1, 0]}


def test_laid_open_texts_go_back_in_pieces():
    texts = ["`" + "a" * 400_000 + "${x}`", None, "", "<p>{y}</p>"] * 4
    pieces = list(_lay_open.func(iter([pa.array(texts)])))
    assert len(pieces) == 2
    assert [t for p in pieces for t in p.to_pylist()] == [t if t is None else lay_open(t) for t in texts]
