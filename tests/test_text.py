"""Text functions, obfuscation patterns, call sites, markdown sections."""

import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscope.functions import metrics, paths, text
from corpuscope.functions.arrays import counted
from corpuscope.operators import obfuscation, tokens
from corpuscope.operators.instrumentation import instrumentation_sites


def _apply(spark, fn, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r.out for r in df.select("i", fn(F.col("c")).alias("out")).orderBy("i").collect()]


HITS = {
    "webpack": ["x.webpackJsonp=1", "/* webpackChunkName */"],
    "uglify": ["a$b$c", "function a(b,c,d){", "!function(a){", "t.prototype.x=function"],
    "terser": [" a$bc ", "!function(a,b)", "xy(a,b,c)"],
    "jsconfuser": ['String["fromCharCode"](1)', 'a["constructor"]["constructor"]', "atob ('x')"],
    "custom_hex": [r"\x41" * 11],
    "eval_obfuscation": ["eval(1); new Function('x')", "eval (1); Function('return')"],
}
MISSES = {
    "webpack": ["webpack"],
    "uglify": ["function ab(c,d,e){", "a.prototype.x = function"],
    "terser": ["A$b", "_xy(a,b,c)", "xyz(a,b,c)"],
    "jsconfuser": ["String.fromCharCode(65)", "atobx("],
    "custom_hex": [r"\x41" * 10],
    "eval_obfuscation": ["eval(1)", "new Function('x')"],
}


def test_patterns_hit_and_miss(spark, files):
    pairs = [(f"/{name}/hit{i}.js", c) for name, cs in HITS.items() for i, c in enumerate(cs)]
    pairs += [(f"/{name}/miss{i}.js", c) for name, cs in MISSES.items() for i, c in enumerate(cs)]
    found = {(r.path, r.pattern) for r in obfuscation.detect_obfuscation(files(*pairs)).collect()}
    for path, _ in pairs:
        name = path.split("/")[1]
        assert ((path, name) in found) == ("/hit" in path), path


def test_rewrites_run_by_confidence_on_the_original_detection(files):
    code = 'eval("atob(\'aGk=\')");new Function("x");var a=String["fromCharCode"](104, 105);'
    row = obfuscation.deobfuscate(files(("/a.js", code), ("/b.js", "plain"))).orderBy("path").collect()
    assert row[0].applied == ["eval_obfuscation", "jsconfuser"]
    assert 'var a="hi";' in row[0].content
    assert row[1].applied == [] and row[1].content == "plain"


def test_bundle_split_and_rewrite(files):
    code = "(function(modules) {boot(__webpack_require__)})([function(a){1}, function (b){2}])"
    df = files(("/a.js", code), ("/b.js", "none"))
    rows = [(r.path, r.module_idx, r.module_code) for r in tokens.split_bundle_modules(df).orderBy("path", "module_idx").collect()]
    assert rows == [("/a.js", 0, "function(a){1}"), ("/a.js", 1, "b){2}"), ("/b.js", 0, "none")]
    out = obfuscation.deobfuscate(df).where("path = '/a.js'").collect()[0].content
    assert out == "// === MODULE 0 ===\nfunction module0(function(a){1}\n\n// === MODULE 1 ===\nfunction module1(b){2}"


def test_char_codes(spark):
    got = _apply(
        spark, text.decode_char_codes,
        'a String["fromCharCode"](72, 105,955) b', 'String["fromCharCode"](55357,56832)', 'String["fromCharCode"](55357,65)',
        'String["fromCharCode"](65601)', "none", 'x=String["fromCharCode"](65)+String["fromCharCode"](66)',
    )
    assert got == ['a "Hiλ" b', '"😀"', '"�A"', '"A"', "none", 'x="A"+"B"']


def test_base64(spark):
    text_in = "naïve ✓"
    good = base64.b64encode(text_in.encode()).decode()
    got = _apply(
        spark, text.decode_base64_calls,
        f'atob("{good}")', f"atob ( '{good.rstrip('=')}' )", "atob('A')", 'atob("/w==")', "atob(x)",
    )
    assert got == [f'"{text_in}"', f'"{text_in}"', '""', '"�"', "atob(x)"]


def test_hex_and_eval(spark):
    assert _apply(spark, text.decode_hex_escapes, r"a\x41\xe9\x4", r"\X41") == [r"aAé\x4", r"\X41"]
    got = _apply(spark, text.mark_eval_payloads, "eval('a$1');eval( \"b\" )", "eval('a\"')")
    assert got == ["// EVAL CONTENT:\na$1\n// END EVAL;// EVAL CONTENT:\nb\n// END EVAL", "eval('a\"')"]


def test_reflow(spark):
    assert _apply(spark, text.reflow_uglify, "a{b,c;}") == ["a{\nb,\nc;\n\n}\n"]
    assert _apply(spark, text.reflow_terser, "a{b;}") == ["a{\nb;\n\n}\n\n"]


def test_renames_rank_by_count_then_position(spark, files):
    body = "z " * 7 + "a " * 7 + "b " * 6 + "c " * 5 + "éa x_a a1 "
    freq = obfuscation.identifier_frequency(files(("/a.js", body)))
    counts = {r.ident: r.n for r in freq.collect()}
    # An accented letter is no word character here, so the a after it stands alone.
    assert counts == {"z": 7, "a": 8, "b": 6, "c": 5}
    renames = obfuscation.rename_map(freq).orderBy("rank").collect()
    assert [(r.ident, r.new_name) for r in renames] == [("a", "element"), ("z", "data"), ("b", "config")]
    done = obfuscation.apply_renames(files(("/a.js", body)), obfuscation.rename_map(freq)).collect()[0].content
    assert done == "data " * 7 + "element " * 7 + "config " * 6 + "c " * 5 + chr(233) + "element x_a a1 "


def test_in_row_renames_agree_with_the_table(spark, files):
    body = "k=v;" * 9 + "q(q)" * 4
    df = files(("/a.js", body))
    table = obfuscation.apply_renames(df, obfuscation.rename_map(obfuscation.identifier_frequency(df)))
    inline = df.select(text.apply_rename_pairs(F.col("content"), text.frequent_letters(F.col("content"))).alias("c"))
    assert [r.content for r in obfuscation.apply_renames(df).collect()] == [r.content for r in table.collect()]
    assert sorted(obfuscation.file_renames(df).collect()) == sorted(obfuscation.rename_map(obfuscation.identifier_frequency(df)).collect())
    assert table.collect()[0].content == inline.collect()[0].c == "element=data;" * 9 + "config(config)" * 4


@pytest.mark.parametrize(
    "before, after",
    [
        ("`a` + `b`", "`ab`"),
        ("`a`\n`b`", "`ab`"),
        (r'"a\\""', r'"a""'),
        (r"'a\\''", r"'a''"),
        ("#u41 #u4 #u123 #u1234 #U5".replace("#", chr(92)), "#u0041 #u0004 #u0123 #u1234 #u0005".replace("#", chr(92))),
        ('"foo"\n  "bar"', '"foobar"'),
        ('["ab\n "cd",]', '["ab"cd",]'),
        ("x='a' + 'b'", "x='a''b'"),
        ("'a' + 'b' + \"c\"", "'a''b'\"c\""),
        ("plain", "plain"),
    ],
)
def test_string_repair(spark, before, after):
    assert _apply(spark, text.normalise_strings, before) == [after]


def test_string_repair_on_long_text(spark):
    long = '"' + "x" * 300_000 + r'\\"" ' + "y" * 300_000
    assert _apply(spark, text.normalise_strings, long) == ['"' + "x" * 300_000 + '"" ' + "y" * 300_000]


def test_comments_and_indent(spark):
    assert _apply(spark, text.strip_comments, "a/* x\n */b // c\nd 'http://e'") == ["ab \nd 'http:"]
    assert _apply(spark, text.halve_indent, "    a\n\t\t\tb  c\n d\n\n  ") == ["  a\n b  c\nd\n\n "]


def test_markdown_section(spark):
    got = _apply(
        spark, text.first_markdown_section,
        "# T\nbody\n## Next\nx", "a\n```\n# in\n```\nb\n# cut\nx", "   ", "\n# second line", "x\n  # indented\ny", "```\n# open",
    )
    assert got == ["# T\nbody", "a\n```\n# in\n```\nb", "", "", "x", "```\n# open"]


def test_paths(spark):
    assert _apply(spark, paths.module_name, "/a/b.min.js", "x.html", "/a/.js", "/a/", "q.TS") == ["b.min", "x.html", "unknown", "unknown", "q.TS"]
    assert _apply(spark, lambda c: paths.relative_path(c, "/r"), "/r/a/b.js", "/r\\a\\b", "/s/x") == ["a/b.js", "a/b", "/s/x"]
    assert _apply(spark, paths.node_key, "/a-b.js") == ["node__a_b_js"]
    assert _apply(spark, paths.extension, "/a.b/c", "/x.TS", "/.js") == ["", "ts", ""]
    assert _apply(spark, metrics.content_key, "abc") == ["ba7816bf8f01cfea414140de5dae2223"]


def test_call_sites(files):
    code = "function go() { x = 1; y == 2 } fetch('/a'); new XMLHttpRequest(); document.querySelectorAll('a'); sessionStorage.getItem('k');"
    df = files(("/a.js", code))
    rows = {(r.family, r.target): r.n for r in instrumentation_sites(df).collect()}
    assert rows == {
        ("function", "go"): 1, ("variable", "x"): 1, ("variable", "y"): 1, ("api", "fetch"): 1, ("api", "XMLHttpRequest"): 1,
        ("dom", "querySelector"): 1, ("storage", "sessionStorage.getItem"): 1,
    }
    only = instrumentation_sites(df, track_functions=False, track_variables=False, track_dom_access=False, track_storage_access=False)
    assert {r.family for r in only.collect()} == {"api"}


@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("xyz")), max_size=30))
@settings(max_examples=5, deadline=None, database=None)
def test_counts_inside_the_row(spark, pairs):
    df = spark.createDataFrame([(pairs,)], "a array<struct<f:string,t:string>>")
    got = df.select(counted(F.col("a")).alias("c")).collect()[0].c
    want = sorted((p, pairs.count(p)) for p in set(pairs))
    assert [(tuple(c.value), c.n) for c in got] == want


def test_histograms_need_no_shuffle(spark, files):
    df = files(("/a.js", "k = v; eval('atob(1)'); fetch('/a'); fetch('/b')"))
    for made in (
        obfuscation.file_renames(df), obfuscation.apply_renames(df), obfuscation.identifier_frequency(df),
        obfuscation.ranked_patterns(df), instrumentation_sites(df),
    ):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
