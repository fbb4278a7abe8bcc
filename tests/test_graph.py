"""Layers, resolution, matrix, reports."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscope.functions import windows
from corpuscope.operators import graph, layers, reports
from corpuscope.operators.joins import grid_join
from corpuscope.plans import queries as plan_queries
from corpuscope.plans.reports import architecture_report
from corpuscope.rules import PATH_RULES
from corpuscope.session import materialize

MODULE = "seq long, path string, name string, exports array<string>, functions array<string>, classes array<string>, size long, complexity long"


def _labels(spark, cases):
    """Raw label and layer per case (path, name, exports, functions, classes, score)."""
    rows = [(i, c[0], c[1], *map(list, c[2:5]), 0, c[5]) for i, c in enumerate(cases)]
    got = layers.classify_layer(spark.createDataFrame(rows, MODULE)).orderBy("seq").collect()
    return [(r.raw_label, r.layer) for r in got]


def _case(path, name="m", exports=(), functions=(), classes=(), score=0):
    return (path, name, exports, functions, classes, score)


def test_path_rules(spark):
    # Words an earlier rule answers first.
    earlier = {"/pages/": "FSD: Pages", "/pages": "UI Components", "/repository": "Data Layer", "page": "Atomic: Page"}
    cases, labels = [], []
    for label, in_path, in_name, _ in PATH_RULES:
        for word in in_path:
            cases.append(_case(f"/X{word.upper()}Y.js"))
            labels.append(earlier.get(word, label))
        for word in in_name:
            cases.append(_case("/q/zz.js", name=word.upper()))
            labels.append(earlier.get(word, label))
    want = [(label, "Unknown" if ":" in label else label) for label in labels]
    assert _labels(spark, cases) == want


def test_export_and_fallback_rules(spark):
    table = [
        (_case("/app/api/x.js", exports=["fetchAll"]), "API Layer"),
        (_case("/app/build/x.js", exports=["useHook"]), "UI Components"),
        (_case("/app/data/x.js", exports=["UserStore"]), "Data Layer"),
        (_case("/app/x.js", exports=["formatDate"]), "Utilities"),
        (_case("/app/x.js", exports=["fetchAll"]), "FSD: App Layer"),
        (_case("/q/x.js", exports=["MyComponent"]), "UI Components"),
        (_case("/q/x.js", score=16), "Business Logic"),
        (_case("/q/x.js", functions=["f"] * 9), "Business Logic"),
        (_case("/q/x.js", classes=["c"] * 3), "Business Logic"),
        (_case("/q/x.js", score=15, functions=["f"] * 8, classes=["c"] * 2), "Unknown"),
    ]
    assert [raw for raw, _ in _labels(spark, [c for c, _ in table])] == [label for _, label in table]


def _strip(name):
    for suffix in (".jsx", ".tsx", ".js", ".ts"):
        if name.endswith(suffix):
            return name[: -len(suffix)]
    return name


def _resolve(dep, modules):
    """All modules in walk order, first exact names, then loose matches."""
    dep_name, dep_dir = _strip(dep.split("/")[-1]), "/".join(dep.split("/")[:-1])
    for _, path, _ in modules:
        base = path.split("/")[-1]
        if base == dep or (dep_name and base == dep_name):
            return path, 1
    for _, path, name in modules:
        folder = "/".join(path.split("/")[:-1])
        if folder.endswith(dep_dir) or dep_dir.endswith(folder):
            return path, 2
        if dep_name and (dep_name in name or name in dep_name):
            return path, 2
    return None, None


def test_resolution_equals_all_pairs(spark):
    rng = random.Random(7)
    words = ["a", "ab", "utils", "ui", "lib", "index", "mod1", "mod12", "core"]
    paths = sorted({"/".join([""] * rng.randint(0, 1) + rng.choices(words, k=rng.randint(1, 3))) + rng.choice([".js", ".ts", ".html", ""]) for _ in range(60)})
    modules = [(i, p, _strip(p.split("/")[-1]) or "unknown") for i, p in enumerate(paths)]
    specs = ["react", "./", "x/", "index.js", "zzz/qq/nothing", "@s/p", "../ab"]
    specs += ["/".join(rng.choices([".", "..", *words], k=rng.randint(1, 3))) + rng.choice(["", ".js", ".tsx"]) for _ in range(80)]
    for keep in (modules, [m for m in modules if "/" in m[1]]):
        mods = spark.createDataFrame(keep, "seq long, path string, name string")
        deps = spark.createDataFrame([("/src", s) for s in sorted(set(specs))], "path string, specifier string")
        got = {r.specifier: (r.dst_path, r["pass"]) for r in graph.resolve_dependencies(deps, mods).collect()}
        assert got == {s: _resolve(s, keep) for s in set(specs)}


def test_long_texts_take_memory_in_proportion(spark):
    """20,000 characters on either side: 200 million substrings if spelled out."""
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(20_000))
    mods = [(0, "/z/none.js", "none"), (1, f"/q/{long}x.js", f"{long}x"), (2, "/q/" + long[500:540] + ".js", long[500:540])]
    specs = ["deep/" + long, "deep/" + long[100:15_000], "deep/" + long[505:520], "deep/q" + long[::-1], "far/" + "/".join(long[:9_000]) + "/zz9"]
    got = {r.specifier: (r.dst_path, r["pass"]) for r in graph.resolve_dependencies(
        spark.createDataFrame([("/s", s) for s in specs], "path string, specifier string"),
        spark.createDataFrame(mods, "seq long, path string, name string"),
    ).collect()}
    assert got == {s: _resolve(s, mods) for s in specs}


@settings(max_examples=100, deadline=None, database=None)
@given(st.lists(st.text(st.sampled_from("ab/é😀"), max_size=9), max_size=6), st.lists(st.integers(0, 9), max_size=4))
def test_window_hashes_tell_substrings_apart(texts, lengths):
    rolling = windows.Rolling(texts)
    text = "".join(texts)
    seen = {}
    for n in set(lengths):
        for found, every in ((rolling.substrings(n), False), (rolling.suffixes(n), True)):
            rows, starts = found
            got = sorted((r, text[s : s + n]) for r, s in zip(rows.tolist(), starts.tolist()))
            if every:
                want = [(r, t[len(t) - n :]) for r, t in enumerate(texts) if len(t) >= n]
            else:
                want = [(r, t[i : i + n]) for r, t in enumerate(texts) for i in range(len(t) - n + 1)] if n else [(r, "") for r in range(len(texts))]
            assert got == sorted(want)
            for (_, part), key in zip([(r, text[s : s + n]) for r, s in zip(rows.tolist(), starts.tolist())], zip(*rolling.keys(starts, n))):
                assert seen.setdefault(part, key) == key
    assert len({(len(part), key) for part, key in seen.items()}) == len(seen)


def test_equal_hashes_are_noticed(spark, monkeypatch):
    """With one hash for all substrings of a length, the wrong module is found and refused."""
    import numpy as np

    monkeypatch.setattr(windows.Rolling, "keys", lambda self, starts, n: (np.zeros(len(starts), np.int64),) * 2)
    mods = spark.createDataFrame([(0, "/p/aa.js", "aa"), (1, "/q/bb.js", "bb")], "seq long, path string, name string")
    deps = spark.createDataFrame([("/s", "x/bbb")], "path string, specifier string")
    with pytest.raises(Exception, match="two substrings share a hash"):
        graph.resolve_dependencies(deps, mods).collect()


def test_grid_join_keeps_all_pairs(spark):
    left = spark.range(3000).selectExpr("id AS src", "IF(id % 3 < 2, 'hot', IF(id % 2 = 0, NULL, concat('k', id % 50))) AS name")
    right = spark.range(900).selectExpr("id AS dst", "IF(id % 2 = 0, 'hot', concat('k', id % 70)) AS name")
    want = left.join(right, "name")
    for block in (7, 100, 10_000):
        got = grid_join(materialize(left, "left"), materialize(right, "right"), "name", ["src"], ["dst"], block=block)
        assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0


def test_grid_join_cuts_a_key_that_is_hot_on_both_sides(spark):
    left = materialize(spark.range(4000).selectExpr("id AS src", "'hot' AS name"), "left")
    right = materialize(spark.range(2000).selectExpr("id AS dst", "'hot' AS name"), "right")
    pairs = grid_join(left, right, "name", ["src"], ["dst"], block=500)
    cells = pairs.groupBy(F.expr("xxhash64(src) % 8"), F.expr("xxhash64(dst) % 4")).count().collect()
    assert sum(r["count"] for r in cells) == 8_000_000
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "__line" in plan and "__column" in plan


def test_matrix_is_the_product_of_its_factors(spark, sf_dir):
    modules = plan_queries._stored_modules(spark, sf_dir)
    deps = plan_queries._deps(spark, sf_dir)
    sources, targets = graph.matrix_factors(modules, deps)
    product = sources.join(targets, "specifier").select("src", "dst").distinct()
    matrix = graph.dependency_matrix(modules, deps).select("src", "dst")
    assert product.exceptAll(matrix).count() == 0 and matrix.exceptAll(product).count() == 0


def test_hot_specifier_keeps_every_edge(spark):
    mods = spark.createDataFrame([(0, "/p/a.js", "a"), (1, "/q/b.js", "b")], "seq long, path string, name string")
    deps = spark.range(5000).selectExpr("concat('/s', id) AS path", "IF(id % 3 = 0, 'react', concat('./x', id)) AS specifier")
    resolved = graph.resolve_dependencies(deps, mods)
    assert resolved.count() == 5000
    assert resolved.where("specifier = 'react' AND dst_path = '/p/a.js'").count() == 1667


def test_strict_mode_and_external(spark):
    mods = spark.createDataFrame([(0, "/p/a.js", "a1"), (1, "/q/b.js", "b1")], "seq long, path string, name string")
    deps = spark.createDataFrame([("/s", "react"), ("/s", "x/yy/zz"), ("/s", "x/q/zz"), ("/s", "./b1")], "path string, specifier string")
    resolved = graph.resolve_dependencies(deps, mods, match_empty_dir=False)
    outside = graph.external_dependencies(deps, resolved)
    assert {r.specifier for r in outside.collect()} == {"react", "x/yy/zz"}


def test_matrix_keys(spark):
    mods = spark.createDataFrame([(0, "/p/a.ts", "a"), (1, "/p/b.js", "b")], "seq long, path string, name string")
    deps = spark.createDataFrame(
        [("s1", "/p/a.ts"), ("s2", "a"), ("s3", "/p/a"), ("s4", "/p/b"), ("s4", "b"), ("s5", "/p/b.ts"), ("s6", "./a")],
        "path string, specifier string",
    )
    got = {(r.src, r.dst) for r in graph.dependency_matrix(mods, deps).collect()}
    assert got == {("s1", "/p/a.ts"), ("s2", "/p/a.ts"), ("s3", "/p/a.ts"), ("s4", "/p/b.js")}


def _scored(spark, scores):
    rows = [(i, f"/q/{i}.js", f"m{i}", [], [], [], 100, s) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, MODULE)


def test_bands_and_ties(spark):
    df = _scored(spark, [10, 11, 20, 21, 30, 31, 31, 30])
    assert {r.band: r.n for r in reports.complexity_distribution(df).collect()} == {"low": 1, "medium": 2, "high": 3, "critical": 2}
    assert [r.name for r in reports.most_complex_modules(df, 4).collect()] == ["m5", "m6", "m4", "m7"]
    picked = reports.refactoring_candidates(df, 2).orderBy("band", "rank").collect()
    assert [(r.band, r.name) for r in picked] == [("critical", "m5"), ("critical", "m6"), ("high", "m4"), ("high", "m7")]


def test_layer_critical_counts_the_rest(spark):
    df = layers.classify_layer(_scored(spark, [40] * 7 + [5]))
    rows = reports.layer_critical_modules(df).orderBy("rank").collect()
    assert [(r.name, r.remaining) for r in rows] == [(f"m{i}", 2) for i in range(5)]


def test_empty_project(spark):
    df = spark.createDataFrame([], MODULE)
    row = reports.complexity_overview(df).collect()[0]
    assert row.total_modules == 0 and row.avg_complexity is None
    assert {r.n for r in reports.complexity_distribution(df).collect()} == {0}


def test_dependency_list(spark):
    df = spark.createDataFrame([("a", ["x", "y"]), ("b", [])], "path string, dependencies array<string>")
    assert {r.path: r.dep_list for r in graph.deps_per_file(df).collect()} == {"a": "- `x`\n- `y`", "b": "_No dependencies_"}


def test_report_orders_files_by_path_when_they_have_no_order(spark, files):
    df = files(("/q/z.js", 'import "lodash"'), ("/q/b.js", "if (a) {}"), ("/q/a.js", "if (a) {}"))
    report = architecture_report(df.withColumn("seq", F.lit(None).cast("bigint")))
    assert [r.name for r in report["most_complex"].collect()] == ["a", "b", "z"]
    assert [r.dst_key for r in report["edges"].collect()] == ["node__q_a_js"]
    assert report["nodes"].count() == 3 and report["matrix"].isEmpty()
