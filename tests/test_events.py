"""Event operators, sources, queue and streaming on small literal tables."""

import json
import os

import pytest
from pyspark.sql import functions as F

from corpuscope.operators import docs_queue, events, in_place, ranking
from corpuscope.operators.joins import hot_keys, hot_split_join
from corpuscope.operators.modules import module_table
from corpuscope.operators.ranking import top_n_by
from corpuscope.plans import fixtures as fx
from corpuscope.plans.reports import runtime_report
from corpuscope.schemas import EVENTS_TABLE
from corpuscope.session import materialize, run_dir
from corpuscope.sources import folders, versions
from corpuscope.sources.events import read_runtime_events, write_runtime_events
from corpuscope.sources.files import read_text, scan_code_files
from corpuscope.sources.reports import read_report_table, write_report_tables
from corpuscope.sources.responses import append_response_cache, read_response_cache, read_response_table, write_response_files
from corpuscope.streaming import events as streaming

SCHEMA = "seq long, ts timestamp, type string, location string, details string"


def _events(spark, *rows):
    df = spark.createDataFrame(list(rows), "seq long, ms long, type string, location string, details string")
    return df.select("seq", F.timestamp_millis("ms").alias("ts"), "type", "location", "details")


def test_empty_log(spark):
    empty = spark.createDataFrame([], SCHEMA)
    row = events.event_summary(empty).collect()[0]
    assert row.total_events == 0 and row.start_ts is None and row.duration_ms is None
    assert events.function_call_stats(empty).collect()[0].asDict() == {"total_calls": 0, "unique_functions": 0}
    assert all(df.columns for df in runtime_report(empty).values())


def test_log_order_not_clock_order(spark):
    df = _events(spark, (0, 5000, "function_call", "b", None), (1, 9000, "function_call", "a", None), (2, 1000, "function_call", "a", None), (3, 2000, "function_call", "b", None))
    assert events.event_summary(df).collect()[0].duration_ms == -3000
    assert [(r.location, r.n) for r in events.most_called(df, 1).collect()] == [("b", 2)]


def test_details_forms(spark):
    forms = ['{"b":1,"a":2}', "[7,8]", "[]", "{}", "text", "5", None]
    df = _events(spark, *[(i, 0, "api_call", "loc", f) for i, f in enumerate(forms)])
    got = [r.details for r in events.event_timeline(df).orderBy("seq").collect()]
    assert got == ["b, a", "0, 1", "", "", "text", "5", None]


def test_endpoint_falls_back_to_location(spark):
    df = _events(
        spark, (0, 0, "api_call", "L", '{"url":"/u","method":"GET"}'), (1, 0, "api_call", "L", '{"url":""}'), (2, 0, "api_call", "L", '{"url":null}'), (3, 0, "dom_access", "M", "{}"),
    )
    assert [(r.endpoint, r.first_seq) for r in events.api_endpoints(df).orderBy("first_seq").collect()] == [("/u", 0), ("L", 1)]
    assert {r.method: r.n for r in events.api_methods(df).collect()} == {"GET": 1, "unknown": 2}
    assert events.api_call_stats(df).collect()[0].asDict() == {"total_calls": 3, "unique_endpoints": 2}


def test_switches_and_ids(spark):
    df = _events(spark, *[(i, 0, t, "x", None) for i, t in enumerate(events.EVENT_TYPES)])
    kept = events.filter_events_by_config(df, track_api_calls=False, track_storage_access=False)
    assert sorted(r.seq for r in kept.collect()) == [0, 1, 3]
    ids = [r.id for r in events.with_event_id(df).collect()]
    assert len(set(ids)) == 5 and {len(i) for i in ids} == {16}


@pytest.mark.parametrize("n", [1, 50, 2500])
def test_top_n_with_a_hot_key(spark, n):
    df = spark.range(6000).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("key"))
    got = {(r.key, r.seq) for r in top_n_by(df, ["key"], [F.desc("seq")], n).collect()}
    want, seen = set(), {}
    for i in range(5999, -1, -1):
        key = "hot" if i % 3 == 0 else f"k{i % 7}"
        seen[key] = seen.get(key, 0) + 1
        if seen[key] <= n:
            want.add((key, i))
    assert got == want
    assert [r.seq for r in events.latest_events(df, n).orderBy(F.desc("seq")).collect()] == list(range(5999, max(5999 - n, -1), -1))


def test_hot_split_join_keeps_all_rows(spark):
    rows = spark.range(3000).selectExpr("id", "IF(id % 3 < 2, 'hot', concat('k', id)) AS key")
    lookup = spark.createDataFrame([("hot", 1), ("k2", 2), ("k2", 3)], "key string, v int")
    got = hot_split_join(rows, lookup, "key", ["id"]).groupBy("v").count().orderBy("v").collect()
    assert got == [(None, 999), (1, 2000), (2, 1), (3, 1)]
    assert hot_keys(rows, "key", 1).collect() == [("hot",)]


def test_exported_log(spark, tmp_path):
    log = [
        {"type": "api_call", "timestamp": 1500, "location": "fetch", "details": {"url": "/a", "n": [1]}, "stackTrace": ["s1", "s2"]},
        {"type": "dom_access", "timestamp": 1600, "location": "q", "details": "plain \"text\"", "stackTrace": []},
        {"type": "dom_access", "timestamp": 1700, "location": "q", "details": None, "stackTrace": []},
    ]
    (tmp_path / "export.json").write_text(json.dumps(log, indent=2))
    df = read_runtime_events(spark, str(tmp_path / "export.json"))
    rows = df.orderBy("seq").collect()
    assert [r.details for r in rows] == ['{"url":"/a","n":[1]}', 'plain "text"', None]
    assert rows[0].stack_trace == ["s1", "s2"] and rows[0].ts.timestamp() == 1.5
    out = str(tmp_path / "lines")
    write_runtime_events(df, out)
    back = read_runtime_events(spark, out, lines=True)
    assert back.exceptAll(df).count() == 0 and back.count() == 3


def test_a_log_of_several_files_keeps_order_and_id(spark, tmp_path):
    rows = [(i, f"e{i}", "t", f"l{i % 7}") for i in range(5000)]
    df = spark.createDataFrame(rows, "seq long, id string, type string, location string").selectExpr(
        "*", "timestamp_millis(seq) AS ts", "CAST(NULL AS string) AS details"
    )
    write_runtime_events(df.repartition(6), str(tmp_path / "log"))
    back = read_runtime_events(spark, str(tmp_path / "log"), lines=True)
    assert [(r.seq, r.id, r.type, r.location) for r in back.orderBy("seq").collect()] == rows


def test_scan_folder(spark, tmp_path):
    (tmp_path / "src" / "deep").mkdir(parents=True)
    (tmp_path / "src" / "a.JS").write_bytes(b"let a = '\xff\xc3\xa9'")
    (tmp_path / "src" / "deep" / "b.tsx").write_text("b")
    (tmp_path / "src" / "deep" / "c.html").write_text("c")
    (tmp_path / "src" / "d.css").write_text("d")
    rows = scan_code_files(spark, str(tmp_path / "src"), walk_order=True).orderBy("seq").collect()
    assert [(r.path[len(str(tmp_path)) :], r.ext, r.content) for r in rows] == [
        ("/src/a.JS", "js", "let a = '�é'"), ("/src/deep/b.tsx", "tsx", "b"), ("/src/deep/c.html", "html", "c"),
    ]


def test_scan_finds_hidden_names_from_one_root(spark, tmp_path):
    site = tmp_path / "site"
    names = ["_app.tsx", "a.ts", ".hid.js", "_next/b.js", "C.JS", "pages/_lib/.x/d.html", "n.css", ".js", "_SUCCESS", "e.js/f.ts"]
    for name in names:
        (site / name).parent.mkdir(parents=True, exist_ok=True)
        (site / name).write_text(name)
    (site / "link.js").symlink_to(site / "a.ts")
    (site / "round").symlink_to(site)
    code = {"_app.tsx", "a.ts", ".hid.js", "_next/b.js", "C.JS", "pages/_lib/.x/d.html", "e.js/f.ts"}
    for root in (str(site), f"file://{site}", [str(site), f"{site}/_next", f"{site}/*/_*"]):
        rows = scan_code_files(spark, root).collect()
        assert {r.path[len(str(site)) + 1 :] for r in rows} == code and len(rows) == len(code)
        assert all(r.path.endswith(r.content) for r in rows)
    assert {r.path[-5:] for r in scan_code_files(spark, [str(site / "a.ts"), f"{site}/_next"]).collect()} == {"/a.ts", "/b.js"}
    assert scan_code_files(spark, str(tmp_path / "none")).count() == 0


def test_scan_opens_no_other_files_and_keeps_unreadable_ones(monkeypatch, tmp_path):
    for name in ("a.js", "b.css", "c.ts"):
        (tmp_path / name).write_text(name)
    opened = []

    def no_reading(path, *_):
        opened.append(os.path.basename(path))
        raise PermissionError(path)

    found = list(folders.entries(str(tmp_path)))
    assert {(os.path.basename(p), d, size) for p, d, size in found} == {("a.js", False, 4), ("b.css", False, 5), ("c.ts", False, 4)}
    monkeypatch.setattr("builtins.open", no_reading)
    assert folders.content_of(str(tmp_path / "a.js")) is None and opened == ["a.js"]
    monkeypatch.undo()
    assert folders.content_of(str(tmp_path / "gone.js")) is None
    assert list(folders.entries(str(tmp_path / "gone"))) == []


def test_an_unreadable_file_is_an_empty_module(spark, tmp_path):
    (tmp_path / "a.js").write_text("if (a) { b(); }")
    listed = folders.list_files(spark, [str(tmp_path)], ["js", "ts"])
    gone = spark.createDataFrame([(str(tmp_path / "gone.ts"), "ts", 10)], "path string, ext string, size long")
    files = read_text(folders.with_content(listed.unionByName(gone))).withColumn("seq", F.lit(1))
    rows = {r.name: r for r in module_table(files).collect()}
    assert rows["a"].complexity == 1 and rows["a"].size == 15
    empty = rows["gone"]
    assert (empty.dependencies, empty.exports, empty.functions, empty.classes, empty["size"], empty.complexity) == ([], [], [], [], 0, 0)


def test_listing_by_uri(tmp_path, monkeypatch):
    """What pyarrow opens is listed like a path: here its own view of local files."""
    (tmp_path / "_d").mkdir()
    (tmp_path / "_d" / "x.js").write_text("x")
    monkeypatch.setattr(folders, "local_path", lambda path: None)
    root = tmp_path.as_uri()
    assert sorted(folders.entries(root)) == [(f"{root}/_d", True, 0)]
    assert list(folders.entries(f"{root}/_d")) == [(f"{root}/_d/x.js", False, 1)]
    assert folders.content_of(f"{root}/_d/x.js") == b"x"
    assert folders.can_list(root) and not folders.can_list("viewfs://store/in")


def test_response_cache(spark, tmp_path):
    (tmp_path / "k1.json").write_text(json.dumps({"prompt": "p", "response": "# a\n# b"}))
    (tmp_path / "k2.json").write_text(json.dumps({"prompt": "p"}))
    cache = read_response_cache(spark, str(tmp_path))
    assert [tuple(r) for r in cache.collect()] == [("k1", "p", "# a\n# b")]
    table = run_dir(spark, "cache")
    append_response_cache(cache.union(cache), table)
    append_response_cache(cache, table, existing=read_response_table(spark, table))
    assert read_response_table(spark, table).count() == 1


def test_worklist(spark, files):
    df = files(("/r/a.js", 'import "x"; import "y"'), ("/r/b.js", "same"), ("/r/c.js", "same"), ("/r/d.html", "done"))
    done = docs_queue.with_content_key(df).where("path = '/r/d.html'")
    cache = done.select("cache_key", F.lit("p").alias("prompt"), F.lit("# t\nx\n# u").alias("response"))
    work = {r.rel: r for r in docs_queue.documentation_worklist(df, cache, "/r").collect()}
    assert {k: v.status for k, v in work.items()} == {"a.js": "pending", "b.js": "pending", "c.js": "shared", "d.html": "cached"}
    assert work["a.js"].deps == "- `x`\n- `y`" and work["b.js"].deps == "_No dependencies_"
    assert 'import "x"' in work["a.js"].prompt and work["c.js"].prompt is None
    unordered = df.withColumn("seq", F.lit(None).cast("bigint"))
    counts = docs_queue.documentation_status(unordered, cache).groupBy("status").count()
    assert {r.status: r["count"] for r in counts.collect()} == {"pending": 2, "shared": 1, "cached": 1}
    sections = docs_queue.cached_sections(docs_queue.with_content_key(df), cache).collect()
    assert [(r.path, r.section) for r in sections] == [("/r/d.html", "# t\nx")]


def test_pending_files(spark, files):
    df = files(("/a.js", ""), ("/b.js", ""), ("/c.js", ""))
    done = spark.createDataFrame([("/a.js", 5), ("/b.js", 0)], "path string, size long")
    assert {r.path for r in docs_queue.pending_files(df, done).collect()} == {"/b.js", "/c.js"}
    assert docs_queue.pending_files(df, done, force=True).count() == 3


def test_stream_twins(spark, sf_dir):
    batch = materialize(fx.runtime_events(spark, sf_dir), "events")
    raw = streaming.read_event_stream(spark, EVENTS_TABLE, sf_dir, "events.parquet")
    stream = fx.derive(raw, "events", fx.RUNTIME_EVENTS_SQL)
    counts = streaming.drain_to_table(streaming.stream_event_counts(stream), "complete", "counts")
    assert counts.exceptAll(streaming.stream_event_counts(batch)).count() == 0 and counts.count() > 0
    kept = streaming.drain_latest(stream, 20, "type", "kept")
    assert kept.exceptAll(events.latest_events(batch, 20, "type")).count() == 0 and kept.count() == 100


def _batches(spark, source, *parts):
    for part in parts:
        rows = [(i, "hot" if i % 3 else f"k{i % 2}") for i in part]
        spark.createDataFrame(rows, "seq long, type string").coalesce(1).write.mode("append").parquet(source)


def test_retention_holds_n_per_key_over_many_batches(spark, tmp_path):
    """Out-of-order batches; the table never holds more, and old versions go."""
    source, folder, checkpoint = (str(tmp_path / n) for n in ("in", "kept", "progress"))
    parts = [range(0, 40), range(100, 140), range(60, 100), range(40, 60)]
    sizes, seen = [], []
    for part in parts:
        _batches(spark, source, part)
        stream = spark.readStream.schema("seq long, type string").parquet(source)
        # A new query over the same checkpoint, as after a restart.
        streaming.retain_latest(stream, folder, checkpoint, 10, "type").trigger(availableNow=True).start().awaitTermination()
        seen += part
        kept = streaming.read_latest(spark, folder, stream.schema)
        want = {}
        for i in sorted(seen, reverse=True):
            key = "hot" if i % 3 else f"k{i % 2}"
            if len(want.setdefault(key, [])) < 10:
                want[key].append(i)
        assert sorted(r.seq for r in kept.collect()) == sorted(i for v in want.values() for i in v)
        sizes.append(len([f for f in os.listdir(folder) if f.startswith("data-")]))
    assert max(sizes) <= 2


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "kept")
    merge = streaming.keep_latest(folder, 3, "type")
    one = spark.createDataFrame([(i, "t") for i in range(5)], "seq long, type string")
    two = spark.createDataFrame([(i, "t") for i in range(3, 9)], "seq long, type string")
    merge(one, 0)
    merge(two, 1)
    for batch, number in ((two, 1), (one, 0)):
        merge(batch, number)
        assert sorted(r.seq for r in streaming.read_latest(spark, folder, one.schema).collect()) == [6, 7, 8]
    assert streaming.read_latest(spark, str(tmp_path / "none"), one.schema).count() == 0


@pytest.mark.parametrize("edge", [1, 40, 100_000])
def test_selection_equals_ranking(spark, monkeypatch, edge):
    monkeypatch.setattr(ranking, "BINS", 8)
    rows = [("hot", (i * 7919) % 5000 - 900) for i in range(4000)] + [("few", i) for i in range(30)] + [("tie", 5)] * 300
    rows += [(None, i) for i in range(200)] + [("null", None)] * 50 + [("null", i) for i in range(60)] + [("far", 2**62 - i) for i in range(120)]
    rows += [("far", -(2**62) + i) for i in range(120)]
    df = materialize(spark.createDataFrame(rows, "key string, seq long").repartition(5), "events")
    for n in (1, 90, 110, 3999):
        got = ranking.greatest_n(df, ["key"], "seq", n, edge_rows=edge).collect()
        want = {}
        for key, seq in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0))):
            if len(want.setdefault(key, [])) < n:
                want[key].append(seq)
        found = {}
        for r in got:
            found.setdefault(r.key, []).append(r.seq)
        order = lambda v: sorted(v, key=lambda x: (x is None, x or 0))
        assert {k: order(v) for k, v in found.items()} == {k: order(v) for k, v in want.items()}
    everything = ranking.greatest_n(df, [], "seq", 777, edge_rows=edge).collect()
    values = sorted((r[1] for r in rows if r[1] is not None), reverse=True)[:777]
    assert sorted((r.seq for r in everything), reverse=True) == values
    assert ranking.greatest_n(df.where("false"), ["key"], "seq", 5).count() == 0


def test_selection_shuffles_no_more_than_n_and_an_edge(spark):
    df = materialize(spark.range(60_000).selectExpr("id AS seq", "'hot' AS type"), "events")
    latest = events.latest_events(df, 10_000, "type")
    assert sorted(r.seq for r in latest.select("seq").collect()) == list(range(50_000, 60_000))
    cuts = ranking._cuts(df.select(F.struct("type").alias("__key"), F.col("seq").alias("v")), 10_000, 500).collect()
    assert len(cuts) == 1 and cuts[0].high - cuts[0].low < 500


def test_rows_are_chosen_in_place(spark):
    rows = spark.range(0, 100_000, 1, 3).selectExpr("id", "concat('content ', id) AS content")
    stored = in_place.store(rows, "in-place")
    some = stored.where("id % 7 = 0 AND id < 90000").select(in_place.ROW)
    assert sorted(r.id for r in in_place.choose(stored, some).select("id").collect()) == [i for i in range(90_000) if i % 7 == 0]
    left = in_place.without_numbers(in_place.choose(stored, some, inside=False))
    assert left.columns == ["id", "content"] and left.count() == 100_000 - len(range(0, 90_000, 7))
    assert in_place.choose(stored, some.where("false")).count() == 0
    # A task that writes fewer rows than a bitmap has bits writes one file or two.
    assert len(stored.inputFiles()) <= 6
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("in_place")]


def test_no_exchange_carries_contents(spark, files, monkeypatch):
    monkeypatch.setattr(docs_queue, "BROADCAST_PATHS", 0)
    df = materialize(files(*[(f"/r/{i}.js", f"text {i % 5}") for i in range(40)]), "files")
    cache = spark.createDataFrame([], "cache_key string, prompt string, response string")
    done = spark.createDataFrame([("/r/1.js", 5)], "path string, size long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        work = docs_queue.documentation_worklist(df, cache, "/r")
        left = docs_queue.pending_files(df, done)
        for plan_of in (work, left):
            plan = plan_of._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            steps = [p for p in plan.split("\n\n") if ") Exchange" in p or ") Sort" in p]
            assert steps and not [p for p in steps if "content" in p or "prompt" in p]
        assert work.where("prompt IS NOT NULL").count() == 5 and work.count() == 40
        assert left.count() == 39
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_an_answer_is_stored_once_by_two_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    answers = lambda *keys: spark.createDataFrame([(k, "p", f"r {k}") for k in keys], "cache_key string, prompt string, response string")
    append_response_cache(answers("a", "b", "b"), path)
    real, raced = versions.commit, []

    def raced_commit(session, folder, number, what):
        if not raced:
            raced.append(1)
            append_response_cache(answers("b", "c"), path)  # another writer is faster
        real(session, folder, number, what)

    monkeypatch.setattr(versions, "commit", raced_commit)
    append_response_cache(answers("c", "d"), path)
    assert sorted(r.cache_key for r in read_response_table(spark, path).collect()) == ["a", "b", "c", "d"]
    with pytest.raises(versions.Taken):
        real(spark, path, 1, {})


def test_a_failed_report_leaves_the_old_one(spark, tmp_path):
    folder = str(tmp_path / "report")
    good = spark.createDataFrame([(1,)], "n int")
    write_report_tables({"a": good, "b": good}, folder)
    bad = good.select(F.raise_error(F.lit("broken")).cast("int").alias("n"))
    with pytest.raises(Exception, match="broken"):
        write_report_tables({"a": good.selectExpr("n + 1 AS n"), "b": bad}, folder)
    assert [read_report_table(spark, folder, t).collect() for t in "ab"] == [[(1,)], [(1,)]]
    for i in (2, 3):
        write_report_tables({"a": good.selectExpr(f"n + {i} AS n")}, folder)
    assert read_report_table(spark, folder, "a").collect() == [(4,)]
    with pytest.raises(FileNotFoundError):
        read_report_table(spark, str(tmp_path / "none"), "a")


def test_answers_as_files(spark, tmp_path):
    folder = str(tmp_path / "answers")
    rows = [("k1", "p", "# a\né"), ("k2", None, "x"), ("k3", "p", None), (None, "p", "r")]
    assert write_response_files(spark.createDataFrame(rows, "cache_key string, prompt string, response string"), folder) == 3
    assert sorted(os.listdir(folder)) == ["k1.json", "k2.json", "k3.json"]
    assert sorted(map(tuple, read_response_cache(spark, folder).collect())) == [("k1", "p", "# a\né"), ("k2", None, "x")]


def test_a_large_export_is_many_tasks_and_keeps_its_order(spark, tmp_path):
    log = [
        {"type": "t", "timestamp": i, "location": f"l{i}", "details": {"deep": {"x": [i, {"y": "}"}]}, "s": "\n  }"}, "stackTrace": ["a"]}
        for i in range(3000)
    ]
    (tmp_path / "b.json").write_text(json.dumps(log[1000:], indent=2))
    (tmp_path / "a.json").write_text(json.dumps(log[:1000], indent=2))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = read_runtime_events(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 10
        rows = df.orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.seq, r.location) for r in rows] == [(i, f"l{i}") for i in range(3000)]
    assert json.loads(rows[2999].details) == log[2999]["details"] and rows[0].stack_trace == ["a"]


@pytest.mark.parametrize("indent, split", [(None, True), (2, True), (None, False), (4, False), (1, False)])
def test_exports_of_any_layout(spark, tmp_path, indent, split):
    log = [{"type": "t", "timestamp": 5, "location": "x", "details": {"a": {}}, "stackTrace": []}, {}, {"type": "u"}]
    (tmp_path / "e.json").write_text(json.dumps(log, indent=indent))
    (tmp_path / "f.json").write_text(json.dumps([], indent=indent))
    rows = read_runtime_events(spark, str(tmp_path), split=split).orderBy("seq").collect()
    assert [(r.seq, r.type) for r in rows] == [(0, "t"), (1, None), (2, "u")]


def test_every_day_is_exported_by_its_own_task(spark, tmp_path, monkeypatch):
    from corpuscope.plans import queries

    # Twenty days of a hundred events, and a copy of each day's last one.
    events = spark.range(2000).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(int(id DIV 100), 0, 0, id % 100) AS ts",
        "id % 7 AS user_id", "IF(id % 2 = 0, 'click', 'view') AS event_type", "0.5D AS value", "'{\"k\": 1}' AS props",
    )
    events.unionByName(events.where("event_id % 100 = 99")).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(queries, "run_dir", lambda _, name: str(tmp_path / name))
    rows = queries.exported_logs(spark, str(tmp_path)).orderBy("seq").collect()
    wanted = [f"e{i}" for i in range(2000) for _ in range(1 + (i % 100 == 99))]
    assert [(r.seq, r.id) for r in rows] == list(enumerate(wanted))
    found = sorted((tmp_path / "exports").glob("day=*/part-*"))
    assert [len(json.loads(f.read_text())) for f in found] == [101] * 20
    assert len({f.name.split("-")[1] for f in found}) == 20
