"""Tables derived from the test data by the same SQL text in Spark and in DuckDB.

Each grows with its source table and reads all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.session import spread

CODE_FILES_SQL = """
SELECT p_partkey AS seq,
  concat('/proj/', CASE p_size % 12 WHEN 0 THEN 'api' WHEN 1 THEN 'components' WHEN 2 THEN 'models'
      WHEN 3 THEN 'utils' WHEN 4 THEN 'config' WHEN 5 THEN 'middleware' WHEN 6 THEN 'features'
      WHEN 7 THEN 'service' WHEN 8 THEN 'lib' WHEN 9 THEN 'store' WHEN 10 THEN 'misc' ELSE 'pages' END,
    '/mod', CAST(p_partkey AS VARCHAR(12)),
    CASE p_partkey % 5 WHEN 0 THEN '.js' WHEN 1 THEN '.ts' WHEN 2 THEN '.jsx' WHEN 3 THEN '.tsx' ELSE '.html' END) AS path,
  concat('import x from "./mod', CAST((p_partkey * 7 + 3) % 1000 AS VARCHAR(12)),
      CASE WHEN ((p_partkey * 7 + 3) % 1000) % 5 = 4 THEN '.html' ELSE '' END, '";', chr(10),
    'const r = require("', CASE p_partkey % 3 WHEN 0 THEN 'react' WHEN 1 THEN 'proj/lib/z' ELSE 'proj/utils/fmt' END, '");', chr(10),
    'export function f', CAST(p_partkey AS VARCHAR(12)), '(a, b) {', chr(10),
    repeat(concat('  if (a && b) { a = b ? 1 : 2; }', chr(10)), CAST(p_size % 8 AS INT)), '}', chr(10),
    repeat(concat('items.map(function (e) { return e; });', chr(10)), CAST(p_size % 3 AS INT))) AS content
FROM part
"""

RUNTIME_EVENTS_SQL = """
SELECT event_id AS seq, ts,
  CASE event_type WHEN 'click' THEN 'function_call' WHEN 'view' THEN 'dom_access' WHEN 'purchase' THEN 'api_call'
    WHEN 'signup' THEN 'storage_access' ELSE 'variable_access' END AS type,
  concat(event_type, '_', CAST(user_id % 20 AS VARCHAR(12))) AS location,
  CASE WHEN event_type = 'purchase' AND event_id % 3 = 0
         THEN concat('{"method":"GET","url":"/u/', CAST(user_id % 7 AS VARCHAR(12)), '"}')
       WHEN event_type = 'purchase' AND event_id % 3 = 1
         THEN concat('{"url":"","options":"o', CAST(user_id % 5 AS VARCHAR(12)), '"}')
       ELSE props END AS details
FROM events
"""

# Files carrying every obfuscation family in turn, plus call sites of all kinds.
# {A} is the decoded text of the character-code call, {H} the hex-escaped word.
OBFUSCATED_FILES_SQL = """
SELECT p_partkey AS seq,
  concat('/dist/chunk', CAST(p_partkey AS VARCHAR(12)), '.js') AS path,
  concat(
    CASE WHEN p_partkey % 2 = 0 THEN concat('var s=String["fromCharCode"](', CAST(65 + p_partkey % 26 AS VARCHAR(12)), ', ',
        CAST(97 + p_size % 26 AS VARCHAR(12)), ',', CAST(945 + p_size % 17 AS VARCHAR(12)), ');', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 3 = 0 THEN concat('var b=atob("', CASE p_size % 4 WHEN 0 THEN 'c21hbGw=' WHEN 1 THEN 'bGFyZ2U'
        WHEN 2 THEN 'w6ljaG8=' ELSE 'aHR0cHM6Ly9h' END, '");', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 5 = 0 THEN concat('var h="', repeat('\\x41\\x62', CAST(4 + p_size % 4 AS INT)), '";', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 7 = 0 THEN concat('eval("run ', p_name, '");new Function("return 1");', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 11 = 0 THEN concat('(function(modules){boot(__webpack_require__)})([function(a){one(', p_brand,
        ')}, function(b){two()}]);', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 13 = 0 THEN concat('!function(e){', repeat('e.prototype.t=function(){};', CAST(p_size % 9 AS INT)), '}(n);', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 4 = 1 THEN concat('fetch("/u/', p_type, '");localStorage.setItem("k", 1);', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 4 = 3 THEN concat('var q=document.querySelector("#a");new XMLHttpRequest();', chr(10)) ELSE '' END,
    '// ', p_name, chr(10)) AS content
FROM part
"""

# A conversation turn, wrapped so that the answers have headings and fences.
RESPONSES_SQL = """
SELECT concat('c', CAST(conv_id AS VARCHAR(12)), '-', CAST(turn AS VARCHAR(12))) AS cache_key,
  role AS prompt,
  CASE conv_id % 4
    WHEN 0 THEN text
    WHEN 1 THEN concat('# Title', chr(10), text, chr(10), '## Next', chr(10), 'after')
    WHEN 2 THEN concat('intro', chr(10), '```', chr(10), '# in code', chr(10), '```', chr(10), text, chr(10), '# Cut', chr(10), 'after')
    ELSE '  ' END AS response
FROM conversations
"""

# One file of a kind each: together they hold every construct that is scored.
RICH_FILES = (
    "async function load(u) { try { const r = await fetch(u); for (const k in r) { if (k) { use(k); } } } catch (e) { throw e; } }",
    "export class A extends B { get x() { return this.y ? 1 : 2; } run() { while (this.go) { this.step(); } } }",
    "export default function main(a) { switch (a) { case 1: return 1; case 2: return 2; default: return 0; } }",
    "const sum = (xs) => xs.reduce((a, b) => a + b, 0), two = function () { do { go(); } while (x); };",
    "const o = { m(a) { return a && b || c; }, get p() { return 1; }, async *q() { await 1; }, k: 2 };",
    "for (let i = 0; i < 3; i++) { for (const v of l) { if (v) continue; } }",
    "const t = `a ${x ? `b ${y && z}` : ''} c`; require('t');",
    "export const V = () => <ul>{xs.map((x) => <li key={x}>{x ? 'y' : \"it's\"} // if (a)</li>)}</ul>;",
    "import d, { e } from './d'; export * from 'f'; export { g } from \"h\"; import 'side'; const i = require('i');",
    "new Promise((res, rej) => { setTimeout(() => res(1), 5); }).then(function done() {}).catch((e) => { if (e) throw e; });",
    "label: while (true) { if (a) { break label; } else if (b) { continue label; } }",
    "function* gen() { yield* other(); } export async function go() { for await (const x of gen()) { await x; } } export { gen };",
)

_TABLES = (
    "part",
    "events",
    "documents",
    "pages",
    "labels",
    "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def derive(source: DataFrame, view: str, sql: str) -> DataFrame:
    # The recipe names one driver table; bind it to this DataFrame, not to a
    # session-wide view, so that two folders can be read in one session.
    text = sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {view}", "FROM {src}")
    return source.sparkSession.sql(text, src=source)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, path, ext, content``: one synthetic source file per part."""
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    files = derive(parts, "part", CODE_FILES_SQL)
    return files.select(
        "seq",
        "path",
        F.lower(F.substring_index("path", ".", -1)).alias("ext"),
        "content",
    )


def rich_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, path, ext, content``: a file per part, of each of the rich kinds in turn."""
    parts = spread(table(spark, sf_dir, "part").select("p_partkey"))
    kinds = F.array(*map(F.lit, RICH_FILES))
    return parts.select(
        F.col("p_partkey").alias("seq"),
        F.concat(F.lit("/rich/f"), F.col("p_partkey"), F.lit(".tsx")).alias("path"),
        F.lit("tsx").alias("ext"),
        F.element_at(kinds, (F.col("p_partkey") % len(RICH_FILES) + 1).cast("int")).alias("content"),
    )


def obfuscated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, path, ext, content``: one obfuscated source file per part."""
    parts = spread(
        table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name", "p_brand", "p_type")
    )
    # Spark reads a backslash in a SQL literal as an escape, DuckDB does not.
    sql = OBFUSCATED_FILES_SQL.replace("\\", "\\\\")
    return derive(parts, "part", sql).select("seq", "path", F.lit("js").alias("ext"), "content")


def runtime_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, ts, type, location, details``: one runtime event per event row."""
    return derive(table(spark, sf_dir, "events"), "events", RUNTIME_EVENTS_SQL)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cache_key, prompt, response``: one stored answer per conversation turn."""
    return derive(table(spark, sf_dir, "conversations"), "conversations", RESPONSES_SQL)


def prose_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, path, ext, content`` over the whole text of ``documents``."""
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("/docs/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".ts")).alias("path"),
        F.lit("ts").alias("ext"),
        F.col("text").alias("content"),
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, path, ext, content`` over the whole HTML of ``pages``."""
    return spread(table(spark, sf_dir, "pages")).select(
        F.col("page_id").alias("seq"),
        F.concat(F.lit("/site/page"), F.col("page_id"), F.lit(".html")).alias("path"),
        F.lit("html").alias("ext"),
        F.col("html").alias("content"),
    )
