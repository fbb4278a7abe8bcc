"""DuckDB SQL with the same results as the registered queries.

The SQL states the expected answer on its own terms: closed formulas over the
source rows of the derived tables, all-pairs tests where the Spark side uses equi
joins, plain regular expressions where it lexes.
"""

from __future__ import annotations

from corpuscope import rules
from corpuscope.operators.docs_queue import PROMPT_HEAD, PROMPT_TAIL
from corpuscope.plans.fixtures import (
    CODE_FILES_SQL,
    OBFUSCATED_FILES_SQL,
    RESPONSES_SQL,
    RUNTIME_EVENTS_SQL,
)
from corpuscope.plans.queries import (
    ARCHITECTURE_SECTIONS,
    LATEST_N,
    LATEST_PER_LOCATION,
    LATEST_PER_TYPE,
    RUNTIME_SECTIONS,
    SIZE_LIMIT,
)

ORACLES: dict[str, str] = {}

_EVENTS = f"WITH ev AS ({RUNTIME_EVENTS_SQL}) "
_CODE = f"WITH code AS (SELECT *, seq % 5 = 4 AS html FROM ({CODE_FILES_SQL})) "
_OBF = f"WITH obf AS ({OBFUSCATED_FILES_SQL}) "


def _text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


# Each code file's features by formula: a = if-blocks, c = callback calls.
_MODULES = (
    _CODE
    + """,
base AS (
  SELECT code.*, p_size % 8 AS a, p_size % 3 AS c,
    regexp_extract(path, '[^/]*$') AS base_name,
    CASE WHEN html THEN regexp_extract(path, '[^/]*$')
         ELSE regexp_replace(regexp_extract(path, '[^/]*$'), '[.](js|ts|jsx|tsx)$', '') END AS name
  FROM code JOIN part ON seq = p_partkey),
mods AS (
  SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir,
    CASE WHEN html THEN 0 ELSE length(content) END AS size,
    CAST(CASE WHEN html THEN 0
      ELSE floor(2.5 * a + 0.5 * c + (1 + floor(2.5 * a + 0.5)) + c + 0.5) END AS BIGINT) AS complexity,
    CASE WHEN html THEN '' ELSE concat('f', CAST(seq AS VARCHAR)) END AS export_name
  FROM base),
deps AS (
  SELECT path, regexp_extract(content, 'from "([^"]*)"', 1) AS specifier, 'import' AS kind, 0 AS ord FROM code WHERE NOT html
  UNION ALL
  SELECT path, regexp_extract(content, 'require[(]"([^"]*)"', 1), 'require', 1 FROM code WHERE NOT html)
"""
)


def _layer_case() -> str:
    def has(column: str, words: tuple[str, ...]) -> list[str]:
        return [f"contains(lower({column}), '{w}')" for w in words]

    out = []
    for label, in_export, in_path in rules.EXPORT_RULES:
        test = "(" + " OR ".join(has("export_name", in_export)) + ")"
        if in_path:
            test += " AND (" + " OR ".join(has("path", in_path)) + ")"
        out.append(f"WHEN {test} THEN '{label}'")
    for label, in_path, in_name, in_export in rules.PATH_RULES:
        tests = has("path", in_path) + has("name", in_name) + has("export_name", in_export)
        out.append(f"WHEN {' OR '.join(tests)} THEN '{label}'")
    out.append("WHEN complexity > 15 THEN 'Business Logic'")
    return "CASE " + " ".join(out) + " ELSE 'Unknown' END"


_LAYER_NAMES = ", ".join(f"'{name}'" for name, _ in rules.LAYERS)
_LAYERED = f""",
labelled AS (SELECT *, {_layer_case()} AS raw_label FROM mods),
layered AS (SELECT *, CASE WHEN raw_label IN ({_LAYER_NAMES}) THEN raw_label ELSE 'Unknown' END AS layer FROM labelled)
"""
_CLASSIFIED = _MODULES + _LAYERED
_BAND = (
    "CASE WHEN complexity <= 10 THEN 'low' WHEN complexity <= 20 THEN 'medium' "
    "WHEN complexity <= 30 THEN 'high' ELSE 'critical' END"
)

# Specifiers to modules by testing all pairs.
_RESOLVED = (
    _MODULES
    + """,
specs AS (
  SELECT DISTINCT specifier,
    regexp_replace(regexp_extract(specifier, '[^/]*$'), '[.](js|ts|jsx|tsx)$', '') AS dep_name,
    CASE WHEN contains(specifier, '/') THEN regexp_replace(specifier, '/[^/]*$', '') ELSE '' END AS dep_dir
  FROM deps),
hits AS (
  SELECT specifier, path AS dst_path, seq,
    CASE WHEN base_name = specifier OR (dep_name <> '' AND base_name = dep_name) THEN 1
         WHEN ((dep_dir <> '' OR {empty_dir}) AND ends_with(dir, dep_dir))
           OR ((dir <> '' OR {empty_dir}) AND ends_with(dep_dir, dir))
           OR (dep_name <> '' AND (contains(name, dep_name) OR contains(dep_name, name))) THEN 2 END AS pass
  FROM specs, mods),
best AS (
  SELECT specifier, dst_path, pass FROM hits WHERE pass IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY specifier ORDER BY pass, seq) = 1),
resolved AS (
  SELECT path AS src_path, specifier, dst_path, pass FROM deps LEFT JOIN best USING (specifier))
"""
)
_RESOLVED_ALL = _RESOLVED.replace("{empty_dir}", "TRUE")
_RESOLVED_STRICT = _RESOLVED.replace("{empty_dir}", "FALSE")

_LETTERS = """WITH words AS (
  SELECT doc_id, concat('/docs/', source, '/', CAST(doc_id AS VARCHAR), '.ts') AS path,
    unnest(regexp_extract_all(text, '\\b([a-zA-Z])\\b', 1)) AS ident,
    generate_subscripts(regexp_extract_all(text, '\\b([a-zA-Z])\\b', 1), 1) - 1 AS pos
  FROM documents),
freq AS (SELECT path, ident, count(*) AS n, CAST(min(pos) AS INT) AS first_pos FROM words GROUP BY ALL),
names AS (SELECT unnest({names}) AS new_name, generate_subscripts({names}, 1) AS rank),
renames AS (
  SELECT path, ident, new_name, CAST(rank AS INT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, first_pos) AS rank FROM freq) JOIN names USING (rank)
  WHERE n > 5)
""".replace("{names}", "[" + ", ".join(f"'{n}'" for n in rules.MEANINGFUL_NAMES) + "]")


# --- sources and sinks ----------------------------------------------------------

ORACLES["scan_folder"] = (
    "SELECT page_id % 16 AS bucket, 'txt' AS ext, CAST(sum(length(html) + 1) AS BIGINT) AS chars FROM pages GROUP BY 1"
)
ORACLES["scan_hidden_folders"] = """
WITH files AS (
  SELECT page_id % 24 AS bucket, string_agg(coalesce(html, '') || chr(10), '' ORDER BY page_id) AS content FROM pages GROUP BY 1)
SELECT concat(CASE bucket % 3 WHEN 0 THEN '_next' WHEN 1 THEN '.hid' ELSE 'plain' END, '/_sub/bucket=', CAST(bucket AS VARCHAR)) AS folder,
  'txt' AS ext, CAST(length(content) AS INT) AS chars, left(sha256(content), 32) AS cache_key
FROM files"""
ORACLES["event_log_roundtrip"] = (
    _EVENTS
    + "SELECT seq, type, location, epoch_us(ts) // 1000 AS ms, array_to_string(json_keys(details), ', ') AS details FROM ev"
)
ORACLES["response_cache_append"] = (
    "SELECT DISTINCT left(sha256(text), 32) AS cache_key, CAST(length(text) AS INT) AS chars FROM documents"
)
ORACLES["response_folder"] = f"SELECT cache_key, prompt, response FROM ({RESPONSES_SQL}) WHERE response IS NOT NULL"
ORACLES["exported_logs"] = (
    _EVENTS
    + """SELECT row_number() OVER (ORDER BY CAST(ts AS DATE), seq) - 1 AS seq, type, location, epoch_us(ts) // 1000 AS ms,
  concat('e', CAST(seq AS VARCHAR)) AS id FROM ev"""
)
ORACLES["pending_files"] = (
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality > 0)"
)

# --- projections and predicates -------------------------------------------------

ORACLES["rel_path"] = _CODE + "SELECT path, substr(path, 7) AS rel FROM code"
ORACLES["module_name"] = _MODULES + "SELECT path, name FROM mods"
ORACLES["only_parseable"] = (
    _CODE + "SELECT path, regexp_extract(path, '[^.]*$') AS ext FROM code WHERE NOT html"
)
ORACLES["within_size_limit"] = f"SELECT doc_id FROM documents WHERE length(text) <= {SIZE_LIMIT}"
ORACLES["content_key"] = "SELECT doc_id, left(sha256(text), 32) AS cache_key FROM documents"
ORACLES["event_timeline"] = (
    _EVENTS
    + "SELECT seq, ts, type, location, array_to_string(json_keys(details), ', ') AS details FROM ev"
)
ORACLES["events_of_type"] = _EVENTS + "SELECT seq, location FROM ev WHERE type = 'api_call'"
ORACLES["filter_events_by_config"] = (
    _EVENTS + "SELECT seq, type FROM ev WHERE type NOT IN ('variable_access', 'dom_access')"
)
ORACLES["with_event_id"] = (
    _EVENTS
    + "SELECT seq, left(sha256(concat(CAST(seq AS VARCHAR), '|', type, '|', location)), 16) AS id FROM ev"
)
ORACLES["module_bands"] = (
    _MODULES
    + f"""SELECT path, {_BAND} AS band, round(size / 1024, 1) AS kb,
  concat('node_', regexp_replace(path, '[^a-zA-Z0-9]', '_', 'g')) AS node FROM mods"""
)
ORACLES["classify_layer"] = _CLASSIFIED + "SELECT path, raw_label, layer FROM layered"

# --- corpus extraction ----------------------------------------------------------

_TOKEN = _text(
    r'"(?:\\.|[^"\\\n])*"'
    + r"|[A-Za-z_$][\w$]*|=>|&&|\|\||\?\?|\d[\w.]*|[^\s\w]"
)
ORACLES["code_tokens"] = (
    _CODE
    + f"""SELECT path, CAST(generate_subscripts(toks, 1) - 1 AS INT) AS pos, unnest(toks) AS tok
FROM (SELECT path, regexp_extract_all(content, {_TOKEN}) AS toks FROM code WHERE NOT html)"""
)
ORACLES["extract_dependencies"] = _MODULES + "SELECT path, specifier, kind, ord FROM deps"
ORACLES["dependency_graph"] = (
    _MODULES + "SELECT path, specifier, min(ord) AS ord FROM deps GROUP BY path, specifier"
)
ORACLES["dependency_kind_counts"] = (
    _MODULES
    + """SELECT path, CAST(count(*) FILTER (kind = 'import') AS BIGINT) AS imports,
  CAST(count(*) FILTER (kind = 'require') AS BIGINT) AS requires, count(DISTINCT specifier) AS distinct_deps
FROM deps GROUP BY path"""
)
ORACLES["module_symbols"] = (
    _MODULES
    + """SELECT path, export_name AS exports,
  CASE WHEN html THEN '' ELSE concat(export_name, '|', export_name) END AS functions, '' AS classes FROM mods"""
)
ORACLES["code_nodes"] = (
    _MODULES
    + """SELECT path, kind, CAST(n AS BIGINT) AS n, CAST(depth * n AS BIGINT) AS ancestors FROM (
  SELECT path, 'fn_decl' AS kind, 1 AS n, 0 AS depth FROM mods WHERE NOT html
  UNION ALL SELECT path, unnest(['if', 'logical', 'ternary']), a, 1 FROM mods WHERE NOT html
  UNION ALL SELECT path, unnest(['callback_call', 'fn_expr']), c, 0 FROM mods WHERE NOT html) WHERE n > 0"""
)
ORACLES["module_complexity"] = _MODULES + "SELECT path, complexity FROM mods WHERE NOT html"
ORACLES["function_complexity"] = (
    _MODULES
    + """SELECT path, complexity, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT path, CAST(1 + floor(2.5 * a + 0.5) AS BIGINT) AS complexity, 1 AS n FROM mods WHERE NOT html
  UNION ALL SELECT path, 1, c FROM mods WHERE NOT html AND c > 0) GROUP BY path, complexity"""
)
_DEP_LIST = "(SELECT path, string_agg(specifier, '|' ORDER BY ord) AS dependencies FROM deps GROUP BY path)"
ORACLES["module_table"] = (
    _MODULES
    + f"""SELECT seq, mods.path, name, coalesce(dependencies, '') AS dependencies, export_name AS exports,
  CASE WHEN html THEN '' ELSE concat(export_name, '|', export_name) END AS functions, '' AS classes,
  CAST(size AS BIGINT) AS size, complexity FROM mods LEFT JOIN {_DEP_LIST} d ON d.path = mods.path"""
)
# What the files of fixtures.RICH_FILES must give, counted by hand from the scoring rules:
# dependencies, exports, functions, classes, complexity, kinds.
_RICH = [
    ("", "", "load", "", 8, "await,catch,fn_decl,for_each,if,try"),
    ("", "A", "", "A|A", 4, "class_decl,ternary,while"),
    ("", "default", "main", "", 4, "case,case,fn_decl,switch"),
    ("", "", "sum|two", "", 7, "arrow,arrow,callback_call,do_while,fn_expr"),
    ("", "", "m|p|q", "", 7, "await,logical,logical,method,method,method"),
    ("", "", "", "", 2, "for,for_each,if"),
    ("t", "", "", "", 2, "logical,ternary"),
    ("", "", "V", "", 9, "arrow,arrow,callback_call,ternary"),
    ("./d|f|h|side|i", "", "", "", 0, ""),
    ("", "", "", "", 10, "arrow,arrow,arrow,callback_call,callback_call,callback_call,fn_expr,if"),
    ("", "", "", "", 3, "if,if,while"),
    ("", "go", "gen|go|go", "", 5, "await,fn_decl,fn_decl,for_each"),
]
ORACLES["rich_modules"] = (
    "SELECT concat('/rich/f', CAST(p_partkey AS VARCHAR), '.tsx') AS path, dependencies, exports, functions, classes,"
    " CAST(complexity AS BIGINT) AS complexity, kinds FROM part JOIN (VALUES "
    + ", ".join(f"({i}, '{d}', '{e}', '{f}', '{c}', {n}, '{k}')" for i, (d, e, f, c, n, k) in enumerate(_RICH))
    + f") t(i, dependencies, exports, functions, classes, complexity, kinds) ON p_partkey % {len(_RICH)} = i"
)
ORACLES["split_bundle_modules"] = (
    f"WITH obf AS (SELECT o.*, p_brand FROM ({OBFUSCATED_FILES_SQL}) o JOIN part ON seq = p_partkey) "
    + """SELECT path, CAST(0 AS INT) AS module_idx,
  CASE WHEN seq % 11 = 0 THEN concat('function(a){one(', p_brand, ')}') ELSE content END AS module_code FROM obf
UNION ALL SELECT path, CAST(1 AS INT), 'b){two()}' FROM obf WHERE seq % 11 = 0"""
)

# --- joins ----------------------------------------------------------------------

ORACLES["files_with_deps"] = (
    _MODULES
    + f"SELECT seq, mods.path, coalesce(dependencies, '') AS dependencies FROM mods LEFT JOIN {_DEP_LIST} d ON d.path = mods.path"
)
ORACLES["resolve_dependencies"] = (
    _RESOLVED_ALL + "SELECT src_path, specifier, dst_path, pass FROM resolved"
)
ORACLES["dependency_matrix"] = (
    _MODULES
    + """SELECT DISTINCT d.path AS src, m.path AS dst, TRUE AS has_dep
FROM (SELECT path, regexp_replace(specifier, '^[.]/', '') AS specifier FROM deps) d, mods m
WHERE d.specifier IN (m.path, m.name, regexp_replace(m.path, '[.]ts$', ''), regexp_replace(m.path, '[.]js$', ''))"""
)
ORACLES["dependency_matrix_factors"] = (
    _MODULES
    + """SELECT specifier, sources, targets FROM (
  SELECT specifier, count(DISTINCT path) AS sources FROM (
    SELECT path, regexp_replace(specifier, '^[.]/', '') AS specifier FROM deps) GROUP BY specifier)
JOIN (SELECT specifier, count(DISTINCT path) AS targets FROM (
    SELECT path, unnest([path, name, regexp_replace(path, '[.]ts$', ''), regexp_replace(path, '[.]js$', '')]) AS specifier FROM mods)
  GROUP BY specifier) USING (specifier)"""
)
_NODE = "concat('node_', regexp_replace({}, '[^a-zA-Z0-9]', '_', 'g'))"
ORACLES["internal_edges"] = (
    _RESOLVED_ALL
    + f"SELECT {_NODE.format('src_path')} AS src_key, {_NODE.format('dst_path')} AS dst_key FROM resolved WHERE dst_path IS NOT NULL"
)
ORACLES["external_dependencies"] = (
    _RESOLVED_STRICT + "SELECT src_path AS path, specifier FROM resolved WHERE dst_path IS NULL"
)
_CACHED = "(SELECT DISTINCT left(sha256(text), 32) AS cache_key FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"
ORACLES["cached_responses"] = f"""SELECT concat('/docs/', source, '/', CAST(doc_id AS VARCHAR), '.ts') AS path, cache_key,
  concat('# ', cache_key, chr(10), 'text') AS section
FROM (SELECT *, left(sha256(text), 32) AS cache_key FROM documents) JOIN {_CACHED} USING (cache_key)"""
ORACLES["documentation_worklist"] = f"""WITH keyed AS (SELECT *, left(sha256(text), 32) AS cache_key FROM documents),
marked AS (SELECT keyed.*,
  CASE WHEN cache_key IN (SELECT cache_key FROM {_CACHED}) THEN 'cached'
       WHEN doc_id = min(doc_id) OVER (PARTITION BY cache_key) THEN 'pending' ELSE 'shared' END AS status FROM keyed)
SELECT concat(source, '/', CAST(doc_id AS VARCHAR), '.ts') AS rel, cache_key,
  CASE WHEN status = 'pending' THEN CAST(length(text) + {len(PROMPT_HEAD) + len(PROMPT_TAIL)} AS INT) END AS prompt_chars,
  '_No dependencies_' AS deps, status FROM marked"""

# --- aggregations ---------------------------------------------------------------

_OVERVIEW = """SELECT count(*) AS total_modules, CAST(sum(complexity) AS BIGINT) AS total_complexity,
  round(avg(complexity), 2) AS avg_complexity FROM mods"""
ORACLES["complexity_overview"] = _MODULES + _OVERVIEW
ORACLES["report_tables_roundtrip"] = _MODULES + _OVERVIEW
ORACLES["complexity_distribution"] = (
    _MODULES
    + f"""SELECT b.band, count(m.band) AS n FROM (SELECT unnest(['low', 'medium', 'high', 'critical']) AS band) b
LEFT JOIN (SELECT {_BAND} AS band FROM mods) m ON m.band = b.band GROUP BY b.band"""
)
ORACLES["layer_summary"] = (
    _CLASSIFIED
    + """SELECT layer, count(*) AS modules, round(avg(complexity), 2) AS avg_complexity,
  round(sum(size) / 1024, 1) AS total_kb, CAST(count(*) FILTER (complexity > 30) AS BIGINT) AS critical
FROM layered GROUP BY layer"""
)
ORACLES["event_summary"] = (
    _EVENTS
    + """SELECT count(*) AS total_events, arg_min(ts, seq) AS start_ts, arg_max(ts, seq) AS end_ts,
  epoch_us(arg_max(ts, seq)) // 1000 - epoch_us(arg_min(ts, seq)) // 1000 AS duration_ms FROM ev"""
)
ORACLES["event_type_counts"] = _EVENTS + "SELECT type, count(*) AS n FROM ev GROUP BY type"
ORACLES["function_call_stats"] = (
    _EVENTS
    + "SELECT count(*) AS total_calls, count(DISTINCT location) AS unique_functions FROM ev WHERE type = 'function_call'"
)
ORACLES["function_call_frequency"] = (
    _EVENTS + "SELECT location, count(*) AS n FROM ev WHERE type = 'function_call' GROUP BY location"
)
_API = _EVENTS + """, api AS (SELECT seq, coalesce(nullif(details::json->>'$.url', ''), location) AS endpoint,
  coalesce(nullif(details::json->>'$.method', ''), 'unknown') AS method FROM ev WHERE type = 'api_call') """
ORACLES["api_call_stats"] = (
    _API + "SELECT count(*) AS total_calls, count(DISTINCT endpoint) AS unique_endpoints FROM api"
)
ORACLES["api_endpoints"] = _API + "SELECT endpoint, min(seq) AS first_seq FROM api GROUP BY endpoint"
ORACLES["api_methods"] = _API + "SELECT method, count(*) AS n FROM api GROUP BY method"
ORACLES["dom_access_stats"] = (
    _EVENTS + "SELECT location AS method, count(*) AS n FROM ev WHERE type = 'dom_access' GROUP BY 1"
)
ORACLES["storage_access_stats"] = (
    _EVENTS
    + "SELECT location AS operation, count(*) AS n FROM ev WHERE type = 'storage_access' GROUP BY 1"
)
ORACLES["identifier_frequency"] = _LETTERS + "SELECT path, ident, n, first_pos FROM freq"
ORACLES["deps_per_file"] = (
    _MODULES
    + """SELECT mods.path, coalesce(dep_list, '_No dependencies_') AS dep_list FROM mods LEFT JOIN (
  SELECT path, string_agg(concat('- `', specifier, '`'), chr(10) ORDER BY ord) AS dep_list FROM deps GROUP BY path) d
ON d.path = mods.path"""
)

# --- windows, sorts, limits -----------------------------------------------------

ORACLES["most_complex_modules"] = (
    _MODULES
    + """SELECT CAST(row_number() OVER (ORDER BY complexity DESC, seq) AS INT) AS rank, name, complexity,
  CAST(CASE WHEN html THEN 0 ELSE 2 END AS INT) AS functions, CAST(0 AS INT) AS classes, round(size / 1024, 1) AS size_kb
FROM mods QUALIFY rank <= 10"""
)
ORACLES["most_called"] = (
    _EVENTS
    + """SELECT location, count(*) AS n FROM ev WHERE type = 'function_call' GROUP BY location
ORDER BY n DESC, min(seq) LIMIT 10"""
)
ORACLES["refactoring_candidates"] = (
    _MODULES
    + f"""SELECT {_BAND} AS band, CAST(row_number() OVER (PARTITION BY {_BAND} ORDER BY complexity DESC, seq) AS INT) AS rank,
  name, complexity FROM mods WHERE complexity > 20 QUALIFY rank <= 5"""
)
ORACLES["layer_critical_modules"] = (
    _CLASSIFIED
    + """SELECT layer, CAST(row_number() OVER (PARTITION BY layer ORDER BY seq) AS INT) AS rank, name, complexity,
  greatest(count(*) OVER (PARTITION BY layer) - 5, 0) AS remaining FROM layered WHERE complexity > 30 QUALIFY rank <= 5"""
)
ORACLES["rename_map"] = _LETTERS + "SELECT path, ident, new_name, rank FROM renames"
ORACLES["latest_events"] = (
    _EVENTS + f"SELECT seq, type, location FROM ev ORDER BY seq DESC LIMIT {LATEST_N}"
)
ORACLES["latest_events_per_type"] = (
    _EVENTS
    + f"""SELECT seq, type, location FROM ev
QUALIFY row_number() OVER (PARTITION BY type ORDER BY seq DESC) <= {LATEST_PER_TYPE}"""
)
ORACLES["latest_events_default"] = _EVENTS + "SELECT seq, type, location FROM ev ORDER BY seq DESC LIMIT 10000"
ORACLES["latest_events_by_selection"] = (
    _EVENTS
    + f"""SELECT seq, type, location FROM ev
QUALIFY row_number() OVER (PARTITION BY location ORDER BY seq DESC) <= {LATEST_PER_LOCATION}"""
)
ORACLES["stream_latest_events"] = ORACLES["latest_events_per_type"]
ORACLES["stream_event_counts"] = (
    _EVENTS + "SELECT type, location, count(*) AS n FROM ev GROUP BY type, location"
)
ORACLES["distinct_specifiers"] = _MODULES + "SELECT DISTINCT specifier FROM deps"

# --- text functions -------------------------------------------------------------


def _match(*shapes: str) -> str:
    return "(" + " OR ".join(f"regexp_matches(content, {_text(s)})" for s in shapes) + ")"


_TERSER = (r"\b[a-z]\$[a-z]+\b", r"!function\([a-z],[a-z]\)", r"\b[a-z]{1,2}\([a-z],[a-z],[a-z]\)")
_DETECTED = (
    _OBF
    + f""", found AS (
  SELECT path, 'webpack' AS pattern, 0.9::DOUBLE AS confidence FROM obf WHERE {_match(rules.WEBPACK_MARKERS)}
  UNION ALL SELECT path, 'uglify', 0.7 FROM obf WHERE {_match(*rules.UGLIFY_SHAPES)}
  UNION ALL SELECT path, 'terser', 0.8 FROM obf WHERE {_match(*_TERSER)}
  UNION ALL SELECT path, 'jsconfuser', 0.85 FROM obf WHERE {_match(*rules.JSCONFUSER_SHAPES)}
  UNION ALL SELECT path, 'custom_hex', 0.6 FROM obf WHERE len(regexp_extract_all(content, {_text(rules.HEX_ESCAPE)})) > 10
  UNION ALL SELECT path, 'eval_obfuscation', 0.95 FROM obf WHERE {_match(rules.EVAL_CALL)} AND {_match(*rules.EVAL_COMPANIONS)})
"""
)
ORACLES["detect_obfuscation"] = _DETECTED + "SELECT path, pattern, confidence FROM found"
ORACLES["ranked_patterns"] = (
    _DETECTED
    + """SELECT path, pattern, confidence,
  CAST(row_number() OVER (PARTITION BY path ORDER BY confidence DESC) AS INT) AS rank FROM found"""
)
ORACLES["registered_pattern"] = (
    _DETECTED
    + """SELECT pattern, confidence, count(*) AS n FROM found GROUP BY ALL
UNION ALL SELECT 'storage_write', 0.5, count(*) FROM obf WHERE contains(content, 'localStorage.setItem')"""
)

ORACLES["registered_rewrite"] = (
    _OBF
    + """SELECT path, replace(replace(content, 'querySelector', 'SELECT'), 'localStorage.setItem', 'store') AS content,
  concat_ws(',', CASE WHEN contains(content, 'querySelector') THEN 'dom_read' END,
    CASE WHEN contains(content, 'localStorage.setItem') THEN 'storage_write' END) AS applied FROM obf"""
)

# The parts of each obfuscated file that the decoders should change, by formula.
_PIECES = f"""WITH obf AS (
  SELECT o.*, p.p_name,
    concat(CAST(65 + seq % 26 AS VARCHAR), ', ', CAST(97 + p_size % 26 AS VARCHAR), ',', CAST(945 + p_size % 17 AS VARCHAR)) AS codes,
    concat(chr(CAST(65 + seq % 26 AS INT)), chr(CAST(97 + p_size % 26 AS INT)), chr(CAST(945 + p_size % 17 AS INT))) AS code_text,
    CASE p_size % 4 WHEN 0 THEN 'c21hbGw=' WHEN 1 THEN 'bGFyZ2U' WHEN 2 THEN 'w6ljaG8=' ELSE 'aHR0cHM6Ly9h' END AS b64,
    CASE p_size % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'large' WHEN 2 THEN concat(chr(233), 'cho') ELSE 'https://a' END AS b64_text,
    concat('run ', p_name) AS eval_text, 4 + p_size % 4 AS hex_pairs
  FROM ({OBFUSCATED_FILES_SQL}) o JOIN part p ON seq = p_partkey) """
ORACLES["decode_char_codes"] = (
    _PIECES
    + """SELECT path, replace(content, concat('String["fromCharCode"](', codes, ')'), concat('"', code_text, '"')) AS content FROM obf"""
)
ORACLES["decode_base64_calls"] = (
    _PIECES
    + """SELECT path, replace(content, concat('atob("', b64, '")'), concat('"', b64_text, '"')) AS content FROM obf"""
)
ORACLES["decode_hex_escapes"] = (
    _PIECES + "SELECT path, replace(replace(content, '\\x41', 'A'), '\\x62', 'b') AS content FROM obf"
)
ORACLES["mark_eval_payloads"] = (
    _PIECES
    + """SELECT path, replace(content, concat('eval("', eval_text, '")'),
  concat('// EVAL CONTENT:', chr(10), eval_text, chr(10), '// END EVAL')) AS content FROM obf"""
)
ORACLES["extract_eval_payloads"] = (
    _PIECES + "SELECT path, CAST(0 AS INT) AS idx, eval_text AS payload FROM obf WHERE seq % 7 = 0"
)
ORACLES["encoded_payloads"] = (
    _PIECES
    + """SELECT path, 'char_codes' AS kind, codes AS payload, code_text AS decoded FROM obf WHERE seq % 2 = 0
UNION ALL SELECT path, 'base64', b64, b64_text FROM obf WHERE seq % 3 = 0
UNION ALL SELECT path, 'hex_escape', concat('\\x', h), d FROM (
  SELECT path, unnest(range(CAST(hex_pairs AS BIGINT))) AS i FROM obf WHERE seq % 5 = 0), (VALUES ('41', 'A'), ('62', 'b')) v(h, d)
UNION ALL SELECT path, 'eval', eval_text, eval_text FROM obf WHERE seq % 7 = 0"""
)
ORACLES["reflow_uglify"] = (
    _OBF
    + """SELECT path, replace(replace(replace(replace(content, ';', concat(';', chr(10))), '{', concat('{', chr(10))),
  '}', concat(chr(10), '}', chr(10))), ',', concat(',', chr(10))) AS content FROM obf"""
)
ORACLES["reflow_terser"] = (
    _OBF
    + """SELECT path, replace(replace(replace(replace(content, ';', concat(';', chr(10))), '}', concat('}', chr(10))),
  '{', concat('{', chr(10))), '}', concat(chr(10), '}', chr(10))) AS content FROM obf"""
)


# One step per rank, each a table of its own, so that the SQL stays linear.
def _rename_steps(source: str) -> str:
    columns = ", ".join(f"max(ident) FILTER (rank = {r}) AS i{r}" for r in range(1, 11))
    pairs = f"(SELECT path, {columns} FROM renames GROUP BY path)"
    steps = [f"s0 AS (SELECT src.*, p.* EXCLUDE (path) FROM {source} src LEFT JOIN {pairs} p USING (path))"]
    for r, name in enumerate(rules.MEANINGFUL_NAMES, start=1):
        replaced = f"regexp_replace(t, concat('\\b', i{r}, '\\b'), '{name}', 'g')"
        steps.append(
            f"s{r} AS (SELECT * REPLACE (CASE WHEN i{r} IS NULL THEN t ELSE {replaced} END AS t) FROM s{r - 1})"
        )
    return ", ".join(steps)


ORACLES["apply_renames"] = (
    _LETTERS
    + ", docs AS (SELECT concat('/docs/', source, '/', CAST(doc_id AS VARCHAR), '.ts') AS path, text AS t FROM documents), "
    + _rename_steps("docs")
    + " SELECT path, t AS content FROM s10"
)
# Rewrites in order: eval, webpack, character codes and base64, reflow, renames, hex.
ORACLES["deobfuscate"] = (
    _DETECTED
    + f""", marked AS (SELECT path, string_agg(pattern, ',' ORDER BY confidence DESC) AS applied FROM found GROUP BY path),
staged AS (
  SELECT pieces.*, p_brand, coalesce(applied, '') AS applied,
    CASE WHEN contains(applied, 'webpack')
         THEN concat('// === MODULE 0 ===', chr(10), 'function module0(function(a){{one(', p_brand, ')}}', chr(10), chr(10),
                     '// === MODULE 1 ===', chr(10), 'function module1(b){{two()}}')
         WHEN contains(applied, 'eval')
         THEN replace(content, concat('eval("', eval_text, '")'), concat('// EVAL CONTENT:', chr(10), eval_text, chr(10), '// END EVAL'))
         ELSE content END AS c1
  FROM ({_PIECES} SELECT * FROM obf) pieces JOIN part ON seq = p_partkey LEFT JOIN marked USING (path)),
decoded AS (
  SELECT *, replace(replace(c1, concat('String["fromCharCode"](', codes, ')'), concat('"', code_text, '"')),
    concat('atob("', b64, '")'), concat('"', b64_text, '"')) AS c2 FROM staged),
docs AS (
  SELECT path, applied, contains(applied, 'uglify') AS ugly, CASE WHEN contains(applied, 'uglify')
    THEN replace(replace(replace(replace(c2, ';', concat(';', chr(10))), '{{', concat('{{', chr(10))),
      '}}', concat(chr(10), '}}', chr(10))), ',', concat(',', chr(10))) ELSE c2 END AS t FROM decoded),
words AS (
  SELECT path, unnest(regexp_extract_all(t, '\\b([a-zA-Z])\\b', 1)) AS ident,
    generate_subscripts(regexp_extract_all(t, '\\b([a-zA-Z])\\b', 1), 1) AS pos FROM docs WHERE ugly),
freq AS (SELECT path, ident, count(*) AS n, min(pos) AS first_pos FROM words GROUP BY ALL),
renames AS (SELECT path, ident, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, first_pos) AS rank FROM freq) WHERE n > 5 AND rank <= 10),
"""
    + _rename_steps("docs")
    + """ SELECT path, applied, CASE WHEN contains(applied, 'custom_hex')
  THEN replace(replace(t, '\\x41', 'A'), '\\x62', 'b') ELSE t END AS content FROM s10"""
)
ORACLES["normalise_strings"] = """SELECT p_partkey, concat(
  'a=`', p_name, p_brand, '`;', chr(10), 'b="', p_name, p_brand, '";', chr(10),
  'c=''', p_name, '''''', p_brand, ''';', chr(10), 'd="\\u000', upper(to_hex(p_size % 16)), '";') AS content FROM part"""
ORACLES["strip_comments"] = """SELECT concat('/site/page', CAST(page_id AS VARCHAR), '.html') AS path,
  regexp_replace(html, '/[*](?s:.)*?[*]/|//[^\\n\\r\\x{2028}\\x{2029}]*', '', 'g') AS content FROM pages"""
ORACLES["halve_indent"] = (
    _CODE
    + """SELECT path, array_to_string(list_transform(string_split(content, chr(10)),
  lambda l: concat(repeat(' ', CAST((length(l) - length(ltrim(l, concat(' ', chr(9))))) // 2 AS INT)), ltrim(l, concat(' ', chr(9))))), chr(10)) AS content FROM code"""
)
ORACLES["instrumentation_sites_inventory"] = f"""WITH files AS (
  SELECT path, content, seq % 5 = 4 AS html, TRUE AS code FROM ({CODE_FILES_SQL})
  UNION ALL SELECT path, content, FALSE, FALSE FROM ({OBFUSCATED_FILES_SQL})),
sites AS (
  SELECT path, 'function' AS family, unnest(regexp_extract_all(content, 'export function (\\w+)', 1)) AS target FROM files WHERE code AND NOT html
  UNION ALL SELECT path, 'variable', unnest(regexp_extract_all(content, {_text(rules.SITE_VARIABLE)}, 1)) FROM files
  UNION ALL SELECT path, 'api', 'XMLHttpRequest' FROM (SELECT path, unnest(regexp_extract_all(content, {_text(rules.SITE_XHR)})) FROM files)
  UNION ALL SELECT path, 'api', 'fetch' FROM (SELECT path, unnest(regexp_extract_all(content, {_text(rules.SITE_FETCH)})) FROM files)
  UNION ALL SELECT path, 'dom', unnest(regexp_extract_all(content, {_text(rules.SITE_DOM)}, 1)) FROM files
  UNION ALL SELECT path, 'storage', unnest(regexp_extract_all(content, {_text(rules.SITE_STORAGE)})) FROM files)
SELECT path, family, target, count(*) AS n FROM sites GROUP BY ALL"""
ORACLES["first_markdown_section"] = f"""WITH r AS ({RESPONSES_SQL}),
lines AS (
  SELECT cache_key, unnest(string_split(response, chr(10))) AS line,
    generate_subscripts(string_split(response, chr(10)), 1) - 1 AS i FROM r),
fenced AS (
  SELECT *, starts_with(trim(line), '```') AS fence,
    sum(CASE WHEN starts_with(trim(line), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY cache_key ORDER BY i) AS fences FROM lines),
cuts AS (
  SELECT cache_key, min(i) FILTER (i > 0 AND NOT fence AND fences % 2 = 0 AND starts_with(trim(line), '#')) AS cut
  FROM fenced GROUP BY cache_key)
SELECT cache_key, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (cut IS NULL OR i < cut), ''), '^\\s+|\\s+$', '', 'g') AS section
FROM fenced JOIN cuts USING (cache_key) GROUP BY cache_key"""

# --- reports --------------------------------------------------------------------

ORACLES["runtime_report_counts"] = (
    _API
    + """SELECT 'event_types' AS section, type AS label, count(*) AS n FROM ev GROUP BY ALL
UNION ALL SELECT 'call_frequency', location, count(*) FROM ev WHERE type = 'function_call' GROUP BY ALL
UNION ALL SELECT 'methods', method, count(*) FROM api GROUP BY ALL
UNION ALL SELECT 'dom_access', location, count(*) FROM ev WHERE type = 'dom_access' GROUP BY ALL
UNION ALL SELECT 'storage_access', location, count(*) FROM ev WHERE type = 'storage_access' GROUP BY ALL"""
)
_COLORS = "CASE layer " + " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in rules.LAYERS) + " END"
ORACLES["architecture_nodes"] = (
    _CLASSIFIED
    + f"""SELECT {_NODE.format('path')} AS node, name, complexity, {_BAND} AS band, layer, {_COLORS} AS color FROM layered"""
)
ORACLES["architecture_report_sizes"] = (
    _RESOLVED_ALL
    + _LAYERED
    + """SELECT 'nodes' AS section, count(*) AS n FROM mods
UNION ALL SELECT 'edges', count(*) FROM resolved WHERE dst_path IS NOT NULL
UNION ALL SELECT 'layers', count(DISTINCT layer) FROM layered
UNION ALL SELECT 'layer_critical', CAST(sum(least(k, 5)) AS BIGINT) FROM (SELECT count(*) AS k FROM layered WHERE complexity > 30 GROUP BY layer)
UNION ALL SELECT 'matrix', count(*) FROM (SELECT DISTINCT d.path, m.path FROM deps d, mods m
  WHERE d.specifier IN (m.path, m.name, regexp_replace(m.path, '[.]ts$', ''), regexp_replace(m.path, '[.]js$', '')))
UNION ALL SELECT 'overview', 1 UNION ALL SELECT 'most_complex', least(10, count(*)) FROM mods UNION ALL SELECT 'distribution', 4
UNION ALL SELECT 'candidates', least(5, count(*) FILTER (complexity > 30)) + least(5, count(*) FILTER (complexity > 20 AND complexity <= 30)) FROM mods"""
)


def _report_rows(columns: dict[str, tuple[str, ...]], tables: dict[str, str]) -> str:
    """The rows of a report's sections, each from the SQL of its own query."""
    parts = []
    for section, names in columns.items():
        cells = ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'null')" for c in names)
        parts.append(f"SELECT '{section}' AS section, concat_ws('|', {cells}) AS line FROM ({tables[section]}) t")
    return " UNION ALL ".join(parts)


ORACLES["runtime_report_rows"] = _report_rows(
    RUNTIME_SECTIONS,
    {
        "summary": ORACLES["event_summary"],
        "event_types": ORACLES["event_type_counts"],
        "function_calls": ORACLES["function_call_stats"],
        "most_called": ORACLES["most_called"],
        "call_frequency": ORACLES["function_call_frequency"],
        "api_calls": ORACLES["api_call_stats"],
        "endpoints": ORACLES["api_endpoints"],
        "methods": ORACLES["api_methods"],
        "dom_access": ORACLES["dom_access_stats"],
        "storage_access": ORACLES["storage_access_stats"],
        "timeline": ORACLES["event_timeline"],
    },
)
ORACLES["architecture_report_rows"] = _report_rows(
    ARCHITECTURE_SECTIONS,
    {
        "nodes": ORACLES["architecture_nodes"],
        "edges": ORACLES["internal_edges"],
        "layers": ORACLES["layer_summary"],
        "layer_critical": ORACLES["layer_critical_modules"],
        "matrix": _MODULES
        + """SELECT DISTINCT d.path AS src, m.path AS dst FROM deps d, mods m
WHERE d.specifier IN (m.path, m.name, regexp_replace(m.path, '[.]ts$', ''), regexp_replace(m.path, '[.]js$', ''))""",
        "overview": ORACLES["complexity_overview"],
        "most_complex": ORACLES["most_complex_modules"],
        "distribution": ORACLES["complexity_distribution"],
        "candidates": ORACLES["refactoring_candidates"],
    },
)
