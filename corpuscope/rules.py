"""Fixed values. Results only agree when these match, so they are stated plainly."""

from __future__ import annotations

# --- fixed values: file kinds -------------------------------------------------
CODE_EXTENSIONS = ("js", "ts", "jsx", "tsx", "html")
PARSEABLE_EXTENSIONS = ("js", "ts", "jsx", "tsx")

# --- fixed values: construct weights, as (anywhere in file, inside a function) --
NODE_WEIGHTS = {
    "if": (1.0, 1.0),
    "ternary": (1.0, 1.0),
    "logical": (0.5, 0.5),
    "switch": (1.0, 0.0),
    "case": (0.0, 1.0),
    "while": (1.0, 1.0),
    "do_while": (0.0, 1.0),
    "for": (1.0, 1.0),
    "for_each": (0.0, 1.0),
    "try": (1.0, 0.0),
    "catch": (0.0, 1.0),
    "await": (0.5, 0.5),
    "callback_call": (0.5, 0.5),
    "class_decl": (2.0, 0.0),
}
FUNCTION_KINDS = ("fn_decl", "fn_expr", "arrow", "method")

# --- fixed values: complexity bands (upper bounds, inclusive) -------------------
BAND_LIMITS = (("low", 10), ("medium", 20), ("high", 30))
TOP_BAND = "critical"
BANDS = ("low", "medium", "high", "critical")
CRITICAL_ABOVE = 30
BUSY_COMPLEXITY, BUSY_FUNCTIONS, BUSY_CLASSES = 15, 8, 2

# --- fixed values: layers in report order, with their display colour -----------
LAYERS = (
    ("API Layer", "#FF6B6B"),
    ("Business Logic", "#4ECDC4"),
    ("Data Layer", "#45B7D1"),
    ("UI Components", "#96CEB4"),
    ("Utilities", "#FFEAA7"),
    ("Configuration", "#DDA0DD"),
    ("Infrastructure", "#C7B198"),
    ("Unknown", "#95A5A6"),
)
UNKNOWN_LAYER = "Unknown"

# --- fixed values: layer rules, first hit wins ---------------------------------
# (label, words an export must contain, words the path must contain)
EXPORT_RULES = (
    ("API Layer", ("fetch", "api", "service"), ("api", "service")),
    ("UI Components", ("component", "view", "hook"), ("component", "ui")),
    ("Data Layer", ("model", "store", "repository"), ("model", "data")),
    ("Utilities", ("util", "helper", "format"), ()),
)
# (label, words in the path, words in the module name, words in an export)
PATH_RULES = (
    ("FSD: App Layer", ("/app/",), (), ()),
    ("FSD: Processes", ("/processes/",), (), ()),
    ("FSD: Pages", ("/pages/",), (), ()),
    ("FSD: Widgets", ("/widgets/",), (), ()),
    ("FSD: Features", ("/features/",), (), ()),
    ("FSD: Entities", ("/entities/",), (), ()),
    ("FSD: Shared", ("/shared/",), (), ()),
    ("DDD: Domain", ("/domain/",), (), ()),
    ("DDD: Application", ("/application/",), (), ()),
    ("DDD: Infrastructure", ("/infrastructure/",), (), ()),
    ("DDD: Presentation", ("/presentation/",), (), ()),
    ("DDD: Aggregate", ("/aggregate/",), (), ()),
    ("DDD: Repository", ("/repository/",), (), ()),
    ("DDD: Service", ("/service/",), (), ()),
    ("DDD: Value Object", ("/valueobject/",), ("valueobject",), ()),
    ("DDD: Entity", ("/entity/",), ("entity",), ()),
    ("Atomic: Atom", ("/atoms/",), ("atom",), ()),
    ("Atomic: Molecule", ("/molecules/",), ("molecule",), ()),
    ("Atomic: Organism", ("/organisms/",), ("organism",), ()),
    ("Atomic: Template", ("/templates/",), ("template",), ()),
    ("Atomic: Page", ("/pages/",), ("page",), ()),
    (
        "API Layer",
        ("/api/", "/service", "/client", "/endpoint"),
        ("api", "service", "client", "endpoint", "controller"),
        (),
    ),
    (
        "UI Components",
        ("/component", "/ui/", "/view", "/pages", "/screens"),
        ("component", "view", "page", "screen", "hook"),
        ("component",),
    ),
    (
        "Data Layer",
        ("/model", "/store", "/data/", "/repository", "/dao"),
        ("model", "store", "repository", "dao", "schema"),
        (),
    ),
    (
        "Utilities",
        ("/util", "/helper", "/lib/", "/utils"),
        ("util", "helper", "tool", "utils"),
        (),
    ),
    (
        "Configuration",
        ("/config", "/setting", "/env"),
        ("config", "setting", "environment", "env"),
        (),
    ),
    (
        "Infrastructure",
        ("/middleware", "/server", "/plugin"),
        ("middleware", "server", "plugin"),
        (),
    ),
)
BUSY_LABEL = "Business Logic"

# --- fixed values: replacement names for frequent one-letter words --------------
MEANINGFUL_NAMES = (
    "element",
    "data",
    "config",
    "result",
    "value",
    "item",
    "index",
    "callback",
    "options",
    "params",
)
RENAME_TOP, RENAME_MIN_COUNT = 10, 5

# --- fixed values: obfuscation patterns ----------------------------------------
# JavaScript's \s, spelled out because Java's \s is ASCII only, and JavaScript's
# ASCII \b, because Java's follows Unicode letters.
WS = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
WORD_START = r"(?<![A-Za-z0-9_])"
WORD_END = r"(?![A-Za-z0-9_])"
NOT_EOL = r"[^\n\r\x{2028}\x{2029}]"

CONFIDENCE = {
    "webpack": 0.9,
    "uglify": 0.7,
    "terser": 0.8,
    "jsconfuser": 0.85,
    "custom_hex": 0.6,
    "eval_obfuscation": 0.95,
}
# Texts that the rewrites put in.
MODULE_HEAD = "// === MODULE "
MODULE_OPEN = " ===\nfunction module"
EVAL_MARKED = "// EVAL CONTENT:\n$1\n// END EVAL"
WEBPACK_MARKERS = r"webpackJsonp|__webpack_require__|webpackChunkName"
WEBPACK_WRAPPER = (
    r"\(function\(modules\)" + WS + r"*\{([\s\S]*?)\}\)\(\[([\s\S]*?)\]\)"
)
WEBPACK_SPLIT = r"," + WS + r"*function" + WS + r"*\("
UGLIFY_SHAPES = (
    r"[a-zA-Z]\$[a-zA-Z]{1,2}\$[a-zA-Z]",
    r"function" + WS + r"+[a-zA-Z]\([a-zA-Z],[a-zA-Z],[a-zA-Z]\)\{",
    r"!function\([a-zA-Z]\)\{",
    r"[a-zA-Z]\.prototype\.[a-zA-Z]=function",
)
TERSER_SHAPES = (
    WORD_START + r"[a-z]\$[a-z]+" + WORD_END,
    r"!function\([a-z],[a-z]\)",
    WORD_START + r"[a-z]{1,2}\([a-z],[a-z],[a-z]\)",
)
JSCONFUSER_SHAPES = (
    r'String\["fromCharCode"\]',
    r'\["constructor"\]\["constructor"\]',
    r"atob" + WS + r"*\(",
)
HEX_ESCAPE = r"\\x[0-9a-fA-F]{2}"
HEX_MIN_COUNT = 10
EVAL_CALL = r"eval" + WS + r"*\("
EVAL_COMPANIONS = (
    r"new" + WS + r"+Function" + WS + r"*\(",
    r"Function" + WS + r"*\(" + WS + r"*[\"']" + NOT_EOL + r"+[\"']" + WS + r"*\)",
)
CHAR_CODES = r'String\["fromCharCode"\]\((\d+(?:,' + WS + r"*\d+)*+)\)"
BASE64_CALL = r"atob" + WS + r"*\(" + WS + r"*[\"']([A-Za-z0-9+/=]+)[\"']" + WS + r"*\)"
EVAL_LITERAL = EVAL_CALL + WS + r"*[\"']([^\"']+)[\"']" + WS + r"*\)"
ONE_LETTER_WORD = WORD_START + r"([a-zA-Z])" + WORD_END

# --- fixed values: runtime events and call sites --------------------------------
EVENT_TYPES = (
    "function_call",
    "variable_access",
    "api_call",
    "dom_access",
    "storage_access",
)
MAX_EVENTS = 10_000
SITE_VARIABLE = r"(\w+)" + WS + r"*=" + WS + r"*([^;,\n]+)"
SITE_XHR = r"new" + WS + r"+XMLHttpRequest\(\)"
SITE_FETCH = r"fetch" + WS + r"*\("
SITE_DOM = r"document\.(getElementById|querySelector|querySelectorAll|createElement)"
SITE_STORAGE = r"(localStorage|sessionStorage)\.(getItem|setItem|removeItem)"
