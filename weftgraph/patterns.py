"""Patterns, word lists and tables that decide what is extracted.

Each pattern has one capture group, the part that is kept.  They use no lookaround, so the
Java, Python and RE2 dialects agree on them.  ``(?U)`` makes classes Unicode-aware in Java, as
they are in Python.
"""

# ---- fixed values ----

#: Candidate for a proper noun: one to three capitalised words, the first of at least three letters.
PROPER_NOUN = r"\b([A-Z][a-z]{2,}(?:['’\-][A-Z][a-z]+)?(?:\s+[A-Z][a-z]+){0,2})\b"

#: Capitalised words that are no names, alone or as the first word of a candidate.
NOT_NAMES = """
The A An And But Or So If As At In On Of To For With By From He She It They We You His Her Their My Your Our Its This
That These Those There Here When Then Now What Who Why How Where While After Before Once Yet Not No Yes Chapter Part
Book Page Contents Introduction Prologue Epilogue Section Figure Table Note
""".split()

#: Words that end a phrase.
FUNCTION_WORDS = """
a an the and or but if then else of to in on at by for with from into over under as is are was were be been being this
that these those it its he she they we you i his her their our your my not no nor so than too very can will would
should could may might must do does did have has had which who whom whose what when where why how all any both each few
more most other some such only own same s t just don now also per via use used using add
""".split()

#: A word, or one other character that is neither a letter nor white space.
PHRASE_TOKEN = r"([A-Za-z][A-Za-z'\-]*|[^A-Za-z\s])"

#: Forms that define a term, in the order in which they are tried.
DEFINITIONS = [
    r"(?m)^[ \t]*[“\"‘']([A-Z][A-Za-z0-9 ,\-/&()]{1,70}?)[”\"’']\s*:",
    r"[“\"‘']([A-Z][A-Za-z0-9 ,\-/&]{1,70}?)[”\"’']\s+(?:means|shall mean|shall have the meaning)\b",
    r"\(\s*(?:the|each(?: a)?|a|an|collectively,?|individually,?|together,?)?\s*[“\"‘']([A-Z][A-Za-z0-9 ,\-/&]{1,70}?)[”\"’']\s*\)",
    r"\b([A-Z][A-Za-z0-9 ,\-/&]{1,70}?)\s+is defined as\b",
    r"\b([A-Z][A-Za-z0-9 ,\-/&]{1,70}?)\s+means\s+[A-Za-z]",
]

#: Marks of divisions by preset, in the order in which they are tried.
MARKERS = {
    "section": [r"(?m)^\s*((?:SECTION|Section)\s+\d+[A-Za-z0-9.]*)", r"(?m)^\s*((?:ARTICLE|Article)\s+[IVXLC0-9]+)"],
    "heading": [r"(?m)^#{1,6}\s+(.+?)\s*$"],
    "slugline": [r"(?m)^\s*((?:INT\.|EXT\.|INT/EXT\.?)[^\n]{0,70})"],
    "chapter": [r"(?m)^\s*((?:CHAPTER|Chapter)\s+[A-Za-z0-9]+)"],
}

#: A reference to a numbered division; the group is its number.
CROSS_REFERENCE = r"(?i)(?:Section|Article|Clause|Chapter|§)\s*([0-9]+(?:\.[0-9]+)*|[IVXLC]+)\b"

#: A line that begins a division of a document.
DIVISION_LINE = r"^[ \t]*(?:#{1,6}[ \t]+\S.*|(?:SECTION|Section|ARTICLE|Article|CHAPTER|Chapter)[ \t]+[\w.\-]+.*|(?:INT\.|EXT\.|INT/EXT\.?)[ \t].*)[ \t]*$"

#: An inline code span.
CODE_SPAN = r"`([^`]+)`"

#: Definitions in source text of languages that are not parsed.
PLAIN_DEFINITION = r"(?m)^\s*(?:def|class|func|function|fn)\s+([A-Za-z_]\w+)"

#: Where services meet: kind, role, pattern of the key; tried in this order.
CONNECTORS = [
    ("http", "server", r"@\w+\.(?:route|get|post|put|delete|patch|head|options)\(\s*['\"]([^'\"]+)['\"]"),
    ("http", "server", r"(?i)\b(?:app|router|mux|srv|server|api)\.(?:get|post|put|delete|patch|head|use|handle|handlefunc|add_route|add_url_rule)\(\s*['\"`]([^'\"`]+)['\"`]"),
    ("http", "server", r"\.route\(\s*['\"]([^'\"]+)['\"]"),
    ("http", "server", r"web::resource\(\s*['\"]([^'\"]+)['\"]"),
    ("http", "client", r"(?i)\b(?:requests|httpx|aiohttp|urllib3|reqwest|axios|got)\.(?:get|post|put|delete|patch|request|head|fetch)\(\s*['\"]([^'\"]+)['\"]"),
    ("http", "client", r"(?i)\b(?:session|client|http|conn|self\.client)\.(?:get|post|put|delete|patch|request|head)\(\s*['\"]([^'\"]+)['\"]"),
    ("http", "client", r"\bfetch\(\s*['\"`]([^'\"`]+)['\"`]"),
    ("topic", "server", r"(?i)(?:subscribe|consume|listen)\w*\(\s*\[?\s*['\"]([^'\"]+)['\"]"),
    ("topic", "server", r"(?i)['\"]([A-Za-z][\w.\-]{2,})['\"]\s*,?\s*#?\s*(?:topic|queue|channel|subject)"),
    ("topic", "client", r"(?i)(?:produce|publish|emit|enqueue)\w*\([^)]*?['\"]([^'\"]+)['\"]"),
    ("topic", "client", r"(?i)\.send\(\s*['\"]([^'\"]+)['\"]"),
]

#: Routes too general to connect anything.
GENERAL_ROUTES = ["/", "", "/health", "/healthz", "/healthcheck", "/ping", "/status", "/metrics", "/favicon.ico", "/robots.txt", "/_health", "/livez", "/readyz"]

#: A parameter of a route.
ROUTE_PARAMETER = r"\{[^}/]*\}|:[A-Za-z_]\w*|<[^>/]*>"

#: Most client and server pairs of one key; a key with more connects nothing.
PAIRS_PER_KEY = 40

#: Languages by suffix, suffixes of the other kinds, and directories that are not walked into.
LANGUAGES = {".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".rs": "rust", ".go": "go", ".java": "java", ".rb": "ruby"}
DOC_SUFFIXES = [".md", ".markdown", ".rst", ".txt"]
PDF_SUFFIXES = [".pdf"]
SPEC_SUFFIXES = [".json", ".yaml", ".yml"]
IGNORED_DIRS = [".git", "node_modules", ".venv", "venv", "dist", "build", "__pycache__"]
SPEC_SNIFF = r"[\"']?(openapi|swagger)[\"']?\s*:"
HTTP_METHODS = ["get", "post", "put", "delete", "patch", "head", "options", "trace"]

#: The lenses that are there from the start.
SEED_LENSES = {
    "code": {
        "description": "Repositories: what is defined, what calls it, and how services reach each other.",
        "extractors": ["ast-callgraph", "structural-binding", "doc-cross-source"],
        "entity_types": ["function", "class", "struct", "method", "interface", "endpoint", "symbol"],
        "relation_types": ["calls", "imports", "binding", "connector", "doc_describes_code"],
        "details": {"aligns": {"endpoint": "schema:EntryPoint"}},
    },
    "prose": {
        "description": "Long texts: the names that recur in them and which of them appear together.",
        "extractors": [{"use": "recurring-proper-nouns", "etype": "character"}, "co-occurrence", "doc-cross-source", "structural-binding"],
        "entity_types": ["character", "place", "concept", "theme"],
        "relation_types": ["co_occurs", "mentions"],
        "details": {"aligns": {"character": "schema:Person", "place": "schema:Place", "concept": "skos:Concept"}},
    },
}

# ---- end of fixed values ----
