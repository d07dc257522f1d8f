"""They must be as they are for right results."""

# --- fixed values: lexical tokens ---
STOP_WORDS = tuple(
    """
    the a an and or if is are was were be been being to of in on at for with by from as
    this that these those it its not no yes do does did done have has had will would can
    could should may might must return returns import from export default const let var
    function def class self this new public private static void true false null none
    """.split()
)
MIN_TOKEN, MAX_TOKENS, PART_WEIGHT = 2, 512, 0.5
#: what stands between identifiers, and where compound ones are cut
SEPARATOR = r"[^A-Za-z0-9_]+"
PARTS = r"_|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"

# --- fixed values: chunk limits (characters, characters, lines); headings and fences ---
MAX_CHUNK, MIN_CHUNK, OVERLAP_LINES = 6000, 100, 8
ATX_HEADING = r"^(#{1,6})\s+(.*?)\s*#*\s*$"
FENCE = r"^\s*(```|~~~)"

# --- fixed values: ranking ---
PREFETCH, RERANK_POOL, RRF_K = 4, 10, 60
RECENCY_FLOOR, RECENCY_SPAN, RECENCY_DAYS = 0.85, 0.15, 90.0
DUPLICATE_COSINE, PER_FILE = 0.85, 2
#: hits that a search gives at the most, and the list of notes
MOST_HITS, MOST_BROWSED = 25, 100
#: what a result tells beside its text, where the table has it
EXTRAS = ("title", "language", "symbol_type", "doc_type", "memory_type", "tags", "status", "created_at", "updated_at", "git_commit", "chunk_index", "chunk_total")

RERANK_SECONDS = 12.0

# --- fixed values: embedding (texts in a call, characters of a text, seconds before tries anew, queries remembered) ---
BATCH, EMBED_CHARS, RETRY_PAUSE, QUERY_CACHE = 32, 12288, (1.5, 3.0), 256

# --- fixed values: seconds until a background sync counts as running; seconds until a lock is stale ---
SYNC_GRACE, STALE_LOCK = 20.0, 300

# --- fixed values: notes ---
NOTE_TYPES = ("decision", "feature", "api", "bug", "deployment", "implementation", "design", "session")
MIN_NOTE, MAX_NOTE = 40, 8000
STALE_TYPES, STALE_DAYS = ("deployment", "bug", "api"), 90

# --- fixed values: discovery ---
IGNORED_DIRS = (
    "node_modules", ".git", ".svn", ".hg", "dist", "build", "out", "target", "bin", "obj", "coverage", "htmlcov", ".cache",
    ".parcel-cache", ".turbo", ".next", ".nuxt", ".svelte-kit", ".venv", "venv", "env", "__pycache__", ".pytest_cache",
    ".mypy_cache", ".ruff_cache", ".tox", ".idea", ".vscode", ".gradle", "vendor", "Pods", ".terraform", "site-packages",
    ".uv-cache", ".uv-python",
)
IGNORED_FILES = (
    "eval.yaml", ".env", ".env.local", ".env.development", ".env.production", ".env.test", ".npmrc", ".pypirc", ".netrc", "id_rsa",
    "id_ed25519", "id_ecdsa", "credentials", "credentials.json", "service-account.json", ".htpasswd", "package-lock.json",
    "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "poetry.lock", "uv.lock", "Pipfile.lock", "Cargo.lock", "composer.lock",
    "Gemfile.lock", "go.sum", ".DS_Store",
)
IGNORED_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".bmp", ".tiff", ".avif", ".mp4", ".mov", ".avi", ".mkv", ".webm", ".mp3",
    ".wav", ".flac", ".ogg", ".pdf", ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar", ".woff", ".woff2", ".ttf", ".otf", ".eot",
    ".exe", ".dll", ".so", ".dylib", ".bin", ".obj", ".o", ".a", ".lib", ".pyc", ".pyo", ".class", ".jar", ".wasm", ".db", ".sqlite",
    ".sqlite3", ".mdb", ".svg", ".map", ".pack", ".idx", ".pem", ".key", ".pfx", ".p12", ".jks", ".keystore", ".asc", ".gpg", ".kdbx",
)
IGNORED_SUFFIXES = (".min.js", ".min.css", ".bundle.js", "_pb2.py", "_pb2_grpc.py", ".generated.ts", ".g.dart")
MAX_FILE, PROBE = 1572864, 8192
#: extension: (chunker, grammar, language)
LANGUAGES = {
    ".py": ("code", "python", "python"), ".pyi": ("code", "python", "python"), ".ts": ("code", "typescript", "typescript"),
    ".mts": ("code", "typescript", "typescript"), ".cts": ("code", "typescript", "typescript"), ".tsx": ("code", "tsx", "typescript"),
    ".js": ("code", "javascript", "javascript"), ".mjs": ("code", "javascript", "javascript"), ".cjs": ("code", "javascript", "javascript"),
    ".jsx": ("code", "javascript", "javascript"), ".go": ("code", "go", "go"), ".rs": ("code", "rust", "rust"), ".java": ("code", "java", "java"),
    ".cs": ("code", "csharp", "csharp"), ".rb": ("code", "ruby", "ruby"), ".php": ("code", "php", "php"), ".c": ("code", "c", "c"),
    ".h": ("code", "cpp", "c"), ".cpp": ("code", "cpp", "cpp"), ".hpp": ("code", "cpp", "cpp"), ".sql": ("code", "sql", "sql"),
    ".sh": ("code", "bash", "shell"), ".bash": ("code", "bash", "shell"), ".css": ("code", "css", "css"), ".scss": ("code", "scss", "css"),
    ".html": ("code", "html", "html"), ".vue": ("text", None, "vue"), ".svelte": ("text", None, "svelte"), ".md": ("docs", None, "markdown"),
    ".mdx": ("docs", None, "markdown"), ".rst": ("docs", None, "rst"), ".txt": ("docs", None, "text"), ".adoc": ("docs", None, "asciidoc"),
    ".yaml": ("text", None, "yaml"), ".yml": ("text", None, "yaml"), ".json": ("text", None, "json"), ".toml": ("text", None, "toml"),
    ".ini": ("text", None, "ini"), ".example": ("text", None, "dotenv"), ".tf": ("text", None, "terraform"),
    ".dockerfile": ("text", None, "dockerfile"), ".graphql": ("text", None, "graphql"), ".prisma": ("text", None, "prisma"),
}
#: (pattern over the name, or over the path if it holds a slash; type), first match wins
DOC_TYPES = (
    ("readme*", "readme"), ("changelog*", "changelog"), ("contributing*", "guide"), ("adr-*", "adr"), ("*/adr/*", "adr"),
    ("*/decisions/*", "adr"), ("openapi*", "openapi"), ("swagger*", "openapi"), ("*schema*.sql", "schema"), ("*/docs/*", "guide"),
    ("*.md", "guide"),
)

# --- fixed values: secrets ---
TOKEN_PATTERNS = (
    r"\b(A3T[A-Z0-9]|AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16}\b",
    r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{22,}\b",
    r"\bsk-(?:proj-|svcacct-)?[A-Za-z0-9_-]{20,}\b",
    r"\bsk-ant-[A-Za-z0-9_-]{20,}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    r"\b[sr]k_live_[A-Za-z0-9]{20,}\b",
    r"\bAIza[A-Za-z0-9_-]{35}\b",
    r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b",
)
#: a text without any of these words holds no match of the pattern in the same place
TOKEN_HINTS = (("A3T", "AKIA", "ASIA", "ABIA", "ACCA"), ("gh",), ("github_pat_",), ("sk-",), ("sk-ant-",), ("xox",), ("k_live_",), ("AIza",), ("eyJ",))
SECRET_NAMES = r"secret|passwd|password|api[_-]?key|access[_-]?key|auth[_-]?token|private[_-]?key|client[_-]?secret"
SECRET_ASSIGNMENT = rf"(?i)\b([A-Z0-9_.-]*(?:{SECRET_NAMES})[A-Z0-9_.-]*)(\s*[:=]\s*|\s*=>\s*)([\"'])([^\"'\n]{{8,}})\3"
KEY_BOUNDARY = r"-----(BEGIN|END) [A-Z0-9 ]*PRIVATE KEY( BLOCK)?-----"
MASK = "[REDACTED]"
