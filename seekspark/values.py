"""Constants, weights and word lists on which search results depend."""

# Reciprocal rank fusion and the factors of re-ranking.
RRF_K = 60
STRATEGY_WEIGHTS = {"vector": 1.0, "fts": 0.8, "ast": 0.9, "path": 0.7, "dependency": 0.6}
PATH_BOOST = {"directory": 1.5, "filename": 1.4, "partial": 1.2}
IMPORT_FACTOR, TEST_FACTOR, SNIPPET_FACTOR, LITERAL_FACTOR, API_FACTOR = 0.5, 0.65, 0.75, 0.7, 1.12
FILE_FACTORS = (1.0, 0.9, 0.8, 0.7)
SNIPPET_LINES, SNIPPET_CHARS = 3, 200
TEST_PATH = r"(^|/)(tests|__tests__)(/|$)|(^|/)[^/]*\.(test|spec)\.[cm]?[jt]sx?$"

# Scores of symbol matches, of path matches and of steps in the dependency graph.
SYMBOL_SCORES = {"exact": 1.0, "prefix": 0.8, "fuzzy": 0.5}
PATH_SCORES = {"directory": 1.0, "filename": 0.9, "partial": 0.7}
DEPTH_START, DEPTH_STEP = 1.0, 0.2

# BM25.
BM25_K1, BM25_B, LEAST_IDF = 1.2, 0.75, 1e-6

# Chunks.
MAX_TOKENS, MERGE_TOKENS, TOKENS_PER_WORD = 500, 50, 1.3
CLASS_TYPES = ("function", "method", "class", "type", "import")

# Query classes.
MULTIPLIERS = {
    "path": {"path": 2.0, "ast": 0.5},
    "symbol": {"ast": 1.5, "vector": 0.5},
    "natural_language": {"vector": 1.5, "path": 1.2, "ast": 0.7},
    "keyword": {},
}
PATH_QUERY = r"/|\.(ts|tsx|js|jsx|mjs|cjs|py|go|rs|java|kt|swift|rb|php|cs|cpp|c|h|hpp|json|yaml|yml|toml|md|sql|sh|bash)$"
SYMBOL_QUERY = r"^([a-z][a-zA-Z0-9]*|[A-Z][a-zA-Z0-9]*|[a-z]+(_[a-z]+)+|[A-Z]+(_[A-Z]+)*)$"
QUESTION_WORDS = "how what where why when which show explain find list".split()
PHRASE_WORDS = "the a an is are was were do does did to for of in on with by and or".split()
SYMBOL_NAMES = r"[A-Z]?[a-z]+(?:[A-Z][a-z]+)*|[a-z]+(?:_[a-z]+)+|[A-Z][a-zA-Z]+"

# Terms of questions: words without search value, word stems, suffixes.
STOP_WORDS = (
    "how does what where when why which who whom "
    "is are was were be been being do did doing done "
    "the a an and or not no nor in on at to for of with by from about into through between after before during "
    "it its this that these those i me my we our you your he she they "
    "can could should would will shall may might has have had having "
    "find show get tell look give list explain "
    "all any some each every much many also just like then there here very really use used using"
).split()
STEMS = {
    "authentication": "auth",
    "authorization": "auth",
    "configuration": "config",
    "initialization": "init",
    "initialize": "init",
    "initializing": "init",
    "implementation": "impl",
    "implements": "impl",
    "implementing": "impl",
    "dependency": "dep",
    "dependencies": "dep",
    "middleware": "middleware",
    "validation": "valid",
    "validator": "valid",
    "serialize": "serial",
    "serialization": "serial",
    "deserialize": "deserial",
    "database": "db",
    "logging": "log",
    "logger": "log",
    "testing": "test",
    "handler": "handle",
    "handling": "handle",
    "callback": "callback",
    "subscriber": "subscribe",
    "subscription": "subscribe",
    "rendering": "render",
    "renderer": "render",
    "transformer": "transform",
    "transformation": "transform",
    "connection": "connect",
    "connecting": "connect",
    "connector": "connect",
    "migrating": "migrate",
    "migration": "migrate",
    "scheduling": "schedule",
    "scheduler": "schedule",
    "parsing": "parse",
    "parser": "parse",
    "routing": "route",
    "router": "route",
    "indexing": "index",
    "indexer": "index",
    "subscribing": "subscribe",
}
SUFFIXES = "tion sion ment ness ing er or able ible ity ous ive ful less ly".split()
CODE_NAME = r"^(?:[a-z]+(?:[A-Z][a-z]*)+|[A-Z][a-zA-Z]+|[a-z]+(?:_[a-z]+)+|[A-Z]+(?:_[A-Z]+)+)$"

# Files.
LANGUAGES = {
    ".ts": "typescript",
    ".tsx": "typescript",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".py": "python",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
    ".rb": "ruby",
    ".php": "php",
    ".swift": "swift",
    ".kt": "kotlin",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".hpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".json": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".toml": "toml",
    ".md": "markdown",
    ".mdx": "markdown",
    ".env": "env",
}
PARSED_LANGUAGES = ("typescript", "javascript", "python")
IGNORED = (
    "node_modules .git dist build *.lock package-lock.json *.png *.jpg *.jpeg *.gif *.webp *.ico *.bmp *.svg *.woff *.woff2 *.ttf *.eot "
    "*.mp3 *.mp4 *.wav *.avi *.mov *.zip *.tar *.gz *.rar *.7z *.pdf *.exe *.dll *.so *.dylib *.o *.a *.wasm *.pyc *.class"
).split()
UNWATCHED_FOLDERS = "node_modules .git .ctx dist build __pycache__".split()
DEBOUNCE_MS = 500

# Embedding and steering.
EMBEDDING_SIZE, EMBED_BATCH, COMMIT_BATCH = 384, 128, 128
CHARS_PER_TOKEN, DOLLARS_PER_MILLION = 4, 0.15
PROVIDERS = {"gemini": "CTX_GEMINI_KEY", "openai": "CTX_OPENAI_KEY", "anthropic": "CTX_ANTHROPIC_KEY"}
EMBEDDERS = ("local", "voyage", "openai")
