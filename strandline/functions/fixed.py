"""Word lists, tables, patterns and limits that results depend on, as the formats define them."""

# Words that queries are stripped of before comparison.
QUERY_STOP_WORDS = (
    "a an and are as at be by for from has have i in is it its of on or that the this to was were will with how what when where why who do does did "
    "can could should would shall may might must about into than then over under"
).split()
# Words that full-text terms leave out.
TERM_STOP_WORDS = "a an and are as at be by for from has he in is it its of on that the to was were will with this these those or but not we you".split()
# Words that say nothing in a question.
FILLER_WORDS = (
    "how does the a an is are was were do what where when which who why can could would should will work works working this that these those in of for to "
    "with from by about it its my our be been being have has had get gets getting find show me please i"
).split()
ABBREVIATIONS = {
    "auth": "authentication", "authn": "authentication", "authz": "authorization", "config": "configuration", "cfg": "configuration", "env": "environment", "err": "error",
    "fn": "function", "func": "function", "impl": "implementation", "init": "initialization", "msg": "message", "param": "parameter", "params": "parameters", "req": "request",
    "res": "response", "repo": "repository", "db": "database", "str": "string", "num": "number", "ctx": "context", "util": "utility", "utils": "utilities", "srv": "server",
    "cli": "client", "dir": "directory", "doc": "document", "docs": "documents", "dep": "dependency", "deps": "dependencies",
}
# The full word's abbreviation is the first that stands for it.
CONTRACTIONS = {full: next(a for a, f in ABBREVIATIONS.items() if f == full) for full in ABBREVIATIONS.values()}
TOKENS_PER_LINE = {
    "ts": 5.5, "tsx": 5.5, "js": 5.5, "jsx": 5.5, "python": 4.5, "go": 5.0, "java": 4.5, "rust": 5.0, "csharp": 5.0, "ruby": 4.5, "php": 4.5, "markdown": 3.0, "yaml": 3.0,
    "json": 3.0, "generic": 4.0,
}
LANGUAGE_OF_SUFFIX = {
    "rb": "ruby", "rake": "ruby", "rbs": "ruby", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "mjs": "typescript", "cjs": "typescript",
    "py": "python", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "hh": "cpp", "cxx": "cpp", "cs": "csharp",
    "tf": "terraform", "hcl": "terraform",
}
LANGUAGE_OF_SHEBANG = (("ruby", r"^#!.*\bruby\b"), ("python", r"^#!.*\bpython[0-9.]*\b"), ("typescript", r"^#!.*\b(node|deno|bun)\b"))
# In order of priority.
LANGUAGE_OF_MARKER = (
    ("tsconfig.json", "typescript"), ("package.json", "typescript"), ("Cargo.toml", "rust"), ("go.mod", "go"), ("pyproject.toml", "python"), ("requirements.txt", "python"),
    ("setup.py", "python"), ("pom.xml", "java"), ("build.gradle", "java"), ("Gemfile", "ruby"), ("Rakefile", "ruby"), ("CMakeLists.txt", "cpp"), ("Makefile", "c"),
    (".terraform-version", "terraform"),
)
LANGUAGE_PATTERNS = {
    "ruby": ["**/*.rb", "**/*.rake"],
    "typescript": ["**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx"],
    "javascript": ["**/*.js", "**/*.jsx", "**/*.mjs", "**/*.cjs"],
    "python": ["**/*.py"],
    "go": ["**/*.go"],
    "rust": ["**/*.rs"],
    "java": ["**/*.java"],
    "c": ["**/*.c", "**/*.h"],
    "cpp": ["**/*.cpp", "**/*.hpp", "**/*.cc", "**/*.hh", "**/*.cxx", "**/*.h"],
    "csharp": ["**/*.cs"],
    "terraform": ["**/*.tf", "**/*.hcl"],
    "generic": ["**/*"],
}
LANGUAGE_EXCLUDES = {
    "ruby": "vendor tmp log spec test node_modules .bundle coverage public/packs public/assets storage .byebug_history sig sorbet **/*.rbi".split(),
    "typescript": "node_modules dist .next coverage build .turbo out .cache .vercel .swc *.tsbuildinfo **/*.min.js **/*.min.css **/*.bundle.js **/*.data.ts **/*.data.js".split(),
    "javascript": "node_modules dist coverage build .cache .parcel-cache out .nuxt .output **/*.min.js **/*.min.css **/*.bundle.js".split(),
    "python": "venv __pycache__ .venv .mypy_cache *.egg-info .pytest_cache .tox .coverage htmlcov dist build .ruff_cache .pytype".split(),
    "go": "vendor bin .idea *.test *.out".split(),
    "rust": "target Cargo.lock **/*.rs.bk .cargo".split(),
    "java": "build .gradle target bin .idea .classpath .project .settings *.class *.jar *.war".split(),
    "c": "build cmake-build-* *.o *.so *.a *.exe *.out compile_commands.json".split(),
    "cpp": "build cmake-build-* *.o *.so *.a *.exe *.out compile_commands.json .ccls-cache .clangd".split(),
    "csharp": "bin obj .vs *.user *.suo packages .vscode *.cache".split(),
    "php": "vendor node_modules .phpunit.cache storage/framework/cache storage/logs bootstrap/cache .env".split(),
    "elixir": "_build deps .elixir_ls cover doc *.beam .fetch".split(),
    "scala": "target .bsp .metals .bloop project/target project/project".split(),
    "kotlin": "build .gradle .idea *.iml out bin".split(),
    "swift": ".build .swiftpm DerivedData *.xcodeproj *.xcworkspace Pods".split(),
    "terraform": ".terraform **/*.tfstate **/*.tfstate.* **/*.tfvars **/*.tfvars.json **/*.auto.tfvars **/*.auto.tfvars.json".split(),
    "generic": "node_modules vendor target .git build dist".split(),
}
ROOT_FOLDERS = "src lib app pkg internal cmd packages".split()
NOISE_SYMBOLS = (
    "this self null nil None true false undefined void int float double bool boolean string String number char byte long short var let const return if else for while do switch "
    "case break continue new delete throw try catch finally class struct enum interface type import export from as async await yield static public private protected override "
    "abstract final virtual super extends implements package module require fn func def lambda println printf print fmt log console main init err error ok Ok Err Some Object "
    "Array Map Set List Dict Tuple"
).split()
CODE_SIGNS = (
    r"\bfunction\s+\w", r"\bconst\s+\w", r"\blet\s+\w", r"\bvar\s+\w", r"\bclass\s+\w", r"\bdef\s+\w", r"\bimport\s+", r"\brequire\s*\(", r"=>", r"(?m)[{};]\s*$",
    r"(?m)^\s*#\s*include", r"\bfunc\s+\w", r"\bpub\s+fn\s",
)
QUESTION_SIGNS = (r"(?i)^(how|what|why|where|when|which|can|does|is|are)\b", r"\?$")
TASKS = {
    "bge-code": {
        "nl2code": "Given a web search query, retrieve relevant code that can help answer the query.",
        "code2code": "Given a piece of code, retrieve code that is semantically equivalent to the input code.",
        "techqa": "Given a question that consists of a mix of text and code snippets, retrieve relevant answers that also consist of a mix of text and code snippets, and can help answer the question.",
    },
    "qwen": dict.fromkeys(("nl2code", "code2code", "techqa"), "Given a web search query, retrieve relevant passages that answer the query"),
}
TASK_FORMATS = {"bge-code": "<instruct>{task}\n<query>{query}", "qwen": "Instruct: {task}\nQuery:{query}"}
# Markdown constructs: one of the strong or two kinds of the weak make a text markdown.
MARKDOWN_STRONG = (r"(?m)^ {0,3}#{1,6}(?:\s|$)", r"(?m)^ {0,3}(?:```|~~~)", r"(?m)^ {0,3}\|.*\|")
MARKDOWN_WEAK = (r"(?m)^ {0,3}[-*+]\s+\S", r"(?m)^ {0,3}\d+[.)]\s+\S", r"(?m)^ {0,3}>\s", r"!?\[[^\]]+\]\([^)]+\)", r"(?m)^ {0,3}(?:-{3,}|\*{3,}|_{3,})\s*$")
TICKETS = (("jira", r"\b([A-Z]{2,}-\d+)\b", ""), ("github", r"(?:^|\s)#(\d+)\b", "#"), ("github", r"\b([\w.-]+/[\w.-]+#\d+)\b", ""))
# Limits of stored texts, in characters.
TEXT_LIMITS = {"query_text": 1024, "message": 512, "error": 256, "identity": 256, "embedded": 8192}
# Non-source text: a text of fewer characters is source; a longer line, or denser text, is not.
NON_SOURCE = {"least": 512, "line": 5000, "average_line": 1000, "white_space": 0.02, "base64": 0.95}
BM25_K1, BM25_B = 1.2, 0.75
RRF_K = 60
DUPLICATE, SIMILAR = 0.85, 0.70
MIN_SCORE, PROJECT_BOOST = 0.45, 0.05
REFORMULATION_MS, REFORMULATION_JACCARD = 90_000, 0.3
MAX_FANOUT = 50
CHUNK_SIZE, CHUNK_OVERLAP = 1024, 128
