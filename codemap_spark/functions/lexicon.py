"""Word lists, weights and names that results depend on."""

SHORT_TECH = "ai api css db go js mcp php py sql ts ui".split()
NOISE = (
    "capire codice code file progetto project repo repository skill usando "
    "a after and are before che come con da del della di does dopo dove for from ha handle how il in is la le lo non not of on per perche "
    "perché prima questa questo se the to un una when where with why"
).split()
TRACE_STOP = (
    "a ad al alla allo anche bug che con da dal dei del fix errore error issue problem problema non di e il in la lo nel nella un una the and for from "
    "how is of to with della dello delle come viene"
).split()
LANGUAGES = {
    ".py": "python", ".php": "php", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript",
    ".tsx": "typescript", ".json": "json", ".toml": "toml", ".yaml": "yaml", ".yml": "yaml", ".md": "markdown", ".rst": "restructuredtext",
    ".html": "html", ".css": "css", ".scss": "scss", ".sql": "sql", ".sh": "shell", ".bat": "batch", ".ps1": "powershell", ".go": "go", ".rs": "rust",
}
ASSET_SUFFIXES = ".png .jpg .jpeg .gif .webp .svg .ico .pdf .zip .gz .woff .woff2 .ttf".split()
CONFIG_NAMES = "pyproject.toml package.json composer.json tsconfig.json vite.config.js webpack.config.js dockerfile .env .gitignore".split()
SOURCE_SUFFIXES = ".py .php .js .jsx .ts .tsx .sql .sh .go .rs".split()
TEST_PARTS = "test tests testing __tests__".split()
RATING_WEIGHTS = {"crucial": 24.0, "useful": 10.0, "neutral": 0.0, "noisy": -3.0, "missing": 8.0}
SOURCE_WEIGHTS = {"agent": 1.0, "benchmark": 1.1, "user": 1.2}
MIN_SIMILARITY, MAX_BOOST, MAX_PENALTY = 0.25, 30.0, -5.0
TEST_AWARE = "test tests unittest pytest coverage spec assertion fixture".split()
UI_INTENT = "css style stile layout design ui frontend colore colori".split()
DB_INTENT = "sql migration migrations database db tabella schema".split()
DOCS_INTENT = "readme docs documentazione guida".split()
EXAMPLE_INTENT = "example examples demo sample tutorial playground".split()
EXAMPLE_PARTS = "example examples demo demos sample samples playground".split()
EXCLUDED_DIRS = (
    ".git .github .agent .agents .codex .cursor .vscode .idea .history .cache .pytest_cache .mypy_cache .ruff_cache .tox .nox .turbo .parcel-cache "
    "node_modules vendor dist build out target .venv venv env .env __pycache__ .next .nuxt .svelte-kit storage cache coverage htmlcov logs tmp temp"
).split()
EXCLUDED_FILES = ".DS_Store Thumbs.db desktop.ini".split()
EXCLUDED_SUFFIXES = ".png .jpg .jpeg .gif .webp .svg .ico .ai .pdf .zip .tar .gz .rar .7z .mp4 .mov .mp3 .wav .woff .woff2 .ttf .eot .sqlite .db".split()
MANIFESTS = "pyproject.toml package.json composer.json go.mod Cargo.toml Gemfile pom.xml build.gradle Makefile docker-compose.yml docker-compose.yaml compose.yml compose.yaml".split()
ENTRY_FILES = "__main__.py main.py app.py server.py cli.py manage.py wsgi.py asgi.py index.php index.js index.ts main.go main.rs lib.rs".split()
ENTRY_PARTS = "cli server router routers routes api app main cmd bin".split()
OVERVIEW_CONFIGS = ".env.example Dockerfile tsconfig.json vite.config.js vite.config.ts webpack.config.js next.config.js eslint.config.js ruff.toml".split()
TAG_WEIGHTS = {"path": 1.0, "filename": 1.3, "language": 0.6, "role": 0.6, "symbol": 1.2, "symbol_kind": 0.5, "relation": 0.8, "relation_target": 1.0}
README_NAMES = "README.md README.rst README.txt readme.md readme.rst readme.txt".split()
FIRST_MANIFESTS = "pyproject.toml package.json composer.json go.mod Cargo.toml".split()
ENTRY_NAMES = "main app application server serve cli run".split()
FRAMEWORK_COMMANDS = "cli command commands management server api".split()
FRAMEWORK_ROUTES = "routing routes urls".split()
FRAMEWORK_PARTS = FRAMEWORK_COMMANDS + FRAMEWORK_ROUTES
START_FILES = "index.php main.py __main__.py app.py server.py main.ts main.tsx main.rs".split()
RENDER_TOKENS = "frontend front view render rendering html markup template page pagina visualizzazione titolo title heading".split()
TRACE_DOCS = "doc docs documentazione readme".split()
SERVICE_PARTS = "/orchestrator /controller /handler /router /service".split()
SYMPTOM_WORDS = "bug errore error exception fail fails failing failure regression regressione render rendered response risposta symptom sintomo test tests wrong".split()
GENERAL_PARTS = "base component controller handler http page request response route router template view views".split()
