"""Language and role of a file, from its path (and first line), as ordered rules: the first that holds wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename

#: directories whose files are never part of a corpus (fixed values)
IGNORED_DIRS = [".git", ".hg", ".svn", ".venv", "venv", "__pycache__", "node_modules", "dist", "build", "target", ".pytest_cache", ".ruff_cache", ".clj-kondo", ".dart_tool", ".yarn", ".gradle", ".next", ".svelte-kit", "spec-output", "vendor"]

#: language -> file suffixes (fixed values)
SUFFIXES = {
    "python": ["py"], "java": ["java"], "groovy": ["groovy"], "kotlin": ["kt"], "scala": ["scala"], "scala-build": ["sbt"], "swift": ["swift"],
    "typescript": ["ts", "tsx", "mts"], "javascript": ["js", "jsx", "cjs", "mjs"], "glimmer-js": ["gjs"], "vue": ["vue"], "svelte": ["svelte"], "astro": ["astro"],
    "go": ["go"], "rust": ["rs"], "csharp": ["cs"], "razor": ["cshtml", "razor"], "xaml": ["xaml", "axaml"], "msbuild": ["csproj", "fsproj"],
    "php": ["php", "inc", "module", "install", "profile", "theme"], "ruby": ["rb", "rake", "gemspec"], "elixir": ["ex", "exs"], "erlang": ["erl"], "clojure": ["clj", "cljs", "cljc", "edn"],
    "dart": ["dart"], "c": ["c", "h"], "cpp": ["cpp", "cc", "hpp"], "lua": ["lua"], "r": ["r"], "julia": ["jl"], "perl": ["pl", "pm"], "shell": ["sh", "bash", "zsh"],
    "powershell": ["ps1"], "batch": ["bat", "cmd"], "sql": ["sql"], "prisma": ["prisma"], "graphql": ["graphql", "graphqls", "gql"], "protobuf": ["proto"],
    "html": ["html", "htm"], "css": ["css"], "scss": ["scss"], "sass": ["sass"], "less": ["less"], "jsp": ["jsp"], "erb": ["erb"], "haml": ["haml"], "twig": ["twig"],
    "ejs": ["ejs"], "pug": ["pug"], "handlebars": ["hbs", "handlebars"], "mustache": ["mustache"], "liquid": ["liquid"], "markdown": ["md", "mdx"], "rst": ["rst"],
    "text": ["txt"], "json": ["json"], "yaml": ["yml", "yaml"], "toml": ["toml"], "xml": ["xml"], "ini": ["ini", "cfg"], "properties": ["properties"], "csv": ["csv"],
    "terraform": ["tf", "tfvars"], "hcl": ["hcl"], "nix": ["nix"], "notebook": ["ipynb"], "image": ["png", "jpg", "jpeg", "gif", "webp", "svg", "ico", "bmp", "avif"], "font": ["woff", "woff2", "ttf", "otf", "eot"],
    "archive": ["zip", "gz", "xz", "jar", "war"], "media": ["mp4", "mp3", "ogg", "mov", "webm"], "lock": ["lock"], "patch": ["patch", "diff"], "template": ["tpl", "tmpl"],
}

#: language by a pattern over the lower-cased base name, tried before the suffixes (fixed values)
NAMES = [
    ("env", r"^\.env"), ("gitignore", r"^\.gitignore$"), ("dockerignore", r"^\.dockerignore$"), ("gitmodules", r"^\.gitmodules$"), ("marker", r"^\.gitkeep$"),
    ("backup", r"~$"), ("apache-config", r"htaccess$"), ("dockerfile", r"^dockerfile"), ("makefile", r"^makefile"), ("ruby", r"^(gemfile|rakefile|capfile|config\.ru)$"),
    ("go-mod", r"^go\.(mod|sum)$"), ("groovy", r"^jenkinsfile$"),
]

#: language by the first line of a file without a known suffix (fixed values)
SHEBANGS = [("ruby", "ruby"), ("php", "php"), ("python", "python"), ("javascript", "node|deno|bun"), ("shell", "sh|bash|zsh|ksh|fish")]

#: (role, pattern over the lower-cased path); first match wins, ``source`` if none (fixed values)
ROLES = [
    ("generated", r"\.(map|wasm|tfstate|tfstate\.backup|enc|bak|orig|save|swo|swp|snap|mo)$|(^|/)(secrets?|\.keep|\.gitkeep)$|~$|\.(min|bundle|chunk)\.js$|(\.pb\.(go|ts|js)|_pb2(_grpc)?\.py)$|\.generated\.[jt]sx?$|\.(g|freezed|gr)\.dart$|(^|/)main\.[^/]*\.dart\.js$|(^|/)[0-9a-f]{6,}-[^/]+hmr\.js$|^[a-z0-9_]+/output\.js$|/deps/output\.js$|/(public/build|public/canvaskit|build/generated|generated|coverage|storybook-static)/|^(generated|coverage|storybook-static)/"),
    ("test", r"^(tests?|spec|features|molecule|e2e|playwright)/|/(tests?|spec|molecule|e2e|playwright)/|(^|/)(__tests__|__mocks__|__testfixtures__|testfixtures|test-fixtures|testutils|test-utils)(/|$)|/src/(androidtest|test[a-z0-9_-]*)/|^src/(androidtest|test[a-z0-9_-]*)/|^(test_[^/]*|[^/]*_tests?\.py)$|_test\.(go|rs|exs|rb|php|cs|tsx?|jsx?)$|_spec\.(rb|php)$|\.(test|spec|e2e)\.([jt]sx?|[mc]js)$|test[-_]cases[^/]*$|\.tftest\.hcl$|\.feature$|^\.astro/test_"),
    ("sample", r"(^|/)(fixtures?|__fixtures__|fakes|testdata|snapshots|__snapshots__|bench|benchmarks?|benchmark-[^/]*|evals|examples|\.storybook|storybook-?utils)(/|$)|\.(eml|response|sample)$|\.stories\.([jt]sx?|[mc]js)$|/create-woo-extension/variants/"),
    ("documentation", r"(^|/)src/main/webapp/help/.*\.html$|(^|/)src/main/resources/(.*/)?help([-_][^/]*)?\.html$"),
    ("config", r"(^|/)(package\.json|pyproject\.toml|requirements\.txt|setup\.(py|cfg)|pom\.xml|build\.gradle(\.kts)?|settings\.gradle(\.kts)?|cargo\.toml|go\.mod|go\.sum|composer\.json|gemfile|mix\.exs|pubspec\.yaml|deps\.edn|project\.clj|package\.swift|dockerfile[^/]*|docker-compose[^/]*\.ya?ml|compose\.ya?ml|makefile|capfile|procfile(\.tunnel)?|unicorn_launcher|terragrunt\.hcl|application\.(properties|ya?ml)|appsettings[^/]*\.json|web\.xml|\.?env[^/]*)$|(^|/)\.env[^/]*$|(^|/)(ts|js)config[.\w-]*\.json$|(^|/)\.(eslintrc\.(json|js|cjs)|stylelintrc\.json)$|\.(config|conf)\.[jt]s$|\.config\.[mc]js$|\.(csproj|config|sbt|dist|production-sample|gitignore|template|tunnel|engine|make|sublime-project|tf|tfvars|tfvars\.json|tofu|pkr\.hcl)$|htaccess$|^\.github/workflows/|(^|/)pulumi\.[^./]+\.ya?ml$|(^|/)(ansible\.cfg|galaxy\.yml|dbt_project\.yml|dagster\.yaml|great_expectations\.yml|prefect\.ya?ml)$"),
    ("data-layer", r"\.sql$|schema\.prisma$|mapper\.xml$"),
    ("notebook", r"\.ipynb$"),
    ("api", r"\.(proto|graphqls?|gql)$|(^|/)conf/routes$"),
    ("style", r"\.(css|scss|sass|less)$|(^|/)styles/"),
    ("frontend-page", r"\.(html?|ftl|hbs|handlebars|mustache|ejs|pug|twig|haml|liquid|erb|rsb|builder|ruby|cshtml|razor|xaml|axaml|blade\.php|scala\.html|jsp)$|(^|/)(routes|pages)/.*\.(svelte|dart|vue|swift)$"),
    ("source", r"\.(svelte|dart|vue|swift)$"),
    ("asset", r"^(public|static|assets)/|/src/main/resources/(static|templates)/|^src/main/resources/(static|templates)/|/assets/|\.(zip|xz|gz|war|jar|mp4|mp3|ogg|mov|mkv|webm|flac|xlsx|sqlite|db|crt|pem|key|p8|eot|woff2?|ttf|otf|png|jpe?g|gif|webp|svgz?|avif|tiff?|bmp|heic|ico|mmdb|pdf|docx|odt|rtf|ps|crx|bin|dat)$"),
    ("documentation", r"\.(vtt|dfxp|log|po|pot|xlf|xliff|mdx?|rdoc|rst|me|textile)$|^docs?/|(^|/)(license|readme)\.[^/]*$"),
    ("api", r"/controller|^controller[^/]*/|controller\.(java|scala)$"),
    ("data-model", r"/model|/entity|entity\.java$"),
    ("repository", r"/repository|repository\.java$"),
    ("service", r"/service|service\.java$"),
    ("webapp", r"(^|/)src/main/webapp/"),
    ("entrypoint", r"(^|/)(main\.py|cli\.py|index\.[jt]s|artisan)$"),
]


def ladder(rules: list[tuple[str, str]], c: Column, default: Column) -> Column:
    """The first label whose pattern is found in ``c``."""
    return F.coalesce(*[F.when(c.rlike(p), F.lit(x)) for x, p in rules], default)


def language_of(path: Column, first_line: Column | None = None) -> Column:
    name = F.lower(basename(path))
    by_suffix = F.create_map(*[F.lit(x) for lang, all_ in SUFFIXES.items() for s in all_ for x in (s, lang)])
    suffix = F.when(name.contains("."), F.element_at(F.split(name, r"\."), -1)).otherwise("")
    last = F.lit("unknown") if first_line is None else F.coalesce(*[F.when(first_line.rlike(rf"^#!.*\b({p})"), F.lit(x)) for x, p in SHEBANGS], F.when(first_line.startswith("#!"), F.lit("script")), F.lit("unknown"))
    return ladder(NAMES, name, F.coalesce(by_suffix[suffix], last))


def role_of(path: Column) -> Column:
    return ladder(ROLES, F.lower(path), F.lit("source"))


def kept_path(path: Column) -> Column:
    """Whether no directory of the path is ignored."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in IGNORED_DIRS]))


def classify(files: DataFrame) -> DataFrame:
    """files (path, content[, size_bytes]) -> path, language, role, size_bytes, content; ignored directories left out."""
    first = F.substring_index(F.substring("content", 1, 200), "\n", 1)
    size = F.col("size_bytes") if "size_bytes" in files.columns else F.octet_length("content").cast("long")
    kept = files.filter(kept_path(F.col("path")))
    return kept.select("path", language_of(F.col("path"), first).alias("language"), role_of(F.col("path")).alias("role"), size.alias("size_bytes"), "content")
