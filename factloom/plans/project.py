"""The whole analysis of one corpus: files to fact tables, relations, gaps, claims and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators import pages as P
from ..operators import relate as R
from ..operators.handlers import all_contract_details
from ..operators.trees import TREE_LABELS, spec_routes, tree_facts, written_nodes
from ..operators.wrappers import resolved_api_calls
from ..operators.link import link_calls
from ..functions.text import normalize_path
from ..operators.ordered import first_wins
from ..sources.tables import stored

#: (kind, path pattern, content pattern, command) of entrypoints (fixed values)
ENTRYPOINTS = [
    ("python-main", r"(^|/)(main|cli|__main__)\.py$", None, None), ("django-manage", r"(^|/)manage\.py$", "django", "python manage.py runserver"), ("django-wsgi", r"(^|/)wsgi\.py$", "get_wsgi_application", None), ("django-asgi", r"(^|/)asgi\.py$", "get_asgi_application", None),
    ("go-main", r"\.go$", r"(?m)^package main\b[\s\S]*^func main\(", "go run ."), ("cargo-main", r"(^|/)src/main\.rs$", None, "cargo run"), ("spring-boot", r"\.(java|kt)$", "@SpringBootApplication", None), ("dotnet", r"(^|/)Program\.cs$", None, "dotnet run"),
    ("laravel-artisan", r"(^|/)artisan$", None, "php artisan"), ("symfony-console", r"(^|/)bin/console$", None, "php bin/console"), ("rack", r"(^|/)config\.ru$", None, "rackup"), ("swiftui-app", r"\.swift$", r"@main\s+struct\s+\w+\s*:\s*App", None), ("clojure-main", r"\.clj$", r"\(:gen-class", None),
    ("streamlit-app", r"\.py$", r"(?m)^import streamlit\b", "streamlit run"), ("gradio-app", r"\.py$", r"(?m)^import gradio\b", None), ("dash-app", r"\.py$", r"\bDash\(__name__", None), ("nextjs", r"(^|/)next\.config\.[cm]?[jt]s$", None, "next dev"), ("vite", r"(^|/)vite\.config\.[cm]?[jt]s$", None, "vite"),
    ("nestjs-entrypoint", r"(^|/)main\.ts$", r"NestFactory", None), ("node-app", r"(^|/)(server|app|index)\.[jt]s$", r"\.listen\(", None), ("docker", r"(^|/)Dockerfile$", r"(?m)^(CMD|ENTRYPOINT)\b", "docker build ."),
]


def entrypoints(files: DataFrame) -> DataFrame:
    """path, kind, command; a file may be several kinds."""
    usable = files.filter(~F.col("role").isin("test", "sample", "generated") & F.col("content").isNotNull())
    found = F.array(*[F.when(F.col("path").rlike(p) & (F.col("content").rlike(c) if c else F.lit(True)), F.struct(F.lit(k).alias("kind"), F.lit(cmd).cast("string").alias("command"))) for k, p, c, cmd in ENTRYPOINTS])
    code = usable.select("path", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("e")).select("path", "e.kind", "e.command")
    manifest = usable.filter(F.col("path").rlike(r"(^|/)package\.json$"))
    bin_ = F.from_json(F.get_json_object("content", "$.bin"), "map<string,string>")
    return code.unionByName(manifest.select("path", F.explode(F.map_keys(bin_)).alias("command")).select("path", F.lit("node-bin").alias("kind"), "command"))


def commands(files: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """path, name, description: commands defined in code, and scripts of package.json."""
    code = X.named(files, "command", raw=raw).select("path", "name", F.col("detail").alias("description"))
    manifest = files.filter(F.col("path").rlike(r"(^|/)package\.json$") & ~F.col("role").isin("test", "sample", "generated"))
    scripts = F.from_json(F.get_json_object("content", "$.scripts"), "map<string,string>")
    return first_wins(code.unionByName(manifest.select("path", F.explode(scripts).alias("name", "description"))), ["path", "name"], ["description"])


def project_facts(files: DataFrame) -> dict[str, DataFrame]:
    """Every fact table of a classified corpus (see ``classify``), lazily; the order of producers doesn't matter.

    The rules scan the files once; the classified files, their matches, and the tables that many others read, are stored.
    """
    files = stored(files, "files")
    raw = stored(X.extract(files), "matches")
    f: dict[str, DataFrame] = {"files": files.drop("content")}
    f["languages"] = files.groupBy("language").agg(F.count("*").alias("n"))
    f["dependencies"], f["imports"], f["symbols"] = stored(X.dependencies(files, raw), "dependencies"), stored(X.named(files, "import", raw=raw), "imports"), stored(X.named(files, "symbol", raw=raw), "symbols")
    f["frameworks"] = X.frameworks(f["dependencies"], f["imports"])
    f["entrypoints"], f["commands"] = stored(entrypoints(files), "entrypoints"), stored(commands(files, raw), "commands")
    nodes = written_nodes(files)
    routes = X.api_routes(files, raw)
    f["routes"], f["calls"] = stored(routes.unionByName(spec_routes(nodes).select(*routes.columns)), "routes"), stored(resolved_api_calls(files, raw), "calls")
    for name, family in (("components", "component"), ("states", "state"), ("frontend_routes", "frontend-route"), ("repositories", "repository"), ("services", "service"), ("data_layer", "data-layer"), ("runtime", "runtime"), ("servlets", "servlet")):
        f[name] = X.named(files, family, raw=raw)
    in_trees = tree_facts(nodes).filter("family = 'runtime'").drop("family", "doc")
    f["runtime"] = stored(f["runtime"].filter(~F.col("kind").isin(*TREE_LABELS)).unionByName(in_trees, allowMissingColumns=True), "runtime")
    f["models"] = stored(X.data_models(files, raw), "models")
    by_file = X.file_route(F.col("path"), "frontend")
    paged = files.filter("role not in ('test', 'sample', 'generated')").withColumn("r", by_file).filter("r is not null")
    f["frontend_routes"] = f["frontend_routes"].select("path", "kind", "name", "line").unionByName(paged.select("path", F.col("r.label").alias("kind"), F.col("r.route").alias("name"), F.lit(1).alias("line")))
    f["pages"] = files.filter("language in ('html', 'jsp') and role not in ('test', 'sample', 'generated')").select("path", page_route(F.col("path")).alias("route"))
    f["forms"], f["assets"], f["styles"] = P.form_facts(files), P.asset_facts(files), P.style_facts(files)
    calls = f["calls"].select(F.xxhash64("path", "line", "endpoint", "method").alias("call_id"), F.col("path").alias("source"), "endpoint", "method", "client")
    names = raw.filter("family = 'route-name' and detail is not null").groupBy(F.upper("verb").alias("method"), normalize_path(F.col("subject")).alias("path"), F.col("path").alias("file")).agg(F.min("detail").alias("route_name"))
    routes = f["routes"].withColumn("file", F.col("evidence.file")).join(names, ["method", "path", "file"], "left").select(F.xxhash64("method", "path", "framework", "handler").alias("route_id"), "method", "path", "framework", "handler", "route_name")
    f["links"] = stored(link_calls(calls, routes), "links")
    targets = R.union_all([f[k].select(F.lit(kind).alias("kind"), "name", F.lit(o).cast("long").alias("ord")) for o, (k, kind) in enumerate((("components", "component"), ("services", "service"), ("repositories", "repository"), ("models", "data-model"), ("commands", "cli-command")))]).filter("name is not null").distinct()
    f["test_maps"] = stored(R.test_maps(files, f["routes"], stored(targets, "targets")), "test-maps")
    f["boundary_paths"], f["issues"] = stored(R.module_boundaries(f), "boundaries"), X.parse_issues(files)
    f["boundaries"] = R.boundary_counts(f["boundary_paths"])
    f["surfaces"] = R.surfaces(f["routes"], f["services"], f["models"])
    f["features"] = R.feature_maps(f["links"], f["routes"], f["commands"], f["entrypoints"])
    f["contracts"] = stored(R.contracts(f["routes"].select("method", "path", "framework"), all_contract_details(files, f["routes"], raw)), "contracts")
    f["contract_gaps"] = stored(R.contract_gaps(f["contracts"], R.unmatched_calls(f["links"]), R.unlinked_routes(f["routes"], f["links"])), "contract-gaps")
    f["large_files"] = R.large_files(files)
    f["quality"] = stored(R.quality(f), "quality")
    f["gaps"] = stored(R.detect_gaps(gap_counts(f), f["issues"]), "gaps")
    f["gap_evidence"] = R.gap_evidence(f, f["gaps"])
    f["findings"] = stored(R.refactor_findings(f), "findings")
    f["claims"] = R.trace_claims(f)
    return f


def page_route(path: Column) -> Column:
    """Where a page file is served: its path without public folders, suffix and index."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^(.*/)?(public|static|www|webapp|templates)/", ""), r"(^|/)index\.\w+$|\.\w+$", "")
    return F.concat(F.lit("/"), F.regexp_replace(bare, "^/+", ""))


def gap_counts(f: dict[str, DataFrame]) -> DataFrame:
    """The one row of counts that the gap rules look at."""
    served = f["links"].filter("matched_route is not null").select(F.col("matched_method").alias("method"), F.col("matched_route").alias("path"))

    def n(df: DataFrame, name: str, cond: str = "true") -> DataFrame:
        return df.agg(F.count_if(F.expr(cond)).alias(name))

    parts = [
        n(f["files"], "unknown_language", "language = 'unknown'"), n(f["files"], "tests", "role = 'test'"), n(f["files"], "sources", "role in ('source','api','asset','data-model','entrypoint','frontend-page','repository','service','style','webapp')"),
        n(f["entrypoints"], "entrypoints"), n(f["dependencies"], "dependencies"), n(f["pages"], "pages"), n(f["forms"], "forms"), n(f["links"], "links"), n(f["routes"], "routes"), n(f["models"], "models_without_fields", "size(fields) = 0"), n(f["frontend_routes"], "frontend_routes"),
        n(f["styles"], "styles"), n(f["states"], "states"), n(R.unmatched_calls(f["links"]), "unmatched_calls"), n(f["routes"].join(served, ["method", "path"], "left_anti"), "uncalled_routes"), n(f["contracts"], "unknown_contracts", "size(request_hints) = 0 or size(response_hints) = 0 or size(status_codes) = 0"), n(f["test_maps"], "unmapped_tests", "target is null"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out
