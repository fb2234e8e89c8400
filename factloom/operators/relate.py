"""Relations over facts: unlinked routes, contracts, features, boundaries, gaps, test maps, claims and differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import feature_name, name_terms, normalize_path, tokens
from ..sources.tables import stored
from .ordered import numbered_within, top_n


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def unlinked_routes(routes: DataFrame, links: DataFrame) -> DataFrame:
    """Routes that no call is linked to, by (method, path) or by ANY on the path."""
    used = links.filter("matched_route is not null").select(F.col("matched_method").alias("method"), F.col("matched_route").alias("path")).distinct()
    return routes.join(used, ["method", "path"], "left_anti")


def unmatched_calls(links: DataFrame) -> DataFrame:
    return links.filter("match_type = 'unmatched' and target_kind = 'backend-route'")


def contracts(routes: DataFrame, hints: DataFrame) -> DataFrame:
    """Routes with the last hints found for (method, path, framework): later rows replace earlier ones. hints: method, path, framework, ord, request_hints, response_hints, status_codes, error_hints."""
    kinds = ["request_hints", "response_hints", "status_codes", "error_hints"]
    last = hints.groupBy("method", "path", "framework").agg(F.max(F.struct("ord", *kinds)).alias("h"))
    empty = F.array().cast("array<string>")
    return routes.join(last, ["method", "path", "framework"], "left").select("method", "path", "framework", *[F.coalesce(f"h.{c}", empty).alias(c) for c in kinds])


def contract_gaps(contract: DataFrame, calls: DataFrame, routes: DataFrame) -> DataFrame:
    """contract, gap_type: up to four for each contract, and one for each unmatched call and unlinked route."""
    name = F.concat_ws(" ", "method", "path")
    kinds = [("request_hints", "unknown-request"), ("response_hints", "unknown-response"), ("status_codes", "unknown-status"), ("error_hints", "unknown-error")]
    own = contract.select(name.alias("contract"), F.explode(F.filter(F.array(*[F.when(F.size(c) == 0, F.lit(k)) for c, k in kinds]), lambda x: x.isNotNull())).alias("gap_type"))
    return union_all([own, calls.select(F.concat_ws(" ", "method", "endpoint").alias("contract"), F.lit("unmatched-api-call").alias("gap_type")), routes.select(name.alias("contract"), F.lit("unmatched-backend-route").alias("gap_type"))])


def related(left: DataFrame, left_name: str, right: DataFrame, right_name: str) -> DataFrame:
    """Pairs of names that share a token, each once. A token is only a join key: pairs are made distinct before anything else."""
    a = left.select(left_name, F.explode(tokens(F.col(left_name))).alias("token")).distinct()
    b = right.select(right_name, F.explode(tokens(F.col(right_name))).alias("token")).distinct()
    return a.join(b, "token").select(left_name, right_name).distinct()


def feature_maps(links: DataFrame, routes: DataFrame, commands: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """name, key, kind, confidence, backend_routes, api_calls: one feature for each link, each unlinked route and each command; entrypoints only if there is nothing else."""
    none = F.array().cast("array<string>")
    linked = links.filter("match_type <> 'external-url'")
    by_link = linked.select(feature_name(F.coalesce("matched_route", "endpoint")).alias("name"), F.concat_ws(":", "source", "method", "endpoint", "matched_route").alias("key"), F.lit("link").alias("kind"), "confidence", F.when(F.col("matched_route").isNotNull(), F.array(F.concat_ws(" ", "matched_method", "matched_route"))).otherwise(none).alias("backend_routes"), F.array(F.concat_ws(" ", "method", "endpoint")).alias("api_calls")).distinct()
    by_route = unlinked_routes(routes, links).select(feature_name(F.col("path")).alias("name"), F.concat_ws(" ", "method", "path").alias("key"), F.lit("route").alias("kind"), F.lit("medium").alias("confidence"), F.array(F.concat_ws(" ", "method", "path")).alias("backend_routes"), none.alias("api_calls"))
    by_command = commands.select(feature_name(F.col("name")).alias("name"), F.concat_ws(":", "path", "name").alias("key"), F.lit("command").alias("kind"), F.lit("medium").alias("confidence"), none.alias("backend_routes"), none.alias("api_calls"))
    some = union_all([by_link, by_route, by_command])
    by_entry = entrypoints.select(feature_name(F.col("path")).alias("name"), F.col("path").alias("key"), F.lit("entrypoint").alias("kind"), F.lit("low").alias("confidence"), none.alias("backend_routes"), none.alias("api_calls"))
    empty = some.agg(F.count("*").alias("n")).filter("n = 0")  # one row or none, so a product with it is a switch
    return some.unionByName(by_entry.crossJoin(F.broadcast(empty)).drop("n"))


#: boundary -> fact tables whose files it has, with the column that names the file (fixed values)
BOUNDARIES = {
    "cli": {"commands": "path", "entrypoints": "path"},
    "frontend": {"pages": "path", "components": "path", "forms": "source", "styles": "path", "assets": "source", "states": "path"},
    "backend-api": {"routes": "evidence.file"},
    "data-layer": {"models": "path", "repositories": "path", "services": "path", "data_layer": "path"},
    "runtime-config": {"runtime": "path"},
    "tests": {"test_maps": "test_path"},
    "shared": {},
}
#: languages of files that are no source of a project's own (fixed values)
NOT_SOURCE = ["config", "dockerfile", "font", "gitignore", "gradle", "image", "json", "license", "lockfile", "markdown", "nix", "properties", "svg", "toml", "xml", "yaml"]
NOT_IMPLEMENTATION = ["dockerfile", "font", "gitignore", "image", "json", "lockfile", "markdown", "svg", "toml", "yaml", "yml"]
IMPLEMENTATION_ROLES = ["api", "data-layer", "data-model", "entrypoint", "frontend-page", "repository", "service", "source", "test", "webapp"]


def is_shared_source(path: Column, language: Column, role: Column) -> Column:
    """Whether a file is source of the project itself, and no configuration or documentation."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    elsewhere = F.lower(path).rlike(r"^(docs|openspec|\.github|\.changeset)/") | name.contains("config") | name.isin("build.js", "build.ts")
    return role.isin("source", "entrypoint") & ~language.isin(*NOT_SOURCE) & ~elsewhere


def module_boundaries(f: dict[str, DataFrame]) -> DataFrame:
    """name, path: the files of each boundary, by the facts found in them; ``shared`` has the source files of none. A file may be in several."""
    parts = [f[t].select(F.lit(name).alias("name"), F.col(c).alias("path")) for name, tables in BOUNDARIES.items() for t, c in tables.items() if t in f]
    known = union_all(parts).filter("path is not null").distinct()
    rest = f["files"].filter(is_shared_source(F.col("path"), F.col("language"), F.col("role"))).select("path").join(known.select("path").distinct(), "path", "left_anti")
    return known.unionByName(rest.select(F.lit("shared").alias("name"), "path"))


def boundary_counts(paths: DataFrame) -> DataFrame:
    """name, n_files of every boundary, those without files too."""
    names = paths.sparkSession.createDataFrame([(n,) for n in BOUNDARIES], "name string")
    return names.join(paths.groupBy("name").agg(F.count("*").alias("n_files")), "name", "left").select("name", F.coalesce("n_files", F.lit(0)).alias("n_files"))


def refactor_findings(f: dict[str, DataFrame]) -> DataFrame:
    """title, severity, subject, detail: unmatched calls, routes without a caller, unknown contracts, tests without a target, large files."""
    called = unmatched_calls(f["links"]).select(F.lit("Unmatched frontend API call").alias("title"), F.lit("medium").alias("severity"), F.concat_ws(" ", F.coalesce("method", F.lit("ANY")), "endpoint").alias("subject"), F.concat(F.lit("called in "), "source").alias("detail"))
    alone = unlinked_routes(f["routes"], f["links"]).select(F.lit("Backend route has no detected frontend caller").alias("title"), F.lit("low").alias("severity"), F.concat_ws(" ", "method", "path").alias("subject"), F.lit("served, but no call in the corpus is linked to it").alias("detail"))
    unknown = f["contract_gaps"].filter("gap_type like 'unknown-%'").agg(F.countDistinct("contract").alias("n")).filter("n > 0")
    unknown = unknown.select(F.lit("API contracts have unknown fields").alias("title"), F.lit("medium").alias("severity"), F.lit("api-contracts").alias("subject"), F.concat("n", F.lit(" contracts lack hints")).alias("detail"))
    tests = f["test_maps"].filter("target_kind = 'unmatched'").select(F.lit("Test file could not be mapped").alias("title"), F.lit("low").alias("severity"), F.col("test_path").alias("subject"), F.lit("no route, component, command, service, repository or model was found for it").alias("detail"))
    large = f["large_files"].select(F.lit("Large file may need a module boundary").alias("title"), F.lit("low").alias("severity"), F.col("path").alias("subject"), F.concat("size_bytes", F.lit(" bytes")).alias("detail"))
    return union_all([called, alone, unknown, tests, large])


#: (gap id, title, severity, condition over the counts) (fixed values)
GAP_RULES = [
    ("GAP-001", "No entrypoint detected", "medium", "entrypoints = 0"),
    ("GAP-002", "No tests detected", "medium", "tests = 0"),
    ("GAP-003", "No dependency metadata detected", "low", "dependencies = 0"),
    ("GAP-004", "Files with unknown language", "low", "unknown_language > 0"),
    ("GAP-005", "No source files detected", "high", "sources = 0"),
    ("GAP-006", "Side effects of API routes are unknown", "low", "routes > 0"),
    ("GAP-007", "Authentication of routes is unknown", "medium", "routes > 0"),
    ("GAP-008", "Data models without fields", "low", "models_without_fields > 0"),
    ("GAP-009", "User flows of the frontend are unknown", "low", "pages + frontend_routes + forms > 0"),
    ("GAP-010", "Rendered style is unknown", "low", "styles > 0"),
    ("GAP-011", "State transitions are unknown", "low", "states > 0"),
    ("GAP-012", "Frontend API calls without a backend route", "medium", "unmatched_calls > 0"),
    ("GAP-013", "Backend routes without a caller", "low", "routes > 0 and links > 0 and uncalled_routes > 0"),
    ("GAP-014", "API contracts with unknown parts", "medium", "unknown_contracts > 0"),
    ("GAP-015", "Tests without a target", "low", "unmapped_tests > 0"),
]


def detect_gaps(counts: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """gap_id, title, severity of the rules that hold for one row of counts, and of each parse issue (path, extractor)."""
    rows = F.array(*[F.when(F.expr(cond), F.struct(F.lit(i).alias("gap_id"), F.lit(t).alias("title"), F.lit(s).alias("severity"))) for i, t, s, cond in GAP_RULES])
    out = counts.select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("g")).select("g.*")
    if issues is None:
        return out
    each = issues.select(F.concat("extractor", F.lit(" issue in "), "path").alias("title"), F.lit("high").alias("severity"))
    return out.unionByName(numbered_within(each.withColumn("prefix", F.lit("GAP-AST")), "prefix", ["title"]).select(F.col("claim_id").alias("gap_id"), "title", "severity"))


#: gap -> (fact table, condition, what names the evidence) (fixed values)
GAP_EVIDENCE = {
    "GAP-004": ("files", "language = 'unknown'", "path"), "GAP-006": ("routes", "true", "concat(evidence.file, ':', evidence.line_start)"), "GAP-007": ("routes", "true", "concat(evidence.file, ':', evidence.line_start)"), "GAP-008": ("models", "size(fields) = 0", "concat(path, ':', line)"),
    "GAP-009": ("frontend_routes", "true", "path"), "GAP-010": ("styles", "true", "path"), "GAP-011": ("states", "true", "concat(path, ':', line)"), "GAP-012": ("links", "match_type = 'unmatched' and target_kind = 'backend-route'", "source"),
    "GAP-014": ("contract_gaps", "gap_type like 'unknown-%'", "contract"), "GAP-015": ("test_maps", "target_kind = 'unmatched'", "test_path"),
}


def gap_evidence(f: dict[str, DataFrame], gaps: DataFrame, n: int = 10) -> DataFrame:
    """gap_id, rank, evidence: the first ``n`` places of each gap that holds."""
    rows = union_all([f[t].filter(cond).select(F.lit(g).alias("gap_id"), F.expr(e).alias("evidence")) for g, (t, cond, e) in GAP_EVIDENCE.items() if t in f])
    part = rows.distinct().withColumn("part", F.pmod(F.xxhash64("evidence"), F.lit(64)))  # the first of each part, then of all
    near = top_n(part, ["gap_id", "part"], ["evidence"], n).drop("rank", "part")
    return top_n(near.join(gaps.select("gap_id"), "gap_id", "left_semi"), ["gap_id"], ["evidence"], n).select("gap_id", "rank", "evidence")


#: table -> (id prefix, claim type, confidence, sentence) (fixed values)
CLAIMS = {
    "languages": ("LANG", "language", "1.0", "concat('The project has ', n, ' ', language, ' files.')"),
    "dependencies": ("DEP", "dependency", "1.0", "concat('Depends on ', name, ' (', scope, ').')"),
    "entrypoints": ("ENTRY", "entrypoint", "0.95", "concat(path, ' is an entrypoint (', kind, ').')"),
    "commands": ("CMD", "command", "0.9", "concat('Command ', name, ' is defined in ', path, '.')"),
    "frameworks": ("FW", "framework", "confidence", "concat('Uses ', name, ' (', category, ').')"),
    "routes": ("API", "api-route", "0.85", "concat('Serves ', method, ' ', path, '.')"),
    "components": ("CMP", "component", "0.85", "concat('Has component ', name, '.')"),
    "frontend_routes": ("FR", "frontend-route", "0.85", "concat('Has frontend route ', name, '.')"),
    "calls": ("CALL", "api-call", "0.8", "concat(path, ' calls ', coalesce(method, 'ANY'), ' ', endpoint, '.')"),
    "links": ("LINK", "api-link", "case confidence when 'high' then 0.85 when 'medium' then 0.65 else 0.4 end", "concat(source, ' -> ', coalesce(matched_route, endpoint), ' (', match_type, ').')"),
    "pages": ("PAGE", "page", "0.85", "concat('Page ', path, ' is shown at ', route, '.')"),
    "servlets": ("SERVLET", "servlet", "0.9", "concat('Servlet ', name, ' is mapped in ', path, '.')"),
    "findings": ("REFACTOR", "refactor-finding", "0.65", "concat(title, ': ', subject, '.')"),
    "forms": ("FORM", "form", "0.85", "concat('Form in ', source, ' to ', coalesce(action, '?'), '.')"),
    "assets": ("ASSET", "asset", "0.8", "concat(source, ' uses ', asset_path, '.')"),
    "styles": ("STYLE", "style", "0.8", "concat(path, ' defines styles.')"),
    "states": ("STATE", "state-usage", "0.8", "concat(path, ' keeps state ', name, '.')"),
    "models": ("DATA", "data-model", "0.85", "concat('Has data model ', name, '.')"),
    "repositories": ("REPO", "repository", "0.85", "concat('Has repository ', name, '.')"),
    "services": ("SERVICE", "service", "0.85", "concat('Has service ', name, '.')"),
    "runtime": ("RUNTIME", "runtime-config", "0.8", "concat(path, ' configures ', name, '.')"),
    "test_maps": ("TEST", "test-map", "case confidence when 'high' then 0.75 when 'medium' then 0.55 else 0.35 end", "concat(test_path, ' tests ', coalesce(target, 'nothing known'), '.')"),
    "features": ("FEATURE", "feature-map", "case confidence when 'high' then 0.8 when 'medium' then 0.6 else 0.4 end", "concat('Feature ', name, '.')"),
    "boundaries": ("BOUNDARY", "module-boundary", "0.7", "concat('Boundary ', name, ' has ', n_files, ' files.')"),
    "contract_gaps": ("CONTRACT", "contract-gap", "0.8", "concat(contract, ': ', gap_type, '.')"),
    "symbols": ("SYM", "symbol", "1.0", "concat(path, ' defines ', kind, ' ', name, '.')"),
    "imports": ("IMP", "import", "1.0", "concat(path, ' imports ', name, '.')"),
    "issues": ("ISSUE", "extraction-issue", "1.0", "concat(path, ': ', message, '.')"),
}


def trace_claims(facts: dict[str, DataFrame]) -> DataFrame:
    """claim_id, claim, claim_type, confidence of every fact; numbered within each table by its sentence."""
    out = [
        facts[name].select(F.lit(prefix).alias("prefix"), F.expr(sentence).alias("claim"), F.lit(kind).alias("claim_type"), F.expr(f"cast({confidence} as double)").alias("confidence")).filter("claim is not null")
        for name, (prefix, kind, confidence, sentence) in CLAIMS.items()
        if name in facts
    ]
    return numbered_within(union_all(out), "prefix", ["claim", "confidence"]).select("claim_id", "claim", "claim_type", "confidence")


def spec_diff(now: dict[str, DataFrame], before: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """surface, change (added or removed), key of the distinct keys that only one of the snapshots has."""
    out = []
    for name, cols in keys.items():
        key = F.concat_ws(" ", *cols).alias("key")
        a, b = now[name].select(key).distinct(), before[name].select(key).distinct()
        out.append(a.exceptAll(b).select(F.lit(name).alias("surface"), F.lit("added").alias("change"), "key"))
        out.append(b.exceptAll(a).select(F.lit(name).alias("surface"), F.lit("removed").alias("change"), "key"))
    return union_all(out)


def count_diff(now: dict[str, DataFrame], before: dict[str, DataFrame]) -> DataFrame:
    """surface, n_now, n_before, delta."""
    def counted(facts: dict[str, DataFrame], as_: str) -> DataFrame:
        return union_all([df.agg(F.count("*").alias(as_)).select(F.lit(n).alias("surface"), as_) for n, df in facts.items()])

    both = counted(now, "n_now").join(counted(before, "n_before"), "surface", "full")
    return both.select("surface", F.coalesce("n_now", F.lit(0)).alias("n_now"), F.coalesce("n_before", F.lit(0)).alias("n_before")).withColumn("delta", F.col("n_now") - F.col("n_before"))


#: words too common to name a test's target (fixed values)
STOP_TERMS = ["test", "tests", "spec", "index", "main", "page", "view", "list", "item", "data", "type", "name", "user", "file", "path", "util", "utils", "helper", "helpers", "mock", "setup", "config", "base", "core", "common", "shared", "form"]


def meaningful(term: Column) -> Column:
    return (F.length(term) >= 4) & term.rlike("[a-z]") & ~term.isin(*STOP_TERMS)


def test_maps(files: DataFrame, routes: DataFrame, targets: DataFrame, max_bytes: int = 256_000) -> DataFrame:
    """test_path, target_kind, target, confidence: one row for each test file.

    A route whose literal path stands in the text is ``high``; then a target (kind, name, ord) named exactly like the file's
    stem is ``high``; then one whose term is among the file's terms is ``medium``; else the row is ``unmatched`` and low.
    Every tier is an equi-join on exploded terms; whole tokens only, so ``init`` does not match ``initiative``.  Of the routes
    or targets that share a key only the least can be chosen, so one stands for all and a key that many share costs no pairs.
    """
    tests = files.filter("role = 'test'").select(F.col("path").alias("test_path"), F.when(F.col("size_bytes") <= max_bytes, F.col("content")).alias("content"))
    quoted = tests.select("test_path", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit("[\"'`](/[^\"'`\\s?#]*)[\"'`?#]"), F.lit(1)))).alias("p"))
    by_route = quoted.withColumn("p", normalize_path(F.col("p"))).join(routes.groupBy(normalize_path(F.col("path")).alias("p")).agg(F.min(F.concat_ws(" ", "method", "path")).alias("target")), "p").select("test_path", F.lit("api-route").alias("target_kind"), "target", F.lit("high").alias("confidence"), F.lit(0).alias("tier"), F.lit(0).cast("long").alias("ord"))
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split("test_path", "/"), -1), r"\.\w+$", ""), r"(?i)^test_|[._-]?(tests?|spec)$", "")
    named = targets.select("kind", "name", "ord", F.array_join(name_terms(F.col("name")), "").alias("flat"), F.explode(F.filter(name_terms(F.col("name")), meaningful)).alias("term"))
    least = lambda key: named.groupBy(key).agg(F.min(F.struct("ord", "kind", "name")).alias("least")).select(key, "least.*")
    by_stem = tests.select("test_path", F.array_join(name_terms(stem), "").alias("flat")).join(least("flat"), "flat").select("test_path", F.col("kind").alias("target_kind"), F.col("name").alias("target"), F.lit("high").alias("confidence"), F.lit(1).alias("tier"), "ord")
    words = F.array_distinct(F.concat(name_terms(F.col("test_path")), name_terms(F.coalesce("content", F.lit("")))))
    by_term = tests.select("test_path", F.explode(F.filter(words, meaningful)).alias("term")).join(least("term"), "term").select("test_path", F.col("kind").alias("target_kind"), F.col("name").alias("target"), F.lit("medium").alias("confidence"), F.lit(2).alias("tier"), "ord")
    best = union_all([by_route, by_stem, by_term]).groupBy("test_path").agg(F.min(F.struct("tier", "ord", "target_kind", "target", "confidence")).alias("b"))
    return tests.select("test_path").join(best, "test_path", "left").select("test_path", F.coalesce("b.target_kind", F.lit("unmatched")).alias("target_kind"), F.col("b.target").alias("target"), F.coalesce("b.confidence", F.lit("low")).alias("confidence"))


def import_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """path, name, target: relative imports resolved to files, trying suffixes and index files in order."""
    base = F.regexp_replace("path", "[^/]*$", "")
    joined = F.concat(base, F.col("name"))

    def step(acc: Column, part: Column) -> Column:
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when((part == ".") | (part == ""), acc).when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    clean = F.array_join(F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), step), "/")
    ends = ["", ".ts", ".tsx", ".js", ".jsx", ".vue", ".svelte", "/index.ts", "/index.tsx", "/index.js"]
    tried = imports.filter("name like './%' or name like '../%'").select("path", "name", clean.alias("p")).select("path", "name", F.posexplode(F.array(*[F.concat("p", F.lit(e)) for e in ends])).alias("rank", "candidate"))
    hit = tried.join(files.select(F.col("path").alias("candidate")), "candidate")
    return hit.groupBy("path", "name").agg(F.min_by("candidate", "rank").alias("target"))


def mount_closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, prefix, depth of mounted routers: edges (parent, child, prefix), roots (node).

    One join for each level of nesting.  A router mounted twice has two prefixes; a chain that comes back to one of its
    nodes ends before it.
    """
    level = roots.select("node", F.lit("").alias("prefix"), F.lit(0).alias("depth"), F.array("node").alias("seen")).distinct()
    out = [level]
    step = edges.select(F.col("parent").alias("node"), "child", F.col("prefix").alias("own"))
    while True:
        further = level.join(step, "node").filter(~F.array_contains("seen", F.col("child")))
        below = further.select(F.col("child").alias("node"), F.regexp_replace(F.concat("prefix", F.lit("/"), "own"), "/+", "/").alias("prefix"), (F.col("depth") + 1).alias("depth"), F.array_append("seen", F.col("child")).alias("seen"))
        level = stored(below.distinct(), "mounts")
        if level.isEmpty():
            return union_all(out).drop("seen").distinct()
        out.append(level)


def surfaces(routes: DataFrame, services: DataFrame, models: DataFrame) -> DataFrame:
    """framework, route_count, handler_count, service_count, model_count; the last two are totals, joined on as one row."""
    own = routes.groupBy("framework").agg(F.count("*").alias("route_count"), F.countDistinct("handler").alias("handler_count"))
    totals = services.agg(F.count("*").alias("service_count")).crossJoin(models.agg(F.count("*").alias("model_count")))
    return own.crossJoin(F.broadcast(totals))


def large_files(files: DataFrame, least: int = 20_000) -> DataFrame:
    """Implementation files of at least ``least`` bytes."""
    wanted = F.col("role").isin(*IMPLEMENTATION_ROLES) & ~F.col("language").isin(*NOT_IMPLEMENTATION) & ~F.lower("path").rlike(r"(package-lock\.json|pnpm-lock\.yaml|yarn\.lock)$")
    return files.filter((F.col("size_bytes") >= least) & wanted).select("path", "role", "size_bytes")


def quality(facts: dict[str, DataFrame]) -> DataFrame:
    """metric, value: coverage ratios over linked calls, called routes, mapped tests and known contracts."""
    links, routes, tests = facts["links"], facts["routes"], facts["test_maps"]
    share = lambda cond: F.round(F.count_if(cond) / F.greatest(F.count("*"), F.lit(1)), 4)
    rows = [
        links.filter("target_kind = 'backend-route'").agg(share(F.col("matched_route").isNotNull()).alias("value")).select(F.lit("linked_call_ratio").alias("metric"), "value"),
        routes.join(links.select(F.col("matched_method").alias("method"), F.col("matched_route").alias("path"), F.lit(1).alias("hit")).distinct(), ["method", "path"], "left").agg(share(F.col("hit").isNotNull()).alias("value")).select(F.lit("called_route_ratio").alias("metric"), "value"),
        tests.agg(share(F.col("target").isNotNull()).alias("value")).select(F.lit("mapped_test_ratio").alias("metric"), "value"),
    ]
    return union_all(rows)


