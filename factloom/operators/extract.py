"""Facts from source text: one scan applies a small table of rules to each file, by its language.

``raw`` in the functions below is a written result of ``extract``, for callers that derive several fact tables from one scan.
"""

from __future__ import annotations

import re
import tomllib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_path, once
from ..sources.tables import arrow_ready, stored
from .lexing import Masks, blocks
from .mounts import mounted
from .ordered import first_wins
from .resources import implied_routes
from .rules import CHANNEL_OF, FILE_ROUTES, MANIFESTS, PATHS, RULES, Rule

#: families of matches that routes and their handlers are found by
ROUTE_FAMILIES = ["route", "scope", "resource", "router", "mount", "binding", "import"]
MODEL_FAMILIES = ["data-model", "field"]
#: roles whose files are not evidence of the project itself (fixed values)
NOISE = ["generated", "sample"]

RULE_ROWS = "path string, language string, role string, line int, rule int, nth int, family string, label string, verb string, subject string, detail string, owner string, scope array<string>"


def compiled(rules: list[Rule]) -> dict[str, list[tuple]]:
    """By language: (number, rule, pattern over the whole text, pattern over one line)."""
    by: dict[str, list[tuple]] = {}
    for n, r in enumerate(rules):
        flags = re.ASCII | (re.IGNORECASE if r.pattern.startswith("(?i)") else 0)
        pattern = r.pattern.removeprefix("(?i)")
        both = re.compile(pattern, flags | re.MULTILINE), re.compile(pattern, flags)
        for lang in r.languages.split():
            by.setdefault(lang, []).append((n, r, *both))
    return by


def matches(content: str, rules: list[tuple], language: str = "") -> Iterator[tuple]:
    """(line, rule number, nth match in the line, family, label, verb, subject, detail, owner, prefixes of the scopes around a route) in one file; empty groups are None.

    Only lines in which a pattern begins are looked at, and matches that begin in a comment or a string are left out.
    """
    starts = masks = None
    found: list[tuple[int, tuple]] = []
    scopes: list[tuple] = []
    for n, r, whole, one in rules:
        at = 0
        while m := whole.search(content, at):
            if starts is None:
                starts = [0, *(x.end() for x in re.finditer("\n", content))]
                masks = Masks(content, language)
            line = bisect_right(starts, m.start())
            end = starts[line] if line < len(starts) else len(content) + 1
            base, hits = (0, [m]) if r.span > 1 else (starts[line - 1], one.finditer(content[starts[line - 1] : end - 1].removesuffix("\r")))
            for k, x in enumerate(hits):
                place = base + x.start() + len(x[0]) - len(x[0].lstrip())
                kind = masks.kind(place)
                if kind and kind != r.inside:
                    continue
                verb = (x[r.verb] if r.verb else None) if isinstance(r.verb, int) else r.verb
                subject, detail, owner = (x[r.subject] if r.subject else None) or None, (x[r.detail] if r.detail else None) or None, x.groupdict().get("owner")
                if r.family == "scope":
                    scopes.append((place, base + x.end(), r.label, verb, subject, detail, owner))
                found.append((place, (line, n, k, r.family, r.label, verb or None, subject, detail, owner)))
            if end > len(content):
                break
            at = end
    around = Scopes(content, language, scopes) if scopes else None
    for place, row in found:
        yield *row, around.prefixes(row[4], place) if around and row[3] in ("route", "resource") else None


class Scopes:
    """The blocks of a file that give the routes inside them a prefix, by label; each knows the one around it."""

    def __init__(self, content: str, language: str, declared: list[tuple]) -> None:
        tree = blocks(content, language)
        opens = [b.start for b in tree]
        self.by_label: dict[str, list[tuple]] = {}

        def innermost(place: int) -> int:
            k = bisect_right(opens, place) - 1
            while k >= 0 and not tree[k].body <= place < tree[k].end:
                k = tree[k].parent
            return k

        for place, end, label, kind, subject, detail, owner in declared:
            if kind == "rest":
                k = innermost(place)
                span = (end, tree[k].end if k >= 0 else len(content))
            elif kind == "above":
                span = next(((b.body, b.end) for b in tree if b.end == place), None)
            else:
                k = bisect_right(opens, end - 1) - 1
                own = tree[k] if k >= 0 and tree[k].body == end else None
                if own is None:
                    parent = innermost(place)
                    own = next((b for b in tree[bisect_right(opens, end - 1) :] if b.parent == parent and b.opener != "("), None)
                span = own and (own.body, own.end)
            if span:
                self.by_label.setdefault(label, []).append((*span, kind, subject, detail, owner))
        self.starts: dict[str, list[int]] = {}
        self.around: dict[str, list[int]] = {}
        for label, spans in self.by_label.items():
            spans.sort(key=lambda x: (x[0], -x[1]))
            self.starts[label] = [x[0] for x in spans]
            open_: list[int] = []
            self.around[label] = []
            for n, x in enumerate(spans):
                while open_ and spans[open_[-1]][1] < x[1]:
                    open_.pop()
                self.around[label].append(open_[-1] if open_ else -1)
                open_.append(n)

    def prefixes(self, label: str, place: int) -> list[str] | None:
        """From the outermost scope around ``place`` to the innermost; None if there is none."""
        spans = self.by_label.get(label)
        if not spans:
            return None
        k, chain = bisect_right(self.starts[label], place) - 1, []
        while k >= 0:
            if spans[k][0] <= place < spans[k][1]:
                chain.append(spans[k])
            k = self.around[label][k]
        parts: list[str] = []
        for _, _, kind, subject, detail, owner in reversed(chain):
            if kind == "resources":
                parts += [detail or subject, f":{singular(subject)}_id"]
            elif kind == "member":
                parts[-1:] = [":id"]
            elif kind == "collection":
                del parts[-1:]
            else:
                parts.append((detail or subject or "").replace("[controller]", owner or ""))
        return [x for x in parts if x.strip("/")] or None


def singular(word: str) -> str:
    for many, one in (("ies", "y"), ("sses", "ss"), ("shes", "sh"), ("ches", "ch"), ("xes", "x"), ("ss", "ss"), ("s", "")):
        if word.endswith(many):
            return word[: -len(many)] + one
    return word


def extract(files: DataFrame, families: list[str] | None = None, rules: list[Rule] | None = None, skip_roles: list[str] = NOISE) -> DataFrame:
    """path, language, role, line, rule, nth, family, label, verb, subject, detail, owner, scope of every match of the rules, empty groups as null.

    One scan of the files whatever the number of families, and nothing shuffled; each pattern is compiled once a task.
    """
    wanted = compiled([r for r in (rules or RULES) if not families or r.family in families])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (path, language, role, *m)
                for path, language, role, content in zip(*(b.column(c).to_pylist() for c in ("path", "language", "role", "content")), strict=True)
                if language in wanted
                for m in matches(content, wanted[language], language)
            ]
            kinds = [pa.string()] * 3 + [pa.int32()] * 3 + [pa.string()] * 6 + [pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in RULE_ROWS.split(", ")])

    src = files.filter(~F.col("role").isin(*skip_roles) & F.col("content").isNotNull()).select("path", "language", "role", "content")
    found = arrow_ready(src).mapInArrow(run, RULE_ROWS)
    allowed = F.coalesce(*[F.when(F.col("label") == k, F.col("path").rlike(rx)) for k, rx in PATHS.items()], F.lit(True))
    return found.filter(allowed)


def evidence(kind: Column | str) -> Column:
    k = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(F.col("path").alias("file"), k.alias("kind"), F.col("line").alias("line_start"), F.col("line").alias("line_end"), F.lit(None).cast("string").alias("note"))


_ORDER = ["path", "line", "rule", "nth"]


def _of(files: DataFrame, families: list[str], raw: DataFrame | None) -> DataFrame:
    return extract(files, families) if raw is None else raw.filter(F.col("family").isin(*families))


def file_route(path: Column, side: str) -> Column:
    """struct(label, route) of a file whose name is a route, or null: groups in brackets are left out, parameters written with colons."""
    found = []
    for label, pattern, own in FILE_ROUTES:
        if own == side:
            route = F.regexp_replace(F.regexp_replace(F.regexp_extract(path, pattern, 1), r"\([^/)]*\)/?", ""), r"\[(?:\.\.\.)?([^\]/]+)\]", ":$1")
            found.append(F.when(path.rlike(pattern), F.struct(F.lit(label).alias("label"), F.concat(F.lit("/"), F.regexp_replace(route, "^/+|/+$", "")).alias("route"))))
    return F.coalesce(*found)


def api_routes(files: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """method, path, handler, framework, kind, class_prefix, evidence; first of (method, path, framework, handler) wins.

    A scope's prefix applies to the routes inside its block, nested scopes one after the other; routers that other files mount
    have their routes under the mount's prefix.
    """
    raw = stored(_of(files, ROUTE_FAMILIES, raw), "route-matches") if raw is None else raw
    declared = stored(declared_routes(raw), "declared")
    return first_wins(mounted(declared, raw, files), ["method", "path", "framework", "handler"], [F.col(f"evidence.{c}") for c in ("file", "line_start")] + ["rule", "nth"]).drop("rule", "nth", "owner", "own_path")


def declared_routes(raw: DataFrame) -> DataFrame:
    """The routes as their files declare them, under the prefixes of the scopes around them (class_prefix), and the router variable (owner)."""
    def prefix() -> Column:
        return F.array_join(F.transform("scope", lambda x: F.regexp_replace(x, "^/+|/+$", "")), "/").alias("class_prefix")

    implied = implied_routes(raw).select("method", normalize_path(F.concat_ws("/", prefix(), "route")).alias("path_"), "handler", "framework", F.lit("route").alias("kind"), prefix(), "owner", evidence("route").alias("evidence"), "rule", "nth")
    raw = raw.filter("family = 'route' and role <> 'test'").select("*", prefix())
    named_by_file = F.col("label") == "next-app"
    channel = F.coalesce(*[F.when(F.col("label") == k, F.lit(v)) for k, v in CHANNEL_OF.items()])

    def placed(file: Column) -> Column:
        own = F.when(named_by_file, F.coalesce(file.route, F.lit(""))).otherwise(F.coalesce("subject", F.lit("")))
        own = F.when(F.col("label") == "wordpress", F.concat_ws("/", "detail", F.regexp_replace("subject", "^/", ""))).otherwise(own)
        below = once(own, lambda x: F.when(F.col("class_prefix").isNotNull(), F.concat_ws("/", "class_prefix", F.regexp_replace(x, "^/+", ""))).otherwise(x))
        path = F.when(channel.isNotNull(), F.concat(channel, "subject")).otherwise(once(below, normalize_path))
        return F.struct(path.alias("path_"), F.when(named_by_file, F.coalesce(file.label, F.lit("next-app"))).otherwise(F.col("label")).alias("framework"))

    raw = raw.withColumn("placed", once(F.when(named_by_file, file_route(F.col("path"), "backend")), placed))
    handler = F.when(F.col("label") != "wordpress", F.col("detail"))
    routes = raw.select(F.upper(F.coalesce("verb", F.lit("GET"))).alias("method"), "placed.path_", handler.alias("handler"), "placed.framework", F.lit("route").alias("kind"), "class_prefix", "owner", evidence("route").alias("evidence"), "rule", "nth")
    return routes.unionByName(implied).withColumnRenamed("path_", "path")


def api_calls(files: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """path, endpoint, method, client, line, evidence; first of (path, method, endpoint, line) wins."""
    raw = _of(files, ["call"], raw).filter("role <> 'test' and subject is not null")
    channel = F.coalesce(*[F.when(F.col("label") == k, F.lit(v)) for k, v in CHANNEL_OF.items()], F.lit(""))
    calls = raw.select("path", F.concat(channel, "subject").alias("endpoint"), F.upper(F.coalesce("verb", F.when(F.col("label") == "fetch", "GET"))).alias("method"), F.col("label").alias("client"), evidence("api-call").alias("evidence"), "line", "rule", "nth")
    return first_wins(calls, ["path", "method", "endpoint", "line"], _ORDER).drop("rule", "nth")


def named(files: DataFrame, family: str, out: str = "name", raw: DataFrame | None = None) -> DataFrame:
    """path, kind, name, detail, line, evidence of a family whose subject is a name; first of (path, kind, name, line) wins."""
    raw = _of(files, [family], raw).filter("subject is not null")
    rows = raw.select("path", F.col("label").alias("kind"), F.col("subject").alias(out), "verb", "detail", evidence(F.lit(family)).alias("evidence"), "line", "rule", "nth")
    return first_wins(rows, ["path", "kind", out, "line"], _ORDER).drop("rule", "nth")


def data_models(files: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """path, kind, name, detail, line, evidence, fields of every data model; a field belongs to the last model of its kind above it."""
    both = _of(files, MODEL_FAMILIES, raw).filter("subject is not null")
    both = both.withColumn("kind", F.explode(F.when(F.col("family") == "field", F.split("label", " ")).otherwise(F.array("label"))))
    above = Window.partitionBy("path", "kind").orderBy("line", "family", "rule", "nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("model", F.last(F.when(F.col("family") == "data-model", F.struct("line", F.col("subject").alias("name"))), ignorenulls=True).over(above))
    own = placed.filter("family = 'field' and model is not null and line > model.line").groupBy("path", "kind", "model.name", "model.line").agg(F.array_sort(F.collect_set(F.struct(F.col("line").alias("at"), F.col("subject").alias("f")))).alias("f"))
    fields = own.select("path", "kind", "name", "line", F.array_distinct("f.f").alias("fields"))
    models = named(files, "data-model", raw=both.filter("family = 'data-model'"))
    return models.join(fields, ["path", "kind", "name", "line"], "left").withColumn("fields", F.coalesce("fields", F.array().cast("array<string>")))


def dependencies(files: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """name, source, scope, path of every declared dependency, from text manifests, package.json, composer.json, pyproject, Cargo and pom files."""
    text = _of(files, ["dependency"], raw).filter("subject is not null and role not in ('test')")
    allowed = F.coalesce(*[F.when(F.col("label") == k, F.col("path").rlike(rx)) for k, rx in MANIFESTS.items()])
    plain = text.filter(allowed).select(F.col("subject").alias("name"), F.col("label").alias("source"), F.when(F.col("label") == "gradle", "gradle").otherwise(F.col("verb")).alias("scope"), "path")
    usable = files.filter(~F.col("role").isin("generated", "test", "sample") & F.col("content").isNotNull())

    def json_scope(name: str, key: str, scope: str) -> DataFrame:
        own = usable.filter(F.col("path").rlike(rf"(^|/){name.replace('.', chr(92) + '.')}$"))
        keys = F.map_keys(F.from_json(F.get_json_object("content", f"$['{key}']"), "map<string,string>"))
        return own.select(F.explode(keys).alias("name"), F.lit(name).alias("source"), F.lit(scope).alias("scope"), "path")

    out = plain
    for name, key, scope in [("package.json", "dependencies", "runtime"), ("package.json", "devDependencies", "development"), ("composer.json", "require", "runtime"), ("composer.json", "require-dev", "development")]:
        out = out.unionByName(json_scope(name, key, scope))
    pom = usable.filter(F.col("path").rlike(r"(^|/)pom\.xml$"))
    out = out.unionByName(pom.select(F.explode(F.regexp_extract_all("content", F.lit(r"(?s)<dependency>.*?<artifactId>([^<]+)</artifactId>"), F.lit(1))).alias("name"), F.lit("pom.xml").alias("source"), F.lit("runtime").alias("scope"), "path"))
    return out.unionByName(_toml(usable))


def _toml(files: DataFrame) -> DataFrame:
    """Dependencies of pyproject.toml, Cargo.toml and Gradle version catalogues: TOML is not regular, so a parser reads it, a batch at a time."""
    @F.pandas_udf("array<struct<name:string,source:string,scope:string>>")
    def read(path: pd.Series, content: pd.Series) -> pd.Series:
        def one(p: str, text: str) -> list[dict]:
            try:
                doc = tomllib.loads(text or "")
            except tomllib.TOMLDecodeError:
                return []
            found = []
            if p.endswith("pyproject.toml"):
                project = doc.get("project", {})
                found += [(x, "pyproject.toml", "runtime") for x in project.get("dependencies", [])]
                found += [(x, "pyproject.toml", k) for k, v in project.get("optional-dependencies", {}).items() for x in v]
            elif p.endswith("Cargo.toml"):
                for key, scope in (("dependencies", "runtime"), ("dev-dependencies", "development"), ("build-dependencies", "build")):
                    found += [(x, "Cargo.toml", scope) for x in doc.get(key, {})]
            else:
                for key, scope in (("libraries", "version-catalog"), ("plugins", "version-catalog-plugin")):
                    found += [(x, "libs.versions.toml", scope) for x in doc.get(key, {})]
            return [{"name": n, "source": s, "scope": c} for n, s, c in found]

        return pd.Series([one(p, t) for p, t in zip(path, content, strict=True)])

    own = files.filter(F.col("path").rlike(r"(^|/)(pyproject\.toml|Cargo\.toml|libs\.versions\.toml)$"))
    rows = own.select("path", F.explode(read("path", "content")).alias("x")).select("x.name", "x.source", "x.scope", "path")
    return rows.withColumn("name", F.regexp_extract("name", r"^[A-Za-z0-9_.\-/:]+", 0))


#: (framework, category, pattern over a dependency or import, confidence) (fixed values)
FRAMEWORKS = [
    ("react", "frontend", "^react(-dom)?$", 0.95), ("vue", "frontend", "^vue$", 0.95), ("angular", "frontend", "^@angular/core$", 0.95), ("svelte", "frontend", "^svelte$", 0.95), ("next", "frontend", "^next$", 0.95),
    ("nuxt", "frontend", "^nuxt3?$", 0.95), ("astro", "frontend", "^astro$", 0.95), ("solid", "frontend", "^solid-js$", 0.95), ("ember", "frontend", "^ember-source$", 0.95), ("remix", "frontend", "^@remix-run/", 0.9),
    ("express", "backend", "^express$", 0.95), ("fastify", "backend", "^fastify$", 0.95), ("nestjs", "backend", "^@nestjs/core$", 0.95), ("koa", "backend", "^koa$", 0.95), ("hono", "backend", "^hono$", 0.95), ("trpc", "backend", "^@trpc/server$", 0.9),
    ("fastapi", "backend", "(?i)^fastapi", 0.95), ("flask", "backend", "(?i)^flask$", 0.95), ("django", "backend", "(?i)^django$", 0.95), ("tornado", "backend", "^tornado$", 0.9), ("aiohttp", "backend", "^aiohttp", 0.9), ("celery", "worker", "^celery$", 0.9),
    ("spring", "backend", "spring-boot|org\\.springframework", 0.95), ("micronaut", "backend", "micronaut", 0.9), ("quarkus", "backend", "quarkus", 0.9), ("ktor", "backend", "ktor", 0.9), ("rails", "backend", "^rails$", 0.95), ("sinatra", "backend", "^sinatra$", 0.95),
    ("laravel", "backend", "^laravel/framework$", 0.95), ("symfony", "backend", "^symfony/framework-bundle$", 0.95), ("slim", "backend", "^slim/slim$", 0.95), ("gin", "backend", "gin-gonic/gin", 0.95), ("chi", "backend", "go-chi/chi", 0.95), ("echo", "backend", "labstack/echo", 0.95),
    ("phoenix", "backend", "^phoenix$", 0.95), ("actix", "backend", "^actix-web$", 0.95), ("axum", "backend", "^axum$", 0.95), ("aspnetcore", "backend", "^Microsoft\\.AspNetCore", 0.95), ("vapor", "backend", "vapor/vapor", 0.95),
    ("sqlalchemy", "data", "(?i)^sqlalchemy$", 0.9), ("prisma", "data", "^(@prisma/client|prisma)$", 0.9), ("drizzle", "data", "^drizzle-orm$", 0.9), ("mongoose", "data", "^mongoose$", 0.9), ("typeorm", "data", "^typeorm$", 0.9), ("hibernate", "data", "hibernate", 0.85),
    ("redux", "state", "^(redux|@reduxjs/toolkit)$", 0.9), ("zustand", "state", "^zustand$", 0.9), ("pinia", "state", "^pinia$", 0.9), ("tailwind", "style", "^tailwindcss$", 0.9), ("jest", "test", "^jest$", 0.9), ("pytest", "test", "^pytest$", 0.9), ("vitest", "test", "^vitest$", 0.9), ("playwright", "test", "playwright", 0.9),
]


def frameworks(deps: DataFrame, imports: DataFrame) -> DataFrame:
    """name, category, source, confidence: each framework once, by its most confident, then first, source; imports count a little less."""
    spark = deps.sparkSession
    table = F.broadcast(spark.createDataFrame(FRAMEWORKS, "name string, category string, pattern string, confidence double"))
    used = deps.select(F.col("name").alias("word"), F.concat(F.lit("dependency:"), "path").alias("source"), F.lit(0.0).alias("less")).unionByName(imports.select(F.col("name").alias("word"), F.concat(F.lit("import:"), "path").alias("source"), F.lit(0.1).alias("less"))).distinct()
    hit = used.join(table, F.expr("word rlike pattern")).withColumn("confidence", F.round(F.col("confidence") - F.col("less"), 2))
    best = hit.groupBy("name").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "source", "category")).alias("b"))
    return best.select("name", "b.category", "b.source", (-F.col("b.c")).alias("confidence"))


def parse_issues(files: DataFrame) -> DataFrame:
    """path, extractor, message for JSON files that do not parse."""
    own = files.filter((F.col("language").isin("json", "notebook")) & F.col("content").isNotNull())
    return own.filter("try_parse_json(content) is null").select("path", F.lit("json").alias("extractor"), F.lit("not valid JSON").alias("message"))
