"""Handlers that stand in another file than their route: from names to files, from files to bodies, from bodies to hints.

A route names its handler in its framework's way; each way gives a few (symbol, file) candidates, best first: what a variable
or a name was imported from, the files of an imported package or of the route's own, or the file that a controller's name
asks for.  Candidates are joined with the files once, and the body of a symbol is its block in the tree of the file, so
neither comments nor strings nor code after it take part.  The first candidate in which the symbol has a body counts.

Routes without a handler, handlers that nothing leads to and files without the symbol give no hints, as before.  Files with
null or empty contents hold no symbols; a handler that several routes name is looked up for each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import arrow_ready, stored
from .contracts import DETAILS, KINDS, contract_details, details
from .lexing import Masks, blocks
from .mounts import bindings
from .relate import import_targets, union_all

#: frameworks by how their routes name a handler (fixed values)
SCRIPT = ["express", "fastify", "koa", "hono", "hapi"]
PYTHON = ["django", "flask", "fastapi", "aiohttp", "tornado", "drf"]
GOLANG = ["gin", "chi", "echo", "fiber", "net-http", "gorilla-mux"]
RUSTY = ["actix", "axum", "rocket", "warp"]
#: framework -> (pattern whose groups are the controller and the action, file of a controller) (fixed values)
CONTROLLERS = {
    "rails": (r"^[\"']?([\w/]+)#(\w+[?!]?)", "controllers/{0}_controller.rb"),
    "laravel": (r"^[\[\"']*(?:[\w\\]*\\)?(\w+)(?:::class\s*,\s*[\"']|@)(\w+)", "Controllers/{0}.php"),
    "phoenix": (r"^(?:\w+\.)*(\w+)\s*,\s*:(\w+)", "controllers/{0}.ex"),
    "adonisjs": (r"^[\"']?(?:[\w/]+/)?(\w+)\.(\w+)", "Controllers/{0}.ts"),
    "sails": (r"^(?:[\w/]+/)?(\w+)Controller\.(\w+)", "controllers/{0}Controller.js"),
}

#: where a symbol is defined: ``{0}`` is its name
_DEFINED = (
    r"(?:\b(?:def|defp|function|func|fn|fun|class|const|let|var)\s+(?:\([^)\n]*\)\s*)?(?:self\.)?{0}(?![\w$])"
    r"|\b(?:module\.)?exports\.{0}\s*="
    r"|^[ \t]*(?:(?:public|private|protected|static|async|override|final)\s+)*(?:[\w<>\[\]?,.]+[ \t]+)?{0}\s*(?:=\s*(?:async\b|function\b|\()|:\s*(?:async\b|function\b|\()|\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)\s*(?::[^\n{{]+)?\{{))"
)
_DEFAULT = r"\bmodule\.exports\s*=(?!\s*\{)|\bexport\s+default\b"


def function_body(text: str, language: str, name: str) -> str | None:
    """The code of a function or class from its definition to the end of its block, without comments and docstrings; ``default``: what a script file exports."""
    masks = Masks(text, language)
    place = _place(text, language, name, masks)
    if place is None:
        return None
    start, end = place
    out, at = [], start
    for kind, s, e in masks.all:
        if start <= s < end and (kind == "comment" or (language == "python" and text[:s].rstrip(" \t")[-1:] in ("\n", "") and text[e : e + 1] in ("\n", "\r", ""))):
            out.append(text[at:s])
            at = e
    return "".join(out) + text[at:end]


def _place(text: str, language: str, name: str, masks: Masks) -> tuple[int, int] | None:
    """Where ``function_body`` begins and ends."""
    pattern = _DEFAULT if name == "default" else _DEFINED.replace("{{", "{").replace("}}", "}").replace("{0}", re.escape(name))
    tree = None
    for m in re.finditer(pattern, text, re.MULTILINE):
        place = m.start() + len(m[0]) - len(m[0].lstrip())
        if masks.kind(place):
            continue
        tree = blocks(text, language) if tree is None else tree
        first = text.rfind("\n", 0, place) + 1
        own = next((b for b in tree if b.opener == ":" and first <= b.start <= place), None)
        if own is not None:
            return first, own.end
        around = max((k for k, b in enumerate(tree) if b.body <= place < b.end), default=-1)
        beside = [b for b in tree if b.parent == around and b.start >= m.start() and b.opener != ":"]
        at, wrapped = m.start(), None
        for b in beside:
            between = text[at : b.start]
            if ";" in between or (at > m.start() and re.search(r"\n\s*\n|\n\s*(?:def|function|func|fn|class|const|let|var|export|exports|module)\b", between)):
                break
            if b.opener not in ("(", "["):
                return first, min(len(text), b.end + (3 if b.opener == "do" else 1))
            wrapped, at = b, b.end + 1
        if wrapped is not None and "\n" in text[wrapped.start : wrapped.end]:
            return first, wrapped.end + 1
    return None


def _named_bindings(raw: DataFrame, files: DataFrame) -> DataFrame:
    """path, variable, symbol, target: names that a script takes out of another file."""
    own = raw.filter("family = 'binding' and label like 'named-%'").select("path", F.col("detail").alias("name"), F.explode(F.split("subject", ",")).alias("n"))
    symbol, variable = F.regexp_extract("n", r"^\s*(?:type\s+)?([\w$]+)", 1), F.regexp_extract("n", r"([\w$]+)\s*$", 1)
    own = own.select("path", "name", symbol.alias("symbol"), variable.alias("variable")).filter("symbol <> '' and variable <> ''").distinct()
    return own.join(import_targets(own.select("path", "name").distinct(), files), ["path", "name"]).select("path", "variable", "symbol", "target")


def _snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", "_"))


def project_root(path: Column) -> Column:
    """What stands before the first folder of sources; names are looked up within it only, so no name is common to all projects."""
    return F.regexp_extract(path, r"^(?:(.*?)/)??(?:app|lib|src|config|routes|start|api)/", 1)


def handler_candidates(routes: DataFrame, raw: DataFrame, files: DataFrame) -> DataFrame:
    """file, framework, handler, prefix, target, symbol, rank: where the handlers of routes (with class_prefix) may be defined. files: path, language, role."""
    named = ["file", "framework", "handler", "prefix"]
    asked = routes.filter("handler is not null").select(F.col("evidence.file").alias("file"), "framework", "handler", F.coalesce("class_prefix", F.lit("")).alias("prefix")).distinct()
    word = F.regexp_replace("handler", r"[\"'\s&]|\.as_view.*$|\(.*$", "")
    asked = asked.withColumn("word", word).withColumn("variable", F.regexp_extract("word", r"^([\w$]+)", 1)).withColumn("last", F.regexp_extract("word", r"([\w$]+)$", 1))
    bare = F.col("variable") == F.col("word")

    variables = bindings(raw, files).withColumnRenamed("path", "file")
    bound = asked.filter(F.col("framework").isin(*SCRIPT, *PYTHON)).join(variables, ["file", "variable"])
    whole = F.col("framework").isin(*SCRIPT)
    by_variable = bound.select(*named, "target", F.when(bare & whole, "default").otherwise(F.col("last")).alias("symbol"), F.lit(1).alias("rank"))
    named_ones = _named_bindings(raw, files).withColumnRenamed("path", "file")
    by_name = asked.filter(F.col("framework").isin(*SCRIPT)).join(named_ones, ["file", "variable"]).select(*named, "target", F.when(bare, F.col("symbol")).otherwise(F.col("last")).alias("symbol"), F.lit(0).alias("rank"))

    folder = F.regexp_replace("path", "/?[^/]*$", "")
    code = files.filter("role <> 'test'")
    asked_go = asked.filter(F.col("framework").isin(*GOLANG))
    beside = asked_go.filter(bare).select(*named, "last", F.regexp_replace("file", "/?[^/]*$", "").alias("folder"), F.lit(0).alias("rank"))
    parts = F.split("subject", "/")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))
    imported = raw.filter("family = 'import' and language = 'go'").select(F.col("path").alias("file"), F.regexp_extract("subject", r"([\w-]+)$", 1).alias("variable"), F.posexplode(endings).alias("rank", "folder")).distinct()
    packages = asked_go.filter(~bare).join(imported, ["file", "variable"]).select(*named, "last", "folder", "rank")
    go = code.filter("language = 'go'").select(F.col("path").alias("target"), folder.alias("folder"))
    by_folder = beside.unionByName(packages).join(go, "folder").select(*named, "target", F.col("last").alias("symbol"), "rank")

    found = {k: [F.regexp_extract("handler", pattern, n) for n in (1, 2)] for k, (pattern, _) in CONTROLLERS.items()}
    rust = F.col("framework").isin(*RUSTY) & ~bare
    asks = [F.when(F.col("framework") == k, F.replace(F.lit(path), F.lit("{0}"), _snake(found[k][0]) if k == "phoenix" else found[k][0])) for k, (_, path) in CONTROLLERS.items()]
    own = asked.withColumn("asks", F.coalesce(*asks, F.when(rust, F.concat(F.regexp_extract("word", r"(\w+)::\w+$", 1), F.lit(".rs")))))
    own = own.withColumn("symbol", F.coalesce(*[F.when(F.col("framework") == k, x[1]) for k, x in found.items()], F.col("last"))).filter("asks is not null and symbol <> ''")
    own = own.select(*named, "asks", "symbol", project_root(F.col("file")).alias("root"), F.lower(F.element_at(F.split("asks", "/"), -1)).alias("base"))
    name = F.when(F.col("path").rlike("(^|/)mod[.]rs$"), F.concat(F.regexp_extract("path", "([^/]*)/mod[.]rs$", 1), F.lit(".rs"))).otherwise(F.element_at(F.split("path", "/"), -1))
    base = code.select(F.col("path").alias("target"), project_root(F.col("path")).alias("root"), F.lower(name).alias("base"))
    within = F.regexp_extract("target", r"[Cc]ontrollers/(?:[\w]+/)*?(\w+)/[^/]+$", 1)
    rank = F.when((within != "") & F.array_contains(F.split("prefix", "/"), F.lower(within)), 0).when(F.lower("target").endswith(F.lower("asks")), 1).otherwise(2)
    by_base = own.join(base, ["root", "base"]).select(*named, "target", "symbol", rank.cast("int").alias("rank"))
    return union_all([by_variable, by_name, by_folder, by_base]).filter("target <> file").distinct()


def cross_file_details(files: DataFrame, routes: DataFrame, raw: DataFrame) -> DataFrame:
    """``DETAILS`` of routes whose handler another file defines, from the handler's body there."""
    named = ["file", "framework", "handler", "prefix"]
    place = routes.filter("handler is not null").select(F.col("evidence.file").alias("file"), "framework", "handler", F.coalesce("class_prefix", F.lit("")).alias("prefix"), "method", F.col("path").alias("route"), F.col("evidence.line_start").alias("line")).distinct()
    known = stored(files.filter("content is not null").select("path", "language", "role"), "paths")  # read by every kind of lookup
    wanted = handler_candidates(routes, raw, known).join(place, named)
    ord_ = F.concat("file", F.lit(":"), F.lpad(F.col("line").cast("string"), 9, "0"))
    asked = wanted.groupBy("target").agg(F.array_sort(F.collect_set(F.struct("symbol", "framework", "method", "route", ord_.alias("ord"), "rank"))).alias("asked"))
    src = files.select(F.col("path").alias("target"), "language", "content").join(asked, "target")
    schema = DETAILS + ", rank int, target string"
    kinds = [pa.string()] * 4 + [pa.list_(pa.string())] * 4 + [pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                target, language, content, asked = (b.column(c)[k].as_py() for c in ("target", "language", "content", "asked"))
                bodies: dict[str, str | None] = {}
                rows = []
                for r in asked:
                    name = r["symbol"]
                    if name not in bodies:
                        bodies[name] = function_body(content or "", language, name)
                    if bodies[name] is not None:
                        d = details(bodies[name], r["framework"], name, r["route"])
                        rows.append((r["method"], r["route"], r["framework"], r["ord"], *(d[x] for x in KINDS), r["rank"], target))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in schema.split(", ")])

    found = arrow_ready(src).mapInArrow(run, schema)
    names = [c.split()[0] for c in DETAILS.split(", ")]
    best = found.groupBy(*names[:4]).agg(F.min_by(F.struct(*names[4:]), F.struct("rank", "target")).alias("d"))
    return best.select(*names[:4], "d.*")


def all_contract_details(files: DataFrame, routes: DataFrame, raw: DataFrame) -> DataFrame:
    """``DETAILS`` of each route from the text around it and from its handler, wherever that stands: hints of both, each once."""
    own = contract_details(files, routes).withColumn("which", F.lit(0))
    both = own.unionByName(cross_file_details(files, routes, raw).withColumn("which", F.lit(1)))
    names = [c.split()[0] for c in DETAILS.split(", ")]
    rows = both.groupBy(*names[:4]).agg(F.array_sort(F.collect_list(F.struct("which", *names[4:]))).alias("r"))
    return rows.select(*names[:4], *[F.array_distinct(F.flatten(F.col(f"r.{c}"))).alias(c) for c in names[4:]])
