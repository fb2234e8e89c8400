"""Calls through wrapped API clients: templates of paths, carried along the calls between functions to a fixed point.

A scan of script files gives relations: constants, functions with their parameters, client instances with a base URL, calls of
clients (sinks) and of anything else, each argument as a template, that is a list of parts: text (``lit``), a parameter of the
function around it (``param``), a name (``ref``).  Constants are closed over files first; only those without open names are
put in, so a cycle of constants stays open and ends.  A function that calls a client with its own parameters is a wrapper; who
calls a wrapper puts arguments in for parameters and is one himself if parameters of his own are left.  Each round joins only
the wrappers found in the round before with the calls of their functions; the functions passed are kept, and a chain that
comes back to one of them ends there.  What has no parameter left is an API call, and so is a wrapper that nobody calls.

Names that nothing defines are parameters of the path (``:name``) where they are a whole part of it, else ``${name}``; one
at the beginning of a path, before a slash, is a base URL and left out.  Calls without a path are none.  Arguments that are
not given leave their parameter as a name.  Files with null contents have no calls; comments and strings
hold none.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import arrow_ready, stored
from .extract import api_calls, evidence
from .handlers import _named_bindings
from .lexing import Block, Lines, Masks, blocks
from .mounts import bindings
from .relate import union_all

SCRIPTS = ["javascript", "typescript", "vue", "svelte"]
VERBS = ["get", "post", "put", "patch", "delete", "head"]
#: functions that take an URL and options, and objects whose methods are named by verbs (fixed values)
FETCHERS = ["fetch", "$fetch", "ofetch", "useFetch", "window.fetch", "axios", "ky", "axios.request"]
CLIENTS = ["axios", "ky", "http", "this.http", "$http", "this.$http", "$axios", "this.$axios", "superagent", "got", "httpClient", "this.httpClient"]
_KEYWORDS = {"if", "for", "while", "switch", "catch", "function", "return", "await", "typeof", "super", "constructor", "import", "require", "with", "else", "do", "new"}
PART = "struct<kind: string, text: string>"
CLIENT_FACTS = f"path string, kind string, name string, owner string, line int, method array<{PART}>, parts array<{PART}>, args array<array<{PART}>>"
_PARTS = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))
_FACT_TYPES = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), _PARTS, _PARTS, pa.list_(_PARTS)]

_DEFINITION = re.compile(
    r"\bfunction\s*\*?\s+(?P<f>[\w$]+)\s*(?:<[^<>()]*>)?\("
    r"|\b(?:const|let|var)\s+(?P<a>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b\s*[\w$]*\s*)?(?:<[^<>()]*>\s*)?\("
    r"|\b(?:const|let|var)\s+(?P<s>[\w$]+)\s*=\s*(?:async\s+)?(?P<one>[\w$]+)\s*=>"
    r"|^[ \t]*(?:(?:public|private|protected|static|async|override|readonly)\s+)*(?P<m>\#?[\w$]+)\s*(?:<[^<>()]*>)?\("
    r"|(?:^|[{,])\s*(?P<p>[\w$]+)\s*:\s*(?:async\s*)?(?:function\b\s*)?\(",
    re.MULTILINE,
)
_CALL = re.compile(r"(?<![\w$.#])(?P<name>(?:this\.)?\#?[\w$]+(?:\??\.\#?[\w$]+)*)\s*(?:<[^<>()]*>)?\(")
_CONSTANT = re.compile(r"\b(?:const|let|var|readonly|static)\s+(?P<name>[\w$]+)\s*(?::[^=\n]+)?=\s*(?=[\"'`\w$(])")
_PROPERTY = re.compile(r"(?:^|[{,])\s*(?P<name>[\w$]+)\s*:\s*(?=[\"'`])", re.MULTILINE)
_ALIAS = re.compile(r"\b(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=\n]+)?=\s*new\s+(?P<class>[\w$]+)|\bexport\s+default\s+(?:new\s+(?P<made>[\w$]+)|(?:async\s+)?(?:function\s+|class\s+)?(?P<given>[\w$]+))|\bmodule\.exports\s*=\s*(?P<old>[\w$]+)\s*;?\s*$", re.MULTILINE)
_INSTANCE = re.compile(r"\b(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:axios|ky|ofetch|got)\.(?:create|extend)\(")
_ATOM = re.compile(r"\s*(?:(?P<q>[\"'])(?P<text>(?:[^\"'\\\n]|\\.|(?!(?P=q))[\"'])*)(?P=q)|(?P<name>[A-Za-z_$][\w$]*(?:(?:\??\.|!\.)\#?[\w$]+)*)(?P<call>\s*\()?|(?P<number>\d[\w.]*)|(?P<tick>`)|(?P<open>\())")

Parts = list[dict[str, str]]


def label(client: str) -> str:
    """A client by the name that the rules give it."""
    name = client.removeprefix("window.").removeprefix("this.").removesuffix(".request")
    return {"http": "angular", "$fetch": "nuxt-fetch", "useFetch": "nuxt-fetch", "ofetch": "nuxt-fetch", "got": "superagent", "$http": "http-client", "$axios": "http-client", "httpClient": "http-client"}.get(name, name)


def _lit(text: str) -> Parts:
    return [{"kind": "lit", "text": text}] if text else []


class Script:
    """What one script file says of clients, wrappers and constants."""

    def __init__(self, text: str, language: str) -> None:
        self.text, self.masks, self.tree, self.lines = text, Masks(text, language), blocks(text, language), Lines(text)
        self.at = {b.start: b for b in self.tree}
        self.opens = [b.start for b in self.tree]
        self.functions: list[tuple[int, int, str, list[str]]] = []  # body, end, name, parameters
        for m in self.found(_DEFINITION):
            self.define(m)
        self.functions.sort()
        self.starts = [f[0] for f in self.functions]

    def found(self, pattern: re.Pattern) -> Iterator[re.Match]:
        for m in pattern.finditer(self.text):
            if not self.masks.kind(m.start() + len(m[0]) - len(m[0].lstrip(" \t\n{,"))):
                yield m

    def block_of(self, place: int) -> Block | None:
        k = bisect_right(self.opens, place) - 1
        while k >= 0 and not self.tree[k].body <= place < self.tree[k].end:
            k = self.tree[k].parent
        return self.tree[k] if k >= 0 else None

    def owner_of(self, place: int) -> str:
        """The class or the object constant that a member stands in."""
        b = self.block_of(place)
        head = self.text[max(0, b.start - 300) : b.start] if b and b.opener == "{" else ""
        m = re.search(r"(?:\b(?:const|let|var)\s+([\w$]+)\s*(?::[^=\n]+)?=|\bclass\s+([\w$]+)[^{}]*|\bexport\s+(default)|\bmodule\.(exports)\s*=)\s*$", head)
        return "" if not m else m[1] or m[2] or "default"

    def define(self, m: re.Match) -> None:
        name = m["f"] or m["a"] or m["s"] or m["m"] or m["p"]
        if name in _KEYWORDS:
            return
        if m["s"]:
            params, after = [m["one"]], m.end()
        else:
            b = self.at.get(m.end() - 1)
            if b is None or b.end >= len(self.text):
                return
            params = [re.split(r"[=:?]", x, maxsplit=1)[0].strip() for x in self.split(b.body, b.end)]
            rest = re.compile(r"\s*(?::[^={;\n]*(?:\{[^}]*\})?[^={;\n]*)?(=>)?\s*").match(self.text, b.end + 1)
            if not rest[1] and self.text[rest.end() : rest.end() + 1] != "{":
                return
            after = rest.end()
        after += len(self.text[after:]) - len(self.text[after:].lstrip())
        body = self.at.get(after)
        span = (body.body, body.end) if body and body.opener == "{" else (after, self.statement(after))
        place = m.start() + len(m[0]) - len(m[0].lstrip(" \t\n{,"))
        owner = self.owner_of(place) if m["m"] or m["p"] else ""
        if m["m"] and not owner:
            return
        self.functions.append((*span, f"{owner}.{name}" if owner else name, params))

    def statement(self, at: int) -> int:
        """The end of the expression that begins here."""
        for m in re.compile(r"[(\[{]|[)\]},;]|\n(?!\s*[.?:+])").finditer(self.text, at):
            if m.start() < at or self.masks.kind(m.start()):
                continue
            if m[0] in "([{":
                at = self.behind(m.start())
            elif m.start() > at or m[0] != "\n":
                return m.start()
        return len(self.text)

    def behind(self, opener: int) -> int:
        """The place behind the block that opens here, or behind the expression inside a template literal."""
        if b := self.at.get(opener):
            return b.end + 1
        k = bisect_right(self.masks.starts, opener)
        return next((start + 1 for start in self.masks.starts[k:] if self.text[start] == "}"), opener + 1)

    def split(self, at: int, end: int) -> list[str]:
        """The parts between commas."""
        out, start = [], at
        for m in re.compile(r"[(\[{,]").finditer(self.text, at, end):
            if m.start() < at or self.masks.kind(m.start()):
                continue
            if m[0] == ",":
                out.append(self.text[start : m.start()])
                start = m.end()
            else:
                at = self.behind(m.start())
        return [x for x in (*out, self.text[start:end]) if x.strip()]

    def around(self, place: int) -> tuple[str, list[str]]:
        """The innermost named function around a place, and its parameters."""
        for body, end, name, params in reversed(self.functions[: bisect_right(self.starts, place)]):
            if body <= place < end:
                return name, params
        return "", []


def parts_of(text: str, params: list[str]) -> Parts:
    """An expression as a template; what is no text, name or sum of such is a name ``value``."""
    out: Parts = []
    at = 0
    while True:
        m = _ATOM.match(text, at)
        if m is None:
            return [{"kind": "ref", "text": "value"}] if text.strip() else []
        at = m.end()
        if m["tick"]:
            end = _template(text, at, params, out)
            if end < 0:
                return [{"kind": "ref", "text": "value"}]
            at = end
        elif m["q"] or m["number"]:
            out += _lit(m["text"] if m["q"] else m["number"])
        elif m["open"] or m["call"]:
            depth, stop = 1, at
            while stop < len(text) and depth:
                depth += (text[stop] in "([{") - (text[stop] in ")]}")
                stop += 1
            inner = parts_of(text[at : stop - 1], params)
            out += inner if m["open"] or (m["name"] in ("encodeURIComponent", "String", "encodeURI") and len(inner) == 1) else [{"kind": "ref", "text": re.split(r"[.?!]", m["name"])[-1] or "value"}]
            at = stop
        else:
            name = re.sub(r"[?!]\.", ".", m["name"])
            out.append({"kind": "param", "text": f"{params.index(name)}:{name}"} if name in params else {"kind": "ref", "text": name})
        rest = re.compile(r"\s*(?:!|as\s+[\w$<>\[\]. |]+)?\s*(\+(?!\+))?\s*").match(text, at)
        at = rest.end()
        if at >= len(text):
            return out
        if not rest[1]:
            return [{"kind": "ref", "text": "value"}]


def _template(text: str, at: int, params: list[str], out: Parts) -> int:
    """Adds a template literal's parts; the place behind it, or -1."""
    start = at
    while at < len(text):
        if text[at] == "\\":
            at += 2
        elif text[at] == "`":
            out += _lit(text[start:at])
            return at + 1
        elif text.startswith("${", at):
            out += _lit(text[start:at])
            depth, stop = 1, at + 2
            while stop < len(text) and depth:
                depth += (text[stop] == "{") - (text[stop] == "}")
                stop += 1
            out += parts_of(text[at + 2 : stop - 1], params)
            start = at = stop
        else:
            at += 1
    return -1


def _option(s: Script, args: list[str], key: str, params: list[str]) -> Parts | None:
    """The value of a key in an object among the arguments."""
    for a in args:
        if a.strip().startswith("{"):
            m = re.search(rf"(?:^|[{{,])\s*{key}\s*(?::\s*(?P<v>[^,}}\n]*(?:\$\{{[^}}]*\}}[^,}}\n]*)*)|(?=[,}}]))", a)
            if m:
                value = m["v"] if m["v"] is not None else key
                other = re.search(r"(?:\|\||\?\?)\s*([\"']\w+[\"'])\s*$", value)  # what it is unless it is given
                return parts_of(other[1] if other else value, params)
    return None


def client_facts(text: str, language: str) -> Iterator[tuple]:
    """kind, name, owner, line, method, parts, args of constants, functions, aliases, sinks and calls in a script."""
    s = Script(text, language)
    for _, _, name, _ in s.functions:
        yield "function", name, "", 0, None, None, None
    for m in s.found(_CONSTANT):
        if not s.around(m.start())[0]:
            value = text[m.end() : s.statement(m.end())]
            parts = parts_of(value, [])
            if parts and parts != [{"kind": "ref", "text": "value"}]:
                yield "constant", (s.owner_of(m.start()) + "." if s.owner_of(m.start()) else "") + m["name"], "", s.lines.of(m.start()), None, parts, None
    for m in s.found(_PROPERTY):
        place = m.start("name")
        owner = s.owner_of(place)
        if owner and not s.around(place)[0]:
            yield "constant", f"{owner}.{m['name']}", "", s.lines.of(place), None, parts_of(text[m.end() : s.statement(m.end())], []), None
    for m in s.found(_ALIAS):
        name, to = (m["name"], m["class"]) if m["name"] else ("default", m["made"] or m["given"] or m["old"])
        if to not in ("async", "function", "class", "new"):
            yield "alias", name, to, s.lines.of(m.start()), None, None, None
    for m in s.found(_INSTANCE):
        b = s.at.get(m.end() - 1)
        prefix = b and next((p for k in ("baseURL", "prefixUrl", "prefix") if (p := _option(s, s.split(b.body, b.end), k, []))), None)
        for verb in VERBS if b else []:
            yield "sink", "", f"{m['name']}.{verb}", s.lines.of(m.start()), _lit(verb.upper()), [*(prefix or []), {"kind": "param", "text": "0:url"}], None
    for m in s.found(_CALL):
        name = m["name"].replace("?.", ".")
        b = s.at.get(m.end() - 1)
        if name in _KEYWORDS or b is None or re.search(r"\bfunction\s*\*?\s*$", text[max(0, m.start() - 20) : m.start()]):
            continue
        owner, params = s.around(m.start())
        args, line = s.split(b.body, b.end), s.lines.of(m.start())
        root, _, verb = name.rpartition(".")
        if name in FETCHERS and args:
            url = _option(s, args[:1], "url", params) if args[0].strip().startswith("{") else parts_of(args[0], params)
            if url:
                yield "sink", label(name), owner, line, _option(s, args, "method", params) or _lit("GET"), url, None
        elif root in CLIENTS and verb in VERBS and args:
            yield "sink", label(root), owner, line, _lit(verb.upper()), parts_of(args[0], params), None
        elif args and len(args) <= 8:
            if name.startswith("this."):
                of = owner.rpartition(".")[0]
                name = f"{of}.{name[5:]}" if of else name
            yield "call", name, owner, line, None, None, [parts_of(a, params) for a in args]


def scan_clients(files: DataFrame) -> DataFrame:
    """``CLIENT_FACTS`` of all script files but tests."""
    names = [re.match(r"\w+", c)[0] for c in re.split(r", (?=\w+ )", CLIENT_FACTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                some = b.slice(k, 64)
                rows = [(path, *r) for path, language, content in zip(*(some.column(c).to_pylist() for c in ("path", "language", "content")), strict=True) for r in client_facts(content, language)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_FACT_TYPES)], names)

    src = files.filter(F.col("language").isin(*SCRIPTS) & ~F.col("role").isin("test", "generated", "sample") & F.col("content").isNotNull())
    return arrow_ready(src.select("path", "language", "content")).mapInArrow(run, CLIENT_FACTS)


def _put_in(parts: Column, known: Column) -> Column:
    """``parts`` with the names that the map ``known`` has replaced by their templates."""
    return F.flatten(F.transform(parts, lambda p: F.when(p.kind == "ref", F.coalesce(F.try_element_at(known, p.text), F.array(p))).otherwise(F.array(p))))


def _open(parts: Column) -> Column:
    return F.exists(parts, lambda p: p.kind == "ref")


def constants(facts: DataFrame, names: DataFrame) -> DataFrame:
    """path, known (map of a name to its template): the constants that can be seen in each file and have no open names."""
    own = facts.filter("kind = 'constant'").groupBy("path", "name").agg(F.min_by("parts", "line").alias("parts"))
    own = stored(own, "constants")
    closed, left = own.filter(~_open(F.col("parts"))), own.filter(_open(F.col("parts")))

    def seen(known: DataFrame) -> DataFrame:
        first, rest = F.substring_index("name", ".", 1), F.expr("substr(name, length(substring_index(name, '.', 1)) + 1)")
        there = known.select(F.col("path").alias("target"), first.alias("symbol"), rest.alias("rest"), "parts")
        taken = names.filter("symbol is not null").join(there, ["target", "symbol"]).select("path", F.concat("variable", "rest").alias("name"), "parts")
        whole = names.filter("symbol is null").join(known.select(F.col("path").alias("target"), "name", "parts"), "target").select("path", F.concat_ws(".", "variable", "name").alias("name"), "parts")
        all_ = union_all([known.select("path", "name", "parts"), taken, whole]).groupBy("path", "name").agg(F.min("parts").alias("parts"))
        return all_.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("name", "parts"))).alias("known"))

    while not left.isEmpty():
        tried = stored(left.join(seen(closed), "path", "left").select("path", "name", F.when(F.col("known").isNull(), F.col("parts")).otherwise(_put_in(F.col("parts"), F.col("known"))).alias("parts")), "constants")
        new = tried.filter(~_open(F.col("parts")))
        if new.isEmpty():  # only names of nothing, or of each other, are left
            break
        closed, left = stored(closed.unionByName(new), "closed"), tried.filter(_open(F.col("parts")))
    return seen(closed)


def visible_names(raw: DataFrame, files: DataFrame) -> DataFrame:
    """path, variable, target, symbol: names that files take from others; symbol is null for whole files."""
    scripts = raw.filter("family = 'binding'")
    whole = bindings(raw, files).select("path", "variable", "target", F.lit(None).cast("string").alias("symbol"))
    default = scripts.filter("label = 'import'").select("path", F.col("subject").alias("variable")).distinct().withColumn("is", F.lit(True))
    whole = whole.join(default, ["path", "variable"], "left").withColumn("symbol", F.when(F.col("is"), F.lit("default"))).drop("is")
    return whole.unionByName(_named_bindings(raw, files)).distinct()


def call_edges(facts: DataFrame, names: DataFrame) -> DataFrame:
    """path, owner, line, callee, args, target, function: calls resolved to functions of the same or another file."""
    calls = facts.filter("kind = 'call'").select("path", "owner", "line", F.col("name").alias("callee"), "args")
    functions = facts.filter("kind = 'function' or (kind = 'sink' and name = '')").select(F.col("path").alias("target"), F.when(F.col("kind") == "sink", F.col("owner")).otherwise(F.col("name")).alias("function")).distinct()
    aliases = facts.filter("kind = 'alias'").select("path", F.col("name").alias("symbol"), F.col("owner").alias("stands_for")).distinct()
    root, rest = F.substring_index("callee", ".", 1), F.expr("substr(callee, length(substring_index(callee, '.', 1)) + 1)")
    calls = calls.withColumn("root", root).withColumn("rest", rest)
    local = calls.select("*", F.col("path").alias("target"), F.col("root").alias("symbol"))
    named = calls.join(names.withColumnRenamed("variable", "root"), ["path", "root"])
    member = F.regexp_extract("rest", r"^\.([\w$#]+)", 1)
    taken = named.filter("symbol is not null")
    within = named.filter("symbol is null and rest <> ''").withColumn("symbol", member).withColumn("rest", F.expr(r"regexp_replace(rest, '^[.][^.]+', '')"))
    bare = named.filter("symbol is null and rest = ''").withColumn("symbol", F.lit("default"))
    cols = ["path", "owner", "line", "callee", "args", "target", "symbol", "rest"]
    seen = stored(union_all([x.select(*cols) for x in (local, taken, within, bare)]), "callees")
    for _ in range(2):  # default -> an object made of a class -> the class
        other = seen.join(aliases.withColumnRenamed("path", "target"), ["target", "symbol"], "left")
        seen = other.withColumn("symbol", F.explode(F.array_compact(F.array_distinct(F.array("symbol", "stands_for"))))).select(*cols).distinct()
    edges = seen.withColumn("function", F.concat("symbol", "rest")).join(functions, ["target", "function"])
    return edges.select("path", "owner", "line", "callee", "args", "target", "function")


def wrapped_calls(files: DataFrame, raw: DataFrame) -> DataFrame:
    """path, line, client, method, endpoint, through (functions passed), in_wrapper of every call of a client; those in wrappers have parameters left that their callers give."""
    known_files = stored(files.filter("content is not null").select("path", "language", "role"), "paths")
    facts = stored(scan_clients(files), "client-facts")
    names = stored(visible_names(raw, known_files), "names")
    known = stored(constants(facts, names), "known")

    def closed(df: DataFrame, *cols: str) -> DataFrame:
        both = df.join(known, "path", "left")
        return both.select(*[F.when(F.col("known").isNull(), F.col(c)).otherwise(_put_in(F.col(c), F.col("known"))).alias(c) if c in cols else F.col(c) for c in df.columns])

    sinks = closed(facts.filter("kind = 'sink'").select("path", F.col("owner").alias("function"), "line", F.col("name").alias("client"), "method", "parts"), "method", "parts")
    edges = call_edges(facts, names).join(known, "path", "left")
    edges = stored(edges.withColumn("args", F.when(F.col("known").isNull(), F.col("args")).otherwise(F.transform("args", lambda a: _put_in(a, F.col("known"))))).drop("known"), "call-edges")

    has_params = F.exists(F.concat("method", "parts"), lambda p: p.kind == "param")
    start = sinks.withColumn("through", F.array(F.concat_ws("#", "path", "function"))).withColumn("in_wrapper", has_params & (F.col("function") != ""))
    delta = stored(start, "sinks")
    out = [delta]

    def given(parts: str) -> Column:
        return F.flatten(F.transform(parts, lambda p: F.when(p.kind == "param", F.coalesce(F.get("args", F.substring_index(p.text, ":", 1).cast("int")), F.array(F.struct(F.lit("ref").alias("kind"), F.substring_index(p.text, ":", -1).alias("text"))))).otherwise(F.array(p))))

    while True:
        wrappers = delta.filter("in_wrapper").select(F.col("path").alias("target"), "function", "method", "parts", "through")
        if wrappers.isEmpty():
            break
        met = edges.join(wrappers, ["target", "function"])
        here = F.concat_ws("#", "path", "owner")
        met = met.filter((F.col("owner") == "") | ~F.array_contains("through", here))
        new = met.select("path", F.col("owner").alias("function"), "line", F.col("callee").alias("client"), given("method").alias("method"), given("parts").alias("parts"), F.concat("through", F.array(here)).alias("through"))
        delta = stored(new.withColumn("in_wrapper", has_params & (F.col("function") != "")).distinct(), "sinks")
        out.append(delta)
    called = edges.select(F.col("target").alias("path"), "function").distinct().withColumn("called", F.lit(True))
    both = union_all(out).join(called, ["path", "function"], "left").withColumn("in_wrapper", F.col("in_wrapper") & F.coalesce("called", F.lit(False)))
    text = F.array_join(F.transform("parts", lambda p: F.when(p.kind == "lit", p.text).otherwise(F.concat(F.lit("${"), F.element_at(F.split(p.text, "[.:]"), -1), F.lit("}")))), "")
    endpoint = F.regexp_replace(F.regexp_replace(text, r"^\$\{[^}]*\}(?=/)", ""), r"(?<=/)\$\{([^}]*)\}(?=$|[/?#])", ":$1")
    method = F.upper(F.array_join(F.transform("method", lambda p: F.when(p.kind == "lit", p.text)), ""))
    rows = both.select("path", "line", "client", F.when(method != "", method).alias("method"), endpoint.alias("endpoint"), "through", "in_wrapper").filter("client <> ''")
    return rows.filter(F.col("in_wrapper") | F.col("endpoint").rlike(r"^(/|https?://)")).distinct()


def resolved_api_calls(files: DataFrame, raw: DataFrame) -> DataFrame:
    """path, endpoint, method, client, line, evidence: the calls that rules find, but for lines of wrappers or better known ones, and the resolved ones."""
    found = stored(wrapped_calls(files, raw), "wrapped-calls")
    ruled = api_calls(files, raw).select("path", "endpoint", "method", "client", "line", "evidence")
    known = found.select("path", "line").distinct()
    calls = found.filter("not in_wrapper").select("path", "endpoint", "method", "client", "line").distinct().withColumn("evidence", evidence("api-call"))
    return ruled.join(known, ["path", "line"], "left_anti").unionByName(calls)
