"""API contracts: what a route reads, answers and fails with, from the text around it.

A route's text is the lines from its own to the next route of its framework in the file, or ``WINDOW`` lines, and the body of its
handler where the file defines it.  The hints to look for are rows of a table, as extraction rules are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from http import HTTPStatus
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import arrow_ready

WINDOW = 80
#: shorter texts of frameworks whose routes are listed one a line (fixed values)
SHORT_WINDOWS = {"axum": 8, "warp": 8}
GO, DJANGO = "gin echo chi fiber net-http", "django drf"


class Hint(NamedTuple):
    frameworks: str
    kind: str  # request, response, status or error
    pattern: str
    text: str  # {0}, {1}: the pattern's groups
    unless: str = ""  # a hint that begins so says more


#: (fixed values: the hints' texts)
HINTS = [
    Hint("express next", "request", r"\breq\.params\.([A-Za-z_$][\w$]*)", "path:req.params.{0}"),
    Hint("express next", "request", r"\breq\.query\.([A-Za-z_$][\w$]*)", "query:req.query.{0}"),
    Hint("express", "request", r"\breq\.body\.([A-Za-z_$][\w$]*)", "body:req.body.{0}"),
    Hint("express", "request", r"\breq\.body\b", "body:req.body", "body:req.body."),
    Hint("express", "response", r"\bres(?:\.status\([^)]*\))?\.(json|send|render)\b", "response:res.{0}"),
    Hint("express", "status", r"\bres\.status\(\s*(\d{3})\s*\)", "{0}"),
    Hint("fastify", "request", r"\b(req|request)\.(?:params)(?:\.|\[[\"'])([A-Za-z_$][\w$]*)", "path:{0}.params.{1}"),
    Hint("fastify", "request", r"\b(req|request)\.query\.([A-Za-z_$][\w$]*)", "query:{0}.query.{1}"),
    Hint("fastify", "request", r"\b(req|request)\.body\.([A-Za-z_$][\w$]*)", "body:{0}.body.{1}"),
    Hint("fastify", "response", r"\b(reply|res|this)(?:\.(?:code|status)\([^)]*\))?\.(send|sendFile|json|redirect|type|header)\s*\(", "response:{0}.{1}"),
    Hint("fastify", "response", r"\breturn\s+\{", "response:return-object"),
    Hint("fastify", "status", r"\b(?:reply|res|this)\.(?:code|status)\(\s*(\d{3})\s*\)", "{0}"),
    Hint("koa", "request", r"\bctx\.params\.(\w+)", "path:ctx.params.{0}"),
    Hint("koa", "request", r"\bctx\.query\.(\w+)", "query:ctx.query.{0}"),
    Hint("koa", "request", r"\bctx\.request\.body\b", "body:ctx.request.body"),
    Hint("koa", "request", r"\bctx\.state\.user\b", "auth:ctx.state.user"),
    Hint("koa", "response", r"\bctx\.body\s*=", "response:ctx.body"),
    Hint("koa", "response", r"\bctx\.redirect\s*\(", "response:ctx.redirect"),
    Hint("koa strapi", "status", r"\bctx\.status\s*=\s*(\d{3})", "{0}"),
    Hint("koa", "status", r"\bctx\.throw\(\s*(\d{3})", "{0}"),
    Hint("hapi", "request", r"\brequest\.params\.(\w+)", "path:request.params.{0}"),
    Hint("hapi", "request", r"\brequest\.query\.(\w+)", "query:request.query.{0}"),
    Hint("hapi", "request", r"\brequest\.payload\b", "body:request.payload"),
    Hint("hapi", "request", r"\brequest\.auth\.credentials\b", "auth:request.auth.credentials"),
    Hint("hapi", "response", r"\b(?:h\.response|reply)\(", "response:reply"),
    Hint("hapi", "status", r"\.code\(\s*(\d{3})\s*\)", "{0}"),
    Hint("hono", "request", r"\bc\.req\.param\(\s*[\"']([^\"']+)", "path:c.req.param.{0}"),
    Hint("hono", "request", r"\bc\.req\.query\(\s*[\"']([^\"']+)", "query:c.req.query.{0}"),
    Hint("hono", "request", r"\bc\.req\.json\b", "body:c.req.json"),
    Hint("hono", "response", r"\b(?:return\s+)?c\.(json|text)\(", "response:c.{0}"),
    Hint("hono", "status", r"\bc\.(?:json|text|body)\([^\n]*,\s*(\d{3})\s*\)", "{0}"),
    Hint("hono", "status", r"\bHttpStatusCodes\.([A-Z][A-Z0-9_]*)", "{0}"),
    Hint("next next-app", "request", r"\b(?:request|req)\.json\(\)", "body:request.json"),
    Hint("next next-app", "request", r"\bsearchParams\b", "query:searchParams"),
    Hint("next next-app", "response", r"\b(NextResponse|Response|res)\.json\b", "response:{0}.json"),
    Hint("next next-app", "status", r"\bstatus\s*[:=]\s*(\d{3})", "{0}"),
    Hint("react-router remix", "request", r"\brequest\.formData\b", "body:formData"),
    Hint("react-router remix", "request", r"\bformData\.get\(\s*[\"']([^\"']+)", "form:{0}"),
    Hint("react-router remix", "request", r"\bsearchParams\.get\(\s*[\"']([^\"']+)", "query:{0}"),
    Hint("react-router remix", "request", r"\b(requireUserId|getUserId)\(request\)", "auth:{0}"),
    Hint("react-router remix", "response", r"\breturn\s+(json|redirect)\(", "response:{0}"),
    Hint("react-router remix", "status", r"\bstatus:\s*(\d{3})", "{0}"),
    Hint("nestjs", "request", r"@Body\([^)]*\)\s*\w+\s*:\s*([\w<>\[\]]+)", "body:{0}"),
    Hint("nestjs", "request", r"@(?:Param)\(\s*[\"'](\w+)", "path:{0}"),
    Hint("nestjs", "request", r"@(?:Query)\(\s*[\"'](\w+)", "query:{0}"),
    Hint("nestjs", "request", r"@UseGuards\b", "auth:@UseGuards"),
    Hint("nestjs", "response", r"\)\s*:\s*([\w<>\[\]]+)\s*\{", "return:{0}"),
    Hint("nestjs", "response", r"\bthis\.(\w*[sS]ervice)\.(\w+)\(", "service-call:{0}.{1}"),
    Hint("nestjs", "status", r"@HttpCode\(\s*(?:HttpStatus\.)?(\w+)\s*\)", "{0}"),
    Hint("adonisjs", "request", r"\brequest\.param\(\s*[\"']([^\"']+)", "path:request.param.{0}"),
    Hint("adonisjs", "request", r"\brequest\.input\(\s*[\"']([^\"']+)", "body:request.input.{0}"),
    Hint("adonisjs", "request", r"\bauth\.user\b", "auth:auth.user"),
    Hint("adonisjs", "response", r"\bview\.render\(\s*[\"']([^\"']+)", "view:{0}"),
    Hint("adonisjs", "response", r"\bresponse\.redirect\b", "response:redirect"),
    Hint("adonisjs", "status", r"\bresponse\.status\(\s*(\d{3})", "{0}"),
    Hint("sails", "request", r"\breq\.param\(\s*[\"']([^\"']+)", "path:req.param.{0}"),
    Hint("sails", "request", r"\bmatched\b|\breq\.allParams\(\)", "request:req.allParams"),
    Hint("sails", "response", r"\bexits\.success\b", "response:exits.success"),
    Hint("sails", "response", r"\bres\.(json|send)\b", "response:res.{0}"),
    Hint("sails", "status", r"\bstatusCode:\s*(\d{3})", "{0}"),
    Hint("loopback", "request", r"@requestBody\b", "body:requestBody"),
    Hint("loopback", "request", r"@param\.(?:filter)\(\s*(\w+)", "query-filter:{0}"),
    Hint("loopback", "response", r"@response\(\s*\d{3}|\bgetModelSchemaRef\(\s*(\w+)", "response-schema:{0}"),
    Hint("loopback", "status", r"@response\(\s*(\d{3})", "{0}"),
    Hint("feathers", "request", r"\b(?:context\.)?data\.(\w+)", "body:data.{0}"),
    Hint("feathers", "response", r"\bapp\.service\(\s*[\"']([^\"']+)", "service-call:{0}"),
    Hint("strapi", "response", r"\bctx\.body\s*=", "response:ctx.body"),
    Hint("strapi", "response", r"\bcreateCore(?:Router|Controller)\(", "response:strapi-core-entity"),
    Hint("fastapi", "response", r"\bresponse_model\s*=\s*([A-Za-z_][\w.]*)", "response_model:{0}"),
    Hint("fastapi", "status", r"\bstatus_code\s*=\s*(?:status\.)?(\d{3}|HTTP_\d{3}_[A-Z_]+)", "{0}"),
    Hint("flask", "request", r"\brequest\.args\.get\(\s*[\"']([^\"']+)[\"']", "query:request.args.{0}"),
    Hint("flask", "request", r"\brequest\.args\b", "query:request.args", "query:request.args."),
    Hint("flask", "request", r"\brequest\.(json|get_json)\b", "body:request.{0}"),
    Hint("flask", "response", r"\bjsonify\(", "response:jsonify"),
    Hint("flask", "response", r"\breturn\s+render_template\(", "response:render_template"),
    Hint("flask", "status", r"\breturn\b[^\n]{0,120},\s*(\d{3})\b", "{0}"),
    Hint(DJANGO, "request", r"\brequest\.(body|data)\b", "body:request.{0}"),
    Hint(DJANGO, "request", r"\brequest\.POST\b", "form:request.POST"),
    Hint(DJANGO, "request", r"\bkwargs\[\s*[\"'](\w+)", "path:kwargs.{0}"),
    Hint(DJANGO, "response", r"\breturn\s+(render|redirect)\(", "response:{0}"),
    Hint(DJANGO, "response", r"\breturn\s+(JsonResponse|HttpResponse\w*|Response)\(", "response:{0}"),
    Hint(DJANGO, "status", r"\bstatus\s*=\s*(?:status\.)?(\d{3}|HTTP_\d{3}_[A-Z_]+)", "{0}"),
    Hint("sinatra", "request", r"\bparams\[\s*[:\"'](\w+)", "param:params.{0}"),
    Hint("sinatra", "request", r"\bparams\b", "param:params", "param:params."),
    Hint("sinatra", "response", r"\.to_json\b", "return:json"),
    Hint("sinatra", "response", r"\bsend_file\b", "response:send_file"),
    Hint("sinatra", "status", r"\b(?:status|halt)[ (]\s*(\d{3})\b", "{0}"),
    Hint("grape", "response", r"\b(present|header|content_type)\s", "response:{0}"),
    Hint("grape", "status", r"\b(?:status|error!\([^,\n]+,)\s*(\d{3})", "{0}"),
    Hint("rails", "request", r"\bparams\[\s*[:\"'](\w+)", "param:params.{0}"),
    Hint("rails", "response", r"\brender\s+(json|html|plain|xml):", "response:render.{0}"),
    Hint("rails", "response", r"\bredirect_to\b", "response:redirect_to"),
    Hint("rails", "status", r"\bstatus:\s*(\d{3}|:\w+)", "{0}"),
    Hint("spring micronaut", "request", r"@(?:RequestBody|Body)\s+(?:@\w+\s+)*([\w<>\[\], ?.]+?)\s+\w+\s*[,)]", "body:{0}"),
    Hint("spring", "request", r"@PathVariable(?:\([^)]*\))?\s+[\w<>.]+\s+(\w+)", "path:{0}"),
    Hint("spring", "request", r"@RequestParam(?:\([^)]*\))?\s+[\w<>.]+\s+(\w+)", "query:{0}"),
    Hint("spring micronaut jax-rs", "response", r"\b(?:public|protected)\s+(?!class\b)(?:static\s+)?([\w<>\[\], ?.]+?)\s+\w+\s*\(", "return:{0}"),
    Hint("spring", "status", r"@ResponseStatus\s*\(\s*(?:\w+\s*=\s*)?(?:HttpStatus\.)?([A-Z_]+|\d{3})", "{0}"),
    Hint("ktor", "request", r"\bcall\.receive<([^>]+)>", "body:{0}"),
    Hint("ktor", "request", r"\bcall\.receiveMultipart\(", "body:multipart"),
    Hint("ktor", "request", r"\bcall\.receiveParameters\(", "form:Parameters"),
    Hint("ktor", "request", r"\bcall\.receiveText\(", "body:text"),
    Hint("ktor", "request", r"\bqueryParameters\[\s*\"(\w+)", "query:{0}"),
    Hint("ktor", "request", r"\bcall\.parameters\[\s*\"(\w+)", "path:{0}"),
    Hint("ktor", "response", r"\bcall\.(respond\w*)\(", "response:{0}"),
    Hint("ktor", "status", r"\bHttpStatusCode\.(\w+)", "{0}"),
    Hint(GO, "request", r"\b\w+\.(?:Param|PathValue)\(\s*\"([^\"]+)\"", "path:{0}"),
    Hint(GO, "request", r"\bchi\.URLParam\([^,\n]+,\s*\"([^\"]+)\"", "path:{0}"),
    Hint(GO, "request", r"\b\w+\.(?:Query|DefaultQuery|QueryParam)\(\s*\"([^\"]+)\"", "query:{0}"),
    Hint(GO, "request", r"\b(?:ShouldBindJSON|BindJSON|ShouldBind|Bind|BodyParser)\(\s*&?(\w+)", "body:{0}"),
    Hint(GO, "response", r"\bgin\.H\{\s*\"(\w+)\"", "response-key:{0}"),
    Hint(GO, "response", r"@Success\s+\d{3}\s+\{\w+\}\s+([\w.]+)", "swagger-success:{0}"),
    Hint(GO, "response", r"\bc\.(JSON|String|HTML|XML|Data|Redirect|SendString)\(", "response:c.{0}"),
    Hint(GO, "status", r"\bhttp\.Status(\w+)", "{0}"),
    Hint(GO, "status", r"\.(?:JSON|String|Status|AbortWithStatus|WriteHeader)\(\s*(\d{3})", "{0}"),
    Hint("axum rocket actix actix-web", "request", r"\bJson<([^>]+)>", "body:Json<{0}>"),
    Hint("axum actix actix-web", "request", r"\bQuery<([^>]+)>", "query:{0}"),
    Hint("axum", "request", r"\bPath<([^>]+)>", "path:{0}"),
    Hint("actix actix-web", "request", r"\bPath<([^>]+)>", "path-model:{0}"),
    Hint("axum rocket", "request", r"\bState<([^>]+)>", "context:State<{0}>"),
    Hint("actix actix-web", "request", r"\bData<([^>]+)>", "context:Data<{0}>"),
    Hint("axum rocket actix actix-web warp", "response", r"->\s*([^\n{]+?)\s*\{", "return:{0}"),
    Hint("actix actix-web", "response", r"\bHttpResponse::(\w+)", "response:HttpResponse::{0}"),
    Hint("axum warp", "status", r"\bStatusCode::([A-Z_]+)", "{0}"),
    Hint("actix actix-web", "status", r"\bHttpResponse::(Ok|Created|NoContent|BadRequest|Unauthorized|Forbidden|NotFound|Conflict|InternalServerError)\b", "{0}"),
    Hint("rocket", "status", r"\bStatus::(\w+)", "{0}"),
    Hint("warp", "response", r"\bwarp::reply::json\b", "response:json"),
    Hint("vapor", "request", r"\bparameters\.get\(\s*\"(\w+)", "path:{0}"),
    Hint("vapor", "request", r"\bcontent\.decode\(\s*(\w+)\.self", "body:{0}"),
    Hint("vapor", "response", r"->\s*([^\n{]+?)\s*(?:in\b|\{)", "return:{0}"),
    Hint("vapor", "status", r"\bAbort\(\s*\.(\w+)", "{0}"),
    Hint("aspnetcore", "request", r"\[FromBody\]\s*(\w+)", "body:{0}"),
    Hint("aspnetcore", "request", r"\[FromQuery[^\]]*\]\s*\w+\??\s+(\w+)", "query:{0}"),
    Hint("aspnetcore", "response", r"\bpublic\s+(?:async\s+)?([\w<>\[\], ?.]+?)\s+\w+\s*\(", "return:{0}"),
    Hint("aspnetcore", "status", r"\b(Ok|Created|NoContent|BadRequest|Unauthorized|Forbid|NotFound|Conflict)\(", "{0}"),
    Hint("laravel", "request", r"\$request->(?:input|get|query)\(\s*[\"'](\w+)", "body:{0}"),
    Hint("laravel", "response", r"\bresponse\(\)->(json|view|download)", "response:{0}"),
    Hint("laravel", "response", r"\breturn\s+view\(\s*[\"']([^\"']+)", "view:{0}"),
    Hint("laravel", "status", r"\b(?:abort|response)\([^)\n]*?(\d{3})\s*\)", "{0}"),
    Hint("phoenix", "response", r"\b(render|json|redirect)\(\s*conn", "response:{0}"),
    Hint("phoenix", "status", r"\bput_status\(\s*(?:conn,\s*)?:?(\w+)", "{0}"),
]

#: framework -> words that tell of errors (fixed values)
ERRORS = {
    "express": ["next(", "throw new", ".catch("],
    "fastify": ["throw ", "httpErrors.", "reply.callNotFound", ".catch("],
    "koa": ["ctx.throw", "ctx.assert", "ValidationError", "throw new", ".catch("],
    "hapi": ["Boom.", "constructErrorResponse", "throw new", ".catch("],
    "hono": ["throw ", "HTTPException", "c.notFound", "notFound"],
    "adonisjs": ["throw ", "findByOrFail", "abort", "session.flashMessages.set"],
    "loopback": ["HttpErrors", "throw new", "reject(", ".catch("],
    "feathers": ["ferrors.", "errors.", "throw new", ".catch("],
    "strapi": ["ctx.throw", "ApplicationError", "ValidationError", "NotFoundError"],
    "fastapi": ["HTTPException", "raise "],
    "flask": ["abort(", "raise "],
    "sinatra": ["halt", "raise "],
    "grape": ["error!", "raise"],
    "spring": ["throw new", "@ExceptionHandler"],
    "ktor": ["throw ", "BadRequestException", "NotFoundException", "StatusPages"],
    "next": ["throw new", "NextResponse.error", "Response.error"],
    "next-app": ["throw new", "NextResponse.error", "Response.error"],
    "react-router": ["throw new Response", "invariant("],
    "remix": ["throw new Response", "invariant("],
    "nestjs": ["throw new", "HttpException", "NotFoundException", "BadRequestException"],
    "gin": ["Abort(", "AbortWithError(", "panic(", "NewError("],
    "echo": ["Abort(", "AbortWithError(", "panic(", "NewError("],
    "chi": ["Abort(", "AbortWithError(", "panic(", "NewError("],
    "fiber": ["Abort(", "AbortWithError(", "panic(", "NewError("],
    "net-http": ["Abort(", "AbortWithError(", "panic(", "NewError("],
    "axum": ["Error::", "anyhow::", "ok_or(", "bail!("],
    "actix": ["Error::", "ResponseError", "error_response()", ".from_err()"],
    "rocket": ["Errors::", "Status::", "?"],
    "warp": ["ErrorResponse", "StatusCode::", "?"],
    "vapor": ["Abort", "fatalError", "throw ", "ValidationError"],
    "django": ["Http404", "PermissionDenied", "ValidationError", "raise "],
    "drf": ["Http404", "PermissionDenied", "ValidationError", "raise "],
}
#: annotations of values that are no request body (fixed values)
PRIMITIVES = ["str", "int", "float", "bool", "bytes", "date", "datetime", "UUID", "Any", "None", "list", "dict", "List", "Dict", "Optional", "Union", "Query", "Path", "Header", "Annotated"]
KINDS = ["request", "response", "status", "error"]
DETAILS = "method string, path string, framework string, ord string, request_hints array<string>, response_hints array<string>, status_codes array<string>, error_hints array<string>"
_CODES = {s.name.replace("_", "").lower(): str(s.value) for s in HTTPStatus} | {"forbid": "403"}
_DEFINED = r"(?:^|[^\w.])(?:def|function|func|fn|fun|const|let|var)\s+(?:\([^)]*\)\s*)?{0}\b|^\s*(?:public|private|protected|async|static|\s)*(?:[\w<>\[\]]+\s+)?{0}\s*\([^)\n]*\)\s*(?::[^\n{{]+)?\{{"


def status_code(found: str) -> str:
    """A status by its number, from any framework's way to write it."""
    number = re.search(r"\d{3}", found)
    return number[0] if number else _CODES.get(re.sub(r"[^A-Za-z]", "", found).lower(), found)


def body_of(lines: list[str], name: str) -> list[str]:
    """The lines of the function ``name``: from its definition on, as long as they are indented more, blank or closing."""
    defined = re.compile(_DEFINED.replace("{0}", re.escape(name)).replace("{{", "{").replace("}}", "}"))
    for k, line in enumerate(lines):
        if defined.search(line):
            margin = len(line) - len(line.lstrip())
            end = k + 1
            while end < len(lines) and end - k < WINDOW and (not lines[end].strip() or len(lines[end]) - len(lines[end].lstrip()) > margin or lines[end].lstrip()[0] in ")}]"):
                end += 1
            return lines[k:end]
    return []


def signature(text: str, handler: str, route: str) -> list[str]:
    """Hints of a Python handler's parameters: in the route's path, of a class, or of the query."""
    head = re.search(rf"\bdef\s+{re.escape(handler)}\s*\(", text)
    if not head:
        return []
    depth, at, cuts = 1, head.end(), [head.end() - 1]
    while at < len(text) and depth:
        depth += (text[at] in "([{") - (text[at] in ")]}")
        if not depth or (depth == 1 and text[at] == ","):
            cuts.append(at)
        at += 1
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        name, _, kind = text[a + 1 : b].partition("=")[0].partition(":")
        name, kind = name.strip().lstrip("*"), kind.strip()
        if not name or name in ("self", "request"):
            continue
        classes = [x for x in re.findall(r"[A-Za-z_]\w*", kind) if x[0].isupper() and x not in PRIMITIVES]
        where = "path" if re.search(rf"\{{{re.escape(name)}(:[^}}]*)?\}}", route) else "body" if classes or "Body(" in text[a:b] else "query"
        out.append(f"{where}:{name}:{kind}" if kind else f"{where}:{name}")
    return out


def details(text: str, framework: str, handler: str | None, route: str) -> dict[str, list[str]]:
    """The hints of one route, by kind, in order and each once."""
    out: dict[str, list[str]] = {k: [] for k in KINDS}
    out["request"] += [f"path:{x}" for x in re.findall(r"[:{<\[](?:\w+:)?([A-Za-z_]\w*)", route)] if framework not in ("express", "koa", "sails") else []
    for h in HINTS:
        if framework in h.frameworks.split() and not (h.unless and any(x.startswith(h.unless) for x in out[h.kind])):
            for m in re.finditer(h.pattern, text, re.MULTILINE):
                found = h.text.format(*(g or "" for g in m.groups())).strip()
                out[h.kind].append(status_code(found) if h.kind == "status" else found)
    if framework == "fastapi" and handler:
        out["request"] += signature(text, handler, route)
    out["error"] += [f"error:{x.rstrip('(')}" for x in ERRORS.get(framework, []) if x in text]
    if framework in ERRORS and re.search(r"\b[45]\d\d\b", text):
        out["error"].append("error:4xx-or-5xx-status")
    return {k: list(dict.fromkeys(x for x in v if x)) for k, v in out.items()}


def contract_details(files: DataFrame, routes: DataFrame) -> DataFrame:
    """``DETAILS`` of each route (method, path, framework, handler, evidence, own_path: as the file has it)."""
    place = F.struct(F.col("evidence.line_start").alias("line"), "framework", "method", F.col("path").alias("route"), "handler")
    by_file = routes.groupBy(F.col("evidence.file").alias("file")).agg(F.array_sort(F.collect_list(place)).alias("routes"))
    own = files.select(F.col("path").alias("file"), "content").join(by_file, "file")
    kinds = [pa.string()] * 4 + [pa.list_(pa.string())] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for file, content, found in zip(*(b.column(c).to_pylist() for c in ("file", "content", "routes")), strict=True):
                lines = (content or "").split("\n")
                for r in found:
                    after = [x["line"] for x in found if x["framework"] == r["framework"] and x["line"] > r["line"]]
                    end = min([r["line"] - 1 + SHORT_WINDOWS.get(r["framework"], WINDOW), *(x - 1 for x in after)])
                    window = lines[r["line"] - 1 : end]
                    name = re.split(r"[.:#\\\\@]", r["handler"] or "")[-1].strip("'\" ")
                    window = window + (body_of(lines, name) if name.isidentifier() and name not in "\n".join(window[1:]) else [])
                    d = details("\n".join(window), r["framework"], name or None, r["route"])
                    rows.append((r["method"], r["route"], r["framework"], f"{file}:{r['line']:09d}", *(d[k] for k in KINDS)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in DETAILS.split(", ")])

    return arrow_ready(own).mapInArrow(run, DETAILS)
