"""Extraction rules as rows of a table: no code per framework.

A rule gives a fact family, a label (framework, client or kind), the languages it reads, a pattern, and which of the
pattern's groups hold the verb, the subject and the detail of the fact; a group named ``owner`` holds what the fact was
declared on, such as a router.  ``span`` is more than 1 if the pattern may run over the ends of lines, however many; it then
matches once from each line.  A rule of one line may match several times in it.  Matches that begin inside a comment or a
string are no facts, unless ``inside`` names what they may begin in.

A rule of the family ``scope`` gives the routes of its label a prefix (the detail, if there is one, else the subject) inside
a block, which its verb tells: ``body`` is the block that the match opens, or else the next one beside it; ``rest`` what is
left of the block around it; ``above`` the block that ends where the match begins.  ``resources``, ``member`` and
``collection`` are bodies whose prefix follows the names of nested resources.
"""

from __future__ import annotations

from typing import NamedTuple

JS, PY, JVM, RB, PHP, GO, CS, RS, EX = "javascript typescript vue svelte", "python", "java kotlin groovy scala", "ruby erb", "php", "go", "csharp razor", "rust", "elixir"
_Q = r"[\"'`]([^\"'`\n]*)[\"'`]"
_VERB = r"(get|post|put|patch|delete|options|head)"
_ON = r"(?P<owner>app|router|server|api|\w*[rR]outer)"
_CALLED = r"[^\n]*\n\s*(?:async\s+)?(?:def|fn|func|function|public|private|protected)\b[^\n(]*?(\w+)\s*\("


class Rule(NamedTuple):
    family: str
    label: str
    languages: str
    pattern: str
    verb: int | str  # a group, or the verb itself
    subject: int
    detail: int = 0
    span: int = 1
    inside: str = ""


RULES = [
    # routes: verb, path, handler
    Rule("route", "express", JS, rf"\b{_ON}\.{_VERB}\(\s*{_Q}(?:\s*,\s*[^,\n]+?)*?\s*(?:,\s*(\w[\w.]*))?\s*\)(?!\s*(?:=>|\{{))", 2, 3, 4),
    Rule("route", "express", JS, rf"\b{_ON}\.{_VERB}\(\s*{_Q}[^\n]*(?:=>\s*|\bfunction\b[^\n{{]*)\{{\s*$", 2, 3),
    Rule("route", "express", JS, rf"\b{_ON}\.all\(\s*{_Q}\s*,\s*(\w[\w.]*)", "ALL", 2, 3),
    Rule("route", "express", JS, rf"\.route\(\s*{_Q}\s*\)\s*\.{_VERB}\(\s*(\w[\w.]*)?", 2, 1, 3),
    Rule("route", "fastify", JS, rf"\bfastify\.{_VERB}\(\s*{_Q}", 1, 2),
    Rule("route", "hapi", JS, r"method:\s*[\"'](\w+)[\"']\s*,\s*path:\s*[\"']([^\"']+)[\"']", 1, 2),
    Rule("route", "hono", JS, rf"\bhono\.{_VERB}\(\s*{_Q}", 1, 2),
    Rule("route", "nestjs", JS, r"@(Get|Post|Put|Patch|Delete|Options|Head|All)\(\s*(?:[\"'`]([^\"'`]*)[\"'`])?\s*\)[^\n]*(?:\n\s*@[^\n]*)*\n\s*(?:public\s+|async\s+)*(\w+)\s*\(", 1, 2, 3, 4),
    Rule("route", "next-app", JS, r"export\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s*(\()", 1, 0, 0),
    Rule("route", "trpc", JS, r"^\s*(\w+):\s*(?:public|protected)?[Pp]rocedure\b", "ANY", 1),
    Rule("route", "fastapi", PY, rf"@{_ON}\.{_VERB}\(\s*{_Q}" + _CALLED, 2, 3, 4, 4),
    Rule("route", "flask", PY, rf"@(?P<owner>\w+)\.route\(\s*{_Q}(?![^\n]*methods)" + _CALLED, "GET", 2, 3, 4),
    Rule("route", "flask", PY, rf"@(?P<owner>\w+)\.route\(\s*{_Q}[^\n]*methods\s*=\s*[\[(]\s*[\"'](\w+)" + _CALLED, 3, 2, 4, 4),
    Rule("route", "django", PY, rf"\b(?:re_)?path\(\s*r?{_Q}\s*,\s*(?!include\b)([\w.]+)", "ANY", 1, 2),
    Rule("route", "aiohttp", PY, rf"\badd_{_VERB}\(\s*{_Q}\s*,\s*([\w.]+)", 1, 2, 3),
    Rule("route", "tornado", PY, r"\(\s*r[\"']([^\"']+)[\"']\s*,\s*(\w+Handler)\b", "ANY", 1, 2),
    Rule("route", "spring", JVM, r"@(Get|Post|Put|Patch|Delete)Mapping\(?\s*(?:(?:value|path)\s*=\s*)?\{?\s*(?:\"([^\"]*)\")?[^\n]*(?:\n\s*@[^\n]*)*\n\s*(?:public|private|protected|suspend|fun|\s)*[\w<>\[\], ?.]*?\b(\w+)\s*\(", 1, 2, 3, 4),
    Rule("route", "spring", JVM, r"@RequestMapping\([^\n]*?\"([^\"]*)\"[^\n]*?method\s*=\s*(?:RequestMethod\.)?(\w+)", 2, 1),
    Rule("route", "jax-rs", JVM, r"@(GET|POST|PUT|DELETE|PATCH)\b[^\n]*\n\s*@Path\(\s*\"([^\"]*)\"\s*\)", 1, 2, 0, 3),
    Rule("route", "ktor", JVM, rf"^\s*{_VERB}\(\s*\"([^\"]*)\"\s*\)\s*\{{", 1, 2),
    Rule("route", "micronaut", JVM, r"@(Get|Post|Put|Delete|Patch)\(\s*(?:uri\s*=\s*)?\"([^\"]*)\"", 1, 2),
    Rule("route", "rails", RB, rf"^\s*{_VERB}\s+[\"']([^\"']+)[\"']\s*(?:,\s*to:|=>)\s*[\"']([^\"']+)[\"']", 1, 2, 3),
    Rule("route", "rails", RB, rf"^\s*{_VERB}\s+:(\w+)\s*(?:,\s*to:\s*[\"']([^\"']+)[\"'])?(?:\s*,\s*on:\s*:\w+)?\s*$", 1, 2, 3),
    Rule("route", "sinatra", RB, rf"^\s*{_VERB}\s+[\"'](/[^\"']*)[\"']\s+do\b", 1, 2),
    Rule("route", "grape", RB, rf"^\s*{_VERB}(?:\s+:(\w+))?\s+do\b", 1, 2),
    Rule("route", "laravel", PHP, rf"Route::{_VERB}\(\s*{_Q}\s*,\s*(?:\[?\s*)([\w\\]+(?:::class\s*,\s*[\"']\w+[\"'])?|[\"'][^\"']+[\"'])", 1, 2, 3),
    Rule("route", "laravel", PHP, rf"Route::any\(\s*{_Q}", "ANY", 1),
    Rule("route", "slim", PHP, rf"\$(?:app|group)->{_VERB}\(\s*{_Q}", 1, 2),
    Rule("route", "symfony", PHP, r"#\[Route\(\s*[\"']([^\"']*)[\"'](?:[^\n]*methods:\s*\[\s*[\"'](\w+))?[^\n]*\n\s*public\s+function\s+(\w+)", 2, 1, 3, 3),
    Rule("route", "gin", GO, r"\b(?P<owner>\w+)\.(GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD|Any)\(\s*\"([^\"]*)\"\s*,\s*(?:[\w.()]+\s*,\s*)*([\w.]+)", 2, 3, 4),
    Rule("route", "chi", GO, r"\br\.(Get|Post|Put|Patch|Delete)\(\s*\"([^\"]*)\"\s*,\s*([\w.]+)", 1, 2, 3),
    Rule("route", "net-http", GO, r"\bHandleFunc\(\s*\"(?:(GET|POST|PUT|PATCH|DELETE) )?(/[^\"]*)\"\s*,\s*([\w.]+)", 1, 2, 3),
    Rule("route", "aspnetcore", CS, r"\[Http(Get|Post|Put|Patch|Delete)(?:\(\s*\"([^\"]*)\"[^\n]*\))?\][^\n]*\n\s*public\s+[^\n(]*?\b(\w+)\s*\(", 1, 2, 3, 3),
    Rule("route", "aspnetcore", CS, r"\.Map(Get|Post|Put|Patch|Delete)\(\s*\"([^\"]*)\"\s*,\s*([\w.]+)?", 1, 2, 3),
    Rule("route", "actix", RS, r"#\[(get|post|put|patch|delete)\(\s*\"([^\"]*)\"[^\n]*\n[^\n]*?fn\s+(\w+)", 1, 2, 3, 3),
    Rule("route", "actix", RS, rf"\.route\(\s*\"([^\"]*)\"\s*,\s*web::{_VERB}\(\)\s*\.to\(\s*(\w[\w:]*)", 2, 1, 3),
    Rule("route", "axum", RS, rf"\.route\(\s*\"([^\"]*)\"\s*,\s*{_VERB}\(\s*(\w[\w:]*)", 2, 1, 3),
    Rule("route", "phoenix", EX, rf"^\s*{_VERB}\s+\"([^\"]*)\"\s*,\s*([\w.]+\s*,\s*:\w+)", 1, 2, 3),
    Rule("route", "vapor", "swift", rf"\bapp\.{_VERB}\(\s*\"([^\"]*)\"", 1, 2),
    Rule("route", "graphql", "graphql", r"^\s+(\w+)\s*(?:\([^)]*\))?\s*:\s*[\w\[\]!]+", "ANY", 1),
    Rule("route", "grpc", "protobuf", r"^\s*rpc\s+(\w+)\s*\(\s*(?:stream\s+)?([\w.]+)", "RPC", 1, 2),
    Rule("route", "adonisjs", JS, rf"\bRoute\.{_VERB}\(\s*{_Q}\s*,\s*[\"']([\w.]+)[\"']", 1, 2, 3),
    Rule("route", "sails", JS, r"^\s*[\"'](GET|POST|PUT|PATCH|DELETE)\s+(/[^\"'\s]*)[\"']\s*:\s*[\"'{]?\s*(?:action:\s*[\"'])?([\w./-]+)?", 1, 2, 3),
    Rule("route", "loopback", JS, rf"@(get|post|put|patch|del)\(\s*{_Q}[^\n]*(?:\n\s*[@}})][^\n]*)*\n\s*async\s+(\w+)\s*\(", 1, 2, 3, 4),
    Rule("route", "feathers", JS, rf"\bapp\.use\(\s*{_Q}\s*,\s*new\s+(\w+)", "ANY", 1, 2),
    Rule("route", "socket.io", JS, r"\bsocket\.on\(\s*[\"']([\w:.-]+)[\"']", "ANY", 1),
    Rule("route", "electron", JS, r"\bipcMain\.(?:handle|on)\(\s*[\"']([\w:.-]+)[\"']", "ANY", 1),
    Rule("route", "bullmq", JS, r"\bnew\s+Worker\(\s*[\"']([\w:.-]+)[\"']", "ANY", 1),
    Rule("route", "kafka", JS, r"\.subscribe\(\s*\{\s*topics?:\s*\[?\s*[\"']([\w.-]+)[\"']", "ANY", 1),
    Rule("route", "kafka", JVM, r"@KafkaListener\([^\n]*?topics\s*=\s*\{?\s*\"([^\"]+)\"", "ANY", 1),
    Rule("route", "rabbitmq", JVM, r"@RabbitListener\([^\n]*?queues\s*=\s*\{?\s*\"([^\"]+)\"", "ANY", 1),
    Rule("route", "rabbitmq", JS + " python", r"\bchannel\.(?:consume|basic_consume)\(\s*(?:queue\s*=\s*)?[\"']([\w.-]+)[\"']", "ANY", 1),
    Rule("route", "tauri", RS, r"#\[tauri::command[^\n]*\n[^\n]*?fn\s+(\w+)", "ANY", 1, 1, 2),
    Rule("route", "warp", RS, r"\bwarp::path!?\(\s*\"([^\"]+)\"", "ANY", 1),
    Rule("route", "fiber", GO, r"\b(?P<owner>app|api|v\d+)\.(Get|Post|Put|Patch|Delete)\(\s*\"([^\"]*)\"\s*,\s*([\w.]+)", 2, 3, 4),
    Rule("route", "gorilla-mux", GO, r"\.HandleFunc\(\s*\"(/[^\"]*)\"\s*,\s*([\w.]+)\)\.Methods\(\s*\"(\w+)\"", 3, 1, 2),
    Rule("route", "wordpress", PHP, r"\bregister_rest_route\(\s*[\"']([^\"']+)[\"']\s*,\s*[\"']([^\"']+)[\"']", "ANY", 2, 1),
    Rule("route", "drupal", "yaml", r"^\s+path:\s*[\"'](/[^\"']*)[\"']", "ANY", 1),
    Rule("route", "aiohttp", PY, rf"@routes\.{_VERB}\(\s*{_Q}" + _CALLED, 1, 2, 3, 2),
    # lines that imply several routes: names, options (verb: the kind)
    Rule("resource", "rails", RB, r"^\s*resources\s+((?:[:\"']\w+[\"']?\s*,\s*)*[:\"']\w+[\"']?)(?![\w\"']|\s*=>)([^\n#]*)", "many", 1, 2),
    Rule("resource", "rails", RB, r"^\s*resource\s+((?:[:\"']\w+[\"']?\s*,\s*)*[:\"']\w+[\"']?)(?![\w\"']|\s*=>)([^\n#]*)", "one", 1, 2),
    Rule("resource", "laravel", PHP, r"\bRoute::(resource|apiResource)\(\s*[\"']([^\"'\n]+)[\"']\s*,\s*([^;]*)", 1, 2, 3, 6),
    Rule("resource", "phoenix", EX, r"^\s*resources\s*\(?\s*\"([^\"\n]+)\"\s*,\s*([^\n#]*)", "many", 1, 2),
    # what routes are declared on: groups of a router variable, and routers mounted on others (verb: the prefix)
    Rule("router", "fastapi", PY, r"^\s*(\w+)\s*=\s*APIRouter\((?:[^)]*?prefix\s*=\s*[\"']([^\"']*)[\"'])?", 2, 1, 0, 4),
    Rule("router", "flask", PY, r"^\s*(\w+)\s*=\s*Blueprint\((?:[^)]*?url_prefix\s*=\s*[\"']([^\"']*)[\"'])?", 2, 1, 0, 4),
    Rule("router", "gin", GO, r"\b(\w+)\s*:?=\s*(\w+)\.Group\(\s*\"([^\"]*)\"", 3, 1, 2),
    Rule("mount", "express", JS, rf"\b{_ON}\.use\(\s*{_Q}\s*,\s*(?:[\w.]+(?:\([^()\n]*\))?\s*,\s*)*(\w+)(?:\.routes\(\))?\s*\)", 2, 3),
    Rule("mount", "fastapi", PY, r"\b(?P<owner>\w+)\.include_router\(\s*([\w.]+)(?:[^)]*?prefix\s*=\s*[\"']([^\"']*)[\"'])?", 3, 2, 0, 4),
    Rule("mount", "flask", PY, r"\b(?P<owner>\w+)\.register_blueprint\(\s*([\w.]+)(?:[^)]*?url_prefix\s*=\s*[\"']([^\"']*)[\"'])?", 3, 2, 0, 4),
    Rule("mount", "django", PY, rf"\b(?:re_)?path\(\s*r?{_Q}\s*,\s*include\(\s*[\"']([\w.]+)[\"']", 1, 2),
    Rule("scope", "spring", JVM, r"@RequestMapping\(\s*(?:(?:value|path)\s*=\s*)?\"([^\"]*)\"\s*\)", "body", 1),
    Rule("scope", "nestjs", JS, r"@Controller\(\s*(?:\{[^}]*?path:\s*)?(?:[\"'`]([^\"'`]*)[\"'`])?", "body", 1, 0, 2),
    Rule("scope", "aspnetcore", CS, r"\[Route\(\s*\"([^\"]*)\"[^\n]*(?:\n\s*\[[^\n]*)*\n\s*public\s+[\w ]*class\s+(?P<owner>\w+?)(?:Controller)?\b", "body", 1, 0, 4),
    Rule("scope", "jax-rs", JVM, r"@Path\(\s*\"([^\"]*)\"\s*\)(?=\s*(?:\n\s*@[^\n]*)*\n\s*(?:public\s+|final\s+|abstract\s+)*(?:class|interface)\b)", "body", 1, 0, 2),
    Rule("scope", "micronaut", JVM, r"@Controller\(\s*\"([^\"]*)\"", "body", 1),
    Rule("scope", "symfony", PHP, r"#\[Route\(\s*(?:path:\s*)?[\"']([^\"']*)[\"'][^\n]*(?:\n\s*#\[[^\n]*)*\n\s*(?:final\s+|abstract\s+)*class\b", "body", 1, 0, 4),
    Rule("scope", "rails", RB, r"^\s*namespace\s+[:\"'](\w[\w/-]*)[\"']?(?:[^\n#]*?\bpath:\s*[\"']([^\"'\n]*)[\"'])?[^\n#]*?\bdo\b", "body", 1, 2),
    Rule("scope", "rails", RB, r"^\s*scope\s+(?:[^\n#]*?\bpath:\s*)?[:\"']([\w/:.()*-]+)[\"']?(?!\w|:)[^\n#]*?\bdo\b", "body", 1),
    Rule("scope", "rails", RB, r"^\s*resources\s+[:\"'](\w+)[\"']?(?:[^\n#]*?\bpath:\s*[\"']([^\"'\n]*)[\"'])?[^\n#]*?\bdo\b", "resources", 1, 2),
    Rule("scope", "rails", RB, r"^\s*resource\s+[:\"'](\w+)[\"']?(?:[^\n#]*?\bpath:\s*[\"']([^\"'\n]*)[\"'])?[^\n#]*?\bdo\b", "body", 1, 2),
    Rule("scope", "rails", RB, r"^\s*member\s+do\b", "member", 0),
    Rule("scope", "rails", RB, r"^\s*collection\s+do\b", "collection", 0),
    Rule("scope", "sinatra", RB, r"^\s*namespace\s+[\"'](/[^\"']*)[\"']\s+do\b", "body", 1),
    Rule("scope", "grape", RB, r"^\s*(?:namespace|resources?|group|segment)\s+[:\"']([\w/:-]+)[\"']?\s+do\b", "body", 1),
    Rule("scope", "grape", RB, r"^\s*route_param\s+(:\w+)[^\n#]*?\bdo\b", "body", 1),
    Rule("scope", "phoenix", EX, r"^\s*scope\s*\(?\s*(?:path:\s*)?\"([^\"]*)\"[^\n#]*?\bdo\b", "body", 1),
    Rule("scope", "ktor", JVM, r"^\s*route\(\s*\"([^\"]*)\"[^)\n]*\)\s*\{", "body", 1),
    Rule("scope", "laravel", PHP, r"\bRoute::(?:\w+\([^()\n]*\)\s*->\s*)*prefix\(\s*[\"']([^\"']*)[\"']\s*\)(?:\s*->\s*(?!group\b)\w+\([^()]*\))*\s*->\s*group\(\s*(?:static\s+)?function\s*\([^)]*\)[^{;]*\{", "body", 1, 0, 8),
    Rule("scope", "laravel", PHP, r"\bRoute::group\(\s*\[[^;{]*?[\"']prefix[\"']\s*=>\s*[\"']([^\"']*)[\"'][^;{]*?,\s*(?:static\s+)?function\s*\([^)]*\)[^{;]*\{", "body", 1, 0, 8),
    Rule("scope", "slim", PHP, r"\$\w+->group\(\s*[\"']([^\"']*)[\"']\s*,\s*(?:static\s+)?function\s*\([^)]*\)[^{;]*\{", "body", 1, 0, 4),
    Rule("scope", "chi", GO, r"\br\.Route\(\s*\"([^\"]*)\"\s*,\s*func\(\s*r\s+chi\.Router\s*\)\s*\{", "body", 1),
    Rule("scope", "actix", RS, r"\bweb::scope\(\s*\"([^\"]*)\"\s*\)", "rest", 1),
    Rule("scope", "adonisjs", JS, r"\}\s*\)\s*(?:\.\w+\([^()]*\)\s*)*\.prefix\(\s*[\"'`]([^\"'`]*)[\"'`]\s*\)", "above", 1, 0, 2),
    Rule("route-name", "laravel", PHP, rf"Route::{_VERB}\(\s*{_Q}[^\n;]*->name\(\s*[\"']([\w.-]+)", 1, 2, 3),
    Rule("route-name", "django", PY, rf"\bpath\(\s*{_Q}[^\n]*\bname\s*=\s*[\"']([\w:.-]+)", "ANY", 1, 2),
    Rule("call", "laravel-route", JS + " php", r"(?<![\w>:$])route\(\s*[\"']([\w-]+\.[\w.-]+)[\"']", "", 1),
    Rule("binding", "import", JS, r"\bimport\s+(\w+)\s*(?:,\s*\{[^}\n]*\}\s*)?from\s+[\"']([^\"'\n]+)[\"']", "", 1, 2),
    Rule("binding", "require", JS, r"\b(?:const|let|var)\s+(\w+)\s*=\s*require\(\s*[\"']([^\"'\n]+)[\"']\s*\)", "", 1, 2),
    Rule("binding", "named-import", JS, r"\bimport\s+(?:\w+\s*,\s*)?\{([^}]*)\}\s*from\s+[\"']([^\"'\n]+)[\"']", "", 1, 2, 4),
    Rule("binding", "named-require", JS, r"\b(?:const|let|var)\s+\{([^}=]*)\}\s*=\s*require\(\s*[\"']([^\"'\n]+)[\"']\s*\)", "", 1, 2, 4),
    Rule("binding", "namespace", JS, r"\bimport\s+\*\s+as\s+(\w+)\s+from\s+[\"']([^\"'\n]+)[\"']", "", 1, 2),
    # frontend calls: method, endpoint
    Rule("call", "fetch", JS, r"\bfetch\(\s*[\"'`]([^\"'`\n]+)[\"'`](?:\s*,\s*\{[^}]*?method:\s*[\"'](\w+)[\"'])?", 2, 1, 0, 4),
    Rule("call", "axios", JS, rf"\baxios\.{_VERB}(?:<[^>\n]*>)?\(\s*{_Q}", 1, 2),
    Rule("call", "axios", JS, r"\baxios\(\s*[\"'`]([^\"'`\n]+)[\"'`]", "GET", 1),
    Rule("call", "ky", JS, rf"\bky\.{_VERB}\(\s*{_Q}", 1, 2),
    Rule("call", "jquery", JS, r"\$\.(get|post)\(\s*[\"'`]([^\"'`\n]+)[\"'`]", 1, 2),
    Rule("call", "angular", JS, rf"\bhttp\.{_VERB}(?:<[^>\n]*>)?\(\s*{_Q}", 1, 2),
    Rule("call", "event-source", JS, r"new\s+EventSource\(\s*[\"'`]([^\"'`\n]+)[\"'`]", "STREAM", 1),
    Rule("call", "websocket", JS, r"new\s+WebSocket\(\s*[\"'`]([^\"'`\n]+)[\"'`]", "STREAM", 1),
    Rule("call", "requests", PY, rf"\b(?:requests|httpx|client)\.{_VERB}\(\s*f?{_Q}", 1, 2),
    Rule("call", "dio", "dart", rf"\bdio\.{_VERB}\(\s*{_Q}", 1, 2),
    Rule("call", "http-client", JS, rf"\b(?:apiClient|httpClient|axiosInstance|\$http|\$axios)\.{_VERB}(?:<[^>\n]*>)?\(\s*{_Q}", 1, 2),
    Rule("call", "swr", JS, r"\buseSWR(?:<[^>\n]*>)?\(\s*[\"'`]([^\"'`\n]+)[\"'`]", "GET", 1),
    Rule("call", "nuxt-fetch", JS, r"(?:\$fetch|\buseFetch|\bofetch)\(\s*[\"'`]([^\"'`\n]+)[\"'`](?:\s*,\s*\{[^}]*?method:\s*[\"'](\w+)[\"'])?", 2, 1, 0, 4),
    Rule("call", "superagent", JS, rf"\b(?:superagent|got)\.{_VERB}\(\s*{_Q}", 1, 2),
    Rule("call", "socket.io", JS, r"\bsocket\.emit\(\s*[\"']([\w:.-]+)[\"']", "ANY", 1),
    Rule("call", "tauri", JS, r"\binvoke(?:<[^>\n]*>)?\(\s*[\"'](\w+)[\"']", "ANY", 1),
    Rule("call", "electron", JS, r"\bipcRenderer\.(?:invoke|send)\(\s*[\"']([\w:.-]+)[\"']", "ANY", 1),
    Rule("call", "aiohttp", PY, rf"\bsession\.{_VERB}\(\s*f?{_Q}", 1, 2),
    Rule("call", "retrofit", JVM, r"@(GET|POST|PUT|PATCH|DELETE|HEAD)\(\s*\"([^\"]+)\"\s*\)", 1, 2),
    Rule("call", "rest-template", JVM, r"\brestTemplate\.(get|post|put|delete)\w*\(\s*\"([^\"]+)\"", 1, 2),
    Rule("call", "http-client", CS, r"\.(Get|Post|Put|Patch|Delete)(?:FromJson|AsJson|String)?Async(?:<[^>\n]*>)?\(\s*\$?\"([^\"]+)\"", 1, 2),
    Rule("call", "net-http", GO, r"\bhttp\.(Get|Post|Head)\(\s*\"([^\"]+)\"", 1, 2),
    Rule("call", "net-http", GO, r"\bhttp\.NewRequest(?:WithContext)?\((?:\w+\s*,\s*)?(?:\"(\w+)\"|http\.Method(\w+))\s*,\s*\"([^\"]+)\"", 1, 3),
    Rule("call", "ruby-http", RB, r"\b(?:HTTParty|Faraday|RestClient)\.(get|post|put|patch|delete)\(?\s*[\"']([^\"']+)[\"']", 1, 2),
    Rule("call", "laravel-http", PHP, rf"\bHttp::{_VERB}\(\s*{_Q}", 1, 2),
    Rule("call", "httpoison", EX, r"\b(?:HTTPoison|Req)\.(get|post|put|patch|delete)!?\(\s*\"([^\"]+)\"", 1, 2),
    Rule("call", "reqwest", RS, r"\b(?:client|reqwest::Client::new\(\))\s*\.(get|post|put|patch|delete)\(\s*\"([^\"]+)\"", 1, 2),
    Rule("call", "url-session", "swift", r"\bURL\(string:\s*\"([^\"]+)\"", "GET", 1),
    # imports: module
    Rule("import", "import", PY, r"^\s*import\s+([\w.]+)", "", 1),
    Rule("import", "from", PY, r"^\s*from\s+([\w.]+)\s+import\s+([^\n#]+)", "", 1, 2),
    Rule("import", "import", JS, r"\bimport\s+(?:([^\"'\n;]+?)\s+from\s+)?[\"']([^\"'\n]+)[\"']", "", 2, 1),
    Rule("import", "require", JS, r"\brequire\(\s*[\"']([^\"'\n]+)[\"']\s*\)", "", 1),
    Rule("import", "dynamic", JS, r"\bimport\(\s*[\"']([^\"'\n]+)[\"']\s*\)", "", 1),
    Rule("import", "import", JVM, r"^\s*import\s+(?:static\s+)?([\w.*]+)", "", 1),
    Rule("import", "import", GO, r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([\w./-]+)\"\s*$", "", 1),
    Rule("import", "use", RS, r"^\s*(?:pub\s+)?use\s+([\w:]+)", "", 1),
    Rule("import", "using", CS, r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;", "", 1),
    Rule("import", "use", PHP, r"^\s*use\s+([\w\\]+)", "", 1),
    Rule("import", "require", RB, r"^\s*require(?:_relative)?\s+[\"']([^\"']+)[\"']", "", 1),
    Rule("import", "alias", EX, r"^\s*(?:alias|import|use|require)\s+([A-Z][\w.]*)", "", 1),
    Rule("import", "import", "swift", r"^\s*import\s+(\w+)", "", 1),
    Rule("import", "import", "dart", r"^\s*import\s+[\"']([^\"']+)[\"']", "", 1),
    # symbols: kind is the label, name the subject
    Rule("symbol", "function", PY, r"^(?:\s*)(?:async\s+)?def\s+(\w+)\s*(\([^\n]*)", "", 1, 2),
    Rule("symbol", "class", PY, r"^\s*class\s+(\w+)", "", 1),
    Rule("symbol", "function", JS, r"\bfunction\s+(\w+)\s*\(", "", 1),
    Rule("symbol", "class", JS, r"\bclass\s+(\w+)", "", 1),
    Rule("symbol", "interface", "typescript", r"\binterface\s+(\w+)", "", 1),
    Rule("symbol", "type", "typescript", r"^\s*(?:export\s+)?type\s+(\w+)\s*(?:<[^>]*>)?\s*=", "", 1),
    Rule("symbol", "function", JS, r"\bconst\s+(\w+)\s*=\s*(?:async\s*)?\([^)\n]*\)\s*=>", "", 1),
    Rule("symbol", "class", JVM + " csharp", r"\b(?:class|record|object)\s+(\w+)", "", 1),
    Rule("symbol", "interface", JVM + " csharp go", r"\binterface\s+(\w+)|^\s*type\s+(\w+)\s+interface", "", 1),
    Rule("symbol", "function", GO, r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(", "", 1),
    Rule("symbol", "struct", GO, r"^type\s+(\w+)\s+struct", "", 1),
    Rule("symbol", "function", RS, r"\bfn\s+(\w+)", "", 1),
    Rule("symbol", "struct", RS, r"\b(?:struct|enum|trait)\s+(\w+)", "", 1),
    Rule("symbol", "class", PHP, r"\b(?:class|interface|trait)\s+(\w+)", "", 1),
    Rule("symbol", "function", PHP, r"\bfunction\s+(\w+)\s*\(", "", 1),
    Rule("symbol", "class", RB, r"^\s*(?:class|module)\s+([\w:]+)", "", 1),
    Rule("symbol", "function", RB, r"^\s*def\s+(?:self\.)?([\w?!]+)", "", 1),
    Rule("symbol", "module", EX, r"^\s*defmodule\s+([\w.]+)", "", 1),
    Rule("symbol", "function", EX, r"^\s*defp?\s+(\w+[?!]?)", "", 1),
    Rule("symbol", "function", "swift", r"\bfunc\s+(\w+)", "", 1),
    Rule("symbol", "struct", "swift", r"\b(?:struct|class|enum|protocol)\s+(\w+)", "", 1),
    Rule("symbol", "class", "dart", r"^\s*(?:abstract\s+)?class\s+(\w+)", "", 1),
    Rule("symbol", "function", "shell", r"^\s*(?:function\s+)?(\w+)\s*\(\)\s*\{", "", 1),
    # components, state, frontend routes
    Rule("component", "react", JS, r"\b(?:export\s+(?:default\s+)?)?(?:function|const)\s+([A-Z]\w*)\s*(?:=\s*(?:\([^)\n]*\)|\w+)\s*=>|\()", "", 1),
    Rule("component", "angular", JS, r"@Component\(\s*\{[^}]*?selector:\s*[\"']([^\"']+)[\"']", "", 1, 0, 4),
    Rule("component", "vue", "vue", r"\bname:\s*[\"'](\w+)[\"']", "", 1),
    Rule("component", "flutter", "dart", r"class\s+(\w+)\s+extends\s+(Stateless|Stateful)Widget", "", 1, 2),
    Rule("component", "swiftui", "swift", r"struct\s+(\w+)\s*:\s*(?:\w+\s*,\s*)*View\b", "", 1),
    Rule("state", "react-hook", JS, r"\[\s*(\w+)\s*,\s*set\w+\s*\]\s*=\s*(useState|useReducer)\b", 2, 1),
    Rule("state", "redux", JS, r"\bcreateSlice\(\s*\{\s*name:\s*[\"'](\w+)[\"']", "slice", 1, 0, 2),
    Rule("state", "zustand", JS, r"\bconst\s+(use\w+)\s*=\s*create\b", "store", 1),
    Rule("state", "pinia", JS, r"\bdefineStore\(\s*[\"'](\w+)[\"']", "store", 1),
    Rule("state", "context", JS, r"\bconst\s+(\w+)\s*=\s*(?:React\.)?createContext\b", "context", 1),
    Rule("frontend-route", "react-router", JS, r"<Route\s[^>\n]*?path=[\"'{]+([^\"'}\n]+)[\"'}]+(?:[^>\n]*?element=\{\s*<\s*(\w+))?", "", 1, 2),
    Rule("frontend-route", "vue-router", JS, r"\bpath:\s*[\"']([^\"']+)[\"']\s*,[^}\n]*?component:\s*(\w+)", "", 1, 2),
    Rule("frontend-route", "angular", JS, r"\{\s*path:\s*[\"']([^\"']*)[\"']\s*,\s*(?:loadChildren|redirectTo)\b", "", 1),
    # data models, services, repositories, data layer
    Rule("data-model", "pydantic", PY, r"^class\s+(\w+)\(\s*(BaseModel|SQLModel)\b", "", 1, 2),
    Rule("data-model", "django-model", PY, r"^class\s+(\w+)\(\s*(models\.Model)\b", "", 1, 2),
    Rule("data-model", "sqlalchemy", PY, r"^class\s+(\w+)\(\s*(Base|db\.Model)\b", "", 1, 2),
    Rule("data-model", "dataclass", PY, r"^@dataclass[^\n]*\nclass\s+(\w+)", "", 1, 0, 2),
    Rule("data-model", "jpa-entity", JVM, r"@(Entity|Document)\b[^\n]*(?:\n\s*@[^\n]*)*\n\s*(?:public\s+|data\s+|open\s+)*class\s+(\w+)", "", 2, 1, 4),
    Rule("data-model", "prisma", "prisma", r"^model\s+(\w+)\s*\{", "", 1),
    Rule("data-model", "mongoose", JS, r"\bmodel(?:<[^>\n]*>)?\(\s*[\"'](\w+)[\"']", "", 1),
    Rule("data-model", "drizzle", JS, r"\bconst\s+(\w+)\s*=\s*(?:pg|mysql|sqlite)Table\(", "", 1),
    Rule("data-model", "typeorm", JS, r"@Entity\([^\n]*\n\s*export\s+class\s+(\w+)", "", 1, 0, 2),
    Rule("data-model", "active-record", RB, r"^\s*class\s+(\w+)\s*<\s*(ApplicationRecord|ActiveRecord::Base)", "", 1, 2),
    Rule("data-model", "eloquent", PHP, r"class\s+(\w+)\s+extends\s+(Model|Authenticatable)\b", "", 1, 2),
    Rule("data-model", "ecto", EX, r"^\s*schema\s+\"(\w+)\"\s+do", "", 1),
    Rule("data-model", "marshmallow-schema", PY, r"^class\s+(\w+)\(\s*(?:\w+\.)?(Schema|SQLAlchemyAutoSchema)\b", "", 1, 2),
    Rule("data-model", "sequelize", JS, r"\bsequelize\.define\(\s*[\"'](\w+)[\"']", "", 1),
    Rule("data-model", "sequelize", JS, r"\bclass\s+(\w+)\s+extends\s+(Model)\b", "", 1, 2),
    Rule("data-model", "adonis-lucid-model", JS, r"\bclass\s+(\w+)\s+extends\s+(BaseModel)\b", "", 1, 2),
    Rule("data-model", "loopback-model", JS, r"@model\([^\n]*\n\s*export\s+class\s+(\w+)", "", 1, 0, 2),
    Rule("data-model", "nestjs-dto", JS, r"\bexport\s+class\s+(\w+Dto)\b", "", 1),
    Rule("data-model", "astro-content-collection", JS, r"\bconst\s+(\w+)\s*=\s*defineCollection\(", "", 1),
    Rule("data-model", "go-struct", GO, r"^type\s+(\w+)\s+struct\s*\{", "", 1),
    Rule("data-model", "rust-serde-struct", RS, r"#\[derive\([^\n]*\b(Serialize|Deserialize)\b[^\n]*(?:\n\s*#\[[^\n]*)*\n\s*(?:pub\s+)?struct\s+(\w+)", "", 2, 1, 4),
    Rule("data-model", "rust-sqlx-type", RS, r"#\[derive\([^\n]*\b(FromRow|sqlx::Type)\b[^\n]*(?:\n\s*#\[[^\n]*)*\n\s*(?:pub\s+)?(?:struct|enum)\s+(\w+)", "", 2, 1, 4),
    Rule("data-model", "csharp-dto", CS, r"\b(?:class|record)\s+(\w+(?:Dto|Request|Response|ViewModel))\b", "", 1),
    Rule("data-model", "csharp-entity", CS, r"\bDbSet<(\w+)>", "", 1),
    Rule("data-model", "kotlin-data-class", "kotlin", r"\bdata\s+class\s+(\w+)", "", 1),
    Rule("data-model", "scala-case-class", "scala", r"\bcase\s+class\s+(\w+)", "", 1),
    Rule("data-model", "swift-codable-model", "swift", r"\b(?:struct|class)\s+(\w+)\s*:\s*[^\n{]*\b(Codable|Decodable)\b", "", 1, 2),
    Rule("data-model", "fluent-model", "swift", r"\bclass\s+(\w+)\s*:\s*[^\n{]*\b(Model)\b", "", 1, 2),
    Rule("data-model", "doctrine-entity", PHP, r"(?:#\[ORM\\Entity|@ORM\\Entity)[^\n]*(?:\n\s*(?:#\[|\*)[^\n]*)*\n\s*(?:final\s+)?class\s+(\w+)", "", 1, 0, 4, "comment"),
    Rule("data-model", "dart-freezed-model", "dart", r"@freezed\s*\n\s*(?:abstract\s+|sealed\s+)?class\s+(\w+)", "", 1, 0, 2),
    Rule("data-model", "clojure-record", "clojure", r"\(defrecord\s+(\w+)", "", 1),
    Rule("data-model", "graphql-type", "graphql", r"^(?:type|input)\s+(?!Query\b|Mutation\b|Subscription\b)(\w+)", "", 1),
    Rule("data-model", "protobuf-message", "protobuf", r"^\s*message\s+(\w+)", "", 1),
    # fields of the model above them, by the model's label
    Rule("field", "pydantic django-model sqlalchemy dataclass marshmallow-schema", PY, r"^\s+(\w+)\s*(?::\s*[\w\[\]. |,]+|=\s*[\w.]+\()", "", 1),
    Rule("field", "prisma", "prisma", r"^\s+(\w+)\s+[A-Z]\w*", "", 1),
    Rule("field", "mongoose drizzle sequelize astro-content-collection", JS, r"^\s+(\w+)\s*:\s*\S", "", 1),
    Rule("field", "typeorm adonis-lucid-model loopback-model nestjs-dto", JS, r"^\s+(?:public\s+|readonly\s+|declare\s+)*(\w+)[?!]?\s*:\s*[\w<>\[\] |]+;?\s*$", "", 1),
    Rule("field", "jpa-entity", JVM, r"^\s+(?:private|protected|public)\s+(?!static)[\w<>\[\]., ?]+\s+(\w+)\s*(?:=[^\n]*)?;", "", 1),
    Rule("field", "kotlin-data-class scala-case-class", "kotlin scala", r"(?:\bval\s+|[(,]\s*)(\w+)\s*:\s*\w+", "", 1),
    Rule("field", "go-struct", GO, r"^\s+([A-Z]\w*)\s+[\w.*\[\]]+", "", 1),
    Rule("field", "rust-serde-struct rust-sqlx-type", RS, r"^\s+(?:pub\s+)?(\w+)\s*:\s*[\w<>:]+,", "", 1),
    Rule("field", "csharp-dto csharp-entity", CS, r"\bpublic\s+[\w<>\[\]?]+\s+(\w+)\s*\{\s*get", "", 1),
    Rule("field", "swift-codable-model fluent-model", "swift", r"^\s+(?:@\w+[^\n]*\s)?(?:var|let)\s+(\w+)\s*:", "", 1),
    Rule("field", "doctrine-entity eloquent", PHP, r"^\s+(?:private|protected|public)\s+\??[\w\\]*\s*\$(\w+)", "", 1),
    Rule("field", "ecto", EX, r"^\s+field\s+:(\w+)", "", 1),
    Rule("field", "dart-freezed-model", "dart", r"\brequired\s+[\w<>?]+\s+(\w+)", "", 1),
    Rule("field", "graphql-type", "graphql", r"^\s+(\w+)\s*(?:\([^)]*\))?\s*:", "", 1),
    Rule("field", "protobuf-message", "protobuf", r"^\s+(?:repeated\s+|optional\s+)?[\w.<>, ]+\s+(\w+)\s*=\s*\d+", "", 1),
    Rule("repository", "spring-data", JVM, r"interface\s+(\w+)\s+extends\s+\w*Repository\s*<\s*(\w+)", "", 1, 2),
    Rule("repository", "class", JVM + " csharp php typescript", r"\bclass\s+(\w+Repository)\b", "", 1),
    Rule("service", "spring", JVM, r"@Service\b[^\n]*(?:\n\s*@[^\n]*)*\n\s*(?:public\s+)?class\s+(\w+)", "", 1, 0, 4),
    Rule("service", "nestjs", JS, r"@Injectable\([^\n]*\n\s*export\s+class\s+(\w+)", "", 1, 0, 2),
    Rule("service", "class", JVM + " csharp php typescript python ruby", r"\bclass\s+(\w+Service)\b", "", 1),
    Rule("data-layer", "table", "sql", r"(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?[\"`\[]?([\w.]+)", "create", 1),
    Rule("data-layer", "view", "sql", r"(?i)create\s+(?:or\s+replace\s+)?(?:materialized\s+)?view\s+[\"`\[]?([\w.]+)", "create", 1),
    Rule("data-layer", "index", "sql", r"(?i)create\s+(?:unique\s+)?index\s+(?:if\s+not\s+exists\s+)?[\"`\[]?(\w+)", "create", 1),
    Rule("data-layer", "migration", RB, r"create_table\s+:?\"?(\w+)", "create", 1),
    Rule("data-layer", "migration", PHP, r"Schema::create\(\s*[\"'](\w+)[\"']", "create", 1),
    Rule("data-layer", "knex", JS, r"\.createTable\(\s*[\"'](\w+)[\"']", "create", 1),
    Rule("data-layer", "alembic", PY, r"\bop\.create_table\(\s*[\"'](\w+)[\"']", "create", 1, 0, 2),
    Rule("data-layer", "django-migration", PY, r"\bCreateModel\(\s*name\s*=\s*[\"'](\w+)[\"']", "create", 1, 0, 2),
    Rule("data-layer", "ecto-migration", EX, r"\bcreate\s+table\(\s*:(\w+)", "create", 1),
    Rule("data-layer", "liquibase", "xml", r"<createTable\s[^>]*?tableName=\"(\w+)\"", "create", 1),
    Rule("data-layer", "mybatis", "xml", r"<(select|insert|update|delete)\s[^>]*?id=\"(\w+)\"", 1, 2),
    Rule("data-layer", "dbt-ref", "sql", r"\{\{\s*(ref|source)\(\s*[\"'](\w+)[\"']", 1, 2),
    Rule("data-layer", "function", "sql", r"(?i)create\s+(?:or\s+replace\s+)?(?:function|procedure)\s+[\"`\[]?([\w.]+)", "create", 1),
    Rule("data-layer", "trigger", "sql", r"(?i)create\s+(?:or\s+replace\s+)?trigger\s+[\"`\[]?(\w+)", "create", 1),
    Rule("data-layer", "type", "sql", r"(?i)create\s+type\s+[\"`\[]?([\w.]+)", "create", 1),
    Rule("data-layer", "foreign-key", "sql", r"(?i)\breferences\s+[\"`\[]?([\w.]+)", "references", 1),
    Rule("data-layer", "alter", "sql", r"(?i)alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?[\"`\[]?([\w.]+)", "alter", 1),
    # commands, servlets, runtime configuration (values never leave the rule: names only)
    Rule("command", "argparse", PY, r"\badd_parser\(\s*[\"']([\w-]+)[\"'](?:[^\n]*?help\s*=\s*[\"']([^\"']*)[\"'])?", "", 1, 2),
    Rule("command", "click", PY, r"@\w+\.command\(\s*(?:[\"']([\w-]+)[\"'])?[^\n]*(?:\n\s*@[^\n]*)*\n\s*def\s+(\w+)", "", 2, 1, 4),
    Rule("command", "commander", JS, r"\.command\(\s*[\"']([\w:-]+)[^\"'\n]*[\"']\s*\)(?:\s*\.description\(\s*[\"']([^\"']*)[\"'])?", "", 1, 2, 2),
    Rule("command", "cobra", GO, r"\bUse:\s*\"(\w[\w-]*)[^\"]*\"\s*,(?:\s*Short:\s*\"([^\"]*)\")?", "", 1, 2, 2),
    Rule("command", "make", "makefile", r"^([\w.-]+):(?!=)", "", 1),
    Rule("command", "rake", RB, r"^\s*task\s+:?[\"']?(\w[\w:-]*)", "", 1),
    Rule("command", "artisan", PHP, r"\$signature\s*=\s*[\"']([\w:-]+)", "", 1),
    Rule("command", "symfony", PHP, r"#\[AsCommand\(\s*(?:name:\s*)?[\"']([\w:-]+)[\"'](?:\s*,\s*(?:description:\s*)?[\"']([^\"']*)[\"'])?", "", 1, 2),
    Rule("command", "clap", RS, r"#\[command\([^\n]*?name\s*=\s*\"([\w-]+)\"", "", 1),
    Rule("command", "mix", EX, r"^\s*defmodule\s+Mix\.Tasks\.([\w.]+)", "", 1),
    Rule("command", "procfile", "text unknown", r"^(web|worker|release|clock):\s+(\S[^\n]*)$", "", 1, 2),
    Rule("servlet", "annotation", "java", r"@WebServlet\([^\n]*?\"([^\"]+)\"[^\n]*\n\s*public\s+class\s+(\w+)", "", 2, 1, 2),
    Rule("runtime", "env-key", "env properties", r"^\s*(?:export\s+)?([A-Za-z_][\w.-]*)\s*=", "", 1),
    Rule("runtime", "env-read", JS, r"\bprocess\.env\.([A-Z][A-Z0-9_]*)", "", 1),
    Rule("runtime", "env-read", PY, r"\bos\.(?:environ(?:\.get)?|getenv)[\[(]\s*[\"']([A-Z][A-Z0-9_]*)[\"']", "", 1),
    Rule("runtime", "env-read", GO, r"\bos\.Getenv\(\s*\"([A-Z][A-Z0-9_]*)\"", "", 1),
    Rule("runtime", "docker-image", "dockerfile", r"(?i)^FROM\s+(\S+)", "", 1),
    Rule("runtime", "docker-port", "dockerfile", r"(?i)^EXPOSE\s+(\d+)", "", 1),
    Rule("runtime", "compose-image", "yaml", r"^\s+image:\s*[\"']?([\w./:-]+)", "", 1),
    Rule("runtime", "resource", "terraform", r"^\s*resource\s+\"(\w+)\"\s+\"(\w+)\"", "", 1, 2),
    Rule("runtime", "terraform-block", "terraform", r"^\s*(variable|output|module|provider|data)\s+\"([\w-]+)\"", "", 2, 1),
    Rule("runtime", "docker-env", "dockerfile", r"(?i)^ENV\s+(\w+)", "", 1),
    Rule("runtime", "docker-command", "dockerfile", r"(?i)^(CMD|ENTRYPOINT)\b", "", 1),
    Rule("runtime", "docker-stage", "dockerfile", r"(?i)^FROM\s+\S+\s+AS\s+(\S+)", "", 1),
    Rule("runtime", "compose-service", "yaml", r"^  ([\w-]+):\s*$", "", 1),
    Rule("runtime", "github-action", "yaml", r"^\s*(?:-\s*)?uses:\s*[\"']?([\w./@-]+)", "", 1),
    Rule("runtime", "github-job", "yaml", r"^  ([\w-]+):\s*$", "", 1),
    Rule("runtime", "github-secret", "yaml", r"\$\{\{\s*secrets\.(\w+)", "", 1),
    Rule("runtime", "gitlab-job", "yaml", r"^([\w.-]+):\s*$", "", 1),
    Rule("runtime", "kubernetes-kind", "yaml", r"^kind:\s*(\w+)", "", 1),
    Rule("runtime", "kubernetes-name", "yaml", r"^metadata:\s*\n\s+name:\s*[\"']?([\w.-]+)", "", 1, 0, 2),
    Rule("runtime", "kubernetes-image", "yaml", r"^\s+(?:-\s*)?image:\s*[\"']?([\w./:@-]+)", "", 1),
    Rule("runtime", "kubernetes-schedule", "yaml", r"^\s*schedule:\s*[\"']?([^\"'\n#]+)", "", 1),
    Rule("runtime", "helm-chart", "yaml", r"^name:\s*[\"']?([\w-]+)", "", 1),
    Rule("runtime", "ansible-task", "yaml", r"^\s*-\s*name:\s*[\"']?([^\"'\n]+)", "", 1),
    Rule("runtime", "spring-config", "yaml", r"^\s*([A-Za-z][\w.-]*):", "", 1),
    Rule("runtime", "appsettings", "json", r"^\s{2,4}\"([\w:.]+)\"\s*:", "", 1),
    Rule("runtime", "wrangler", "toml", r"^(\w+)\s*=", "", 1),
    Rule("runtime", "vercel", "json", r"\"(?:src|source)\"\s*:\s*\"([^\"]+)\"", "", 1),
    Rule("runtime", "jenkins-stage", "groovy", r"\bstage\(\s*[\"']([^\"']+)[\"']", "", 1),
    Rule("runtime", "env-read", JVM, r"\bSystem\.getenv\(\s*\"([A-Z][A-Z0-9_]*)\"", "", 1),
    Rule("runtime", "env-read", RB, r"\bENV(?:\.fetch\(|\[)\s*[\"']([A-Z][A-Z0-9_]*)[\"']", "", 1),
    Rule("runtime", "env-read", PHP, r"\b(?:env|getenv)\(\s*[\"']([A-Z][A-Z0-9_]*)[\"']", "", 1),
    Rule("runtime", "env-read", RS, r"\benv::var\(\s*\"([A-Z][A-Z0-9_]*)\"", "", 1),
    Rule("runtime", "env-read", EX, r"\bSystem\.(?:get_env|fetch_env!?)\(\s*\"([A-Z][A-Z0-9_]*)\"", "", 1),
    Rule("runtime", "env-read", CS, r"\bGetEnvironmentVariable\(\s*\"([A-Z][A-Z0-9_]*)\"", "", 1),
    Rule("runtime", "config-value", JVM, r"@Value\(\s*\"\$\{([\w.-]+)", "", 1),
    Rule("runtime", "cron", JS, r"\bcron\.schedule\(\s*[\"']([^\"']+)[\"']", "", 1),
    Rule("runtime", "scheduled", JVM, r"@Scheduled\(\s*(\w+)\s*=\s*\"?([^\")]+)", "", 1, 2),
    Rule("runtime", "celery-task", PY, r"^@(?:app|shared|celery)[._]?(?:task|shared_task)\b[^\n]*\n\s*def\s+(\w+)", "", 1, 0, 2),
    # dependencies: name and scope
    Rule("dependency", "requirements.txt", "text", r"^([A-Za-z][\w.-]*)(?:\[[^\]]*\])?\s*(?:[=<>~!]=?[^#\n]*)?(?:#.*)?$", "runtime", 1),
    Rule("dependency", "Gemfile", RB, r"^\s*gem\s+[\"']([\w-]+)[\"']", "runtime", 1),
    Rule("dependency", "gemspec", RB, r"\badd_(?:runtime_|development_)?dependency\(?\s*[\"']([\w-]+)[\"']", "gemspec", 1),
    Rule("dependency", "go.mod", "go-mod", r"^\s*(?:require\s+)?([\w.-]+\.[\w]+/[\w./-]+)\s+v[\w.+-]+", "runtime", 1),
    Rule("dependency", "gradle", "groovy kotlin", r"\b(implementation|api|testImplementation|runtimeOnly|compileOnly)\s*\(?\s*[\"']([\w.-]+:[\w.-]+)", "gradle", 2, 1),
    Rule("dependency", "*.csproj", "msbuild", r"<PackageReference\s+Include=\"([^\"]+)\"", "msbuild", 1),
    Rule("dependency", "mix.exs", EX, r"\{\s*:(\w+)\s*,\s*\"", "runtime", 1),
    Rule("dependency", "project.clj", "clojure", r"\[([\w./-]+)\s+\"[^\"]+\"\]", "leiningen", 1),
    Rule("dependency", "build.sbt", "scala-build", r"\"([\w.-]+)\"\s*%%?\s*\"([\w.-]+)\"\s*%", "sbt", 2, 1),
    Rule("dependency", "Package.swift", "swift", r"\.package\(\s*(?:name:[^,\n]+,\s*)?url:\s*\"([^\"]+)\"", "swift-package", 1),
]

#: files that a dependency rule reads, by its label (fixed values)
MANIFESTS = {"requirements.txt": r"(^|/)requirements[^/]*\.txt$", "Gemfile": r"(^|/)Gemfile$", "gemspec": r"\.gemspec$", "go.mod": r"(^|/)go\.mod$", "gradle": r"(^|/)build\.gradle(\.kts)?$", "*.csproj": r"\.csproj$", "mix.exs": r"(^|/)mix\.exs$", "project.clj": r"(^|/)project\.clj$", "build.sbt": r"(^|/)build\.sbt$", "Package.swift": r"(^|/)Package\.swift$"}

#: the only files in which a runtime or route label counts, by path (fixed values)
PATHS = {
    "compose-service": r"(^|/)(docker-)?compose[^/]*\.ya?ml$", "compose-image": r"(^|/)(docker-)?compose[^/]*\.ya?ml$", "github-action": r"(^|/)\.github/(workflows|actions)/", "github-job": r"(^|/)\.github/workflows/",
    "github-secret": r"(^|/)\.github/", "gitlab-job": r"(^|/)\.gitlab-ci[^/]*\.ya?ml$", "kubernetes-kind": r"(^|/)(k8s|kubernetes|deploy|deployment|manifests|charts|templates|base|overlays)/", "kubernetes-name": r"(^|/)(k8s|kubernetes|deploy|deployment|manifests|base|overlays)/",
    "kubernetes-image": r"(^|/)(k8s|kubernetes|deploy|deployment|manifests|base|overlays)/", "kubernetes-schedule": r"(^|/)(k8s|kubernetes|deploy|manifests|\.github/workflows)/", "helm-chart": r"(^|/)Chart\.ya?ml$", "ansible-task": r"(^|/)(playbooks?|roles|tasks|handlers)/|(^|/)(site|playbook)\.ya?ml$",
    "spring-config": r"(^|/)(application|bootstrap)[^/]*\.ya?ml$", "appsettings": r"(^|/)appsettings[^/]*\.json$", "wrangler": r"(^|/)wrangler\.toml$", "vercel": r"(^|/)vercel\.json$", "procfile": r"(^|/)Procfile[^/]*$", "drupal": r"\.routing\.yml$",
}
#: label -> what its names are channels of (fixed values)
CHANNEL_OF = {"socket.io": "socket.io#", "electron": "ipc#", "tauri": "tauri#", "kafka": "kafka#", "rabbitmq": "rabbitmq#", "bullmq": "bullmq#", "laravel-route": "route:"}
#: (label, pattern over the path whose group is the route, side) of routes that stand in file names (fixed values)
FILE_ROUTES = [
    ("next-app", r"(?:^|/)app/(.*?)/?route\.[jt]sx?$", "backend"), ("sveltekit", r"(?:^|/)src/routes/(.*?)/?\+server\.[jt]s$", "backend"), ("next-api", r"(?:^|/)pages/(api/.*?)(?:/index)?\.[jt]sx?$", "backend"),
    ("nitro", r"(?:^|/)server/((?:api|routes)/.*?)(?:/index)?(?:\.(?:get|post|put|patch|delete))?\.[jt]s$", "backend"), ("astro", r"(?:^|/)src/pages/(.*?)(?:/index)?\.[jt]s$", "backend"),
    ("next-app", r"(?:^|/)app/(.*?)/?page\.[jt]sx$", "frontend"), ("next-pages", r"(?:^|/)pages/(?!api/)(?!_)(.*?)(?:/?index)?\.[jt]sx$", "frontend"), ("nuxt", r"(?:^|/)pages/(.*?)(?:/?index)?\.vue$", "frontend"),
    ("sveltekit", r"(?:^|/)src/routes/(.*?)/?\+page\.svelte$", "frontend"), ("astro", r"(?:^|/)src/pages/(.*?)(?:/?index)?\.astro$", "frontend"), ("solid-start", r"(?:^|/)src/routes/(.*?)(?:/?index)?\.[jt]sx$", "frontend"),
]
