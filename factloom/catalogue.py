"""The registered queries over the corpus operators, and the SQL that each must equal.

The tables hold no source code, so queries over code read a corpus that both engines write from the tables by the same
string functions: one file of routes for each nation and region, one page for each customer, one test for each supplier.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import extract as X
from .operators import pages as P
from .operators import relate as R
from .operators.contracts import contract_details
from .operators.classify import classify, kept_path, language_of, role_of
from .operators.link import link_calls
from .operators.ordered import first_wins, numbered, top_n
from .plans.project import commands, entrypoints, project_facts
from .plans.report import render
from .sources.tables import spread, stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---------------------------------------------------------------- pages

NORMAL = r"""CASE WHEN u = '' THEN '' ELSE CASE WHEN length(q) > 1 THEN regexp_replace(q, '/+$', '') ELSE q END END"""
_ROUTE = r"""(SELECT *, CASE WHEN starts_with(e, '/') THEN e ELSE '/' || e END AS q FROM
  (SELECT *, regexp_extract(regexp_replace(u, '^https?://[^/?#]*', ''), '^[^?#]*', 0) AS e FROM (SELECT *, trim(url) AS u FROM pages)))"""


@query("page_facts", rf"""SELECT page_id, {NORMAL} AS route, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title,
  nullif(regexp_extract({NORMAL}, '^/([a-z]{{2}})(?:/|$)', 1), '') AS language FROM {_ROUTE}""")
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_facts(table(spark, sf_dir, "pages"))


@query("page_title_count", r"SELECT regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, count(*) AS n FROM pages GROUP BY 1")
def page_title_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("html", P.TITLE, 1).alias("title")).agg(F.count("*").alias("n"))


@query("normalize_path", rf"SELECT page_id, {NORMAL} AS path FROM {_ROUTE}")
def normalize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.normalize_path(F.col("url")).alias("path"))


@query("external_hosts", r"SELECT regexp_extract(trim(url), '^https?://([^/?#]*)', 1) AS host, count(*) AS n FROM pages WHERE regexp_matches(trim(url), '^https?://') GROUP BY 1")
def external_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(T.external_host(F.col("url")).alias("host")).agg(F.count("*").alias("n")).filter("host is not null")


@query("nav_links", r"""SELECT href, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href=["'']([^"'']*)["'']', 1)) AS href FROM pages) GROUP BY 1""")
def nav_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.links(table(spark, sf_dir, "pages")).groupBy("href").agg(F.count("*").alias("n"))


@query("style_selectors", r"""SELECT selector, count(*) AS n FROM (SELECT trim(regexp_replace(unnest(regexp_extract_all(array_to_string(regexp_extract_all(html, '(?is)<style[^>]*>(.*?)</style>', 1), chr(10)), '([^{}@/;]+)\{', 1)), '\s+', ' ', 'g')) AS selector FROM pages) WHERE selector <> '' GROUP BY 1""")
def style_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.selectors(table(spark, sf_dir, "pages")).groupBy("selector").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- classification, on paths made from the part table

_EXT = ["py", "ts", "test.ts", "java", "min.js", "css", "html", "sql", "md", "png", "vue", "go", "json", "rb"]
_DIR = ["src", "node_modules/x", "docs", "src/controllers", "public", "src/models", "examples", "lib", "src/services", "tests"]
_PATHS = f"""(SELECT p_partkey, ([{','.join(repr(x) for x in _DIR)}])[p_partkey % {len(_DIR)} + 1] || '/part' || p_partkey || '.' || ([{','.join(repr(x) for x in _EXT)}])[p_partkey % {len(_EXT)} + 1] AS path FROM part)"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("p_partkey") % len(xs) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(at(_DIR), F.lit("/part"), "p_partkey", F.lit("."), at(_EXT)).alias("path"))


@query("language_by_suffix", f"""SELECT language, count(*) AS n FROM (SELECT CASE regexp_extract(path, '([^.]+)$', 1) WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'java' THEN 'java' WHEN 'js' THEN 'javascript' WHEN 'css' THEN 'css'
  WHEN 'html' THEN 'html' WHEN 'sql' THEN 'sql' WHEN 'md' THEN 'markdown' WHEN 'png' THEN 'image' WHEN 'vue' THEN 'vue' WHEN 'go' THEN 'go' WHEN 'json' THEN 'json' WHEN 'rb' THEN 'ruby' END AS language FROM {_PATHS}) GROUP BY 1""")
def language_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).groupBy(language_of(F.col("path")).alias("language")).agg(F.count("*").alias("n"))


@query("role_ladder", f"""SELECT p_partkey, CASE WHEN path LIKE '%.min.js' THEN 'generated' WHEN starts_with(path, 'tests/') OR path LIKE '%.test.ts' THEN 'test' WHEN starts_with(path, 'examples/') THEN 'sample'
  WHEN path LIKE '%.sql' THEN 'data-layer' WHEN path LIKE '%.css' THEN 'style' WHEN path LIKE '%.html' THEN 'frontend-page' WHEN path LIKE '%.vue' THEN 'source' WHEN starts_with(path, 'public/') OR path LIKE '%.png' THEN 'asset'
  WHEN path LIKE '%.md' OR starts_with(path, 'docs/') THEN 'documentation' WHEN contains(path, '/controller') THEN 'api' WHEN contains(path, '/model') THEN 'data-model' WHEN contains(path, '/service') THEN 'service' ELSE 'source' END AS role FROM {_PATHS}""")
def role_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("p_partkey", role_of(F.col("path")).alias("role"))


@query("ignored_dirs", f"SELECT p_partkey, path FROM {_PATHS} WHERE NOT contains('/' || path, '/node_modules/')")
def ignored_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).filter(kept_path(F.col("path")))


# ---------------------------------------------------------------- names and tokens

_TOKENS = "list_filter(list_distinct(list_transform(regexp_extract_all({0}, '[A-Za-z][A-Za-z0-9]*'), lambda x: lower(x))), lambda x: x NOT IN ('api','app','src','main','test','tests'))"


@query("token_set", f"SELECT doc_id, list_sort({_TOKENS.format('text')}) AS tokens FROM documents".replace("SELECT doc_id, list_sort(", "SELECT doc_id, array_to_string(list_sort(", 1).replace(") AS tokens", "), ' ') AS tokens"))
def token_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(T.tokens(F.col("text"))), " ").alias("tokens"))


@query("feature_name", f"SELECT p_partkey, coalesce(nullif(array_to_string(list_transform(list_sort({_TOKENS.format('p_name')})[1:2], lambda x: upper(x[1]) || lower(x[2:])), ' '), ''), 'Feature') AS feature FROM part")
def feature_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.feature_name(F.col("p_name")).alias("feature"))


@query("token_overlap_join", f"""WITH a AS (SELECT DISTINCT p_type, unnest({_TOKENS.format('p_type')}) AS t FROM part), b AS (SELECT DISTINCT p_brand, unnest({_TOKENS.format("p_brand || ' ' || p_type")}) AS t FROM part)
  SELECT p_type, count(DISTINCT p_brand) AS n FROM a JOIN b USING (t) GROUP BY 1""")
def token_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    a = part.select("p_type", F.explode(T.tokens(F.col("p_type"))).alias("t")).distinct()
    b = part.select("p_brand", F.explode(T.tokens(F.concat_ws(" ", "p_brand", "p_type"))).alias("t")).distinct()
    return a.join(b, "t").groupBy("p_type").agg(F.countDistinct("p_brand").alias("n"))


@query("service_substring_join", "SELECT a.r_name AS region, b.n_name AS nation FROM region a JOIN nation b ON contains(b.n_name, substr(a.r_name, 1, 1))")
def service_substring_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    # n-grams of the longer side make the substring an equi-join
    grams = b.select(F.col("n_name").alias("nation"), F.explode(F.array_distinct(F.expr("transform(sequence(1, length(n_name)), i -> substring(n_name, i, 1))"))).alias("g"))
    return a.select(F.col("r_name").alias("region"), F.substring("r_name", 1, 1).alias("g")).join(grams, "g").select("region", "nation")


# ---------------------------------------------------------------- order-dependent operators

@query("first_wins_dedupe", "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1")
def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return first_wins(e, ["user_id", "event_type"], ["event_id"])


@query("last_wins_lookup", "SELECT o.o_orderkey, CAST(l.last_part AS BIGINT) AS last_part FROM orders o LEFT JOIN (SELECT l_orderkey, arg_max(l_partkey, l_linenumber * 100000000 + l_partkey) AS last_part FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey")
def last_wins_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_partkey", F.col("l_linenumber") * 100000000 + F.col("l_partkey")).alias("last_part"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return orders.join(last, orders.o_orderkey == last.l_orderkey, "left").select("o_orderkey", "last_part")


@query("best_confidence", "SELECT s_nationkey, s_name, s_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_name) AS r FROM supplier) WHERE r = 1")
def best_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return first_wins(s, ["s_nationkey"], [F.col("s_acctbal").desc(), F.col("s_name")]).select("s_nationkey", "s_name", "s_acctbal")


@query("evidence_top10", "SELECT o_custkey, o_orderkey, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 10")
def evidence_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 10)


@query("trace_claims", "SELECT printf('REGION-%03d', row_number() OVER (ORDER BY claim)) AS claim_id, claim FROM (SELECT 'Has region ' || r_name || '.' AS claim FROM region) UNION ALL SELECT printf('NATION-%03d', row_number() OVER (ORDER BY claim)) AS claim_id, claim FROM (SELECT 'Has nation ' || n_name || '.' AS claim FROM nation)")
def trace_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "region").select(F.concat(F.lit("Has region "), "r_name", F.lit(".")).alias("claim"))
    b = table(spark, sf_dir, "nation").select(F.concat(F.lit("Has nation "), "n_name", F.lit(".")).alias("claim"))
    return numbered(a, "REGION", ["claim"]).unionByName(numbered(b, "NATION", ["claim"])).select("claim_id", "claim")


# ---------------------------------------------------------------- rules

_RULES = [("STANDARD", "basic"), ("PROMO", "offer"), ("ECONOMY", "cheap"), ("SMALL", "small"), ("MEDIUM", "medium"), ("LARGE", "large")]


@query("framework_rules", f"SELECT label, count(*) AS n FROM part JOIN (VALUES {','.join(map(str, _RULES))}) r(prefix, label) ON starts_with(p_type, prefix) GROUP BY 1")
def framework_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = F.broadcast(spark.createDataFrame(_RULES, "prefix string, label string"))  # a fixed table
    return table(spark, sf_dir, "part").join(rules, F.expr("startswith(p_type, prefix)")).groupBy("label").agg(F.count("*").alias("n"))


@query("gap_rules", """WITH c AS (SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS a, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS b, (SELECT count(*) FROM region WHERE r_name = 'NOWHERE') AS d)
  SELECT gap_id, n FROM (SELECT 'GAP-001' AS gap_id, a AS n, a > 0 AS holds FROM c UNION ALL SELECT 'GAP-002', b, b > 0 FROM c UNION ALL SELECT 'GAP-003', d, d = 0 FROM c) WHERE holds""")
def gap_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"))
    one = one.crossJoin(table(spark, sf_dir, "customer").agg(F.count_if(F.col("c_acctbal") < 0).alias("b"))).crossJoin(table(spark, sf_dir, "region").agg(F.count_if(F.col("r_name") == "NOWHERE").alias("d")))
    rules = [("GAP-001", "a", "a > 0"), ("GAP-002", "b", "b > 0"), ("GAP-003", "d", "d = 0")]
    rows = F.array(*[F.when(F.expr(c), F.struct(F.lit(i).alias("gap_id"), F.col(n).alias("n"))) for i, n, c in rules])
    return one.select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("g")).select("g.*")


@query("large_files", "SELECT doc_id, source, n_chars FROM documents WHERE n_chars >= 20000")
def large_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("n_chars >= 20000").select("doc_id", "source", "n_chars")


@query("json_props", "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long").alias("k")
    return table(spark, sf_dir, "events").groupBy("event_type", k).agg(F.count("*").alias("n"))


@query("module_boundaries", "SELECT CASE WHEN event_type IN ('click','view') THEN 'frontend' WHEN event_type = 'purchase' THEN 'backend-api' ELSE 'shared' END AS name, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1")
def module_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    name = F.when(t.isin("click", "view"), "frontend").when(t == "purchase", "backend-api").otherwise("shared")
    return table(spark, sf_dir, "events").groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))


@query("backend_surfaces", """SELECT l_returnflag, count(*) AS route_count, count(DISTINCT l_partkey) AS handler_count, (SELECT count(*) FROM supplier) AS service_count, (SELECT count(*) FROM part) AS model_count FROM lineitem GROUP BY 1""")
def backend_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("framework"), F.col("l_partkey").alias("handler"))
    return R.surfaces(routes, table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")).withColumnRenamed("framework", "l_returnflag")


# ---------------------------------------------------------------- differences, closure

_SPLIT = "TIMESTAMP '1995-01-01'"
_SIDES = f"(SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= {_SPLIT}) EXCEPT (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < {_SPLIT})"


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("customer"), F.col("o_orderpriority").alias("priority"), "o_orderdate")
    late = F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp")
    return o.filter(late), o.filter(~late)


@query("spec_diff", f"""WITH a AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS key FROM orders WHERE o_orderdate >= {_SPLIT}), b AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS key FROM orders WHERE o_orderdate < {_SPLIT})
  SELECT 'customer' AS surface, 'added' AS change, key FROM (SELECT key FROM a EXCEPT SELECT key FROM b) UNION ALL SELECT 'customer', 'removed', key FROM (SELECT key FROM b EXCEPT SELECT key FROM a)""")
def spec_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, before = _snapshots(spark, sf_dir)
    return R.spec_diff({"customer": now}, {"customer": before}, {"customer": ["customer"]})


@query("spec_diff_counts", f"""SELECT 'orders' AS surface, count(*) FILTER (o_orderdate >= {_SPLIT}) AS n_now, count(*) FILTER (o_orderdate < {_SPLIT}) AS n_before, count(*) FILTER (o_orderdate >= {_SPLIT}) - count(*) FILTER (o_orderdate < {_SPLIT}) AS delta FROM orders""")
def spec_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, before = _snapshots(spark, sf_dir)
    return R.count_diff({"orders": now}, {"orders": before})


@query("mount_closure", """WITH RECURSIVE e AS (SELECT 'root' AS parent, 'r' || r_regionkey AS child, lower(r_name) AS prefix FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, lower(n_name) FROM nation),
  m AS (SELECT 'root' AS node, '' AS prefix, 0 AS depth UNION ALL SELECT e.child, regexp_replace(m.prefix || '/' || e.prefix, '/+', '/', 'g'), m.depth + 1 FROM m JOIN e ON e.parent = m.node) SELECT DISTINCT node, prefix, depth FROM m""")
def mount_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "region").select(F.lit("root").alias("parent"), F.concat(F.lit("r"), "r_regionkey").alias("child"), F.lower("r_name").alias("prefix"))
    b = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"), F.lower("n_name").alias("prefix"))
    return R.mount_closure(a.unionByName(b), spark.createDataFrame([("root",)], "node string"))


# ---------------------------------------------------------------- the code corpus

_NATION_SRC = """'app.get(''/api/nations/' || n_nationkey || ''', getNation' || n_nationkey || ');' || chr(10) || 'app.post(''/api/nations/' || n_nationkey || '/customers'', addCustomer);' || chr(10)"""
_REGION_SRC = """'router.get(''/api/regions/:id/' || lower(r_name) || ''', getRegion);' || chr(10) || 'app.delete(''/api/unused/' || r_regionkey || ''', drop' || r_regionkey || ');' || chr(10)"""
_CUSTOMER_SRC = """CASE c_custkey % 6 WHEN 0 THEN 'fetch(''/api/nations/' || c_nationkey || ''');' WHEN 1 THEN 'axios.post(''/api/nations/' || c_nationkey || '/customers'', {});' WHEN 2 THEN 'axios.get(''https://host' || c_custkey % 3 || '.example.com/x'');'
  WHEN 3 THEN 'axios.get(''/api/regions/' || c_custkey || '/asia'');' WHEN 4 THEN 'axios.put(''/api/nations/' || c_nationkey || ''');' ELSE 'axios.get(''/api/missing/' || c_custkey || ''');' END || chr(10)"""
_SUPPLIER_SRC = """'API_KEY_' || s_suppkey || '=x' || chr(10) || 'export PORT=' || s_nationkey || chr(10)"""


def _spark_quotes(sql: str) -> str:
    """Doubled quotes inside string literals, as Spark escapes them."""
    out, inside, i = [], False, 0
    while i < len(sql):
        if inside and sql[i : i + 2] == "''":
            out.append("\\'")
            i += 2
            continue
        inside ^= sql[i] == "'"
        out.append(sql[i])
        i += 1
    return "".join(out)


def _rows(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    """The columns of a table that ``sql`` names; its rows are dealt over many tasks, but for tables of a fixed few rows."""
    rows = table(spark, sf_dir, name)
    rows = rows.select(*[c for c in rows.columns if c in sql])
    return rows if name in ("region", "nation") else spread(rows)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus: path, content."""
    def files(name: str, path: str, content: str) -> DataFrame:
        return _rows(spark, sf_dir, name, path + content).select(F.expr(path).alias("path"), F.expr(_spark_quotes(content)).alias("content"))

    parts = [files("nation", "'src/nations/n' || n_nationkey || '.js'", _NATION_SRC), files("region", "'src/regions/r' || r_regionkey || '.js'", _REGION_SRC), files("customer", "'web/c' || c_custkey || '.ts'", _CUSTOMER_SRC), files("supplier", "'config/s' || s_suppkey || '/.env'", _SUPPLIER_SRC)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_CODE = f"""code AS (SELECT 'src/nations/n' || n_nationkey || '.js' AS path, {_NATION_SRC} AS content FROM nation UNION ALL SELECT 'src/regions/r' || r_regionkey || '.js', {_REGION_SRC} FROM region
  UNION ALL SELECT 'web/c' || c_custkey || '.ts', {_CUSTOMER_SRC} FROM customer UNION ALL SELECT 'config/s' || s_suppkey || '/.env', {_SUPPLIER_SRC} FROM supplier)"""
_LINES = "lines AS (SELECT path, unnest(string_split(content, chr(10))) AS text, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM code)"
_RX = r"\b(?:app|router|server|api)\.(get|post|put|patch|delete|options|head)\(\s*[\"''`]([^\"''`\n]*)[\"''`](?:\s*,\s*[^,\n]+?)*?\s*(?:,\s*(\w[\w.]*))?\s*\)".replace('\\"', '"')
_ROUTES = f"""routes AS (SELECT upper(regexp_extract(text, '{_RX}', 1)) AS method, regexp_extract(text, '{_RX}', 2) AS rpath, regexp_extract(text, '{_RX}', 3) AS handler, path AS file, line FROM lines WHERE regexp_matches(text, '{_RX}'))"""
_CALLS = r"""calls AS (SELECT path, line, regexp_extract(text, 'fetch\(''([^'']+)''', 1) AS endpoint, 'GET' AS method, 'fetch' AS client FROM lines WHERE contains(text, 'fetch(')
  UNION ALL SELECT path, line, regexp_extract(text, 'axios\.(\w+)\(''([^'']+)''', 2), upper(regexp_extract(text, 'axios\.(\w+)\(''([^'']+)''', 1)), 'axios' FROM lines WHERE contains(text, 'axios.'))"""
_LINKS = r"""links AS (SELECT c.path AS source, c.endpoint, c.method, r.rpath AS matched_route,
   CASE WHEN starts_with(c.endpoint, 'https://') THEN 'external-url' WHEN r.rpath IS NULL THEN 'unmatched' WHEN r.rpath <> c.endpoint THEN 'param' WHEN r.method <> c.method THEN 'method-mismatch' ELSE 'exact' END AS match_type,
   CASE WHEN starts_with(c.endpoint, 'https://') THEN 'high' WHEN r.rpath IS NULL THEN 'low' WHEN r.rpath <> c.endpoint THEN 'medium' WHEN r.method <> c.method THEN 'low' ELSE 'high' END AS confidence,
   CASE WHEN starts_with(c.endpoint, 'https://') THEN 'external-api' ELSE 'backend-route' END AS target_kind
   FROM calls c LEFT JOIN routes r ON r.rpath = c.endpoint OR (contains(r.rpath, '/:id/') AND c.method = r.method AND regexp_matches(c.endpoint, '^/api/regions/\d+/' || regexp_extract(r.rpath, '([^/]+)$', 1) || '$')))"""
_ALL = f"WITH {_CODE}, {_LINES}, {_ROUTES}, {_CALLS}, {_LINKS} "


def _routes(files: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    return X.api_routes(files, raw)


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """routes, links of the corpus, by one scan of it."""
    files = classify(code_files(spark, sf_dir))
    raw = stored(X.extract(files, [*X.ROUTE_FAMILIES, "call"]), "matches")
    routes, calls = stored(_routes(files, raw), "routes"), X.api_calls(files, raw)
    keyed = calls.select(F.xxhash64("path", "line").alias("call_id"), F.col("path").alias("source"), "endpoint", "method", "client")
    known = routes.select(F.xxhash64("method", "path").alias("route_id"), "method", "path", "framework", "handler", F.lit(None).cast("string").alias("route_name"))
    return routes, link_calls(keyed, known)


@query("extract_routes_express", _ALL + "SELECT method, rpath AS path, handler, file, line FROM routes")
def extract_routes_express(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routes(classify(code_files(spark, sf_dir))).select("method", "path", "handler", "evidence.file", F.col("evidence.line_start").cast("long").alias("line"))


@query("extract_calls", _ALL + "SELECT path, endpoint, method, client, line FROM calls")
def extract_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.api_calls(classify(code_files(spark, sf_dir))).select("path", "endpoint", "method", "client", F.col("line").cast("long").alias("line"))


@query("link_calls", _ALL + "SELECT source, endpoint, method, matched_route, match_type, confidence, target_kind FROM links")
def link_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir)[1].select("source", "endpoint", "method", "matched_route", "match_type", "confidence", "target_kind")


@query("link_tiers", _ALL + "SELECT match_type, confidence, count(*) AS n FROM links GROUP BY 1, 2")
def link_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir)[1].groupBy("match_type", "confidence").agg(F.count("*").alias("n"))


@query("unmatched_calls", _ALL + "SELECT source, endpoint FROM links WHERE match_type = 'unmatched'")
def unmatched_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unmatched_calls(_links(spark, sf_dir)[1]).select("source", "endpoint")


@query("unlinked_routes", _ALL + "SELECT method, rpath AS path FROM routes r WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE (c.endpoint = r.rpath AND c.method = r.method) OR (r.method = 'GET' AND c.endpoint = r.rpath AND c.method = 'PUT') OR (contains(r.rpath, '/:id/') AND c.method = 'GET' AND regexp_matches(c.endpoint, '^/api/regions/\\d+/' || regexp_extract(r.rpath, '([^/]+)$', 1) || '$')))".replace("\\\\", "\\"))
def unlinked_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes, links = _links(spark, sf_dir)
    return R.unlinked_routes(routes, links).select("method", "path")


@query("env_keys", r"SELECT 'config/s' || s_suppkey || '/.env' AS path, k AS name FROM supplier, LATERAL (SELECT unnest(['API_KEY_' || s_suppkey, 'PORT']) AS k)")
def env_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.named(classify(code_files(spark, sf_dir)), "runtime").filter("kind = 'env-key'").select("path", "name")


@query("quality_ratios", _ALL + """SELECT 'linked_call_ratio' AS metric, round(count(*) FILTER (matched_route IS NOT NULL) / count(*), 4) AS value FROM links WHERE target_kind = 'backend-route'""")
def quality_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir)[1].filter("target_kind = 'backend-route'")
    return links.agg(F.round(F.count_if(F.col("matched_route").isNotNull()) / F.count("*"), 4).alias("value")).select(F.lit("linked_call_ratio").alias("metric"), "value")


@query("contract_gaps", """SELECT CAST(o_orderkey AS VARCHAR) AS contract, unnest(list_filter([CASE WHEN o_orderstatus = 'O' THEN 'unknown-request' END, CASE WHEN o_totalprice < 50000 THEN 'unknown-response' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'unknown-status' END], lambda x: x IS NOT NULL)) AS gap_type FROM orders""")
def contract_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    none, some = F.array().cast("array<string>"), F.array(F.lit("x"))
    c = o.select(F.col("o_orderkey").cast("string").alias("path"), F.lit(None).cast("string").alias("method"), F.when(F.col("o_orderstatus") == "O", none).otherwise(some).alias("request_hints"), F.when(F.col("o_totalprice") < 50000, none).otherwise(some).alias("response_hints"), F.when(F.col("o_orderpriority").startswith("1"), none).otherwise(some).alias("status_codes"), some.alias("error_hints"))
    empty = c.filter("false")
    return R.contract_gaps(c, empty.withColumn("endpoint", F.col("path")), empty)


@query("frontend_surfaces", "SELECT c_mktsegment AS framework, count(*) AS route_count, count(DISTINCT c_nationkey) AS component_count, (SELECT count(*) FROM customer) AS total FROM customer GROUP BY 1")
def frontend_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    own = c.groupBy(F.col("c_mktsegment").alias("framework")).agg(F.count("*").alias("route_count"), F.countDistinct("c_nationkey").alias("component_count"))
    return own.crossJoin(F.broadcast(c.agg(F.count("*").alias("total"))))


@query("customers_without_large_orders", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 400000)")
def customers_without_large_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select("o_custkey")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti")


@query("test_map_terms", r"""WITH b AS (SELECT DISTINCT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{8,}'))) AS term FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{8,}'))) AS term FROM documents)
  SELECT item_id, count(*) AS n_pairs, count(DISTINCT doc_id) AS n_docs FROM b JOIN d USING (term) GROUP BY 1""")
def test_map_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    def terms(name: str, key: str) -> DataFrame:
        found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0)))
        return table(spark, sf_dir, name).select(key, F.explode(found).alias("term")).distinct()

    return terms("benchmark", "item_id").join(terms("documents", "doc_id"), "term").groupBy("item_id").agg(F.count("*").alias("n_pairs"), F.countDistinct("doc_id").alias("n_docs"))


# ---------------------------------------------------------------- a corpus of services: mounted routers, models, tests, manifests

#: (table, path, content) of its files, as string functions of both engines
_SERVICES = [
    ("region", "'srv/r' || r_regionkey || '/index.js'", "'const users = require(''./users'');' || chr(10) || 'app.use(''/r' || r_regionkey || '/api'', users);' || chr(10)"),
    ("region", "'srv/r' || r_regionkey || '/users.js'", "'router.get(''/list/:id'', (req, res) => {' || chr(10) || '  if (!req.query.page) {' || chr(10) || '    res.status(404).json({});' || chr(10) || '  }' || chr(10) || '});' || chr(10)"),
    ("region", "'srv/r' || r_regionkey || '/package.json'", "'{\"dependencies\": {\"express\": \"1\"}}'"),
    ("nation", "'api/n' || n_nationkey || '/main.py'", "'from routers import items' || chr(10) || 'app.include_router(items.router, prefix=\"/n' || n_nationkey || '\")' || chr(10)"),
    ("nation", "'api/n' || n_nationkey || '/routers/items.py'", "'router = APIRouter(prefix=\"/items\")' || chr(10) || '@router.post(\"/{item_id}\", status_code=201, response_model=Item)' || chr(10) || 'def add' || n_nationkey || '(item_id: int, body: Item):' || chr(10) || '    raise HTTPException(409)' || chr(10)"),
    ("supplier", "'tests/s' || s_suppkey || '.test.js'", "CASE WHEN s_suppkey % 2 = 0 THEN 'visit(''/r' || s_nationkey % 5 || '/api/list/:id'');' ELSE 'ok();' END || chr(10)"),
    ("part", "'app/models/p' || p_partkey || '.py'", "'class Part' || p_partkey || '(BaseModel):' || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN '    pass' ELSE '    name: str' || chr(10) || '    size: int' END || chr(10)"),
]


def service_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus: path, content."""
    return R.union_all([_rows(spark, sf_dir, name, path + content).select(F.expr(path).alias("path"), F.expr(_spark_quotes(content)).alias("content")) for name, path, content in _SERVICES])


_FACTS: dict[tuple[str, str], dict[str, DataFrame]] = {}


def _service_facts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Every fact of the corpus; the analysis is the same for each query of one session, so it is planned once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FACTS:
        _FACTS[key] = project_facts(classify(service_files(spark, sf_dir)))
    return _FACTS[key]


def _service_routes(spark: SparkSession, sf_dir: str, more: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The classified files, their routes, and the matches of the routes' families and ``more``, by one scan; all are stored."""
    files = stored(classify(service_files(spark, sf_dir)), "files")
    raw = stored(X.extract(files, [*X.ROUTE_FAMILIES, *(more or [])]), "matches")
    return files, stored(X.api_routes(files, raw), "routes"), raw


@query("mounted_routes", """SELECT 'GET' AS method, '/r' || r_regionkey || '/api/list/:id' AS path, NULL AS handler, 'express' AS framework, 'srv/r' || r_regionkey || '/users.js' AS file FROM region
  UNION ALL SELECT 'POST', '/n' || n_nationkey || '/items/{item_id}', 'add' || n_nationkey, 'fastapi', 'api/n' || n_nationkey || '/routers/items.py' FROM nation""")
def mounted_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _service_routes(spark, sf_dir)[1].select("method", "path", "handler", "framework", "evidence.file")


@query("contract_hints", """SELECT '/r' || r_regionkey || '/api/list/:id' AS path, 'query:req.query.page' AS request, 'response:res.json' AS response, '404' AS status, 'error:4xx-or-5xx-status' AS error FROM region
  UNION ALL SELECT '/n' || n_nationkey || '/items/{item_id}', 'path:item_id|path:item_id:int|body:body:Item', 'response_model:Item', '201', 'error:HTTPException|error:raise |error:4xx-or-5xx-status' FROM nation""")
def contract_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, routes, _ = _service_routes(spark, sf_dir)
    c = R.contracts(routes.select("method", "path", "framework"), contract_details(files, routes))
    return c.select("path", *[F.array_join(x, "|").alias(n) for x, n in (("request_hints", "request"), ("response_hints", "response"), ("status_codes", "status"), ("error_hints", "error"))])


@query("model_fields", "SELECT 'Part' || p_partkey AS name, 'pydantic' AS kind, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'name,size' END AS fields FROM part")
def model_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.data_models(classify(service_files(spark, sf_dir))).select("name", "kind", F.array_join("fields", ",").alias("fields"))


@query("detected_frameworks", "SELECT 'express' AS name, 'backend' AS category, 'dependency:srv/r' || min(r_regionkey) || '/package.json' AS source, 0.95 AS confidence FROM region")
def detected_frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = classify(service_files(spark, sf_dir))
    return X.frameworks(X.dependencies(files), X.named(files, "import")).withColumn("confidence", F.col("confidence").cast("decimal(3,2)").cast("double"))


@query("test_targets", """SELECT 'tests/s' || s_suppkey || '.test.js' AS test_path, CASE WHEN s_suppkey % 2 = 0 THEN 'api-route' ELSE 'unmatched' END AS target_kind,
  CASE WHEN s_suppkey % 2 = 0 THEN 'GET /r' || s_nationkey % 5 || '/api/list/:id' END AS target, CASE WHEN s_suppkey % 2 = 0 THEN 'high' ELSE 'low' END AS confidence FROM supplier""")
def test_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, routes, raw = _service_routes(spark, sf_dir, X.MODEL_FAMILIES)
    targets = X.data_models(files, raw).select(F.lit("data-model").alias("kind"), "name", F.lit(0).cast("long").alias("ord")).distinct()
    return R.test_maps(files, routes, targets)


@query("boundary_sizes", """SELECT 'shared' AS name, count(*) AS n_files FROM region UNION ALL SELECT 'cli', count(*) FROM nation UNION ALL SELECT 'backend-api', (SELECT count(*) FROM region) + count(*) FROM nation UNION ALL SELECT 'frontend', 0
  UNION ALL SELECT 'runtime-config', 0 UNION ALL SELECT 'tests', count(*) FROM supplier UNION ALL SELECT 'data-layer', count(*) FROM part""")
def boundary_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stored(classify(service_files(spark, sf_dir)), "files")
    raw = stored(X.extract(files), "matches")
    tests = files.filter("role = 'test'").select(F.col("path").alias("test_path"))
    facts = {"files": files, "routes": X.api_routes(files, raw), "models": X.data_models(files, raw), "commands": commands(files, raw), "entrypoints": entrypoints(files), "test_maps": tests}
    return R.boundary_counts(stored(R.module_boundaries(facts), "boundaries"))


@query("refactor_findings", """SELECT title, count(*) AS n FROM (SELECT 'Backend route has no detected frontend caller' AS title FROM region UNION ALL SELECT 'Backend route has no detected frontend caller' FROM nation
  UNION ALL SELECT 'Test file could not be mapped' FROM supplier WHERE s_suppkey % 2 = 1) GROUP BY 1""")
def refactor_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _service_facts(spark, sf_dir)["findings"].groupBy("title").agg(F.count("*").alias("n"))


@query("gap_evidence", """SELECT gap_id, CAST(rank AS INTEGER) AS rank, evidence FROM (SELECT 'GAP-008' AS gap_id, row_number() OVER (ORDER BY e) AS rank, e AS evidence FROM (SELECT 'app/models/p' || p_partkey || '.py:1' AS e FROM part WHERE p_partkey % 3 = 0)
  UNION ALL SELECT 'GAP-015', row_number() OVER (ORDER BY e), e FROM (SELECT 'tests/s' || s_suppkey || '.test.js' AS e FROM supplier WHERE s_suppkey % 2 = 1)) WHERE rank <= 10""")
def gap_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, routes, raw = _service_routes(spark, sf_dir, X.MODEL_FAMILIES)
    models = stored(X.data_models(files, raw), "models")
    targets = models.select(F.lit("data-model").alias("kind"), "name", F.lit(0).cast("long").alias("ord")).distinct()
    facts = {"models": models, "test_maps": R.test_maps(files, routes, targets)}
    return R.gap_evidence(facts, spark.createDataFrame([("GAP-008",), ("GAP-015",)], "gap_id string"))


@query("service_gaps", """SELECT * FROM (VALUES ('GAP-006', 'low'), ('GAP-007', 'medium'), ('GAP-008', 'low'), ('GAP-015', 'low')) g(gap_id, severity)""")
def service_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _service_facts(spark, sf_dir)["gaps"].select("gap_id", "severity")


@query("service_claims", """WITH r AS (SELECT count(*) AS n FROM region), a AS (SELECT count(*) AS n FROM nation), s AS (SELECT count(*) AS n FROM supplier), p AS (SELECT count(*) AS n FROM part)
  SELECT 'language' AS claim_type, CAST(3 AS BIGINT) AS n UNION ALL SELECT 'dependency', n FROM r UNION ALL SELECT 'entrypoint', n FROM a UNION ALL SELECT 'framework', 1 UNION ALL SELECT 'api-route', r.n + a.n FROM r, a UNION ALL SELECT 'data-model', n FROM p
  UNION ALL SELECT 'test-map', n FROM s UNION ALL SELECT 'feature-map', r.n + a.n FROM r, a UNION ALL SELECT 'module-boundary', 7 UNION ALL SELECT 'refactor-finding', r.n + a.n + (s.n + 1) // 2 FROM r, a, s UNION ALL SELECT 'contract-gap', r.n + a.n FROM r, a UNION ALL SELECT 'symbol', a.n + p.n FROM a, p UNION ALL SELECT 'import', r.n + a.n FROM r, a""")
def service_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _service_facts(spark, sf_dir)["claims"].groupBy("claim_type").agg(F.count("*").alias("n"))


@query("service_documents", """WITH r AS (SELECT count(*) AS n FROM region), a AS (SELECT count(*) AS n FROM nation), s AS (SELECT count(*) AS n FROM supplier), p AS (SELECT count(*) AS n FROM part)
  SELECT 'api-routes' AS document, r.n + a.n AS n FROM r, a UNION ALL SELECT 'data-models', n FROM p UNION ALL SELECT 'tests', n FROM s UNION ALL SELECT 'gaps', 4 UNION ALL SELECT 'inventory', 3 * r.n + 2 * a.n + s.n + p.n FROM r, a, s, p""")
def service_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = render(_service_facts(spark, sf_dir)).filter("document in ('api-routes', 'data-models', 'tests', 'gaps', 'inventory')")
    return rows.groupBy("document").agg(F.max("n").alias("n"))


@query("project_claims")
def project_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All claims of the code corpus, by the whole project plan."""
    return project_facts(classify(code_files(spark, sf_dir)))["claims"]


@query("project_report")
def project_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the code corpus."""
    return render(project_facts(classify(code_files(spark, sf_dir))))
