"""Linking API calls to routes: candidates by equi-joins on derived keys, then the best tier and the best row of it.

Calls repeat, so distinct (endpoint, method, client) are linked once and joined back.  A route pattern is keyed by the texts
of its static parts and their places, and an endpoint looks under its own texts at the places of each such pattern of its
length; routes that are alike stand once, by their least.  So no tier compares all calls with all routes, however alike their
paths begin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import external_host, is_static, meets, normalize_path, optional_variants, parsed, unquoted, without_format
from ..sources.tables import stored

#: (tier, match_type, confidence of a method match) (fixed values)
TIERS = [
    (1, "named-route", "high"), (2, "phoenix-helper", "high"), (3, "rails-helper", "medium"), (4, "exact", "high"), (5, "case-insensitive", "medium"), (6, "format-suffix", "medium"), (7, "param", "medium"),
    (8, "rails-anchored-param", "low"), (9, "rails-resource-text-id-param", "low"), (10, "param-format-suffix", "medium"), (11, "rails-anchored-param-format-suffix", "low"),
    (12, "rails-resource-text-id-param-format-suffix", "low"), (13, "static-choice-param", "low"), (14, "static-page-family", "low"), (15, "trpc-procedure", "medium"),
]
PARAM_TIER, EXACT_TIER = 7, 4


def _least(routes: DataFrame, *by: str | Column) -> DataFrame:
    """The least route of each method among those alike in ``by``: no other of them can be chosen, so a path that many routes share costs no pairs."""
    return routes.groupBy(*by, F.upper("method").alias("has")).agg(F.min("route_id").alias("route_id"))


def _patterns(routes: DataFrame, path: Column) -> DataFrame:
    """The shapes of routes' variants: parts, the places that need their own text, these texts as key, specificity.

    Nothing is asked of a parameter but whether its name ends in id, so parameters are alike otherwise.
    """
    v = routes.select("route_id", "method", "kind", "framework", F.explode(optional_variants(path)).alias("variant")).withColumn("parts", parsed(F.col("variant"))).filter(F.size("parts") > 0)
    alike = F.transform("parts", lambda p: F.struct(p.kind.alias("kind"), F.when(p["name"].endswith("id"), "id").otherwise("").alias("name"), F.when(p.kind == "param", "").otherwise(p.text).alias("text")))
    v = _least(v.withColumn("parts", alike), "kind", "framework", "parts")
    count = lambda *kinds: F.size(F.filter("parts", lambda p: p.kind.isin(*kinds)))
    star = F.array_position(F.transform("parts", lambda p: p.kind), "rest")
    mask = F.transform("parts", lambda p, i: ~p.kind.isin("param", "rest", "version") & ((F.col("star") == 0) | (i < F.col("star") - 1)))
    specificity = F.struct((F.size("parts") - count("param", "rest")).alias("s"), (-count("rest")).alias("w"), (-count("param")).alias("p"))
    v = v.withColumn("star", star).withColumn("mask", mask)
    return v.select("route_id", "kind", "framework", "parts", F.size("parts").alias("n"), "mask", _key("parts", "mask").alias("key"), specificity.alias("specificity"))


def _key(parts: str, mask: str) -> Column:
    """The texts of the parts that ``mask`` names, at their places."""
    return F.array_join(F.zip_with(parts, mask, lambda p, m: F.when(m, p.text).otherwise("*")), "/")


def _same_shape(calls: DataFrame, patterns: DataFrame, endpoint: str) -> DataFrame:
    """Endpoints beside the patterns of as many parts whose static parts they have: call_id, own, and the pattern's columns. Written, as many tiers look at it.

    An endpoint has one key for each mask among the patterns of its length, so what it meets is found by its texts and not by trying.
    """
    patterns = stored(patterns, "patterns")
    masks = patterns.select("n", "mask").distinct()
    ends = calls.filter(F.col(endpoint) != "").select("call_id", parsed(F.col(endpoint)).alias("own")).filter(F.size("own") > 0)
    ends = stored(ends.withColumn("n", F.size("own")), "endpoints").join(masks, "n")
    return ends.select("call_id", "own", "n", _key("own", "mask").alias("key")).join(patterns.drop("mask"), ["n", "key"])


#: whether a static part of the route is met by the endpoint's
_ANCHORED = lambda: F.exists(F.zip_with("parts", "own", lambda p, o: is_static(p) & meets(p, o)), lambda x: x)


def _best(both: DataFrame) -> DataFrame:
    return both.groupBy("call_id", "route_id").agg(F.max("specificity").alias("specificity"))


def _pattern_matches(both: DataFrame, signal: bool) -> DataFrame:
    """Routes whose parts up to a rest take the endpoint's. ``signal``: a lone id or parameters only are enough beside shared static parts."""
    star = F.array_position(F.transform("parts", lambda p: p.kind), "rest")
    upto = F.when(star > 0, star - 1).otherwise(F.col("n")).cast("int")
    fits = F.forall(F.slice(F.zip_with("parts", "own", meets), F.lit(1), upto), lambda x: x)
    route, own = F.element_at("parts", 1), F.element_at("own", 1)
    one_id = (F.col("n") == 1) & F.coalesce(route["name"].endswith("id"), F.lit(False)) & own.kind.isin("id", "param")
    all_params = F.forall("own", lambda o: o.kind == "param")
    return _best(both.filter(fits & (_ANCHORED() | (one_id | all_params) if signal else _ANCHORED())))


def _text_id_matches(both: DataFrame, members: bool) -> DataFrame:
    """Rails routes whose id parameters stand for words: each between static parts, or (``members``) on resource member routes after a plural part."""
    n = F.size("parts")
    text = lambda p, o: (p.kind == "param") & p["name"].endswith("id") & o.kind.isin("word", "version")
    met = F.zip_with("parts", "own", lambda p, o: F.when(meets(p, o), "met").when(text(p, o), "text").otherwise("no"))
    static_at = lambda i: F.coalesce(is_static(F.get("parts", i)), F.lit(False))
    last = F.get("parts", n - 1)
    if members:
        safe = F.transform(met, lambda m, i: (m == "met") | ((m == "text") & static_at(i - 1) & F.get("parts", i - 1).text.endswith("s")))
        wanted = F.col("kind") == "rails-resource-member-route"
    else:
        safe = F.transform(met, lambda m, i: (m == "met") | ((m == "text") & static_at(i - 1) & static_at(i + 1)))
        wanted = is_static(last)
    ok = (F.col("framework") == "rails") & F.coalesce(wanted, F.lit(False)) & F.exists(met, lambda m: m == "text") & F.forall(safe, lambda x: x)
    return _best(both.filter(ok & _ANCHORED()))


def link_calls(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """calls (call_id, source, endpoint, method, client) and routes (route_id, method, path, framework, handler, route_name[, kind])
    -> one row per call: call_id, source, endpoint, method, matched_route, matched_method, matched_framework, match_type, confidence, target_kind.
    """
    asked = calls.select("endpoint", "method", "client").distinct().withColumn("call_id", F.xxhash64("endpoint", "method", "client"))
    host = external_host(F.col("endpoint"))
    open_ = asked.filter(host.isNull() | (unquoted(F.col("endpoint")) == "")).withColumn("e", normalize_path(F.col("endpoint"))).withColumn("ef", without_format(F.col("e")))
    r = routes.withColumn("p", normalize_path(F.col("path"))).withColumn("pf", without_format(F.col("p")))
    flat = F.struct(F.lit(0).alias("s"), F.lit(0).alias("w"), F.lit(0).alias("p"))

    def tier(number: int, df: DataFrame) -> DataFrame:
        spec = F.col("specificity") if "specificity" in df.columns else flat
        return df.select("call_id", "route_id", F.lit(number).alias("tier"), spec.alias("specificity"))

    def equal(number: int, left: Column, right: Column, only: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
        a = (open_ if ends is None else ends).select("call_id", left.alias("k")).filter("k is not null and k <> ''")
        b = _least((r if only is None else only).select("route_id", "method", right.alias("k")).filter("k is not null and k <> ''"), "k")
        return tier(number, a.join(b, "k"))

    s = unquoted(F.col("endpoint"))
    name = F.when(s.startswith("route:"), F.substring_index(s, ":", -1))
    helper = F.regexp_extract(s, r"^phoenix-helper:(\w+):(\w+)$", 1)
    action = F.regexp_extract(s, r"^phoenix-helper:(\w+):(\w+)$", 2)
    phoenix = F.when(helper != "", F.concat(F.regexp_replace(F.lower(helper), "_", ""), F.lit(":"), action))
    handler = F.concat(F.regexp_replace(F.lower(F.regexp_extract("handler", r"(\w+?)Controller[.:#](\w+)$", 1)), "_", ""), F.lit(":"), F.regexp_extract("handler", r"(\w+?)Controller[.:#](\w+)$", 2))
    rails = F.when(s.startswith("rails-helper:"), F.regexp_replace(F.substring_index(s, ":", -1), "_(path|url)$", ""))
    stem = F.array_join(F.transform(F.filter(parsed(F.col("p")), is_static), lambda x: x.text), "_")
    last = F.when((F.col("client") == "trpc") & F.col("e").startswith("/trpc/"), F.regexp_extract("e", r"([^./]+)$", 1))
    trpc = r.filter((F.col("framework") == "trpc") & F.col("p").startswith("/trpc/")).withColumn("k", F.regexp_extract("p", r"([^./]+)$", 1))
    single = trpc.withColumn("n", F.count("*").over(Window.partitionBy("k"))).filter("n = 1")

    choice = _static_choices(open_, r)
    if "kind" not in r.columns:
        r = r.withColumn("kind", F.lit("route"))
    whole, bare = _same_shape(open_, _patterns(r, F.col("p")), "e"), _same_shape(open_, _patterns(r, F.col("pf")), "ef")
    page = open_.filter((F.upper("method") == "GET") & F.col("e").rlike(r"^/:[A-Za-z_][\w-]*\.html$"))
    page = calls.filter(F.lower("source").contains("static")).select("endpoint", "method", "client").distinct().join(page, ["endpoint", "method", "client"], "left_semi").withColumn("call_id", F.xxhash64("endpoint", "method", "client"))
    shown = r.filter((F.upper("method") == "GET") & (F.lower("handler") == "static#show") & F.col("p").rlike(r"^/[A-Za-z][\w-]*$"))
    seen = routes.agg(F.collect_set("framework").alias("frameworks"), F.count("route_name").alias("named")).first()  # a few names
    needs = {2: "phoenix", 3: "rails", 5: "aspnetcore", 8: "rails", 9: "rails", 11: "rails", 12: "rails", 15: "trpc"}
    kept = {1: seen.named > 0} | {number: framework in seen.frameworks for number, framework in needs.items()}
    found = [
        equal(1, name, F.col("route_name")),
        equal(2, phoenix, handler, r.filter(F.col("framework") == "phoenix")),
        equal(3, rails, stem, r.filter(F.col("framework") == "rails")),
        equal(4, F.col("e"), F.col("p")),
        equal(5, F.lower("e"), F.lower("p"), r.filter(F.col("framework") == "aspnetcore")),
        equal(6, F.col("ef"), F.col("pf")),
        tier(7, _pattern_matches(whole, True)),
        tier(8, _text_id_matches(whole, False)),
        tier(9, _text_id_matches(whole, True)),
        tier(10, _pattern_matches(bare, False)),
        tier(11, _text_id_matches(bare, False)),
        tier(12, _text_id_matches(bare, True)),
        tier(13, choice),
        equal(14, F.lit("static#show"), F.lower("handler"), shown, page),
        equal(15, last, F.col("k"), single),
    ]
    # tiers that no route of this corpus can meet are left out of the plan
    found = [df for (number, _, _), df in zip(TIERS, found, strict=True) if kept.get(number, True)]
    all_ = found[0]
    for more in found[1:]:
        all_ = all_.unionByName(more)

    least = r.groupBy("route_id", F.upper("method").alias("has")).agg(F.min(F.struct("path", "framework")).alias("least"))  # one place of those a route is declared at
    both = all_.join(asked.select("call_id", F.upper("method").alias("asked_method")), "call_id").join(least.select("route_id", "has", F.col("least.path").alias("route_path"), "least.framework"), "route_id")
    hit = F.col("has").isin("ANY", "ALL") | F.coalesce(F.col("has") == F.col("asked_method"), F.lit(False))
    stream = (F.col("asked_method") == "STREAM") & (F.col("has") == "GET")
    rank = F.when(hit, 0).when(F.coalesce(stream, F.lit(False)), 1).when(F.col("asked_method").isNull(), 2).when(F.col("tier") == EXACT_TIER, 3).otherwise(9)
    ranked = both.withColumn("rank", rank)
    # the first tier with a candidate decides, but tier 7 lets the later ones try when its methods don't fit
    ranked = ranked.filter(~((F.col("tier") == PARAM_TIER) & (F.col("rank") == 9)))
    best = F.struct("tier", "rank", (-F.col("specificity.s")).alias("s"), (-F.col("specificity.w")).alias("w"), (-F.col("specificity.p")).alias("p"), "route_id", "route_path", "has", "framework")
    chosen = ranked.groupBy("call_id").agg(F.min(best).alias("b")).filter("b.rank < 9")
    types = F.create_map(*[F.lit(x) for t, m, _ in TIERS for x in (t, m)])
    levels = F.create_map(*[F.lit(x) for t, _, c in TIERS for x in (t, c)])
    t, k = F.col("b.tier"), F.col("b.rank")
    kind = F.when(k == 1, "stream-get").when(k == 3, "method-mismatch").otherwise(types[t])
    level = F.when(k == 0, levels[t]).when(k == 1, "medium").when(k == 2, F.when(t == EXACT_TIER, "medium").otherwise("low")).otherwise("low")
    linked = asked.join(chosen.select("call_id", F.col("b.route_path").alias("matched_route"), F.col("b.has").alias("matched_method"), F.col("b.framework").alias("route_framework"), kind.alias("mt"), level.alias("cf")), "call_id", "left")
    dynamic = s.startswith("dynamic:") | s.contains("${")
    target = F.when(host.isNotNull(), "external-api").when(F.col("mt").isNotNull(), "backend-route").when(dynamic, "dynamic-endpoint").when(s.startswith("rails-helper:"), "framework-helper").otherwise("backend-route")
    other = F.when(F.col("t") == "external-api", "external-url").when(F.col("t") != "backend-route", F.col("t")).otherwise("unmatched")
    out = linked.withColumn("t", target).select(
        "endpoint", "method", "client", "matched_route", "matched_method",
        F.coalesce("route_framework", F.when(F.col("t") == "external-api", host).when(F.col("t") == "dynamic-endpoint", "dynamic").when(F.col("t") == "framework-helper", "rails")).alias("matched_framework"),
        F.coalesce("mt", other).alias("match_type"),
        F.coalesce("cf", F.when(F.col("t") == "external-api", "high").when(F.col("t") == "backend-route", "low").otherwise("medium")).alias("confidence"),
        F.col("t").alias("target_kind"),
    )
    out = out.withColumnsRenamed({"endpoint": "_e", "method": "_m", "client": "_c"})
    on = F.col("endpoint").eqNullSafe(F.col("_e")) & F.col("method").eqNullSafe(F.col("_m")) & F.col("client").eqNullSafe(F.col("_c"))
    return calls.join(out, on, "left").select("call_id", "source", "endpoint", "method", "matched_route", "matched_method", "matched_framework", "match_type", "confidence", "target_kind")


def _static_choices(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Endpoints whose parameters stand for at least two static alternatives of one route shape."""
    ends = calls.select("call_id", parsed(F.col("ef")).alias("own")).filter(F.exists("own", lambda x: x.kind == "param"))
    shape = F.array_join(F.transform("own", lambda x: F.when(x.kind == "param", "*").otherwise(x.text)), "/")
    ends = ends.select("call_id", shape.alias("shape"), F.transform("own", lambda x: x.kind == "param").alias("hole"))
    holes = ends.select("hole").distinct().withColumn("n", F.size("hole"))
    parts = routes.select("route_id", "method", parsed(F.col("pf")).alias("own")).filter((F.size("own") > 0) & ~F.exists("own", lambda x: x.kind == "param"))
    parts = parts.select("route_id", "method", F.transform("own", lambda x: x.text).alias("parts"), F.size("own").alias("n"))
    safe = F.forall(F.zip_with("parts", "hole", lambda p, h: ~h | p.rlike(r"^[A-Za-z][\w-]*$")), lambda x: x)
    seen = parts.join(holes, "n").filter(safe).select("route_id", "method", F.array_join(F.zip_with("parts", "hole", lambda p, h: F.when(h, "*").otherwise(p)), "/").alias("shape"), F.array_join("parts", "/").alias("own_path"))
    several = seen.groupBy("shape").agg(F.countDistinct("own_path").alias("k")).filter("k >= 2").select("shape")
    return ends.select("call_id", "shape").join(_least(seen, "shape").join(several, "shape"), "shape").select("call_id", "route_id").distinct()
