"""The routes that one ``resources`` line implies: a table of actions, under the set operations of its options.

``IMPLIED`` has a row for each action of a kind of resource.  A line's actions are those of its kind, cut down to ``only``
and without ``except``; a name's own path, parameter or controller take the place of the usual ones.  Scopes and resources
around the line give the prefix, as for other routes; a shallow resource has its members without the resources around it.
Lines with several names imply the routes of each; unknown actions in options change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (framework, kind, action, method, path below the resource) (fixed values)
IMPLIED = [
    ("rails", "many", "index", "GET", ""), ("rails", "many", "create", "POST", ""), ("rails", "many", "show", "GET", "/{id}"), ("rails", "many", "update", "PATCH", "/{id}"), ("rails", "many", "update", "PUT", "/{id}"), ("rails", "many", "destroy", "DELETE", "/{id}"),
    ("rails", "one", "show", "GET", ""), ("rails", "one", "create", "POST", ""), ("rails", "one", "update", "PATCH", ""), ("rails", "one", "update", "PUT", ""), ("rails", "one", "destroy", "DELETE", ""),
    ("laravel", "resource", "index", "GET", ""), ("laravel", "resource", "create", "GET", "/create"), ("laravel", "resource", "store", "POST", ""), ("laravel", "resource", "show", "GET", "/{id}"), ("laravel", "resource", "edit", "GET", "/{id}/edit"), ("laravel", "resource", "update", "PUT", "/{id}"), ("laravel", "resource", "update", "PATCH", "/{id}"), ("laravel", "resource", "destroy", "DELETE", "/{id}"),
    ("laravel", "apiResource", "index", "GET", ""), ("laravel", "apiResource", "store", "POST", ""), ("laravel", "apiResource", "show", "GET", "/{id}"), ("laravel", "apiResource", "update", "PUT", "/{id}"), ("laravel", "apiResource", "update", "PATCH", "/{id}"), ("laravel", "apiResource", "destroy", "DELETE", "/{id}"),
    ("phoenix", "many", "index", "GET", ""), ("phoenix", "many", "create", "POST", ""), ("phoenix", "many", "new", "GET", "/new"), ("phoenix", "many", "show", "GET", "/{id}"), ("phoenix", "many", "edit", "GET", "/{id}/edit"), ("phoenix", "many", "update", "PATCH", "/{id}"), ("phoenix", "many", "update", "PUT", "/{id}"), ("phoenix", "many", "delete", "DELETE", "/{id}"),
]


def singular_of(word: Column) -> Column:
    """A plural word's singular by its ending."""
    w = F.regexp_replace(word, r"[^A-Za-z0-9_]+", "_")
    return F.when(w.endswith("ies"), F.regexp_replace(w, "ies$", "y")).when(w.rlike("(ss|sh|ch|x)es$"), F.regexp_replace(w, "es$", "")).when(w.endswith("s") & ~w.endswith("ss"), F.regexp_replace(w, "s$", "")).otherwise(w)


def _items(option: str) -> Column:
    """The names in a list option, or in a single one; none if it is not given."""
    value = F.regexp_extract("detail", rf"\b{option}['\"]?(?:\s*=>|:|\s*\()\s*(\[[^\]]*\]|%[iw]\[[^\]]*\]|array\s*\([^)]*\)|:\w+|['\"]\w+['\"])", 1)
    return F.regexp_extract_all(F.regexp_replace(value, r"^(%[iw]|array)", ""), F.lit(r"\w+"), F.lit(0))


def _value(option: str) -> Column:
    return F.nullif(F.regexp_extract("detail", rf"\b{option}:\s*[:\"']([^\"',\s\])]+)", 1), F.lit(""))


def implied_routes(raw: DataFrame) -> DataFrame:
    """method, path, handler, framework, class_prefix, scope, and the rest of the match, of every route that a resource implies; path is that below its scopes."""
    own = raw.filter("family = 'resource' and role <> 'test' and subject is not null").withColumn("detail", F.coalesce("detail", F.lit("")))
    names = F.when(F.col("label") == "rails", F.regexp_extract_all("subject", F.lit(r"[:\"'](\w+)"), F.lit(1))).otherwise(F.array(F.regexp_replace("subject", "^/+|/+$", "")))
    own = own.withColumn("name", F.explode(names)).withColumn("only", _items("only")).withColumn("without", _items("except"))
    table = raw.sparkSession.createDataFrame(IMPLIED, "label string, verb string, action string, method string, below string")
    both = own.join(F.broadcast(table), ["label", "verb"]).filter("(size(only) = 0 or array_contains(only, action)) and not array_contains(without, action)")
    laravel = F.col("label") == "laravel"
    parts = F.split("name", r"\.")
    dotted = F.array_join(F.transform(parts, lambda p, k: F.when(k < F.size(parts) - 1, F.concat(p, F.lit("/{"), singular_of(p), F.lit("}"))).otherwise(p)), "/")
    base = F.when(laravel, dotted).otherwise(F.coalesce(_value("path"), F.col("name")))
    parameter = F.when(laravel, F.concat(F.lit("{"), singular_of(F.element_at(F.split(F.element_at(parts, -1), "/"), -1)), F.lit("}"))).otherwise(F.concat(F.lit(":"), F.coalesce(_value("param"), F.lit("id"))))
    path = F.concat(F.regexp_replace(base, "^/+|/+$", ""), F.replace("below", F.lit("{id}"), parameter))
    first = F.array_position(F.transform("scope", lambda x: x.rlike("^:.*_id$")), True).cast("int")
    shallow = F.col("detail").rlike(r"\bshallow:\s*true") & F.col("below").contains("{id}") & (F.coalesce(first, F.lit(0)) > 1)
    scope = F.when(shallow, F.slice("scope", F.lit(1), first - 2)).otherwise(F.col("scope"))
    class_ = F.regexp_extract("detail", r"^[\"']?([\w\\.]+)", 1)
    rails = F.concat(F.coalesce(_value("controller"), F.col("name")), F.lit("#"), "action")
    handler = F.when(F.col("label") == "rails", rails).when(laravel & (class_ != ""), F.concat(F.regexp_replace(class_, r"^.*\\", ""), F.lit("@"), "action")).when(class_ != "", F.concat(class_, F.lit(", :"), "action"))
    return both.select("path", "line", "rule", "nth", "owner", F.col("label").alias("framework"), "method", path.alias("route"), handler.alias("handler"), scope.alias("scope"))
