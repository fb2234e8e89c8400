"""Full paths of routes on mounted routers: prefixes of router variables in a file, and of files mounted by others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .relate import import_targets, mount_closure


def _python_files(modules: DataFrame, files: DataFrame) -> DataFrame:
    """path, name, target: dotted modules resolved to files: beside the importing file, from the root, or under ``src``."""
    here = F.regexp_replace("path", "[^/]*$", "")
    dots = F.length(F.regexp_extract("name", r"^\.*", 0))
    inner = F.regexp_replace(F.regexp_replace("name", r"^\.+", ""), r"\.", "/")
    up = F.regexp_replace(here, r"[^/]+/$", "")
    bases = F.when(dots == 1, F.array(here)).when(dots > 1, F.array(up)).otherwise(F.array(here, F.lit(""), F.lit("src/")))
    tried = F.flatten(F.transform(bases, lambda b: F.array(F.concat(b, inner, F.lit(".py")), F.concat(b, inner, F.lit("/__init__.py")))))
    hit = modules.select("path", "name", F.posexplode(tried).alias("rank", "candidate")).join(files.select(F.col("path").alias("candidate")), "candidate")
    return hit.groupBy("path", "name").agg(F.min_by("candidate", "rank").alias("target"))


def bindings(raw: DataFrame, files: DataFrame) -> DataFrame:
    """path, variable, target: imported names and the files they stand for."""
    own = raw.filter("family = 'binding' and label not like 'named-%'").select("path", F.col("subject").alias("variable"), F.col("detail").alias("name")).distinct()
    script = own.join(import_targets(own.select("path", "name").distinct(), files), ["path", "name"]).select("path", "variable", "target")
    names = raw.filter("family = 'import' and label = 'from'").select("path", F.col("subject").alias("module"), F.explode(F.split("detail", ",")).alias("n"))
    first, last = F.regexp_extract("n", r"^[\s(]*(\w+)", 1), F.regexp_extract("n", r"(\w+)[\s)]*$", 1)
    dotted = F.when(F.col("module").endswith("."), F.concat("module", first)).otherwise(F.concat_ws(".", "module", first))
    both = names.select("path", last.alias("variable"), F.posexplode(F.array(dotted, F.col("module"))).alias("rank", "name")).filter("variable <> ''").distinct()
    found = both.join(_python_files(both.select("path", "name").distinct(), files), ["path", "name"])
    python = found.groupBy("path", "variable").agg(F.min_by("target", "rank").alias("target"))
    return script.unionByName(python).distinct()


def _node(path: Column, variable: Column) -> Column:
    return F.concat(path, F.lit("#"), variable)


def mount_edges(raw: DataFrame, files: DataFrame) -> DataFrame:
    """parent, child, prefix: a file to its router variables, variables to groups of theirs, and variables to the files they mount."""
    groups = raw.filter("family = 'router'").select("path", F.col("subject").alias("variable"), F.col("detail").alias("parent"), F.coalesce("verb", F.lit("")).alias("prefix"))
    owners = raw.filter("family in ('route', 'mount') and owner is not null").select("path", F.col("owner").alias("variable")).distinct()
    plain = owners.join(groups.select("path", "variable").distinct(), ["path", "variable"], "left_anti").select("path", "variable", F.lit(None).cast("string").alias("parent"), F.lit("").alias("prefix"))
    known = groups.unionByName(plain)
    above = known.select("path", F.col("variable").alias("parent"), F.lit(1).alias("has")).distinct()
    inside = known.join(above, ["path", "parent"], "left").select(F.when(F.col("has") == 1, _node(F.col("path"), F.col("parent"))).otherwise(F.col("path")).alias("parent"), _node(F.col("path"), F.col("variable")).alias("child"), "prefix")

    mounts = raw.filter("family = 'mount'").select("path", F.coalesce("owner", F.lit("")).alias("owner"), F.col("subject").alias("what"), F.coalesce("verb", F.lit("")).alias("prefix"), "label")
    by_name = mounts.filter("label <> 'django'").withColumn("variable", F.substring_index("what", ".", 1)).join(bindings(raw, files), ["path", "variable"])
    modules = mounts.filter("label = 'django'").withColumn("name", F.col("what"))
    by_module = modules.join(_python_files(modules.select("path", "name").distinct(), files), ["path", "name"])
    parent = F.when(F.col("owner") == "", F.col("path")).otherwise(_node(F.col("path"), F.col("owner")))
    across = [x.filter("target <> path").select(parent.alias("parent"), F.col("target").alias("child"), "prefix") for x in (by_name, by_module)]
    return inside.unionByName(across[0]).unionByName(across[1]).distinct()


def mounted(routes: DataFrame, raw: DataFrame, files: DataFrame) -> DataFrame:
    """``routes`` (with owner) under their full paths; a router mounted twice gives a route for each prefix, one never mounted keeps its paths."""
    edges = stored(mount_edges(raw, files), "mount-edges")
    if edges.filter(F.regexp_replace("prefix", "/", "") != "").isEmpty():
        return routes.withColumn("own_path", F.col("path"))
    child = edges.select(F.col("child").alias("node")).distinct()
    roots = edges.select(F.col("parent").alias("node")).distinct().join(child, "node", "left_anti")
    closed = mount_closure(edges, roots).filter("depth > 0").select("node", "prefix").distinct()
    node = F.when(F.col("owner").isNotNull(), _node(F.col("evidence.file"), F.col("owner"))).otherwise(F.col("evidence.file"))
    whole = F.regexp_replace(F.concat(F.coalesce("prefix", F.lit("")), F.lit("/"), "path"), "/+", "/")
    whole = F.when(F.length(whole) > 1, F.regexp_replace(whole, "/$", "")).otherwise(whole)
    both = routes.withColumn("node", node).join(closed, "node", "left")
    return both.withColumn("own_path", F.col("path")).withColumn("path", F.when(F.coalesce(F.regexp_replace("prefix", "^/+$", ""), F.lit("")) == "", F.col("path")).otherwise(whole)).drop("node", "prefix")
