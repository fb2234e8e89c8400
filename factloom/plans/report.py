"""Fact tables as documents: rows of text, each holding the next ``PART_LINES`` lines of its document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import top_n
from ..operators.relate import union_all
from ..sources.tables import stored

#: lines in one row of a document; paths that the text of a boundary shows (fixed values)
PART_LINES, SHOWN_PATHS = 5000, 30
#: document -> (title, fact table, line, order) (fixed values)
DOCUMENTS = {
    "inventory": ("Inventory", "files", "concat('- `', path, '` (', language, ', ', role, ', ', size_bytes, ' bytes)')", "path"),
    "dependencies": ("Dependencies", "dependencies", "concat('- ', name, ' — ', source, ' (', scope, ')')", "name"),
    "entrypoints": ("Entrypoints", "entrypoints", "concat('- `', path, '` (', kind, ')', coalesce(concat(': `', command, '`'), ''))", "path"),
    "commands": ("Commands", "commands", "concat('- `', name, '` in `', path, '`', coalesce(concat(': ', description), ''))", "name"),
    "frameworks": ("Frameworks", "frameworks", "concat('- ', name, ' (', category, ', ', format_number(confidence, 2), ')')", "name"),
    "api-routes": ("API routes", "routes", "concat('- `', method, ' ', path, '` — ', framework, coalesce(concat(' → ', handler), ''))", "path"),
    "api-calls": ("API calls", "calls", "concat('- `', coalesce(method, 'ANY'), ' ', endpoint, '` in `', path, '`')", "endpoint"),
    "api-links": ("API links", "links", "concat('- `', source, '` → `', coalesce(matched_route, endpoint), '` (', match_type, ', ', confidence, ')')", "source"),
    "components": ("Components", "components", "concat('- ', name, ' in `', path, '`')", "name"),
    "frontend-routes": ("Frontend routes", "frontend_routes", "concat('- `', name, '` in `', path, '`')", "name"),
    "forms": ("Forms", "forms", "concat('- `', source, '` → ', coalesce(action, '?'), ' [', array_join(fields, ', '), ']')", "source"),
    "assets": ("Assets", "assets", "concat('- `', asset_path, '` (', asset_kind, ') in `', source, '`')", "asset_path"),
    "styles": ("Styles", "styles", "concat('- `', path, '`: ', size(selectors), ' selectors, ', size(css_variables), ' variables')", "path"),
    "state": ("State", "states", "concat('- ', name, ' (', kind, ') in `', path, '`')", "name"),
    "data-models": ("Data models", "models", "concat('- ', name, ' (', kind, ') in `', path, '`')", "name"),
    "data-layer": ("Data layer", "data_layer", "concat('- ', name, ' (', kind, ') in `', path, '`')", "name"),
    "runtime-config": ("Runtime configuration", "runtime", "concat('- ', name, ' (', kind, ') in `', path, '`')", "name"),
    "symbols": ("Symbols", "symbols", "concat('- ', kind, ' `', name, '` at `', path, ':', line, '`')", "path"),
    "imports": ("Imports", "imports", "concat('- `', path, '` imports `', name, '`')", "path"),
    "tests": ("Test map", "test_maps", "concat('- `', test_path, '` → ', coalesce(target, 'unmatched'), ' (', confidence, ')')", "test_path"),
    "features": ("Features", "features", "concat('- ', name, ' (', kind, ', ', confidence, ')')", "name"),
    "module-boundaries": ("Module boundaries", "boundaries", "concat('- ', name, ': ', n_files, ' files', coalesce(concat(': `', array_join(paths, '`, `'), '`'), ''))", "name"),
    "contract-gaps": ("Contract gaps", "contract_gaps", "concat('- `', contract, '`: ', gap_type)", "contract"),
    "quality": ("Quality", "quality", "concat('- ', metric, ': ', value)", "metric"),
    "pages": ("Pages", "pages", "concat('- `', path, '` at `', route, '`')", "path"),
    "refactor": ("Refactoring", "findings", "concat('- ', title, ' (', severity, '): `', subject, '` — ', detail)", "title"),
    "contracts": ("API contracts", "contracts", "concat('- `', method, ' ', path, '`: ', concat_ws('; ', nullif(array_join(request_hints, ', '), ''), nullif(array_join(response_hints, ', '), ''), nullif(array_join(status_codes, ', '), ''), nullif(array_join(error_hints, ', '), '')))", "path"),
    "gap-evidence": ("Evidence of gaps", "gap_evidence", "concat('- ', gap_id, ': `', evidence, '`')", "gap_id"),
    "gaps": ("Gaps", "gaps", "concat('- ', gap_id, ' ', title, ' (', severity, ')')", "gap_id"),
    "evidence": ("Evidence", "claims", "concat('- ', claim_id, ': ', claim, ' (', format_number(confidence, 2), ')')", "claim_id"),
}


def render(facts: dict[str, DataFrame], part_lines: int = PART_LINES) -> DataFrame:
    """document, part, n, text: all ``n`` lines of each document in order, ``part_lines`` to a row; part 0 has the title.

    Lines are range-sorted and numbered by per-partition counts, so no document passes through one task.
    """
    facts = dict(facts)
    if "boundaries" in facts:
        shown = top_n(facts["boundary_paths"], ["name"], ["path"], SHOWN_PATHS).groupBy("name").agg(F.array_sort(F.collect_list("path")).alias("paths"))
        facts["boundaries"] = facts["boundaries"].join(shown, "name", "left")
    titles = [(name, title, table, line, order) for name, (title, table, line, order) in DOCUMENTS.items() if table in facts]
    lines = union_all([facts[table].select(F.lit(name).alias("document"), F.expr(f"cast({order} as string)").alias("o"), F.expr(line).alias("line")).filter("line is not null") for name, _, table, line, order in titles])
    spark = lines.sparkSession
    order = ["document", "o", "line"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(lines.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "lines")
    sizes = placed.groupBy("document", "_p").agg(F.count("*").alias("n"))
    own = Window.partitionBy("document")
    sizes = sizes.select("document", "_p", (F.sum("n").over(own.orderBy("_p")) - F.col("n")).alias("before"), F.sum("n").over(own).alias("n"))
    inside = placed.withColumn("i", F.row_number().over(Window.partitionBy("document", "_p").orderBy("o", "line")))
    at = (F.col("before") + F.col("i") - 1).alias("at")
    numbered = inside.join(F.broadcast(sizes), ["document", "_p"]).select("document", "n", at, "line").withColumn("part", F.expr(f"at div {part_lines}"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    bodies = numbered.groupBy("document", "part").agg(F.max("n").alias("n"), text.alias("body"))
    heads = spark.createDataFrame([(name, title) for name, title, *_ in titles], "document string, title string")
    rows = F.broadcast(heads).join(bodies, "document", "right").unionByName(heads.join(bodies.select("document").distinct(), "document", "left_anti").select("document", "title", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("n"), F.lit("None found.").alias("body")))
    return rows.select("document", "part", "n", F.concat(F.when(F.col("part") == 0, F.concat(F.lit("# "), "title", F.lit("\n\n"))).otherwise(F.lit("")), F.col("body"), F.lit("\n")).alias("text"))
