from pyspark.sql import functions as F

from factloom.operators.relate import boundary_counts, detect_gaps, gap_evidence, module_boundaries
from factloom.plans.report import DOCUMENTS, render


def test_documents_keep_every_line(spark):
    n = 12001
    imports = spark.range(n).select(F.format_string("p%05d", "id").alias("path"), F.lit("x").alias("name")).repartition(3)
    imports = imports.unionByName(imports.filter("path = 'p00007'"))  # a repeated fact is listed twice
    rows = render({"imports": imports, "commands": spark.createDataFrame([], "path string, name string, description string")}).collect()
    parts = sorted((r for r in rows if r.document == "imports"), key=lambda r: r.part)
    assert [r.part for r in parts] == [0, 1, 2] and {r.n for r in parts} == {n + 1}
    want = sorted([f"p{i:05d}" for i in range(n)] + ["p00007"])
    assert "".join(r.text for r in parts) == "# Imports\n\n" + "".join(f"- `{p}` imports `x`\n" for p in want)
    assert [(r.document, r.part, r.n, r.text) for r in rows if r.document != "imports"] == [("commands", 0, 0, "# Commands\n\nNone found.\n")]
    assert set(DOCUMENTS) >= {r.document for r in rows}


def test_boundaries_keep_every_path(spark):
    rows = [(f"src/api/f{i:02d}.py", "python", "source") for i in range(40)] + [("tests/a.py", "python", "test"), ("README.md", "markdown", "documentation"), ("src/x.py", "python", "source"), ("src/config.py", "python", "source")]
    files = spark.createDataFrame(rows, "path string, language string, role string")
    routes = files.filter("path like '%/f%'").select(F.struct(F.col("path").alias("file")).alias("evidence"))
    facts = {"files": files, "routes": routes.unionByName(routes), "test_maps": files.filter("role = 'test'").select(F.col("path").alias("test_path"))}
    paths = module_boundaries(facts)
    assert {(r.name, r.path) for r in paths.collect()} == {("backend-api", f"src/api/f{i:02d}.py") for i in range(40)} | {("tests", "tests/a.py"), ("shared", "src/x.py")}
    counts = boundary_counts(paths)
    assert {r.name: r.n_files for r in counts.collect()} == {"cli": 0, "frontend": 0, "backend-api": 40, "data-layer": 0, "runtime-config": 0, "tests": 1, "shared": 1}
    text = render({"boundaries": counts, "boundary_paths": paths}).first().text
    assert "- backend-api: 40 files: `src/api/f00.py`" in text and "f29.py`\n" in text and "f30" not in text and "- tests: 1 files: `tests/a.py`" in text


def test_gaps_have_rows_for_issues_and_ten_places(spark):
    names = ["entrypoints", "tests", "dependencies", "unknown_language", "sources", "routes", "models_without_fields", "pages", "frontend_routes", "forms", "styles", "states", "unmatched_calls", "links", "uncalled_routes", "unknown_contracts", "unmapped_tests"]
    counts = spark.createDataFrame([tuple(0 for _ in names)], ", ".join(f"{n} long" for n in names))
    issues = spark.createDataFrame([("b.json", "json"), ("a.json", "json")], "path string, extractor string")
    got = {(r.gap_id, r.severity) for r in detect_gaps(counts, issues).collect()}
    assert got == {("GAP-001", "medium"), ("GAP-002", "medium"), ("GAP-003", "low"), ("GAP-005", "high"), ("GAP-AST-001", "high"), ("GAP-AST-002", "high")}
    facts = {"files": spark.createDataFrame([(f"f{i:02d}", "unknown") for i in range(30)], "path string, language string")}
    rows = gap_evidence(facts, spark.createDataFrame([("GAP-004",)], "gap_id string")).collect()
    assert [(r.gap_id, r["rank"], r.evidence) for r in sorted(rows, key=lambda r: r["rank"])] == [("GAP-004", i + 1, f"f{i:02d}") for i in range(10)]
