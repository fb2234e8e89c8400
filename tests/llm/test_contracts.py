"""Every registered query by name over small tables with null ids, repeats and clashing columns; the pipeline against plain Python."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import packing, queries
from factloom.llm.shared import shared_folder

random.seed(8)
WORDS = [f"wort{i}" for i in range(300)]
COLUMNS = {
    "op1_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op2_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op3_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op4_ngram_jaccard": "doc_id n_shingles component_id",
    "op6_bestfit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op7_language_id": "doc_id held_out lang_pred score",
    "op8_line_dedup": "doc_id n_lines n_removed n_chunks_removed kept_sha256",
    "op8_line_dedup_every_run": "doc_id n_lines n_removed n_chunks_removed kept_sha256",
    "op9_toxicity": "doc_id held_out score predicted",
    "op10_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op12_minhash_dedup": "doc_id n_shingles component_id kept",
}
TYPES = {"string": "labels base_labels spans base_sha256 kept_sha256 items_sha256 lang_pred", "int": "piece predicted rank", "double": "score", "boolean": "held_out contaminated kept"}


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def write(spark, folder, rows, labels=True):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string, k int, bin array<int>")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(0, 60, 3)] * labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, prose(25)) for i in range(3)] * labels, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, [0.5, float(i)], 1, "x") for i in range(120)] * labels, "vec_id long, embedding array<float>, label int, score string").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def row(i, text, lang="de"):
    return (i, text, lang, "s", len(text or ""), "clash", 3, [1])


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rows = [row(i, prose(30 + i)) for i in range(60)] + [row(None, prose(40)), row(None, prose(40)), row(None, None), row(5, prose(9)), row(60, None), row(61, ""), row(62, "... 12", None), row(63, "x" * 70_000), row(64, prose(30_000), "en")]
    rows += [rows[3], rows[3]]
    return write(spark, str(tmp_path_factory.mktemp("tables")), rows)


def kinds(name):
    return next((kind for kind, names in TYPES.items() if name in names.split()), "bigint")


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in COLUMNS])
def test_query(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    wanted = COLUMNS[name].split()
    assert [c for c in got.columns if c in wanted] == wanted
    assert {c: t for c, t in got.dtypes if c in wanted} == {c: kinds(c) for c in wanted}
    ids = [r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = got.collect()
    have = [r.doc_id for r in rows if name != "op6_bestfit_packing" or r.piece == 0]
    assert sorted(have, key=repr) == sorted(ids, key=repr)
    if "held_out" in wanted:
        import zlib

        mod, left = (4, 2) if name.startswith("op7") else (5, 0)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == left) for r in rows if r.doc_id is not None)
    if "predicted" in wanted:
        assert all(r.predicted == (r.score >= 0.5) for r in rows)


def test_all_queries_are_held_somewhere():
    elsewhere = {"op5_topk_search", "op11_turn_repair", "op13_hard_negatives"}  # of other tables: below, and in test_pairs_and_turns
    assert set(queries.QUERIES) == set(COLUMNS) | elsewhere


def test_topk_query(spark, sf_dir):
    rows = queries.QUERIES["op5_topk_search"](spark, sf_dir)
    assert rows.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert {(r.query_id, r["rank"]) for r in rows.collect()} == {(q, k) for q in (0, 100) for k in range(1, 11)}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_on_empty_tables(spark, tmp_path, name):
    assert queries.QUERIES[name](spark, write(spark, str(tmp_path), [], labels=False)).count() == 0


def test_nothing_but_results_is_left(spark, sf_dir):
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    for name in ("op3_substring_dedup", "op4_ngram_jaccard", "op6_bestfit_packing"):
        queries.QUERIES[name](spark, sf_dir).count()
    assert len(set(folder.iterdir()) - before) == 3
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("factloom_run")]


# ---------------------------------------------------------------- pipeline


def lines_left(docs):
    """Plain Python: every line of a repeated run of two or more goes, but for its first place."""
    first, out = {}, {}
    for i, t in sorted(docs.items()):
        lines, gone = t.split("\n"), set()
        for k in range(len(lines) - 1):
            at = first.setdefault(tuple(lines[k : k + 2]), (i, k))
            if at != (i, k) and at != (i, k - 1):
                gone |= {k, k + 1}
        out[i] = (t, True) if not gone else ("\n".join(x for k, x in enumerate(lines) if k not in gone), False)
    return {i: t for i, (t, whole) in out.items() if whole or t}


def representatives(docs):
    """Plain Python: the smallest doc_id of each group of near copies."""

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, root = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}
    for i in docs:
        for j in docs:
            a, b = sets[i], sets[j]
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return {i: t for i, t in docs.items() if root[i] == i}


def uncontaminated(docs, items):
    """Plain Python: documents of which less than a twentieth stands in windows of items."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    windows = {tuple(w[k : k + 13]) for w in map(words, items) for k in range(max(1, len(w) - 12)) if w}
    out = {}
    for i, t in docs.items():
        w, hit = words(t), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        if not hit or 20 * len(hit) < len(w):
            out[i] = t
    return out


def test_pipeline_against_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    base, shared = prose(60), f"{prose(8)}\n{prose(8)}\n{prose(8)}"
    rows = [row(i, prose(40 + i)) for i in range(30)]
    rows += [row(30, base), row(31, base), row(32, base + " extra"), row(33, None), row(34, "123 ..."), row(35, f"own\n{shared}\nend a"), row(36, f"{shared}\nother end"), row(37, shared)]
    sf_dir = write(spark, str(tmp_path), rows)
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    dirty = [row(40, f"{prose(30)} {items[1]} {prose(20)}"), row(41, prose(600) + " " + items[2])]
    spark.createDataFrame(dirty, spark.read.parquet(f"{sf_dir}/documents.parquet").schema).write.mode("append").parquet(f"{sf_dir}/documents.parquet")
    docs = {r[0]: r[1] for r in rows + dirty}

    want = {i: t for i, t in docs.items() if t and any(map(str.isalpha, t))}
    steps, now = {"language_id": want}, spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps["line_dedup"] = lines_left(steps["language_id"])
    steps["ngram_jaccard"] = representatives(steps["line_dedup"])
    steps["decontamination"] = uncontaminated(steps["ngram_jaccard"], items)
    assert [len(x) for x in steps.values()] == [38, 37, 35, 34]
    for (name, stage), kept in zip(corpus_pipeline.STAGES, steps.values(), strict=False):
        after = stage(spark, now, sf_dir)
        assert after.columns == now.columns
        assert {r.doc_id: (r.text, r.n_chars) for r in after.collect()} == {i: (t, len(t)) for i, t in kept.items()}, name
        now = after

    tok = Tokenizer.from_file(packing.tokenizer_path())
    size = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in steps["decontamination"].items()}
    out = corpus_pipeline.run(spark, sf_dir).collect()
    have: dict[int, int] = {}
    for r in out:
        have[r.doc_id] = have.get(r.doc_id, 0) + r.length
    assert have == size
    assert len({r.sequence_id for r in out}) == -(-sum(size.values()) // packing.CAPACITY)
    assert corpus_pipeline.run(spark, sf_dir).select(F.sum("length")).first()[0] == sum(size.values())
