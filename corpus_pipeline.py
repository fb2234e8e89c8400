"""A training-corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and is written as Parquet and read
again before the next.  All but the last return the columns of ``documents``.  An empty table stays one in every stage, and
texts are taken whole however long they are.  What happens to nulls, ties and repeated rows is said at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, language_id, line_dedup, ngram_jaccard, packing
from factloom.llm.shared import Tables, result, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language (null, or no letters); profiles are learned from ``docs``.

    Rows without a lang teach nothing and are judged like others; if no row has one, every language is unknown and all go.
    Repeated rows and rows with a null doc_id are each judged by their text; ties between languages drop nothing.
    """
    return language_id.keep_known(docs, language_id.fit(docs))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every repeated run of two lines or more out of the texts; n_chars follows. Documents left without any text go.

    Null texts stay null. The first place by (doc_id, text hash, line) is kept, null ids first; rows equal in doc_id and text
    are one document and all come out alike.
    """
    rows = line_dedup.dedup_lines(docs, every=True)
    rows = rows.filter("dl_n_removed = 0 or length(text) > 0")
    n_chars = F.when(F.col("dl_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return rows.withColumn("n_chars", n_chars).select(*docs.columns) if "n_chars" in docs.columns else rows.select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near copies.

    Null and empty texts, and rows with a null doc_id, are copies of nothing and stay. Rows that repeat the kept doc_id stay.
    """
    return ngram_jaccard.keep_representatives(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth of the words or more stands in benchmark passages.

    Each row is judged by its own text, whatever its doc_id; null texts stay.
    """
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences. Null texts are the closing id alone; repeated rows are packed each on its own."""
    return packing.pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("line_dedup", unique_lines),
    ("ngram_jaccard", one_of_each),
    ("decontamination", uncontaminated),
    ("bestfit_packing", packed),
]

#: packing by a genetic algorithm has no SQL form; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the tables of the stages before it are deleted once they have been read."""
    docs, before = table(spark, sf_dir, "documents"), None
    with Tables(spark, "pipeline") as tables:
        for name, stage in STAGES[:-1]:
            docs = tables.put(stage(spark, docs, sf_dir), name)
            if before is not None:
                tables.drop(before)
            before = docs
        return result(STAGES[-1][1](spark, docs, sf_dir), "pipeline")
