"""A directory tree as a table of files, and fact tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.classify import classify


def scan_tree(spark: SparkSession, root: str, max_bytes: int = 64 << 20) -> DataFrame:
    """path (relative), language, role, size_bytes, content of every file below ``root``, by Spark's own reader.

    Undecodable bytes are replaced and a byte order mark is dropped; files above ``max_bytes`` keep their row with null content.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "^.*?" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    text = F.regexp_replace(F.col("content").cast("string"), "^﻿", "")
    files = raw.select(path.alias("path"), F.when(F.col("length") <= max_bytes, text).alias("content"), F.col("length").alias("size_bytes"))
    return classify(files)


def write_facts(facts: dict[str, DataFrame], root: str) -> None:
    """One Parquet table for each fact table."""
    for name, df in facts.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def read_facts(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """Fact tables written earlier; columns added since are null (additive schema evolution)."""
    return {n: spark.read.option("mergeSchema", "true").parquet(f"{root}/{n}") for n in names}
