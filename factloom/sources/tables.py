"""The tables of a scale folder, and fact tables that are written once and read many times."""

from __future__ import annotations

import atexit
import contextlib
import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()
_STORED: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over as many tasks as a shuffle has, for narrow rows that much is made of: a small file is one task otherwise, whatever is made of its rows."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once a session, unless they find it on their own path."""
    package = Path(__file__).resolve().parents[1]
    on_path = {*os.environ.get("PYTHONPATH", "").split(os.pathsep), *(p for p in sys.path if p.endswith(("site-packages", "dist-packages")))}
    context = spark.sparkContext
    if str(package.parent) in on_path or context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    archive = Path(tempfile.mkdtemp(prefix="factloom-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(archive))


def arrow_ready(df: DataFrame) -> DataFrame:
    """``df``, after the executors have been given the package."""
    ship(df.sparkSession)
    return df


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet in the folder of ``spark.checkpoint.dir`` and read again; deleted when the driver's Python ends.

    Tables that several others derive from are computed once, and survive the loss of executors.  Without that setting a
    temporary folder serves, if all of Spark runs on this machine.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _OWN.setdefault(context.applicationId, _OWN.get(context.applicationId) or tempfile.mkdtemp(prefix="factloom-"))
    path = f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STORED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _forget() -> None:
    for spark, path in _STORED:
        with contextlib.suppress(Exception):  # the JVM may be gone
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
