"""What the operators of this subpackage share on Spark's side: tables that all executors see, and the package on workers."""

from __future__ import annotations

import atexit
import contextlib
import importlib.util
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()
_RESULTS: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one where it is unset and all of Spark runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _OWN.setdefault(context.applicationId, _OWN.get(context.applicationId) or tempfile.mkdtemp(prefix="factloom-"))
    return folder.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once a session, unless they find it on their own path."""
    root = Path(__file__).resolve().parents[2]
    on_path = {*os.environ.get("PYTHONPATH", "").split(os.pathsep), *(p for p in sys.path if p.endswith(("site-packages", "dist-packages")))}
    context = spark.sparkContext
    if str(root) in on_path or context.applicationId in _SHIPPED or importlib.util.find_spec("factloom") is None:
        return
    _SHIPPED.add(context.applicationId)
    archive = Path(tempfile.mkdtemp(prefix="factloom-")) / "factloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((root / "factloom").rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(str(archive))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: what holds while a table is written: shuffle files go as soon as the query that made them ends, and Arrow batches are small
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304b"}


@contextlib.contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """Holds ``_WRITING``; the session's own settings come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Tables:
    """The Parquet tables that one call writes in the shared folder, all deleted when its ``with`` ends.

    A table cuts the lineage and survives the loss of any executor.  Spark chooses the number of tasks that write it.
    """

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark, self.folder, self._n = spark, f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_: object) -> None:
        _delete(self.spark, self.folder)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.folder}/{self._n}-{name}"
        with writing(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._table_path = path  # dropped by ``drop``
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, t._table_path)


def result_folder(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    _RESULTS.append((spark, path))
    return path


def result(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table that outlives the call that made it."""
    spark = df.sparkSession
    path = result_folder(spark, what)
    with writing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _forget() -> None:
    for spark, path in _RESULTS:
        with contextlib.suppress(Exception):  # the JVM may be gone
            _delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id long, text binary); other columns, whatever their names, take no part."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))


#: rows of a few numbers that may be broadcast; beyond it the join is left to a shuffle.
BROADCAST_ROWS = 1_000_000


def join_ids(df: DataFrame, ids: DataFrame, on: list[str], how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` joined with a written table of ids; broadcast only if it has been counted to hold at most ``limit`` rows."""
    return df.join(F.broadcast(ids) if ids.count() <= limit else ids, on, how)


def join_same(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` where the columns ``on`` are equal or both null."""
    own = right.select(*[F.col(c).alias(f"_same_{c}") if c in on else F.col(c) for c in right.columns])
    equal = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_same_{c}")) for c in on])
    return left.join(own, equal, how).drop(*[f"_same_{c}" for c in on])
