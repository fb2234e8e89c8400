"""Toxicity by a character n-gram linear classifier with naive Bayes features.

A text is lower-cased and its runs of non-letters become one boundary mark; its features are the distinct character
n-grams of ``SIZES`` marks or letters, hashed into 2**``BITS`` buckets.  For each bucket r is the log-count ratio of
toxic to other training documents (add-one smoothed).  The ``FEATURES`` buckets whose r is most certain (r over its
standard error) are kept, and a logistic regression with an L2 penalty is trained on the features scaled by r.

``fit`` learns from at most ``SAMPLE`` labelled documents of each class, chosen by a hash of doc_id: the bound of this
classifier's sample; documents of a class count so much more as were left out.  Rows with a null label teach nothing; if
a document has several labels, the highest holds; if several texts, the smallest.  Null and empty texts have no features and get the intercept's score.
With labels of one class only, or without any labelled document, every score is that class's share (0 without labels).
Long texts are scored whole.  Repeated rows score alike, a null doc_id is scored and teaches nothing, and an empty table
gives no rows.  Other columns, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_id import _letters
from .shared import Tables, ship, table
from .textwords import chunks, joined

SIZES, BITS, FEATURES, SAMPLE = (3, 4, 5, 6), 20, 2048, 5000
PENALTY, ROUNDS = 1e-4, 200
RESULT = "doc_id long, score double"


def features(texts: list[bytes | None], kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the distinct n-gram buckets of a chunk of texts, in order; ``kept``: of those buckets only (a mask)."""
    low = [(x or b"").decode("utf-8", "replace").lower() for x in texts]
    codes = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(-1, len(low)), [1, *(len(x) + 1 for x in low)])  # the mark before a text is the end of the one before it
    letter = _letters()[codes]
    keep = letter | np.concatenate((np.ones(1, bool), letter[:-1]))
    code, doc = np.where(letter, codes, 1).astype(np.uint64)[keep], doc[keep]
    docs, buckets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    h = code
    for k in range(2, max(SIZES) + 1):
        if len(code) < k:
            break
        h = joined(h[:-1], code[k - 1 :])
        if k in SIZES:
            bucket = (h >> np.uint64(64 - BITS)).astype(np.int64)
            own = doc[k - 1 :]
            ok = own == doc[1 : len(doc) - k + 2]  # a window may begin with the mark before its text, and with no earlier one
            if kept is not None:
                ok &= kept[bucket]
            docs.append(own[ok])
            buckets.append(bucket[ok])
    both = np.sort((np.concatenate(docs) << BITS) | np.concatenate(buckets))
    both = both[np.concatenate((np.ones(min(1, len(both)), bool), both[1:] != both[:-1]))]
    return both >> BITS, both & ((1 << BITS) - 1)


class Model:
    """Kept buckets in order, their weights (already times r), and the intercept."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, intercept: float) -> None:
        self.intercept = intercept
        self.weights = np.zeros(1 << BITS, dtype=np.float32)
        self.weights[buckets] = weights

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        doc, bucket = features(texts, self.weights != 0)
        z = self.intercept + np.bincount(doc, self.weights[bucket].astype(np.float64), len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, weight: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of a penalised logistic regression; (rows, cols, values) is the sparse matrix."""
    n = len(y)
    w, b = np.zeros(size), float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1)))
    total = weight.sum()
    scale = np.bincount(cols, values**2 * weight[rows], size) / total * 0.25 + PENALTY
    step = np.zeros(size)
    share = np.bincount(rows, minlength=n)
    rate = 1.0 / max(1.0, float(np.percentile(share[share > 0], 90)) if (share > 0).any() else 1.0) * 4
    for _ in range(ROUNDS):
        z = b + np.bincount(rows, values * (w + 0.9 * step)[cols], n)
        gap = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        slope = np.bincount(cols, values * gap[rows], size) / total + PENALTY * w
        step = 0.9 * step - rate * slope / scale
        w += step
        b -= 0.5 * float(gap.sum() / (total * 0.25))
    return w, b


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of ``labels`` (doc_id, toxic) over the texts of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    truth = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic") > 0).cast("int").alias("toxic"))
    have = {r.toxic: r["count"] for r in truth.groupBy("toxic").count().collect()}
    if len(have) < 2:
        only = next(iter(have), 0)
        return Model(np.zeros(0, np.int64), np.zeros(0), 30.0 if only else -30.0)
    picked = [truth.filter(f"toxic = {k}").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample) for k in (0, 1)]
    few = F.broadcast(picked[0].unionAll(picked[1]))  # at most 2 * sample rows of two numbers
    text = F.col("text").cast("string").cast("binary").alias("text")
    known = docs.select("doc_id", text).join(few, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    with Tables(spark, "toxicity") as tables:
        return _fitted(tables.put(known.select("text", "toxic"), "known"), have)


def _fitted(known: DataFrame, have: dict[int, int]) -> Model:
    """known: text, toxic (0 or 1), a bounded sample; have: how many labelled documents each class has."""
    spark = known.sparkSession

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << BITS), dtype=np.int32)
        docs_seen = np.zeros(2, dtype=np.int64)
        for part, texts in chunks(batches):
            y = np.array(part.column("toxic").to_pylist(), dtype=np.int64)
            doc, bucket = features(texts)
            for label in (0, 1):
                n[label] += np.bincount(bucket[y[doc] == label], minlength=1 << BITS).astype(np.int32)
            docs_seen += np.bincount(y, minlength=2)
        at = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[0, at], docs_seen[0]).astype(np.int64)), pa.array(np.append(n[1, at], docs_seen[1]).astype(np.int64))], ["bucket", "n0", "n1"])

    total = known.mapInArrow(counts, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    docs_of = total.filter("bucket = -1").first()
    if docs_of is None or not docs_of.n0 or not docs_of.n1:  # no labelled text of one class
        return Model(np.zeros(0, np.int64), np.zeros(0), 30.0 if docs_of is not None and docs_of.n1 else -30.0)
    d0, d1 = docs_of.n0, docs_of.n1
    r = F.log((F.col("n1") + 1) / F.lit(d1 + 2.0)) - F.log((F.col("n0") + 1) / F.lit(d0 + 2.0))
    sure = F.abs(F.col("r")) / F.sqrt(1 / (F.col("n1") + 1) + 1 / (F.col("n0") + 1))
    best = total.filter("bucket >= 0 and n0 + n1 >= 3").withColumn("r", r).orderBy(sure.desc(), "bucket").limit(FEATURES).select("bucket", "r").collect()
    buckets, ratio = (np.array([x[i] for x in best], dtype=kind) for i, kind in ((0, np.int64), (1, np.float64)))
    order = np.argsort(buckets)
    buckets, ratio = buckets[order], ratio[order]

    kept = spark.sparkContext.broadcast(buckets)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            mask = np.zeros(1 << BITS, dtype=bool)
            mask[kept.value] = True
            doc, bucket = features(texts, mask)
            at = np.searchsorted(kept.value, bucket).astype(np.int16)
            own = np.split(at, np.searchsorted(doc, np.arange(1, len(texts))))
            yield pa.RecordBatch.from_arrays([part.column("toxic").cast(pa.int32()), pa.array([x.tobytes() for x in own], pa.binary())], ["toxic", "cols"])

    rows = known.mapInArrow(present, "toxic int, cols binary").toArrow()
    cols = [np.frombuffer(x, dtype=np.int16).astype(np.int64) for x in rows.column("cols").to_pylist()]
    y = np.array(rows.column("toxic").to_pylist(), dtype=np.float64)
    row = np.repeat(np.arange(len(y)), [len(x) for x in cols])
    col = np.concatenate(cols) if cols else np.zeros(0, np.int64)
    weight = np.where(y == 1, have[1] / max(1, (y == 1).sum()), have[0] / max(1, (y == 0).sum()))
    w, b = _logistic(row, col, ratio[col], y, weight / weight.mean(), len(buckets))
    return Model(buckets, w * ratio, b)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.score(texts), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, RESULT)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = "crc32(cast(doc_id as string)) % 5 = 0"
    found = score_toxicity(docs, fit(docs, labels.filter(f"not ({held_out})")))
    return found.select("doc_id", F.expr(held_out).alias("held_out"), "score", F.expr("cast(score >= 0.5 as int)").alias("predicted"))
