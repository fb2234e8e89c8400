"""Language identification by rank-order profiles of character n-grams.

A text is lower-cased; runs of non-letters become one boundary mark; its n-grams are those of 1 to 3 marks or letters
with no boundary inside and not the boundary alone.  The profile of a language, and of a document, is its ``PROFILE``
most frequent n-grams in order of falling count, ties by code.  The out-of-place distance adds up, over the document's
profile, how far each n-gram's rank is from its rank in the language's profile, or ``PROFILE`` where it is not in it.
The nearest language is predicted, ties going to the first by name.

Letters are Unicode letters; code points count modulo 2**16.  A null text, or one without letters, is ``und`` with
score 0; so is every text when no language has been learned.  The score is 1 minus the distance over its largest
possible value.  Repeated rows are predicted alike.  A null doc_id is kept as it is; all null ones are sampled alike.
Without documents nothing is learned and nothing returned; other columns, whatever their names, take no part.

``fit`` learns from at most ``SAMPLE`` documents of each language, chosen by a hash of doc_id: the bound of this
classifier's sample.  Profiles hold ``PROFILE`` rows a language, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ship, table
from .textwords import CHUNK, chunks

PROFILE = 400
SAMPLE = 4000
HASHES = 1 << 63
#: training n-grams counted in a worker before they are handed on
FLUSH = 1 << 20
#: bytes of text whose n-grams are looked at together; a byte takes some 140 meanwhile
SLICE = CHUNK // 8
RESULT = "doc_id long, lang_pred string, score double"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document, n-gram) of every n-gram of a chunk; an n-gram is up to three 16-bit codes, 1 for a boundary."""
    low = [(x or b"").decode("utf-8", "replace").lower() for x in texts]
    joined = "\n".join(low) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(low), dtype=np.uint64), [len(x) + 1 for x in low])
    letter = _letters()[cp]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others ends a word
    keep[:-1] |= letter[1:]
    keep &= letter | np.concatenate((np.ones(1, bool), letter[:-1])) | ~np.concatenate((np.zeros(1, bool), keep[:-1]))
    code = np.where(letter, cp & np.uint32(0xFFFF), 1).astype(np.uint64)[keep]
    doc, letter = doc[keep], letter[keep]
    docs, keys = [doc[letter]], [code[letter]]
    if len(code) > 1:
        ok = (doc[1:] == doc[:-1]) & (letter[1:] | letter[:-1])
        docs.append(doc[1:][ok])
        keys.append((code[:-1] << np.uint64(16) | code[1:])[ok])
    if len(code) > 2:
        ok = (doc[2:] == doc[:-2]) & letter[1:-1]
        docs.append(doc[2:][ok])
        keys.append((code[:-2] << np.uint64(32) | code[1:-1] << np.uint64(16) | code[2:])[ok])
    return np.concatenate(docs), np.concatenate(keys)


def _counted(keys: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    if weight is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, weight = keys[order], weight[order]
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    n = np.diff(np.append(at, len(keys))) if weight is None else (np.add.reduceat(weight, at) if len(at) else weight)
    return keys[at], n


class Profiles:
    """Rank of each profile n-gram in each language."""

    def __init__(self, rows: list[tuple[str, int, int]]) -> None:
        self.langs = sorted({x for x, _, _ in rows})
        self.keys = np.unique(np.array([k for _, k, _ in rows], dtype=np.uint64))
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), -1, dtype=np.int64)
        for lang, key, rank in rows:
            self.ranks[np.searchsorted(self.keys, np.uint64(key)), self.langs.index(lang)] = rank

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        pred, score = ["und"] * len(texts), [0.0] * len(texts)
        doc, key = grams(texts)
        if not len(doc) or not self.langs:
            return pred, score
        both, n = _counted(doc << np.uint64(48) | key)
        doc, key = (both >> np.uint64(48)).astype(np.int64), both & np.uint64((1 << 48) - 1)
        first = np.flatnonzero(np.concatenate((np.ones(1, bool), doc[1:] != doc[:-1])))
        order = np.argsort((doc << 32) - n, kind="stable")
        size = np.diff(np.append(first, len(doc)))
        rank = np.arange(len(doc)) - np.repeat(first, size)
        top = rank < PROFILE
        rank, doc, key = rank[top], doc[top], key[order][top]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        own = self.ranks[np.where(self.keys[at] == key, at, len(self.keys))]
        apart = np.where(own < 0, PROFILE, np.abs(own - rank[:, None]))
        total = np.add.reduceat(apart, np.cumsum(np.minimum(size, PROFILE)) - np.minimum(size, PROFILE), axis=0)
        best = total.argmin(axis=1)
        for d, b, t, m in zip(doc[rank == 0].tolist(), best.tolist(), total[np.arange(len(best)), best].tolist(), np.minimum(size, PROFILE).tolist(), strict=True):
            pred[d], score[d] = self.langs[b], 1 - t / (PROFILE * m)
        return pred, score


def sample_threshold(sample: int, n: int) -> int:
    """Of ``HASHES`` hash values, how many to take for ``sample`` of ``n`` documents."""
    return HASHES - 1 if n <= sample else max(1, HASHES * sample // n)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Profiles:
    """Profiles of the languages in ``docs`` (doc_id, text, lang); rows without lang or text teach nothing."""
    spark = docs.sparkSession
    ship(spark)
    src = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in src.groupBy("lang").count().collect()}
    if not counts:
        return Profiles([])
    # a threshold on all 63 bits: a language of any size keeps about ``sample`` documents
    below = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, sample_threshold(sample, n))])
    src = src.filter(F.xxhash64("doc_id", F.lit(11)).bitwiseAND(F.lit(HASHES - 1)) <= below[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, n = _counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])
            held.clear()

        for part, texts in chunks(batches, most=SLICE):
            langs = part.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                keys, n = _counted(grams([t for t, x in zip(texts, langs, strict=True) if x == lang])[1])
                held.setdefault(lang, []).append((keys, n.astype(np.int64)))
                size += len(keys)
            if size > FLUSH:
                yield from flush()
                size = 0
        yield from flush()

    totals = src.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    part = totals.withColumn("part", F.spark_partition_id())  # ranked within partitions first, so no language lands in one task whole

    order = [F.col("n").desc(), F.col("gram")]
    near = part.withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("r") <= PROFILE)
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("r") <= PROFILE)
    return Profiles([(r.lang, r.gram, r.r - 1) for r in best.select("lang", "gram", "r").collect()])


def judged(batches: Iterator[pa.RecordBatch], profiles: Profiles) -> Iterator[tuple[pa.RecordBatch, list[str], list[float]]]:
    """Slices of the batches with the language and score of each row."""
    for part, texts in chunks(batches, most=SLICE):
        yield part, *profiles.predict(texts)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, pred, score in judged(batches, model.value):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, RESULT)


def keep_known(docs: DataFrame, profiles: Profiles, min_score: float = 0.0) -> DataFrame:
    """``docs`` without those that are ``und`` or score below ``min_score``; columns unchanged, nothing shuffled."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, pred, score in judged(batches, model.value):
            yield part.filter(pa.array([p != "und" and s >= min_score for p, s in zip(pred, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter("crc32(cast(doc_id as string)) % 4 <> 2")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(training_rows(docs)))
    return found.select("doc_id", F.expr("crc32(cast(doc_id as string)) % 4 = 2").alias("held_out"), "lang_pred", "score")
