"""Exact top-k search by a three-phase uniform threshold.

A vector's integer components are cut into ``LISTS`` groups of dimensions; each group is one list of partial scores and a
query's score is the sum over its lists.

1. Every part of the data gathers the ``k`` best entries of each list among its first ``SEED`` rows and adds up the other
   lists of those entries only; the k-th best score of all parts is a lower bound t of the true k-th best.  Any rows give a
   safe bound, so this phase looks at a bounded part of the data; it decides nothing else.
2. t is sent back.  A row below the uniform cutoff t / LISTS in all lists scores below t, so a part collects the entries at
   or above it, list by list; a list is left out for queries that cannot reach the cutoff there, by the norms of both sides.
   The part's own k-th best raises t as it goes.
3. Only for the entries collected are the missing lists added up, exactly, where their rows are; the best k are kept, ties
   to the smaller id.  A part sends at most k rows a query on; nothing else is shuffled.

Queries are taken in blocks of at most ``QUERY_VALUES`` components: what the driver collects and broadcasts, and drops
again once the block's result is written.  Inside a task they are met ``QUERY_ROWS`` at a time.

Vectors that are null, or hold null or non-finite components, take no part; nor do rows with a null id.  Rows with the
query's own id are not its candidates, nor are vectors of another length; other repeated rows count each.  A query id that
repeats is asked once, with its smallest vector.  With fewer than k candidates all are returned; without vectors or queries
there are no rows.  Other columns, whatever their names, take no part.  Scores outside 64 bits are held at the limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Tables, result_folder, ship, table, writing

LISTS, SCALE, SEED, ROWS_AT_ONCE, QUERY_ROWS, QUERY_VALUES = 2, 1024, 2048, 2048, 1024, 1 << 19
_EXACT = 2.0**53
ROWS = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    return v.filter("vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, integer components as doubles) of a batch, in pieces of vectors of one length."""
    col = batch.column("v")
    offsets = col.offsets.to_numpy()
    flat = np.floor(SCALE * col.values.to_numpy(zero_copy_only=False))
    ids, size = batch.column("vec_id").to_numpy(), np.diff(offsets)
    for d in np.unique(size).tolist():
        own = np.flatnonzero(size == d)
        for a in range(0, len(own), ROWS_AT_ONCE):
            some = own[a : a + ROWS_AT_ONCE]
            yield ids[some], flat[offsets[some][:, None] + np.arange(d)]


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exactly; entries are whole numbers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    if np.abs(a).max() * np.abs(b).max() * max(1, a.shape[1]) < _EXACT:
        return a @ b.T
    return np.array([[int(x) for x in r] for r in a], dtype=object) @ np.array([[int(x) for x in r] for r in b], dtype=object).T


def pair_dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of each row of a with the same row of b, exactly."""
    if not a.size or np.abs(a).max() * np.abs(b).max() * max(1, a.shape[1]) < _EXACT:
        return np.einsum("ij,ij->i", a, b)
    return np.array([sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for r, s in zip(a, b, strict=True)], dtype=object)


def _whole(scores: np.ndarray) -> np.ndarray:
    return np.clip(scores, -(2**63) + 1, 2**63 - 1).astype(np.int64) if scores.dtype == object else scores.astype(np.int64)


def cuts(d: int) -> list[tuple[int, int]]:
    """The dimensions of each list."""
    at = np.linspace(0, d, LISTS + 1).astype(int).tolist()
    return list(zip(at[:-1], at[1:], strict=True))


def _norms(x: np.ndarray) -> list[np.ndarray]:
    return [np.sqrt((x[:, a:b] ** 2).sum(axis=1)) for a, b in cuts(x.shape[1])]


class Best:
    """The k best entries so far of each query of one block and vector length."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, low: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k = ids, q, k
        self.low = low  # of each query, a score that its k-th best reaches at least
        self.norms = _norms(q)
        self.rows = self.found = self.score = np.zeros(0, np.int64)
        #: pairs of a query and a row whose list was multiplied out, or were added up, and what brute force would do
        self.counts = {"lists": 0, "missing": 0, "candidates": 0, "pairs": 0}

    def add(self, rows: np.ndarray, found: np.ndarray, score: np.ndarray) -> None:
        rows, found, score = (np.concatenate(x) for x in ((self.rows, rows), (self.found, found), (self.score, score)))
        order = np.lexsort((found, -score, rows))
        own = rows[order]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        last = order[place == self.k - 1]
        self.low[rows[last]] = np.maximum(self.low[rows[last]], score[last].astype(float))
        order = order[place < self.k]
        self.rows, self.found, self.score = rows[order], found[order], score[order]

    def seed(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Phase 1: the best entries of each list, and their scores."""
        for s in range(0, len(self.q), QUERY_ROWS):
            q = self.q[s : s + QUERY_ROWS]
            pairs = []
            for a, b in cuts(q.shape[1]):
                part = np.where(self.ids[s : s + QUERY_ROWS, None] == ids, -np.inf, dot(q[:, a:b], x[:, a:b]).astype(float))
                self.counts["lists"] += part.size
                top = np.argpartition(-part, min(self.k, len(ids)) - 1, axis=1)[:, : self.k]
                pairs.append(np.repeat(np.arange(len(q)), top.shape[1]) * len(ids) + top.ravel())
            rows, at = np.divmod(np.unique(np.concatenate(pairs)), len(ids))
            ok = self.ids[s + rows] != ids[at]
            rows, at = rows[ok], at[ok]
            self.counts["missing"] += len(rows)
            self.add(rows + s, ids[at], _whole(pair_dots(q[rows], x[at])))

    def collect(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Phases 2 and 3: entries at the cutoff in some list, and the sums of those alone."""
        norms = _norms(x)
        for s in range(0, len(self.q), QUERY_ROWS):
            q, low = self.q[s : s + QUERY_ROWS], self.low[s : s + QUERY_ROWS]
            cutoff = np.floor(low / LISTS)
            self.counts["pairs"] += len(q) * len(ids)
            parts, pairs = [], [np.zeros(0, np.int64)]
            for j, (a, b) in enumerate(cuts(q.shape[1])):
                live = np.flatnonzero(self.norms[j][s : s + QUERY_ROWS] * norms[j].max() * (1 + 1e-9) + 1 >= cutoff)
                part = dot(q[live, a:b], x[:, a:b])
                self.counts["lists"] += part.size
                i, at = np.nonzero(part.astype(float) >= cutoff[live, None])
                pairs.append(live[i] * len(ids) + at)
                parts.append((live, part))
            rows, at = np.divmod(np.unique(np.concatenate(pairs)), len(ids))
            ok = self.ids[s + rows] != ids[at]
            rows, at = rows[ok], at[ok]
            self.counts["candidates"] += len(rows)
            total = np.zeros(len(rows), dtype=np.result_type(*(p.dtype for _, p in parts)))
            for (a, b), (live, part) in zip(cuts(q.shape[1]), parts, strict=True):
                place = np.full(len(q), -1)
                place[live] = np.arange(len(live))
                place = place[rows]
                have = place >= 0
                total[have] += part[place[have], at[have]]
                self.counts["missing"] += int((~have).sum())
                total[~have] += pair_dots(q[rows[~have], a:b], x[at[~have], a:b])
            ok = total.astype(float) >= low[rows]
            self.add(rows[ok] + s, ids[at[ok]], _whole(total[ok]))


class Queries:
    """A block of queries by vector length: ids and integer components."""

    def __init__(self, rows: list[tuple[int, list[float]]]) -> None:
        self.groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d in {len(v) for _, v in rows}:
            own = [(i, v) for i, v in rows if len(v) == d]
            self.groups[d] = (np.array([i for i, _ in own], dtype=np.int64), np.floor(SCALE * np.array([v for _, v in own], dtype=np.float64).reshape(len(own), d)))


def _searched(block: Broadcast, low: Broadcast | None, k: int):
    """Vectors -> ``ROWS`` of the part's best; without ``low`` those of the seed rows only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        seen = 0
        for batch in batches:
            for ids, x in _matrices(batch):
                d = x.shape[1]
                if d not in block.value.groups or (low is None and seen >= SEED):
                    continue
                if d not in best:
                    qid, q = block.value.groups[d]
                    start = np.array([low.value.get(i, -np.inf) for i in qid.tolist()]) if low else np.full(len(qid), -np.inf)
                    best[d] = Best(qid, q, start, k)
                if low is None:
                    best[d].seed(ids, x)
                else:
                    best[d].collect(ids, x)
                seen += len(ids)
            if low is None and seen >= SEED:
                break
        for b in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (b.ids[b.rows], b.found, b.score)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, query_values: int = QUERY_VALUES) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of largest integer inner product with each query. Both frames come from ``usable``."""
    spark = vectors.sparkSession
    ship(spark)
    path = result_folder(spark, "top-k")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    with Tables(spark, "queries") as tables:
        asked = tables.put(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "asked")
        size = asked.agg(F.sum(F.size("v") + 1)).first()[0] or 0
        blocks = max(1, -(-size // query_values))
        for n in range(blocks):
            own = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n)
            block = spark.sparkContext.broadcast(Queries([(r.vec_id, list(r.v)) for r in own.collect()]))
            near = vectors.mapInArrow(_searched(block, None, k), ROWS)
            bound = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") == k).select("query_id", "score").collect()
            low = spark.sparkContext.broadcast({r.query_id: float(r.score) for r in bound})
            found = vectors.mapInArrow(_searched(block, low, k), ROWS).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            with writing(spark):
                found.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
            block.destroy()
            low.destroy()
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)


def op5_topk_search(spark, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"), 10)


ORACLE = r"""
WITH e AS (SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
