"""Hard negatives by branch and bound over ball trees.

A row has an id, a label and a vector, whose components become whole numbers (floor of ``SCALE`` times each).  Its score with
an anchor is the inner product; higher scores come first, ties by the smaller id.  An anchor's positives are its first
``positives`` other rows of the same label.  For each of them the hard negatives are the first ``negatives`` rows of other
labels whose score lies between ``low`` and ``high`` hundredths of the positive's.

1. The rows are dealt evenly to parts of about ``TREE_ROWS``, and each part's rows are put into ball trees, one for each
   label and length of vectors, down to leaves of ``LEAF`` rows; a ball has a centre and a radius.
2. Anchors are packed into blocks of ``BLOCK``; every block meets every part, as rows dealt by part, so no side is broadcast
   or collected, and a task holds the trees of one part and one block at a time.
3. The product of an anchor q with all rows of a ball is at most q.c + |q|r and at least q.c - |q|r.  From the roots down, a
   ball is left out if its label can't serve, if its upper bound lies under the window or its lower bound above it, or if its
   upper bound lies strictly beneath the current kth score of every window of the anchor; leaves are visited from the highest
   upper bound on, and the kth scores rise as they go.
4. A first pass over one part gives each window a kth score that the passes over all parts begin with.  A part sends on at
   most k rows a window.

Positives are searched with one open window each, negatives with the windows of the positives found.  Rows with a null id or
label, a null vector, or a null or non-finite component take no part.  Rows with the anchor's own id are not its candidates,
nor are vectors of another length; other repeated rows count each.  An anchor id that repeats is asked once, with its least
(label, vector).  An anchor without positives, or positives without negatives in their window, give no rows, and so does an
empty table.  Scores outside 64 bits are held at the limits.  Other columns, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Tables, result, ship, table
from .topk_search import _EXACT, _whole, dot

SCALE, TREE_ROWS, LEAF, BLOCK = 256, 8192, 64, 256
#: vectors of a part, a tree each: nodes as (first row, one past the last, children, label), centres and radii
TREES = "part int, kind int, d int, ids binary, labels binary, vectors binary, nodes binary, balls binary, lows binary, highs binary, kth binary"
FOUND = "anchor_id long, window int, vec_id long, score long"
_NO = -(2**63)
_HIGHEST = 2**63 - 1


def usable(vectors: DataFrame, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding") -> DataFrame:
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    return v.filter("vec_id is not null and label is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


class Ball:
    """Ball trees over the rows of one part and length: one for each label, their nodes level by level."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, nodes: np.ndarray, balls: np.ndarray) -> None:
        self.ids, self.labels, self.x, self.nodes = ids, labels, x, nodes
        self.centre, self.radius = balls[:, :-1], balls[:, -1]
        self.norm = np.sqrt((self.centre**2).sum(axis=1)) + self.radius
        self.roots = np.flatnonzero(~np.isin(np.arange(len(nodes)), nodes[:, 2:4]))

    @staticmethod
    def grow(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> Ball:
        order = np.lexsort((ids, labels))
        cuts = np.flatnonzero(np.append(True, labels[order][1:] != labels[order][:-1])).tolist() + [len(ids)]
        nodes, balls = [], []
        todo = [(a, b, -1, 0) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for a, b, parent, side in todo:  # grows as balls are cut
            own = x[order[a:b]]
            centre = own.mean(axis=0)
            away = np.sqrt(((own - centre) ** 2).sum(axis=1))
            nodes.append([a, b, -1, -1, labels[order[a]]])
            balls.append(np.append(centre, away.max()))
            if parent >= 0:
                nodes[parent][2 + side] = len(nodes) - 1
            if b - a > LEAF and away.max() > 0:
                one = own[away.argmax()]
                other = own[((own - one) ** 2).sum(axis=1).argmax()]
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own @ (other - one), half)]
                todo += [(a, a + half, len(nodes) - 1, 0), (a + half, b, len(nodes) - 1, 1)]
        return Ball(ids[order], labels[order], x[order], np.array(nodes, dtype=np.int64), np.array(balls))

    def leaves(self, q: np.ndarray, labels: np.ndarray, same: bool, lows: np.ndarray, highs: np.ndarray, best: Best) -> tuple[np.ndarray, np.ndarray]:
        """(anchors as rows, leaves) that may hold something, and the leaves' upper bounds; balls that can't are left out with all below."""
        size = np.sqrt((q**2).sum(axis=1))
        live = np.zeros((len(q), len(self.nodes)), bool)
        upper = np.full((len(q), len(self.nodes)), -np.inf)
        level, active = self.roots, np.ones((len(q), len(self.roots)), bool)
        ends = []
        while len(level):
            ip, spread = q @ self.centre[level].T, np.outer(size, self.radius[level])
            slack = 0.5 + 1e-9 * np.outer(size, self.norm[level])
            up, down = ip + spread + slack, ip - spread - slack
            active &= (labels[:, None] == self.nodes[level, 4]) == same
            some = np.zeros_like(active)
            for w in range(lows.shape[1]):
                some |= (up >= np.maximum(lows[:, w], best.kth[:, w])[:, None]) & (down <= highs[:, w][:, None])
            active &= some
            upper[:, level], live[:, level] = up, active
            ends.append(level[self.nodes[level, 2] < 0])
            inner = (self.nodes[level, 2] >= 0) & active.any(axis=0)
            level, active = self.nodes[level[inner], 2:4].ravel(), np.repeat(active[:, inner], 2, axis=1)
        own = np.concatenate(ends)
        return own, np.where(live[:, own], upper[:, own], -np.inf)


class Best:
    """The k best (score, id) of each anchor and window."""

    def __init__(self, kth: np.ndarray, k: int) -> None:
        self.k, self.kth = k, kth.astype(float)
        self.score = np.full((*kth.shape, k), _NO)
        self.ids = np.full((*kth.shape, k), _HIGHEST)
        #: pairs of an anchor and a row that were multiplied out, and all there are
        self.met = self.pairs = 0

    def add(self, rows: np.ndarray, w: int, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores (one row for each of ``rows``) of candidates; those that are none have the score ``_NO``."""
        ok = ((score >= self.kth[rows, w][:, None]) & (score > _NO)).any(axis=1)
        rows, score = rows[ok], score[ok]
        if not len(rows):
            return
        score = np.concatenate((self.score[rows, w], score), axis=1)
        ids = np.concatenate((self.ids[rows, w], np.broadcast_to(ids, (len(rows), len(ids)))), axis=1)
        ids = np.where(score == _NO, _HIGHEST, ids)
        order = np.argsort(ids, axis=1, kind="stable")
        order = np.take_along_axis(order, np.argsort(-np.maximum(np.take_along_axis(score, order, 1), _NO + 1), axis=1, kind="stable"), 1)[:, : self.k]
        self.score[rows, w], self.ids[rows, w] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
        last = self.score[rows, w, -1]
        self.kth[rows, w] = np.maximum(self.kth[rows, w], np.where(last == _NO, -np.inf, last))


def search(tree: Ball, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, same: bool, lows: np.ndarray, highs: np.ndarray, best: Best) -> None:
    """The best rows of one part's trees for a block of anchors (``same``: rows of the anchor's label, else of others), into ``best``."""
    best.pairs += len(q) * len(tree.ids)
    exact = max(np.abs(q).max(initial=0), 1) * max(np.abs(tree.x).max(initial=0), 1) * max(1, q.shape[1]) < _EXACT
    if exact:
        leaves, upper = tree.leaves(q, labels, same, lows, highs, best)
    else:  # bounds of such numbers would not be safe
        leaves = np.flatnonzero(tree.nodes[:, 2] < 0)
        upper = np.where((labels[:, None] == tree.nodes[leaves, 4]) == same, np.inf, -np.inf)

    def visit(k: int, rows: np.ndarray) -> None:
        a, b = tree.nodes[leaves[k], :2]
        best.met += len(rows) * int(b - a)
        score = _whole(dot(q[rows], tree.x[a:b]))
        score = np.where(ids[rows][:, None] == tree.ids[a:b], _NO, score)
        for w in range(lows.shape[1]):
            inside = (score >= lows[rows, w][:, None]) & (score <= highs[rows, w][:, None])
            best.add(rows, w, np.where(inside, score, _NO), tree.ids[a:b])

    if not len(leaves) or not len(q):
        return
    first = upper.argmax(axis=1)
    for k in np.unique(first).tolist():
        rows = np.flatnonzero((first == k) & (upper[:, k] > -np.inf))
        if len(rows):
            visit(k, rows)
            upper[rows, k] = -np.inf
    for k in np.argsort(-upper.max(axis=0), kind="stable").tolist():
        rows = np.flatnonzero((upper[:, k] > -np.inf) & (upper[:, k] >= best.kth.min(axis=1)))
        if len(rows):
            visit(k, rows)


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers as doubles, or as floats where these hold them."""
    return (x.astype(np.float32) if not x.size or np.abs(x).max() < 2**24 else x).tobytes()


def _unpacked(data: bytes, rows: int, d: int) -> np.ndarray:
    kind = np.float64 if rows * d and len(data) == 8 * rows * d else np.float32
    return np.frombuffer(data, kind).astype(np.float64).reshape(rows, d)


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(places, whole components, length) of a batch's vectors, by length."""
    col = batch.column("v")
    offsets = col.offsets.to_numpy()
    flat = np.floor(SCALE * col.values.to_numpy(zero_copy_only=False))
    size = np.diff(offsets)
    for d in np.unique(size).tolist():
        own = np.flatnonzero(size == d)
        yield own, flat[offsets[own][:, None] + np.arange(d)].reshape(len(own), d), d


def _frames(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] * 3 + [pa.binary()] * 8
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split()[0] for c in TREES.split(", ")])


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's rows -> its trees."""
    part = TaskContext.get().partitionId()
    held: dict[int, list[tuple[np.ndarray, ...]]] = {}

    def grown(d: int) -> pa.RecordBatch:
        t = Ball.grow(*(np.concatenate(x) for x in zip(*held.pop(d), strict=True)))
        return _frames([(part, 0, d, t.ids.tobytes(), t.labels.tobytes(), _packed(t.x), t.nodes.tobytes(), np.column_stack((t.centre, t.radius)).tobytes(), None, None, None)])

    for b in batches:
        for own, x, d in _vectors(b):
            held.setdefault(d, []).append((b.column("vec_id").to_numpy()[own], b.column("label").to_numpy()[own], x))
            if sum(len(r[0]) for r in held[d]) >= 2 * TREE_ROWS:
                yield grown(d)
    for d in list(held):
        yield grown(d)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors with their windows (arrays low, high, kth) -> blocks of them, of one length and number of windows each."""
    for b in batches:
        windows = [np.array(b.column(c).to_pylist(), dtype=object) for c in ("low", "high", "kth")]
        n = np.array([len(x) for x in b.column("low").to_pylist()], dtype=np.int64)
        for own, x, d in _vectors(b):
            for w in np.unique(n[own]).tolist():
                some = np.flatnonzero(n[own] == w)
                for a in range(0, len(some), BLOCK):
                    at = some[a : a + BLOCK]
                    cut = [np.array([list(c[k]) for k in own[at]], dtype=np.int64) for c in windows]
                    yield _frames([(None, 1, d, b.column("vec_id").to_numpy()[own[at]].tobytes(), b.column("label").to_numpy()[own[at]].tobytes(), _packed(x[at]), None, None, *(c.tobytes() for c in cut))])


def _met(k: int, same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, trees = None, []
        for b in batches:
            for n in range(b.num_rows):
                (r,) = b.slice(n, 1).to_pylist()
                if r["part"] != part:
                    part, trees = r["part"], []
                ids, labels = (np.frombuffer(r[c], np.int64) for c in ("ids", "labels"))
                x = _unpacked(r["vectors"], len(ids), r["d"])
                if r["kind"] == 0:
                    trees.append(Ball(ids, labels, x, np.frombuffer(r["nodes"], np.int64).reshape(-1, 5), np.frombuffer(r["balls"], np.float64).reshape(-1, r["d"] + 1)))
                    continue
                lows, highs, kth = (np.frombuffer(r[c], np.int64).reshape(len(ids), -1) for c in ("lows", "highs", "kth"))
                best = Best(np.where(kth == _NO, -np.inf, kth), k)
                for t in trees:
                    if t.x.shape[1] == r["d"]:
                        search(t, ids, labels, x, same, lows, highs, best)
                a, w, p = np.nonzero(best.score > _NO)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(w.astype(np.int32)), pa.array(best.ids[a, w, p]), pa.array(best.score[a, w, p])], ["anchor_id", "window", "vec_id", "score"])

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "window").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _searched(asked: DataFrame, trees: DataFrame, parts: int, k: int, same: bool, tables: Tables) -> DataFrame:
    """anchor_id, window, rank, vec_id, score: the best k of each window. asked: vec_id, label, v, low, high (arrays)."""

    def through(anchors: DataFrame, own: DataFrame, last: int) -> DataFrame:
        blocks = anchors.mapInArrow(_blocks, TREES).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(last - 1))))
        both = own.unionByName(blocks.select(*own.columns)).repartition(last, "part").sortWithinPartitions("part", "kind")
        return _first(both.mapInArrow(_met(k, same), FOUND), k)

    none = F.transform("low", lambda _: F.lit(_NO))
    anchors = asked.withColumn("kth", none)
    if parts > 1:
        seen = tables.put(through(anchors, trees.filter("part = 0"), 1).filter(F.col("rank") == k), "seed")
        bounds = seen.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("m"))
        known = asked.join(bounds.withColumnRenamed("anchor_id", "vec_id"), "vec_id", "left")
        anchors = known.withColumn("kth", F.transform("low", lambda _, w: F.coalesce(F.try_element_at("m", w.cast("int")), F.lit(_NO)))).drop("m")
    return tables.put(through(anchors, trees, parts), "found")


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Both frames come from ``usable``; anchors are among the rows."""
    spark = rows.sparkSession
    ship(spark)
    with Tables(spark, "hard-negatives") as tables:
        own = tables.put(rows.select("vec_id", "label", "v"), "rows")
        parts = max(1, -(-own.count() // TREE_ROWS))
        trees = tables.put(own.repartition(parts).mapInArrow(_grown, TREES), "trees")
        asked = tables.put(anchors.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v"), "anchors")
        open_ = asked.withColumn("low", F.array(F.lit(_NO + 1))).withColumn("high", F.array(F.lit(_HIGHEST)))
        near = _searched(open_, trees, parts, positives, True, tables).select("anchor_id", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        bound = F.col("positive_score").cast("decimal(38,0)")
        edges = F.struct("window", F.ceil(bound * low / 100).cast("long").alias("low"), F.floor(bound * high / 100).cast("long").alias("high"))
        windows = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(edges)).alias("w"))
        windowed = asked.join(windows, "vec_id").select("vec_id", "label", "v", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
        found = _searched(windowed, trees, parts, negatives, False, tables)
        out = near.join(found, ["anchor_id", "window"])
        return result(out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, rows.filter("vec_id % 100 = 0"))


ORACLE = r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""
