"""N-gram Jaccard join over count-vector R-trees.

A document's set holds its distinct ``SHINGLE``-word shingles, lower-cased; a shorter text is one shingle; a text without
words has none and links with nothing.  Two documents link at a Jaccard similarity of ``NUM``/``DEN`` or more.  Shingles
are hashed to 64 bits; the top bits are the shingle's group, and a document's point is its count in each group.  Overlap
is at most the sum over the groups of the smaller count.  Parities of finer groups, as many as shingles or more, bound the
overlap from the other side: each group in which two parities differ holds a shingle that only one set has.  Groups are
nested, so parities fold from fine to coarse.

1. Documents with one set (by 128 bits) form a class and are represented by their smallest doc_id.
2. One R-tree over all points cannot be cut into independent parts, so points are routed to a forest: linked documents
   share one of the first n - ceil(0.8 n) + 1 shingles of any common order (rare ones first, ties by hash), and the
   documents sharing one such shingle are a cell.  The list of common shingles only orders; results don't depend on it.
3. Each cell's points are bulk-loaded into an R-tree: sorted and cut in half by the group in which they spread most, again
   and again down to leaves of ``LEAF``; a node has the largest count per group and the least and most set size below it.
   All candidates come from these trees.  Descending from pairs of the root with itself, a pair of nodes goes on if the
   summed minima of its counts allow a link, down to pairs of points.  Survivors are bounded by parities and verified on
   whole sets.
4. Trees are descended three times.  The first time only pairs of neighbours are taken from trees of several leaves: the
   first document of a node with those of its children.  Their links make components, which absorb groups of copies without
   pairing all their members.  Trees of one leaf are taken in full at once.
5. The second time all trees that hold several components are descended in full, past pairs of nodes within one component.
   A pair meets in each cell that it shares, and groups of documents just below the threshold hold many pairs, so pairs
   that may link don't leave their cell: it gives a forest of them that joins what they join.  The forests make clusters,
   and every pair that may link lies within one.
6. A document is in one cluster at most, so clusters get whole sets.  Their trees are descended and their pairs bounded by
   wide parities and verified where they meet; what leaves is a forest of links between components.

Cells and clusters above ``CELL`` rows or ``SHINGLES`` shingles are cut into parts by a hash: the first time each part has
the cell's smallest document too, which meets all of it; later the cell is cut by set size first (a link needs sizes within
0.8, so a band meets itself and the next) and each two parts of a band meet in a tree of their own.

No cell is gathered whole, no partner or candidate is dropped, and no link between different components is lost.
doc_ids are expected to be unique; rows that repeat one share its links.  A row with a null doc_id has its n_shingles, a
null component_id, and links with nothing.  Null and empty texts are components of their own.  Long texts have parities of
as many groups as they need.  An empty table gives no rows; other columns, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Tables, id_and_text, join_ids, result, ship, table
from .textwords import SPACE_WORDS, Words, chunks, mix, release

SHINGLE, NUM, DEN = 5, 80, 100
COARSE, CELL, LEAF, COMMON = 32, 512, 8, 1 << 16
#: shingles of a part's sets
SHINGLES = 1 << 20
#: cells below this many rows are trees of one leaf after the first time
LARGE = 64
#: shingles looked at together when common ones are counted
FLUSH = 2 << 20
#: pairs bounded at a time
PAIRS = 1 << 15


def shingle_sets(texts: list[bytes | None], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash) of a chunk, distinct, by document and hash; a shingle is ``width`` words, or all of a shorter text."""
    w = Words(texts, SPACE_WORDS, True)
    n = w.counts()
    docs, hashes = [], []
    for k in (width, *sorted({int(x) for x in n[(n > 0) & (n < width)]})):
        at, h = w.windows(k)
        doc = np.searchsorted(w.first, at, side="right") - 1
        if k < width:
            whole = n[doc] == k
            doc, h = doc[whole], h[whole]
        docs.append(doc)
        hashes.append(h)
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
    return doc[new], h[new]


def common_shingles(src: DataFrame, most: int = COMMON) -> np.ndarray:
    """At most ``most`` shingles that many documents hold, rarest first. A hint for the order of shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, docs = [], 0, 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            many = n >= max(8, docs // 512)
            return pa.RecordBatch.from_arrays([pa.array(h[many].view(np.int64)), pa.array(n[many])], ["h", "n"])

        for part, texts in chunks(batches):
            held.append(shingle_sets(texts)[1])
            size, docs = size + len(held[-1]), docs + part.num_rows
            if size > FLUSH:
                yield flush()
                held, size, docs = [], 0, 0
        yield flush()

    rows = src.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "h").limit(most).collect()
    return np.array([r.h for r in reversed(rows)], dtype=np.int64).view(np.uint64)


def points(doc: np.ndarray, h: np.ndarray, size: int) -> np.ndarray:
    """Counts in ``COARSE`` groups of each of ``size`` documents; 65535 stands for that many or more."""
    group = (h >> np.uint64(64 - int(np.log2(COARSE)))).astype(np.int64)
    return np.minimum(np.bincount(doc * COARSE + group, minlength=size * COARSE), 65535).astype(np.uint16).reshape(size, COARSE)


def wide(points: list[bytes]) -> np.ndarray:
    """Points as upper bounds of the counts."""
    point = np.frombuffer(b"".join(points), np.uint16).reshape(-1, COARSE)
    return np.where(point == 65535, 1 << 40, point.astype(np.int64))


def parities(doc: np.ndarray, h: np.ndarray, n: np.ndarray, more: int = 0) -> list[bytes]:
    """A bit for each group of each document, set where its count is odd; ``n`` groups at least, up to twice as many, times 2**more."""
    bits = np.maximum(6, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64) + more)
    at = np.concatenate((np.zeros(1, np.int64), np.cumsum(1 << bits)))
    where = at[doc] + (h >> (64 - bits[doc]).astype(np.uint64)).astype(np.int64)  # ascends, as the hashes of a document do
    last = np.flatnonzero(np.append(where[1:] != where[:-1], np.ones(min(1, len(where)), bool)))
    odd = where[last[np.diff(last, prepend=-1) % 2 == 1]]
    out = np.zeros(int(at[-1]) >> 3, np.uint8)
    start = np.flatnonzero(np.append(np.ones(min(1, len(odd)), bool), odd[1:] >> 3 != odd[:-1] >> 3))
    if len(start):
        out[odd[start] >> 3] = np.add.reduceat(1 << (odd & 7), start)
    return [out[a:b].tobytes() for a, b in zip((at[:-1] >> 3).tolist(), (at[1:] >> 3).tolist(), strict=True)]


def may_link(parity: list[bytes], n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the parities of each pair of places allow a link: as many shingles as bits differ are in one set only. Sets are within 0.8 of each other in size, so one has as many bits or twice as many."""
    size = np.fromiter(map(len, parity), np.int64, len(parity))
    least = np.minimum(size[x], size[y])
    ok = np.zeros(len(x), bool)
    for width in np.unique(least).tolist():
        own = np.flatnonzero(least == width)
        rows = np.unique(np.concatenate((x[own], y[own])))
        bits = np.empty((len(rows), width), np.uint8)
        same = size[rows] == width
        bits[same] = np.frombuffer(b"".join(parity[k] for k in rows[same].tolist()), np.uint8).reshape(-1, width)
        for k in np.flatnonzero(~same).tolist():
            raw = np.frombuffer(parity[rows[k]], np.uint8)
            while len(raw) > width:  # folded: a group is odd if one of its halves is
                half = np.unpackbits(raw, bitorder="little")
                raw = np.packbits(half[::2] ^ half[1::2], bitorder="little")
            bits[k] = raw
        words = bits.view(np.uint64)
        place = np.zeros(len(parity), np.int64)
        place[rows] = np.arange(len(rows))
        step = max(1, (PAIRS << 5) // width)
        for a in range(0, len(own), step):
            i, j = x[own[a : a + step]], y[own[a : a + step]]
            apart = np.bitwise_count(words[place[i]] ^ words[place[j]]).sum(axis=1, dtype=np.int64)
            ok[own[a : a + step]] = enough((n[i] + n[j] - apart) // 2, n[i], n[j])
    return ok


def forest(x: np.ndarray, y: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which of the pairs are enough to join all labels that they join. Labels are places."""
    kept, left = [np.zeros(0, np.int64)], np.arange(len(x))
    while True:
        a, b = label[x[left]], label[y[left]]
        left, a, b = left[a != b], a[a != b], b[a != b]
        if not len(left):
            return np.concatenate(kept)
        order = np.lexsort((np.minimum(a, b), np.maximum(a, b)))
        high, at = np.unique(np.maximum(a, b)[order], return_index=True)  # each goes to its least neighbour below it
        kept.append(left[order[at]])
        up = np.arange(len(label))
        up[high] = np.minimum(a, b)[order][at]
        while (up[up] != up).any():
            up = up[up]
        label = up[label]


def _describe(common: np.ndarray):
    by_hash = np.sort(common)
    rank = np.argsort(common) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            doc, h = shingle_sets(texts)
            size = part.num_rows
            n = np.bincount(doc, minlength=size)
            first = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
            rare = np.zeros(len(h), np.int64)
            if len(by_hash):
                at = np.minimum(np.searchsorted(by_hash, h), len(by_hash) - 1)
                rare = np.where(by_hash[at] == h, rank[at], 0)
            order = np.lexsort((h, rare, doc))
            keep = n - (4 * n + 4) // 5 + 1
            prefix = order[np.arange(len(h)) - first[doc] < keep[doc]]
            offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.minimum(keep, n))))
            digest = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(c)), dtype=np.uint64))) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
            point = [x.tobytes() for x in points(doc, h, size)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n), *(pa.array((d[first[1:]] - d[first[:-1]]).view(np.int64)) for d in digest), pa.array(parities(doc, h, n), pa.binary()), pa.array(point, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h[prefix].view(np.int64)))],
                ["doc_id", "n", "d1", "d2", "parity", "point", "prefix"],
            )

    return run


DESCRIBED = "doc_id long, n long, d1 long, d2 long, parity binary, point binary, prefix array<long>"


def enough(overlap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether that overlap of sets of a and b shingles is a link."""
    return DEN * overlap >= NUM * (a + b - overlap)


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their parities -> those that may link."""
    for t in batches:
        if t.num_rows:
            n, place = np.concatenate([t.column(c).to_numpy() for c in ("nx", "ny")]), np.arange(t.num_rows)
            keep = may_link(t.column("fx").to_pylist() + t.column("fy").to_pylist(), n, place, place + t.num_rows)
            yield t.filter(pa.array(keep)).select(["x", "y"])
    release()


def linked(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Which pairs of whole sets link."""
    a, b = (np.fromiter((len(s) >> 3 for s in v), np.int64, len(v)) for v in (x, y))
    keep = np.zeros(len(x), bool)
    cut = np.searchsorted(np.cumsum(a + b), np.arange(FLUSH >> 1, int((a + b).sum()), FLUSH >> 1))
    for own in np.split(np.arange(len(x)), cut):
        h = np.frombuffer(b"".join(v[k] for v in (x, y) for k in own.tolist()), np.uint64)
        pair = np.concatenate((np.repeat(own, a[own]), np.repeat(own, b[own])))
        order = np.lexsort((h, pair))
        h, pair = h[order], pair[order]
        both = np.bincount(pair[1:][(h[1:] == h[:-1]) & (pair[1:] == pair[:-1])], minlength=len(x))[own]
        keep[own] = enough(both, a[own], b[own])
    return keep


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their whole sets -> those that link."""
    for t in batches:
        yield t.filter(pa.array(linked(*(t.column(c).to_pylist() for c in ("sx", "sy"))))).select(["x", "y"])
    release()


def _sets(batches: Iterator[pa.RecordBatch], width: int = SHINGLE) -> Iterator[pa.RecordBatch]:
    for part, texts in chunks(batches):
        doc, h = shingle_sets(texts, width)
        cut = np.searchsorted(doc, np.arange(part.num_rows + 1)).tolist()
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["doc_id", "s"])


def links(src: DataFrame, described: DataFrame, pairs: DataFrame, tables: Tables) -> DataFrame:
    """The pairs (x, y) that link: bounded by their parities first, then verified on whole sets. Written."""
    n, parity = described.select("doc_id", "n"), described.select("doc_id", "parity")
    close = pairs.join(n.toDF("x", "nx"), "x").join(n.toDF("y", "ny"), "y").filter(f"{DEN} * least(nx, ny) >= {NUM} * greatest(nx, ny)")
    close = tables.put(close.select("x", "y", "nx", "ny"), "close")
    left = join_ids(parity.toDF("x", "fx"), close, ["x"], "inner")
    right = join_ids(parity.toDF("y", "fy"), close.select("x", "y"), ["y"], "inner")
    near = tables.put(left.join(right, ["x", "y"]).mapInArrow(_bounded, "x long, y long"), "bounded")
    ids = tables.put(near.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct(), "ids")
    sets = tables.put(join_ids(src, ids, ["doc_id"], "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_sets, "doc_id long, s binary"), "sets")
    both = near.join(sets.toDF("x", "sx"), "x").join(sets.toDF("y", "sy"), "y")
    out = tables.put(both.mapInArrow(_verified, "x long, y long"), "links")
    tables.drop(close, near, ids, sets)
    return out


class RTree:
    """A count-vector R-tree over points (one row each) of sets of ``n`` shingles; ``comp``: the component of each."""

    def __init__(self, n: np.ndarray, point: np.ndarray, comp: np.ndarray, leaf: int = LEAF) -> None:
        self.n, self.point, self.comp = n, point, comp
        parts = [np.lexsort((n, comp))]
        while max(map(len, parts)) > leaf:
            halves = []
            for own in parts:
                if len(own) > 1:
                    at = point[own]
                    own = own[np.argsort(at[:, at.var(axis=0).argmax()], kind="stable")]
                halves += [own[: (len(own) + 1) // 2], own[(len(own) + 1) // 2 :]]
            parts = halves
        self.leaves = np.full((len(parts), leaf), -1)
        for k, own in enumerate(parts):
            self.leaves[k, : len(own)] = own
        first = self.leaves[:, 0]
        real = self.leaves >= 0
        shown = np.where(real, self.leaves, first[:, None])  # an empty place repeats the leaf's first row
        node = {"top": point[shown].max(axis=1), "least": n[shown].min(axis=1), "most": n[shown].max(axis=1), "low": comp[shown].min(axis=1), "high": comp[shown].max(axis=1), "first": first}
        self.levels = [node]  # from the leaves up to the root
        while len(node["first"]) > 1:
            node = {k: f(v[::2], v[1::2]) for (k, v), f in zip(node.items(), (np.maximum, np.minimum, np.maximum, np.minimum, np.maximum, lambda a, b: a), strict=True)}
            self.levels.append(node)

    def _linkable(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the points of each pair may link: different components, sizes and summed minima."""
        n, m = self.n[i], self.n[j]
        ok = (self.comp[i] != self.comp[j]) & (DEN * np.minimum(n, m) >= NUM * np.maximum(n, m))
        for a in range(0, len(i), PAIRS):
            own = a + np.flatnonzero(ok[a : a + PAIRS])
            ok[own] = enough(np.minimum(self.point[i[own]], self.point[j[own]]).sum(axis=1, dtype=np.int64), n[own], m[own])
        return ok

    def pairs(self, part: np.ndarray | None = None, done: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of points that may link; of different ``part`` only, if there are two, and not both in one of the masks ``done``."""
        i = j = np.zeros(1, np.int64)
        for depth, node in enumerate(reversed(self.levels)):
            if depth:
                own = i == j
                i, j = np.concatenate((2 * i, 2 * i, 2 * i + 1, 2 * i[~own] + 1)), np.concatenate((2 * j, 2 * j + 1, 2 * j + 1, 2 * j[~own]))
            least, most = node["least"], node["most"]
            ok = (DEN * most[i] >= NUM * least[j]) & (DEN * most[j] >= NUM * least[i])
            ok &= ~((node["low"][i] == node["high"][i]) & (node["low"][j] == node["high"][j]) & (node["low"][i] == node["low"][j]))
            i, j = i[ok], j[ok]
            fits = [enough(np.minimum(node["top"][i[a : a + PAIRS]], node["top"][j[a : a + PAIRS]]).sum(axis=1, dtype=np.int64), least[i[a : a + PAIRS]], least[j[a : a + PAIRS]]) for a in range(0, len(i), PAIRS)]
            fits = np.concatenate([np.zeros(0, bool), *fits])
            i, j = i[fits], j[fits]
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, (PAIRS << 3) // self.leaves.shape[1] ** 2)
        for a in range(0, len(i), step):
            p, q = i[a : a + step], j[a : a + step]
            x, y = (np.broadcast_to(v, (len(p), *2 * self.leaves.shape[1:])) for v in (self.leaves[p][:, :, None], self.leaves[q][:, None, :]))
            ok = (x >= 0) & (y >= 0) & ((p != q)[:, None, None] | (np.arange(x.shape[1])[:, None] < np.arange(x.shape[2])))
            x, y = x[ok], y[ok]
            if part is not None and part.min() != part.max():
                ok = part[x] != part[y]
                x, y = x[ok], y[ok]
            for mask in done:
                ok = ~(mask[x] & mask[y])
                x, y = x[ok], y[ok]
            ok = self._linkable(x, y)
            left.append(x[ok])
            right.append(y[ok])
        return np.concatenate(left), np.concatenate(right)

    def neighbours(self, leader: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that may link of each node's first document with its children's, and of ``leader`` with all."""
        x, y = [np.repeat(self.leaves[:, 0], self.leaves.shape[1] - 1)], [self.leaves[:, 1:].ravel()]
        for node in self.levels[:-1]:
            x.append(node["first"][::2])
            y.append(node["first"][1::2])
        if leader is not None:
            x.append(np.full(len(self.n), leader))
            y.append(np.arange(len(self.n)))
        x, y = np.concatenate(x), np.concatenate(y)
        ok = (x >= 0) & (y >= 0) & (x != y)
        x, y = x[ok], y[ok]
        ok = self._linkable(x, y)
        return x[ok], y[ok]


def _by_cell(batches: Iterator[pa.RecordBatch], keys: list[str], pairs) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell -> the pairs of doc_ids that ``pairs(table, starts, sizes)`` finds. Cells may run over the ends of batches."""
    held: pa.Table | None = None

    def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if t.num_rows:
            new = np.zeros(t.num_rows, bool)
            new[0] = True
            for c in keys:
                k = t.column(c).to_numpy()
                new[1:] |= k[1:] != k[:-1]
            start = np.flatnonzero(new)
            x, y = pairs(t, start, np.diff(np.append(start, t.num_rows)))
            doc = t.column("doc_id").to_numpy()
            both = np.stack((np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y])), 1)
            both = both[np.lexsort((both[:, 1], both[:, 0]))]
            both = both[np.append(np.ones(min(1, len(both)), bool), (both[1:] != both[:-1]).any(axis=1))]
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["x", "y"])

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        last = np.flatnonzero(np.logical_or.reduce([(k := held.column(c).to_numpy()) != k[-1] for c in keys]))
        cut = int(last[-1]) + 1 if len(last) else 0
        yield from found(held.slice(0, cut))
        held = held.slice(cut)
    if held is not None:
        yield from found(held)
    release()


def _first_descent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells (h, part) of doc_id, n, point, leads -> pairs of neighbours; all pairs of one leaf."""

    def pairs(t: pa.Table, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        doc, n, leads = (t.column(c).to_numpy() for c in ("doc_id", "n", "leads"))
        point = wide(t.column("point").to_pylist())
        place = np.arange(t.num_rows) - np.repeat(start, size)
        after = np.repeat(size, size) - 1 - place
        one_leaf = np.repeat(size <= LEAF, size)
        after = np.where(one_leaf, after, 0)
        left = np.repeat(np.arange(t.num_rows), after)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after)
        ok = np.zeros(len(left), bool)
        for a in range(0, len(left), PAIRS):
            x, y = left[a : a + PAIRS], right[a : a + PAIRS]
            fits = (doc[x] != doc[y]) & (DEN * np.minimum(n[x], n[y]) >= NUM * np.maximum(n[x], n[y]))
            fits[fits] = enough(np.minimum(point[x[fits]], point[y[fits]]).sum(axis=1), n[x[fits]], n[y[fits]])
            ok[a : a + PAIRS] = fits
        left, right = [left[ok]], [right[ok]]
        for s, k in zip(start[size > LEAF].tolist(), size[size > LEAF].tolist(), strict=True):
            own = slice(s, s + k)
            leader = np.flatnonzero(leads[own])
            x, y = RTree(n[own], point[own], doc[own]).neighbours(int(leader[0]) if len(leader) else None)
            left.append(x + s)
            right.append(y + s)
        return np.concatenate(left), np.concatenate(right)

    return _by_cell(batches, ["h", "part"], pairs)


CELL_KEYS = ["h", "band", "i", "j"]


def _in_cells(cells: DataFrame, link: Callable) -> DataFrame:
    """Cells (h, band, i, j) of part, guest, doc_id, comp, n, point and what ``link`` looks at -> pairs of its forests, each once.

    ``link(cell, x, y, label)`` gets the pairs that come from the cell's tree and the components of its rows, as places.
    """

    def pairs(t: pa.Table, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part, comp, n, guest = (t.column(c).to_numpy() for c in ("part", "comp", "n", "guest"))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, k in zip(start.tolist(), size.tolist(), strict=True):
            own = slice(s, s + k)
            point = wide(t.column("point").slice(s, k).to_pylist())
            x, y = RTree(n[own], point, comp[own], k if LEAF < k < LARGE else LEAF).pairs(part[own], (guest[own],))
            if len(x):
                _, first, label = np.unique(comp[own], return_index=True, return_inverse=True)
                kept = link(t.slice(s, k), x, y, first[label])
                left.append(x[kept] + s)
                right.append(y[kept] + s)
        return np.concatenate(left), np.concatenate(right)

    ordered = cells.repartition(*CELL_KEYS).sortWithinPartitions(*CELL_KEYS, "doc_id")
    return ordered.mapInArrow(lambda b: _by_cell(b, CELL_KEYS, pairs), "x long, y long").distinct()


def _second_descent(cell: pa.Table, x: np.ndarray, y: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which pairs join all rows that pairs which may link by their parities (parity) join."""
    near = np.flatnonzero(may_link(cell.column("parity").to_pylist(), cell.column("n").to_numpy(), x, y))
    return near[forest(x[near], y[near], np.arange(len(label)))]


def _third_descent(cell: pa.Table, x: np.ndarray, y: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which pairs link by their whole sets (s) and join all components that links join."""
    sets = cell.column("s").to_pylist()
    n = np.fromiter((len(v) >> 3 for v in sets), np.int64, len(sets))
    near = np.flatnonzero(may_link(parities(np.repeat(np.arange(len(n)), n), np.frombuffer(b"".join(sets), np.uint64), n, 3), n, x, y))
    kept = [np.zeros(0, np.int64)]
    label = label.copy()
    while len(near):
        near = near[label[x[near]] != label[y[near]]]  # joined meanwhile
        some, near = near[:LARGE], near[LARGE:]
        some = some[linked(*([sets[k] for k in v[some].tolist()] for v in (x, y)))]
        some = some[forest(x[some], y[some], label)]
        kept.append(some)
        for a, b in zip(x[some].tolist(), y[some].tolist(), strict=True):
            label[label == label[a]] = label[b]
    return np.concatenate(kept)


def _spread(known: DataFrame, tables: Tables) -> DataFrame:
    """Cells that hold several components, as rows for ``_in_cells`` without their points. known: h, doc_id, comp, n."""
    mixed = known.groupBy("h").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("m"), F.sum("n").alias("w")).filter("a < b")
    mixed = tables.put(mixed.select("h", ((F.col("m") > CELL) | (F.col("w") > SHINGLES)).alias("hot")), "mixed")
    band = F.floor(F.log("n") / F.log(F.lit(DEN / NUM))).cast("int")
    kinds = F.when(F.col("hot"), F.array(F.struct(band.alias("band"), F.lit(False).alias("guest")), F.struct((band + 1).alias("band"), F.lit(True).alias("guest"))))
    kinds = kinds.otherwise(F.array(F.struct(F.lit(-1).alias("band"), F.lit(False).alias("guest"))))
    rows = tables.put(known.join(mixed, "h").select("h", "doc_id", "comp", "n", F.explode(kinds).alias("k")).select("*", "k.band", "k.guest").drop("k"), "spread")
    cells = rows.groupBy("h", "band").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.min("guest").alias("guests"), F.count("*").alias("m"), F.sum("n").alias("w")).filter("a < b and not guests")
    parts = F.greatest(F.ceil(F.col("m") / CELL), F.ceil(F.col("w") / SHINGLES)).cast("int")
    cells = tables.put(cells.select("h", "band", parts.alias("parts")), "spread-cells")
    rows = rows.join(cells, ["h", "band"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("h", "band", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "part", "guest", "doc_id", "comp", "n")


def _class_labels(src: DataFrame, described: DataFrame, member: DataFrame, copies: DataFrame, tables: Tables) -> DataFrame:
    """(rep, label): the component of each class that links with another."""
    postings = join_ids(described.filter("n > 0 and doc_id is not null"), copies, ["doc_id", "n", "d1", "d2"], "left_anti").select("doc_id", "n", F.explode("prefix").alias("h"))
    cells = postings.groupBy("h").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("b"), F.count("*").alias("m")).filter("leader < b")
    cells = tables.put(cells.select("h", "leader", F.ceil(F.col("m") / CELL).cast("int").alias("parts"), (F.col("m") > LEAF).alias("leaves")), "cells")
    rows = tables.put(postings.join(cells, "h").select("h", "doc_id", "n", "leader", "parts", "leaves"), "cell-rows")

    part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    everywhere = (F.col("doc_id") == F.col("leader")) & (F.col("parts") > 1)
    trees = rows.withColumn("part", F.explode(F.when(everywhere, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(part))))
    trees = trees.drop("n").join(described.select("doc_id", "n", "point"), "doc_id").select("h", "part", "doc_id", "n", "point", everywhere.cast("int").alias("leads"))
    near = trees.repartition("h", "part").sortWithinPartitions("h", "part", "doc_id").mapInArrow(_first_descent, "x long, y long").distinct()
    near = links(src, described, near, tables)
    label = connected_components(near.toDF("a", "b"), tables)

    # trees of one leaf have been taken in full
    known = join_ids(rows.filter("leaves").select("h", "doc_id", "n"), label.toDF("doc_id", "label"), ["doc_id"], "left")
    known = tables.put(known.select("h", "doc_id", F.coalesce("label", "doc_id").alias("comp"), "n"), "known")
    tables.drop(rows, cells)
    cells = _spread(known, tables).drop("n").join(described.select("doc_id", "n", "point", "parity"), "doc_id")
    joined = tables.put(_in_cells(cells, _second_descent), "forests")
    cluster = connected_components(joined.toDF("a", "b"), tables)

    of_docs = known.select("doc_id", "comp", "n").distinct()
    clustered = tables.put(of_docs.join(cluster.toDF("doc_id", "h"), "doc_id").select("h", "doc_id", "comp", "n"), "clustered")
    sets = tables.put(join_ids(src, clustered.select("doc_id"), ["doc_id"], "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_sets, "doc_id long, s binary"), "sets")
    more = tables.put(_in_cells(_spread(clustered, tables).join(described.select("doc_id", "point"), "doc_id").join(sets, "doc_id"), _third_descent), "more")
    # components that these links join, by their labels
    own = label.toDF("doc_id", "label")
    for c in ("x", "y"):
        more = join_ids(more, own.withColumnRenamed("doc_id", c), [c], "left").withColumn(c, F.coalesce("label", c)).drop("label")
    up = connected_components(more.toDF("a", "b"), tables)
    known = label.toDF("rep", "comp").unionByName(up.select(F.col("node").alias("rep"), F.col("node").alias("comp"))).distinct()
    return known.join(up.toDF("comp", "up"), "comp", "left").select("rep", F.coalesce("up", "comp").alias("label"))


def jaccard_components(docs: DataFrame, **columns: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    spark = docs.sparkSession
    ship(spark)
    src = id_and_text(docs, **columns)
    with Tables(spark, "jaccard") as tables:
        described = tables.put(src.mapInArrow(_describe(common_shingles(src)), DESCRIBED), "described")
        kinds = ["n", "d1", "d2"]
        classes = tables.put(described.filter("n > 0 and doc_id is not null").groupBy(*kinds).agg(F.min("doc_id").alias("rep")), "classes")
        member = described.select("doc_id", *kinds).join(classes, kinds, "left").select("doc_id", *kinds, F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"))
        member = tables.put(member, "members")
        copies = tables.put(member.filter("rep <> doc_id").select("doc_id", *kinds).distinct(), "copies")
        label = _class_labels(src.filter("doc_id is not null"), described, member, copies, tables)
        out = member.join(label.toDF("rep", "label"), "rep", "left")
        return result(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id")), "components")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id; columns unchanged.

    Rows that repeat the kept doc_id all stay, and so do rows with a null one.
    """
    gone = result(jaccard_components(docs).filter("component_id <> doc_id").select("doc_id").distinct(), "near-copies")
    return join_ids(docs, gone, ["doc_id"], "left_anti")


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b USING (h) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(root) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY d.doc_id, n
"""
