"""MinHash near-duplicates, their candidates judged by odd sketches.

A document's set holds its distinct ``WIDTH``-word shingles, lower-cased; a shorter text is one shingle, a text without words
has none and links with nothing.  Two documents link at a Jaccard similarity of ``NUM``/``DEN`` or more.

1. Documents with one set (by 128 bits) form a class and are represented by their smallest doc_id.
2. A set has ``SAMPLES`` MinHash samples.  ``BANDS`` of ``ROWS`` samples each are the keys of its buckets: a pair at the
   threshold shares none with a chance of (1 - 0.8 ** ROWS) ** BANDS, which is 1e-10.  All samples are folded into the odd
   sketch: each flips one of ``BITS`` bits, so equal samples of two documents cancel in the exclusive or of their sketches,
   and the number of bits left tells how many samples differ.  ``cutoff`` is the number that a pair at the threshold
   exceeds with a chance of ``LOSS``; a pair of more bits is no candidate.
3. First each bucket's members meet its leader (one of ``LEADERS`` ways to choose it, by the key, so a group of copies meets
   a few documents and not itself).  Candidates that the sketches leave are compared on whole sets; their links make
   components.
4. In buckets of three and more that still hold several components, sketches of all members of different components are
   met, and components with a candidate between them are joined to clusters; a bucket sends on a forest of such pairs, which
   is no longer than its members.
5. Each cluster is a cell whose documents come together with their whole sets, once.  There every candidate of different
   components is compared on whole sets, and components that have been linked are one from then on, so a cell too sends on
   a forest.  Pairs near the threshold, which a group of copies has many of, are never rows.

Buckets and clusters above ``CELL`` members or ``SHINGLES`` shingles are cut by the size of the sets (a link needs sizes
within 0.8, so a band of sizes meets itself and the next) and then into parts, of which each two meet in a task of their own;
nothing is dropped.

Every link is one that whole sets confirm (by 64-bit shingle hashes; copies by 128 bits).  doc_ids are expected to be
unique; rows that repeat one share its links.  A row with a null doc_id has its n_shingles, null component_id and kept, and
links with nothing.  Null and empty texts are components of their own.  Texts are taken whole, however long.  An empty table
gives no rows; other columns, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .ngram_jaccard import DEN, NUM, _by_cell, _sets, _verified, enough, shingle_sets
from .shared import Tables, id_and_text, join_ids, result, ship, table
from .textwords import chunks, joined, mix

WIDTH = 2
BANDS, ROWS, SAMPLES, BITS = 32, 3, 128, 512
LOSS = 1e-9
LEADERS, CELL, SHINGLES = 8, 2048, 1 << 21
#: documents whose samples are drawn, and pairs whose sketches are met, at a time
DOCS_AT_ONCE, PAIRS = 2048, 1 << 18
DESCRIBED = "doc_id long, n long, d1 long, d2 long, sketch binary, keys array<long>"

#: one odd factor and one summand for each sample
_FACTOR = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix(np.arange(SAMPLES + 1, 2 * SAMPLES + 1, dtype=np.uint64))


def cutoff(samples: int = SAMPLES, bits: int = BITS, similarity: float = NUM / DEN, loss: float = LOSS) -> int:
    """The least number of bits that the sketches of a pair of that similarity differ in beyond it with a chance of ``loss`` at most.

    The number of differing samples is binomial; each is two flips of random bits, and a flip of a set bit clears it.
    """
    differ = np.zeros(samples + 1)
    differ[0] = similarity**samples
    for k in range(samples):
        differ[k + 1] = differ[k] * (samples - k) / (k + 1) * (1 - similarity) / similarity
    odd = np.zeros(bits + 1)
    odd[0], up = 1.0, 1 - np.arange(bits + 1) / bits
    total = differ[0] * odd
    for k in range(samples):
        for _ in range(2):
            raised, lowered = odd * up, odd * (1 - up)
            odd = np.append(0, raised[:-1]) + np.append(lowered[1:], 0)
        total += differ[k + 1] * odd
    beyond = np.cumsum(total[::-1])[::-1]  # the chance of this many bits or more
    return int(np.flatnonzero(np.append(beyond[1:], 0) <= loss)[0])


MOST = cutoff()


def min_hashes(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents with shingles, their samples as rows) of shingle hashes sorted by document."""
    own, start = np.unique(doc, return_index=True)
    out = np.empty((len(own), SAMPLES), np.uint64)
    if len(own):
        for k in range(SAMPLES):
            out[:, k] = np.minimum.reduceat(h * _FACTOR[k] + _ADD[k], start)
    return own, out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """``BITS`` parities of each row of samples, as bytes."""
    place = (mix(samples ^ _ADD) % np.uint64(BITS)).astype(np.int64) + np.arange(len(samples))[:, None] * BITS
    odd = np.bincount(place.ravel(), minlength=len(samples) * BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(samples), BITS), axis=1)


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples[:, : BANDS * ROWS].reshape(len(samples), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2])
    for k in range(ROWS):
        key = joined(key, rows[:, :, k])
    return key


def linkable(n: np.ndarray) -> np.ndarray:
    """Whether a set of n shingles can link with another set at all: if need be, with one that has a shingle more."""
    return DEN * n >= NUM * (n + 1)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in chunks(batches):
        for a in range(0, len(texts), DOCS_AT_ONCE):
            some = texts[a : a + DOCS_AT_ONCE]
            doc, h = shingle_sets(some, WIDTH)
            n = np.bincount(doc, minlength=len(some))
            first = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
            digest = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(c)), dtype=np.uint64))) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
            own, samples = min_hashes(doc, h)
            sketch: list[bytes | None] = [None] * len(some)
            for k, s in zip(own.tolist(), odd_sketches(samples), strict=True):
                sketch[k] = s.tobytes()
            asked = linkable(n[own])
            count = np.zeros(len(some), np.int64)
            count[own[asked]] = BANDS
            offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(count)))
            keys = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(band_keys(samples[asked]).ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").slice(a, len(some)), pa.array(n), *(pa.array((d[first[1:]] - d[first[:-1]]).view(np.int64)) for d in digest), pa.array(sketch, pa.binary()), keys],
                ["doc_id", "n", "d1", "d2", "sketch", "keys"],
            )


def _rows_of(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), BITS // 64)


def fits(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether pairs of sketches (along the last axis) and set sizes may link."""
    near = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64) <= MOST
    return near & (DEN * np.minimum(n, m) >= NUM * np.maximum(n, m))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their sketches and sizes -> the pairs that may link."""
    for t in batches:
        if t.num_rows:
            ok = fits(*(_rows_of(t.column(c).to_pylist()) for c in ("kx", "ky")), *(t.column(c).to_numpy() for c in ("nx", "ny")))
            yield t.filter(pa.array(ok)).select(["x", "y"])


def _confirmed(src: DataFrame, near: DataFrame, tables: Tables) -> DataFrame:
    """The pairs (x, y) of a written table that link on their whole sets. Written; ``near`` goes."""
    ids = tables.put(near.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct(), "ids")
    sets = tables.put(join_ids(src, ids, ["doc_id"], "left_semi").dropDuplicates(["doc_id"]).mapInArrow(partial(_sets, width=WIDTH), "doc_id long, s binary"), "sets")
    both = near.join(sets.toDF("x", "sx"), "x").join(sets.toDF("y", "sy"), "y")
    out = tables.put(both.mapInArrow(_verified, "x long, y long"), "links")
    tables.drop(near, ids, sets)
    return out


def _candidates(sketch: np.ndarray, n: np.ndarray, comp: np.ndarray, apart: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which rows each of ``x`` may link with: of other components, and not set apart from it (see ``met_elsewhere``)."""
    ok = np.empty((len(x), len(n)), bool)
    for a in range(0, len(x), max(1, PAIRS // len(n))):
        own = x[a : a + max(1, PAIRS // len(n)), None]
        ok[a : a + len(own)] = (comp[own] != comp) & ~met_elsewhere(apart, own) & fits(sketch[own], sketch, n[own], n)
    return ok


def met_elsewhere(apart: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Pairs that another cell meets, or that have been met. apart: part, guest, leads of each row; two parts meet each other only."""
    part, guest, leads = apart
    out = ((guest[x] & guest) | leads[x] | leads) > 0
    return out | (part[x] == part) if part.min() != part.max() else out


def _cell_columns(t: pa.Table, start: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, guest, leads), component and size of the set of a cell's rows."""
    part, guest, leads, comp, n = (t.column(c).slice(start, size).to_numpy() for c in ("part", "guest", "leads", "doc_id", "n"))
    return np.stack((part, guest, leads)).astype(np.int64), comp, n


def _forests(t: pa.Table, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs that join all rows of a cell between which candidates lead."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, k in zip(start.tolist(), size.tolist(), strict=True):
        apart, comp, n = _cell_columns(t, s, k)
        near = _candidates(_rows_of(t.column("sketch").slice(s, k).to_pylist()), n, comp, apart, np.arange(k))
        waiting = near.any(axis=1)
        while waiting.any():
            front = np.flatnonzero(waiting)[:1]
            waiting[front] = False
            while len(front):
                reached = np.flatnonzero(near[front].any(axis=0) & waiting)
                left.append(front[near[np.ix_(front, reached)].argmax(axis=0)] + s)
                right.append(reached + s)
                waiting[reached] = False
                front = reached
    return np.concatenate(left), np.concatenate(right)


def _cell_links(t: pa.Table, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs that link on their whole sets and join all components of a cell between which links lead."""
    left, right = [], []
    for s, k in zip(start.tolist(), size.tolist(), strict=True):
        apart, comp, n = _cell_columns(t, s, k)
        comp = comp.copy()
        sketch = _rows_of(t.column("sketch").slice(s, k).to_pylist())
        _, shingle = np.unique(np.frombuffer(b"".join(t.column("s").slice(s, k).to_pylist()), np.uint64), return_inverse=True)
        first = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
        label, count = np.unique(comp, return_counts=True)
        mark = np.zeros(int(shingle.max()) + 1, bool)
        for x in np.flatnonzero(comp != label[count.argmax()]).tolist():
            y = np.flatnonzero(_candidates(sketch, n, comp, apart, np.array([x]))[0])
            if not len(y):
                continue
            own = shingle[first[x] : first[x + 1]]
            mark[own] = True
            at = np.repeat(first[y] - np.concatenate((np.zeros(1, np.int64), np.cumsum(n[y])[:-1])), n[y]) + np.arange(int(n[y].sum()))
            both = np.bincount(np.repeat(np.arange(len(y)), n[y])[mark[shingle[at]]], minlength=len(y))
            mark[own] = False
            for z in y[enough(both, n[x], n[y])].tolist():
                if comp[z] != comp[x]:
                    left.append(x + s)
                    right.append(z + s)
                    comp[comp == comp[z]] = comp[x]
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def _cells(rows: DataFrame, tables: Tables, least: int = 2) -> DataFrame:
    """Rows key, doc_id, comp, n, leads of the keys that hold several components, dealt to cells (key, band, i, j)."""
    mixed = rows.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("m"), F.sum("n").alias("w")).filter(f"a < b and m >= {least}")
    mixed = tables.put(mixed.select("key", ((F.col("m") > CELL) | (F.col("w") > SHINGLES)).alias("hot")), "mixed")
    band = F.floor(F.log("n") / F.log(F.lit(DEN / NUM))).cast("int")
    kinds = F.when(F.col("hot"), F.array(F.struct(band.alias("band"), F.lit(False).alias("guest")), F.struct((band + 1).alias("band"), F.lit(True).alias("guest"))))
    kinds = kinds.otherwise(F.array(F.struct(F.lit(-1).alias("band"), F.lit(False).alias("guest"))))
    spread = rows.join(mixed, "key").select("key", "doc_id", "comp", "leads", "n", F.explode(kinds).alias("k")).select("*", "k.band", "k.guest").drop("k")
    spread = tables.put(spread, "spread")
    cells = spread.groupBy("key", "band").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.min("guest").alias("guests"), F.count("*").alias("m"), F.sum("n").alias("w")).filter("a < b and not guests")
    parts = F.greatest(F.ceil(F.col("m") / CELL), F.ceil(F.col("w") / SHINGLES)).cast("int")
    cells = tables.put(cells.select("key", "band", parts.alias("parts")), "spread-cells")
    dealt = spread.join(cells, ["key", "band"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select("key", "band", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "part", "guest", "leads", "doc_id", "comp", "n")


_CELL_KEYS = ["key", "band", "i", "j"]


def _met(cells: DataFrame, what) -> DataFrame:
    """Pairs of components (a, b) that ``what`` finds in the cells."""
    own = cells.withColumn("doc_id", F.col("comp")).drop("comp").repartition(*_CELL_KEYS).sortWithinPartitions(*_CELL_KEYS, "doc_id")
    return own.mapInArrow(lambda b: _by_cell(b, _CELL_KEYS, what), "a long, b long").filter("a < b").distinct()


def _class_labels(src: DataFrame, described: DataFrame, copies: DataFrame, tables: Tables) -> DataFrame:
    """(rep, label): the component of each class that links with another."""
    own = join_ids(described.filter("n > 0 and doc_id is not null"), copies, ["doc_id", "n", "d1", "d2"], "left_anti").dropDuplicates(["doc_id"])
    own = tables.put(own.select("doc_id", "n", "sketch", "keys"), "representatives")
    postings = own.select("doc_id", F.explode("keys").alias("key"))
    order = F.struct(F.xxhash64("doc_id", F.pmod("key", F.lit(LEADERS))).alias("o"), "doc_id")
    cells = postings.groupBy("key").agg(F.min(order).alias("leader"), F.count("*").alias("m")).filter("m > 1")
    rows = tables.put(postings.join(cells.select("key", "leader.doc_id", "m").toDF("key", "leader", "m"), "key"), "bucket-rows")

    sized = own.select("doc_id", "n", "sketch")
    pairs = rows.filter("doc_id <> leader").select(F.least("doc_id", "leader").alias("x"), F.greatest("doc_id", "leader").alias("y")).distinct()
    both = pairs.join(sized.toDF("x", "nx", "kx"), "x").join(sized.toDF("y", "ny", "ky"), "y")
    links = _confirmed(src, tables.put(both.mapInArrow(_judged, "x long, y long"), "led"), tables).toDF("a", "b")
    label = connected_components(links, tables)

    known = join_ids(own.select("doc_id", "n"), label.toDF("doc_id", "label"), ["doc_id"], "left").select("doc_id", "n", F.coalesce("label", "doc_id").alias("comp"))
    known = tables.put(known, "known")
    many = rows.filter("m > 2").select("key", "doc_id", (F.col("doc_id") == F.col("leader")).alias("leads")).join(known, "doc_id")
    forest = tables.put(_met(_cells(many, tables, 3).join(sized.select("doc_id", "sketch"), "doc_id"), _forests), "forest")
    cluster = connected_components(forest, tables)

    clustered = tables.put(known.join(cluster.toDF("comp", "key"), "comp").select("key", "doc_id", "comp", "n", F.lit(False).alias("leads")), "clustered")
    sets = join_ids(src, clustered.select("doc_id"), ["doc_id"], "left_semi").dropDuplicates(["doc_id"]).mapInArrow(partial(_sets, width=WIDTH), "doc_id long, s binary")
    sets = tables.put(sets, "cluster-sets")
    more = tables.put(_met(_cells(clustered, tables).join(sized.select("doc_id", "sketch"), "doc_id").join(sets, "doc_id"), _cell_links), "more")
    return connected_components(links.unionByName(more), tables)


def near_duplicates(docs: DataFrame, **columns: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    spark = docs.sparkSession
    ship(spark)
    src = id_and_text(docs, **columns)
    with Tables(spark, "odd-sketches") as tables:
        described = tables.put(src.mapInArrow(_describe, DESCRIBED), "described")
        kinds = ["n", "d1", "d2"]
        classes = tables.put(described.filter("n > 0 and doc_id is not null").groupBy(*kinds).agg(F.min("doc_id").alias("rep")), "classes")
        member = described.select("doc_id", *kinds).join(classes, kinds, "left").select("doc_id", *kinds, F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"))
        member = tables.put(member, "members")
        copies = tables.put(member.filter("rep <> doc_id").select("doc_id", *kinds).distinct(), "copies")
        label = _class_labels(src.filter("doc_id is not null"), described, copies, tables)
        out = member.join(label.toDF("rep", "label"), "rep", "left").withColumn("component_id", F.coalesce("label", "rep"))
        return result(out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept")), "near-duplicates")


def op12_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 1], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b USING (h) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node),
c AS (SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(root) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY d.doc_id, n)
SELECT *, doc_id = component_id AS kept FROM c
"""
