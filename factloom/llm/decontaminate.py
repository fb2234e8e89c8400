"""Benchmark decontamination with training suffix arrays.

Every chunk of about 1 MB of training documents is a shard with a suffix array: its word positions in the order of the
word sequences that begin there and end with their document.  It is sorted by prefix doubling, whole and to any depth.
Every test suffix that starts a window is binary-searched in every shard, suffixes of one window together; the range found
gives all places of the window.  The longest verbatim match of a document with the items that hit it is searched by halves.  A table of the shard's ``LEAD``-word hashes spares the
search of suffixes that cannot stand in it.  Places found are compared with the
test item's words, or by a second hash of them, not by their hashes alone.

A window is ``WINDOW`` consecutive words of an item; an item of fewer words, but not none, is one window.  Nulls and
texts without words hit nothing.  Repeated items with one id count once; repeated documents each get their own row, and
so do rows with a null doc_id.  Texts of any length are searched whole.  Without items nothing is hit, without documents
there are no rows.  Other columns pass through or take no part, whatever their names.

The test set is held in memory in blocks of at most ``BLOCK_BYTES`` of text (a longer item is a block of its own).  With
several blocks the shards are written first, text and suffix array, and each block is one pass over them, written before
the next is collected; the hits are united by row.  The result is the same for any block size.  The longest match is
that of most words, then of the first place, then of the smallest item id.  An item with a null id counts as one more
item; null ids come first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables, id_and_text, result, ship, table
from .textwords import ALNUM_WORDS, Words, byte_hashes, chunks, window_hashes

WINDOW, LEAD = 13, 4
BLOCK_BYTES = 8 << 20
_TABLE = np.uint64(64 - 22)
SHARD = "row array<long>, text array<binary>, suffixes binary"
PARTS = "row long, n_words long, starts array<int>, ends array<int>, items array<string>, longest int, longest_item string, longest_at int"
RESULT = "doc_id long, n_words long, n_hit long, items array<string>, longest int, longest_item string, longest_at int"


def document_ends(w: Words) -> np.ndarray:
    """For each word position where its document ends."""
    return np.repeat(w.first[1:], w.counts())


def suffix_array(w: Words) -> np.ndarray:
    """The word positions of a chunk in the order of their suffixes, by prefix doubling of what is still tied."""
    n, end = len(w), document_ends(w)
    order = np.argsort(w.hash, kind="stable").astype(np.int64)
    rank = np.zeros(n, np.int64)  # the first slot of those not told apart yet, from 1; 0: behind the document
    slots, key, depth, going = np.arange(n), w.hash[order], 1, np.ones(n, bool)
    while True:
        new = np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))
        group = slots[new][np.cumsum(new) - 1]
        rank[order[slots]] = group + 1
        tied = ~(new & np.append(new[1:], True))
        slots = slots[tied & going]  # those tied with nothing more to come are equal
        if not len(slots):
            return order
        own = order[slots]
        going = own + depth < end[own]
        key = rank[own] * (n + 1) + rank[np.minimum(own + depth, n - 1)] * going
        by_key = np.argsort(key, kind="stable")
        order[slots], key, going = own[by_key], key[by_key], going[by_key]
        depth *= 2


class TestSuffixes:
    """The suffixes of test items that start a window: their item, first word and the words of the window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.window = window
        self.text = w = Words([x for _, x in items], ALNUM_WORDS, True)
        self.words, n = w.hash, w.counts()
        self.ids = [k for k, _ in items]
        size = np.minimum(n, window)
        per = np.where(n > 0, n - size + 1, 0)
        self.item = np.repeat(np.arange(len(n)), per)
        self.start = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, a + k) for a, k in zip(w.first[:-1], per, strict=True))]).astype(np.int64)
        self.length = size[self.item]
        self.leads = {}
        for q in np.unique(np.minimum(self.length, LEAD)).tolist():
            own = np.flatnonzero(np.minimum(self.length, LEAD) == q)
            at, h = w.windows(q)
            self.leads[q] = (own, h[np.searchsorted(at, self.start[own])] >> _TABLE)


    def keys(self, own: np.ndarray) -> np.ndarray:
        """The word hashes of some windows, a row each; 0 behind a shorter one."""
        col = np.arange(self.window)
        at = np.minimum(self.start[own][:, None] + col, len(self.words) - 1)
        return np.where(col < self.length[own][:, None], self.words[at], np.uint64(0))

    def item_words(self, item: int) -> np.ndarray:
        return self.words[self.text.first[item] : self.text.first[item + 1]]


def _search(w: Words, end: np.ndarray, suffixes: np.ndarray, keys: np.ndarray, length: np.ndarray, above: bool) -> np.ndarray:
    """For each key the first slot of the suffix array that is not below it (``above``: that is above it)."""
    lo, hi = np.zeros(len(keys), np.int64), np.full(len(keys), len(suffixes), np.int64)
    col = np.arange(keys.shape[1])
    while len(live := np.flatnonzero(lo < hi)):
        mid = (lo[live] + hi[live]) // 2
        place = suffixes[mid]
        at = place[:, None] + col
        row = np.where(at < end[place][:, None], w.hash[np.minimum(at, len(w) - 1)], np.uint64(0))
        key = keys[live]
        differ = (row != key) & (col < length[live, None])
        j = differ.argmax(axis=1)
        own = np.arange(len(live))
        right = np.where(differ[own, j], row[own, j] < key[own, j], above)
        lo[live], hi[live] = np.where(right, mid + 1, lo[live]), np.where(right, hi[live], mid)
    return lo


def matches(w: Words, tests: TestSuffixes, suffixes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(window, word position) of every place in the chunk where a test window stands, and the test suffixes of each window.

    Windows of equal words are one, so a place is found once for each length of windows, however often both sides repeat.
    """
    none = np.zeros(0, np.int64)
    wanted = [none]
    for q, (own, lead) in tests.leads.items():
        there = np.zeros(1 << 22, dtype=bool)
        there[w.windows(q)[1] >> _TABLE] = True
        wanted.append(own[there[lead]])
    wanted = np.sort(np.concatenate(wanted))
    if not len(wanted):
        return none, none, []
    keys = np.column_stack((tests.keys(wanted), tests.length[wanted].astype(np.uint64)))
    keys, first, window, count = np.unique(keys, axis=0, return_index=True, return_inverse=True, return_counts=True)
    of = np.split(wanted[np.argsort(window.ravel(), kind="stable")], np.cumsum(count)[:-1])
    suffixes = suffix_array(w) if suffixes is None else suffixes
    end, length = document_ends(w), tests.length[wanted[first]]
    lo, hi = (_search(w, end, suffixes, keys[:, :-1], length, above) for above in (False, True))
    n = hi - lo
    flat = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    window, place = np.repeat(np.arange(len(n)), n), suffixes[flat]
    return (*_compared(w, tests, wanted[first], window, place), of)


def _compared(w: Words, tests: TestSuffixes, suffix: np.ndarray, window: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose words are those of the window, by the words of the first place of each and by a second hash of the others'."""
    if not len(place):
        return window, place
    length = tests.length[suffix][window]
    ends = np.cumsum(length)
    col = np.arange(int(ends[-1])) - np.repeat(ends - length, length)
    here, there = np.repeat(place, length) + col, np.repeat(tests.start[suffix][window], length) + col
    same = byte_hashes(w.data, w.start[here], w.end[here], 1) == byte_hashes(tests.text.data, tests.text.start[there], tests.text.end[there], 1)
    ok = np.logical_and.reduceat(same, ends - length)
    for k in np.unique(window, return_index=True)[1].tolist():
        p, a, size = int(place[k]), int(tests.start[suffix[window[k]]]), int(length[k])
        ok[k] &= w.text(p, p + size) == tests.text.text(a, a + size)
    return window[ok], place[ok]


def _longest(words: np.ndarray, tests: TestSuffixes, items: list[int]) -> tuple[int, int, int]:
    """(length, item, place) of the longest run of words that a document shares with one of the items that hit it.

    A shared run of some length has shared runs of every smaller one, down to a window, so the length is searched by halves.
    """
    long_, short = ([i for i in items if (len(tests.item_words(i)) >= tests.window) == big] for big in (True, False))

    def shared(size: int, own: list[int]) -> tuple[np.ndarray, np.ndarray]:
        here = window_hashes(words, size)
        return here, np.isin(here, np.concatenate([np.zeros(0, np.uint64), *(window_hashes(tests.item_words(i), size) for i in own)]))

    own, size = long_, tests.window
    if long_:
        most = min(len(words), max(len(tests.item_words(i)) for i in long_))
        while size < most:
            middle = (size + most + 1) // 2
            size, most = (middle, most) if shared(middle, long_)[1].any() else (size, middle - 1)
    else:  # items below a window stand whole or not at all
        size = max(len(tests.item_words(i)) for i in short)
        own = [i for i in short if len(tests.item_words(i)) == size]
    here, hit = shared(size, own)
    place = int(hit.argmax())
    return size, next(i for i in own if (window_hashes(tests.item_words(i), size) == here[place]).any()), place


def scan(texts: list[bytes | None], tests: TestSuffixes, suffixes: np.ndarray | None = None) -> list[tuple]:
    """For each text of a shard: (n_words, starts, ends, item ids, longest, its item, its place)."""
    w = Words(texts, ALNUM_WORDS, True)
    out = [[n, [], [], [], None, None, None] for n in w.counts().tolist()]
    window, place, of = matches(w, tests, suffixes)
    if len(window):
        doc = np.searchsorted(w.first, place, side="right") - 1
        order = np.lexsort((place, doc))
        window, place, doc = window[order], place[order], doc[order]
        cuts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])).tolist() + [len(doc)]
        items_of = [np.unique(tests.item[x]) for x in of]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            row, start = out[doc[a]], int(w.first[doc[a]])
            own = np.unique(window[a:b])
            size = np.array([tests.length[of[k][0]] for k in own.tolist()])
            row[1], row[2] = united(place[a:b] - start, place[a:b] - start + size[np.searchsorted(own, window[a:b])])
            items = np.unique(np.concatenate([items_of[k] for k in own.tolist()])).tolist()
            row[3] = sorted({tests.ids[i] for i in items}, key=lambda x: (x is not None, x or ""))
            size, item, at = _longest(w.hash[w.first[doc[a]] : w.first[doc[a] + 1]], tests, items)
            row[4:] = [size, tests.ids[item], at]
    return out


def united(starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Ranges in the order of their starts as disjoint ones of the same words."""
    reach = np.maximum.accumulate(ends)
    new = np.append(True, starts[1:] > reach[:-1])
    return starts[new].tolist(), reach[np.append(new[1:], True)].tolist()


def is_contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def _test_set(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    return items.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).cast("string").cast("binary").alias("text")).filter("text is not null").distinct()


def block_count(items: DataFrame, block_bytes: int = BLOCK_BYTES, **columns: str) -> int:
    total = _test_set(items, **columns).agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    return max(1, math.ceil(2 * total / block_bytes)) if total > block_bytes else 1


def test_blocks(items: DataFrame, n: int, **columns: str) -> Iterator[list[tuple[str | None, bytes]]]:
    """The test set in ``n`` blocks, each collected when it is asked for; null texts are left out."""
    t = _test_set(items, **columns)
    for k in range(n):
        own = t if n == 1 else t.filter(F.expr(f"pmod(xxhash64(item_id, text), {n}) = {k}"))
        yield [(r.item_id, bytes(r.text)) for r in own.orderBy("item_id", "text").collect()]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in chunks(batches):
        suffixes = suffix_array(Words(texts, ALNUM_WORDS, True)).astype(np.int32).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([part.column("row").to_pylist()], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.binary())), pa.array([suffixes], pa.binary())], ["row", "text", "suffixes"])


def _block_hits(tests: Broadcast, first: bool) -> Callable:
    """Shards -> ``PARTS`` of one test block; rows without hits only if ``first``."""
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, texts, suffixes in zip(*(b.column(c) for c in ("row", "text", "suffixes")), strict=True):
                found = scan(texts.as_py(), tests.value, np.frombuffer(suffixes.as_py(), np.int32).astype(np.int64))
                size, a, e, ids, longest, item, at = (list(x) for x in zip(*found, strict=True))
                out = pa.RecordBatch.from_arrays([pa.array(rows.as_py(), pa.int64()), pa.array(size, pa.int64()), pa.array(a, ints), pa.array(e, ints), pa.array(ids, pa.list_(pa.string())), pa.array(longest, pa.int32()), pa.array(item, pa.string()), pa.array(at, pa.int32())], ["row", "n_words", "starts", "ends", "items", "longest", "longest_item", "longest_at"])
                yield out if first else out.filter(pa.array([bool(x) for x in a], pa.bool_()))

    return run


#: SQL for the number of words that ranges (starts, ends) cover together
_COVERED = """aggregate(array_sort(flatten(collect_list(arrays_zip(starts, ends)))), named_struct('n', 0L, 'to', 0),
    (a, x) -> named_struct('n', a.n + greatest(0, x.ends - greatest(x.starts, a.to)), 'to', greatest(a.to, x.ends)), a -> a.n)"""


def _hits(rows: DataFrame, items: DataFrame, n: int, tables: Tables) -> DataFrame:
    """row, and what ``RESULT`` has after doc_id, by ``n`` passes over the shards of ``rows``: row (unique), text."""
    spark = rows.sparkSession
    shards = tables.put(rows.select("row", "text").mapInArrow(_shards, SHARD), "shards")
    parts = None
    for k, block in enumerate(test_blocks(items, n)):
        tests = spark.sparkContext.broadcast(TestSuffixes(block))
        own = tables.put(shards.mapInArrow(_block_hits(tests, k == 0), PARTS), "hits")
        tests.destroy()
        parts = own if parts is None else parts.unionAll(own)
    best = F.min(F.when(F.col("longest").isNotNull(), F.struct((-F.col("longest")).alias("less"), "longest_at", "longest_item", "longest")))
    merged = parts.groupBy("row").agg(F.max("n_words").alias("n_words"), F.expr(_COVERED).alias("n_hit"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), best.alias("b"))
    return merged.select("row", "n_words", "n_hit", "items", "b.longest", "b.longest_item", "b.longest_at")


def _rows(tests: Broadcast, row: Callable) -> Callable:
    """Chunks of documents -> what ``row`` makes of a chunk and of what one test block finds in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            yield row(part, scan(texts, tests.value))

    return run


def find_contamination(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES, **columns: str) -> DataFrame:
    """One row per row of ``docs``: n_words, n_hit, the item ids whose windows occur, and the longest verbatim match (words, item, place)."""
    spark = docs.sparkSession
    ship(spark)
    src = id_and_text(docs, **columns)
    n_blocks = block_count(items, block_bytes)
    if n_blocks == 1:
        def whole(part: pa.RecordBatch, found: list) -> pa.RecordBatch:
            n, a, b, ids, size, item, at = (list(x) for x in zip(*found, strict=True))
            hit = [sum(e) - sum(s) for s, e in zip(a, b, strict=True)]
            return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(size, pa.int32()), pa.array(item, pa.string()), pa.array(at, pa.int32())], ["doc_id", "n_words", "n_hit", "items", "longest", "longest_item", "longest_at"])

        tests = spark.sparkContext.broadcast(TestSuffixes(next(test_blocks(items, 1))))
        return src.mapInArrow(_rows(tests, whole), RESULT)

    with Tables(spark, "contamination") as tables:
        rows = tables.put(src.withColumn("row", F.monotonically_increasing_id()), "rows")
        return result(rows.select("row", "doc_id").join(_hits(rows, items, n_blocks, tables), "row").drop("row"), "contamination")


def remove_contaminated(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without its contaminated rows, all columns unchanged."""
    spark = docs.sparkSession
    ship(spark)
    n_blocks = block_count(items, block_bytes)
    if n_blocks > 1:
        with Tables(spark, "contamination") as tables:
            row = "row" + "_" * max(map(len, docs.columns))  # the name of no column
            rows = tables.put(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
            found = _hits(id_and_text(rows, doc_id=row).withColumnRenamed("doc_id", "row"), items, n_blocks, tables)
            bad = found.filter("n_hit > 0 and 20 * n_hit >= n_words").select(F.col("row").alias(row))
            return result(rows.join(bad, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]), "decontaminated")

    def keep(part: pa.RecordBatch, found: list) -> pa.RecordBatch:
        return part.filter(pa.array([not is_contaminated(sum(b) - sum(a), n) for n, a, b, *_ in found], pa.bool_()))

    tests = spark.sparkContext.broadcast(TestSuffixes(next(test_blocks(items, 1))))
    return docs.mapInArrow(_rows(tests, keep), docs.schema)


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), F.expr("n_hit > 0 and 20 * n_hit >= n_words").alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT DISTINCT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
