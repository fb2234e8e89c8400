"""Substring deduplication with a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words of one document.  Of each window the fingerprint is its smallest ``GRAM``-word
hash, so equal windows have equal fingerprints and neighbouring windows mostly share one: a document has about one
fingerprint in 22 words.

The index holds immutable runs, bucketed and sorted by fingerprint, with one row for each fingerprint: the batches it occurs
in.  A new batch is written as one more run; when there are more than ``FANOUT`` runs the two smallest are merged.  Lookup
and merging are merge joins of buckets, without an exchange.  Beside the runs stands a log of each batch: its postings
(fingerprint, doc_id) and its texts, which are read only of batches that share a fingerprint with the new one.

Adding a batch merge-joins its run with the historical runs.  Where a fingerprint is shared, in history or inside the batch,
the windows around it are taken from the texts again and compared by 128-bit BLAKE2 digests of their words; the first
document of each window, by (batch, doc_id), owns it, and every other document of the batch loses the words that the
window covers.  Whole copies of an earlier document are found first, in runs of SHA-256 digests of their words: they lose
everything, and add nothing to the index.

An index in a folder of its own can be opened again: every batch ends with a new manifest, and one without a finished
manifest is not part of it.  Batches, buckets and run sizes don't change results, only the order of batches does.

All steps are joins and grouped minima with partial aggregation; no group is ever gathered, however many copies it has.
Null and empty texts have no words; documents below ``WINDOW`` words lose none; windows repeated inside one document
only are kept; rows that repeat a doc_id do not remove each other's words.  A null doc_id comes before all others and is in
the first batch.  An empty table gives no rows; other columns, whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Tables, id_and_text, join_ids, join_same, result, ship, table, writing
from .textwords import SPACE_WORDS, Words, chunks, window_hashes

WINDOW, GRAM, FANOUT, BATCHES = 50, 8, 2, 3


def fingerprints(w: Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start word of each window of a chunk, word place of its fingerprint, fingerprint hash)."""
    gram = window_hashes(w.hash, GRAM)
    wide = window - GRAM + 1
    at = np.arange(max(0, len(w) - window + 1))
    last = np.repeat(w.first[1:], w.counts())[: len(at)]
    at = at[at + window <= last]
    if not len(at):
        return at, at, gram[:0]
    least = np.empty(len(at), dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(gram, wide)
    for a in range(0, len(at), 1 << 15):
        least[a : a + (1 << 15)] = view[at[a : a + (1 << 15)]].argmin(axis=1)
    place = at + least
    return at, place, gram[place]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in chunks(batches):
        w = Words(texts, SPACE_WORDS, False)
        _, place, h = fingerprints(w)
        doc = np.searchsorted(w.first, place, side="right") - 1
        order = np.lexsort((h, doc))  # each fingerprint once a document
        doc, h = doc[order], h[order]
        new = np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
        doc, h = doc[new], h[new]
        offsets = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)), pa.int32())
        digest = [hashlib.sha256(b" ".join((x or b"").split())).digest() for x in texts]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(w.counts()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64)))],
            ["doc_id", "n_words", "digest", "hashes"],
        )


DESCRIBED = "doc_id long, n_words long, digest binary, hashes array<long>"


def _candidates(w: Words, shared: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(start, two numbers of a digest) of the windows of one document whose fingerprint is one of ``shared``."""
    at, _, h = fingerprints(w)
    at = at[np.isin(h, np.array(shared, dtype=np.int64).view(np.uint64))]
    words = w.text(0, len(w))
    whole = b" ".join(words)
    start = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.fromiter((len(x) + 1 for x in words), np.int64, len(words)))))
    digest = b"".join(hashlib.blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(start[at].tolist(), (start[at + WINDOW] - 1).tolist(), strict=True))
    return at, np.frombuffer(digest, np.int64).reshape(-1, 2)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in chunks(batches):
        both, row = [], []
        for i, (text, shared) in enumerate(zip(texts, part.column("shared").to_pylist(), strict=True)):
            _, d = _candidates(Words([text], SPACE_WORDS, False), shared)
            _, one = np.unique(d[:, 0], return_index=True)
            both.append(d[one])
            row.append(np.full(len(one), i))
        at, d = pa.array(np.concatenate(row)), np.concatenate(both)
        yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), part.column("batch").take(at), part.column("doc_id").take(at)], ["w1", "w2", "batch", "doc_id"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in chunks(batches):
        digest, n, kept = [], [], []
        for text, shared, owned in zip(texts, part.column("shared").to_pylist(), part.column("owned").to_pylist(), strict=True):
            w = Words([text], SPACE_WORDS, False)
            at, d = _candidates(w, shared)
            at = at[~np.isin(d[:, 0], np.array(owned or [], dtype=np.int64))]
            edge = np.zeros(len(w) + 1, dtype=np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            gone = np.cumsum(edge)[:-1] > 0
            words = w.text(0, len(w))
            digest.append(hashlib.sha256(b" ".join(words)).digest())
            n.append(int(gone.sum()))
            kept.append(b" ".join([x for x, out in zip(words, gone.tolist(), strict=True) if not out]).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "digest", "n_removed", "kept"])


class Runs:
    """Immutable runs of one kind of key, in ``buckets`` buckets by h and sorted in each; one row for each h (and payload)."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, buckets: int, paths: list[str]) -> None:
        self.spark, self.folder, self.schema, self.buckets = spark, folder, schema, buckets
        self.names: dict[str, str] = {}
        self.paths = list(paths)
        for p in paths:
            self.names[p] = self._name()
            spark.sql(f"CREATE TABLE {self.names[p]} ({schema}) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {buckets} BUCKETS LOCATION '{p}'")

    @staticmethod
    def _name() -> str:
        return f"factloom_run_{uuid.uuid4().hex}"

    def write(self, rows: DataFrame) -> str:
        """``rows`` as a run that is looked up only once it is among ``paths``. Rows of a bucket must stand in one partition."""
        name = self._name()
        path = f"{self.folder}/{name}"
        with writing(self.spark):
            rows.write.bucketBy(self.buckets, "h").sortBy("h").option("path", path).saveAsTable(name)
        self.names[path] = name
        return path

    def read(self, path: str) -> DataFrame:
        return self.spark.table(self.names[path])

    def forget(self) -> None:
        """Takes the names out of the session; the files stay."""
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


class FingerprintIndex:
    """Runs and logs of the batches added so far, in ``folder``; opened again if there is an index already."""

    FINGERPRINTS = "h BIGINT, many BOOLEAN, batches ARRAY<INT>"
    DIGESTS = "h BIGINT, digest BINARY, many BOOLEAN, first STRUCT<batch: INT, doc_id: BIGINT>"

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None, fanout: int = FANOUT) -> None:
        ship(spark)
        self.spark, self.folder, self.fanout = spark, folder.rstrip("/"), fanout
        self.log = {"merges": 0}
        state = self._manifest()
        self.batch = state.get("batch", 0)
        buckets = state.get("buckets") or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.fingerprints = Runs(spark, self.folder, self.FINGERPRINTS, buckets, state.get("fingerprints", []))
        self.digests = Runs(spark, self.folder, self.DIGESTS, buckets, state.get("digests", []))
        self.sizes: dict[str, int] = state.get("sizes", {})  # of each run, in batches

    def _files(self, path: str) -> tuple:
        """Hadoop's path and file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest(self) -> dict:
        """The newest manifest."""
        path, files = self._files("manifest-*.json")
        names = {int(x.getPath().getName()[9:-5]): x.getPath().toString() for x in files.globStatus(path) or []}
        return json.loads(self.spark.read.text(names[max(names)], wholetext=True).first()[0]) if names else {}

    def _commit(self) -> None:
        """Makes the batch part of the index: a manifest that is moved into place whole."""
        state = {"batch": self.batch, "buckets": self.fingerprints.buckets, "fingerprints": self.fingerprints.paths, "digests": self.digests.paths, "sizes": self.sizes}
        under_way, files = self._files(f"new-{uuid.uuid4().hex}.json")
        out = files.create(under_way)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        files.rename(under_way, self._files(f"manifest-{self.batch}.json")[0])

    def _logged(self, kind: str, batch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{kind}-{batch}").withColumn("batch", F.lit(batch))

    def _new_run(self, runs: Runs, keys: DataFrame) -> str:
        """``keys`` (grouped by h) as a run; the exchange of the grouping is the one that deals them to buckets."""
        path = runs.write(keys.repartition(runs.buckets, "h"))
        self.sizes[path] = 1
        return path

    def _merge(self, runs: Runs, combine: dict[str, Column]) -> None:
        """The two smallest runs become one, by a merge join of their buckets, until there are ``fanout``."""
        while len(runs.paths) > self.fanout:
            one, two = sorted(runs.paths, key=lambda p: self.sizes[p])[:2]
            a, b = runs.read(one).alias("a"), runs.read(two).alias("b")
            both = a.join(b, F.col("a.h") == F.col("b.h"), "full").select(F.coalesce("a.h", "b.h").alias("h"), *[x.alias(c) for c, x in combine.items()])
            path = runs.write(both)
            self.sizes[path] = self.sizes[one] + self.sizes[two]
            runs.paths = [p for p in runs.paths if p not in (one, two)] + [path]
            self.log["merges"] += 1

    def add(self, docs: DataFrame, tables: Tables) -> DataFrame:
        """Indexes ``docs`` (doc_id, text) and returns, per row: doc_id, n_words, n_removed, kept (null: the text's words as they are), digest (of all its words)."""
        now = F.lit(self.batch + 1)
        src = docs.select("doc_id", "text")
        described = tables.put(src.mapInArrow(_describe, DESCRIBED), "described")
        log = f"{self.folder}/{{}}-{self.batch + 1}"

        # whole copies, by merge joins of digests
        first = F.min(F.struct(now.alias("batch"), "doc_id")).alias("first")
        own = described.filter(F.col("n_words") >= WINDOW).groupBy("digest").agg(first, (F.count("*") > 1).alias("many"))
        run = self._new_run(self.digests, own.select(F.xxhash64("digest").alias("h"), "digest", "many", "first"))
        seen = self.digests.read(run)
        for k, path in enumerate(self.digests.paths):
            old = self.digests.read(path).select("h", F.col("digest").alias(f"d{k}"), F.col("first").alias(f"f{k}"))
            seen = seen.join(old, "h", "left")
        known = [F.when(F.col(f"d{k}") == F.col("digest"), F.col(f"f{k}")) for k in range(len(self.digests.paths))]
        owner = F.coalesce(*known, F.col("first"))
        repeated = tables.put(seen.filter(F.col("many") | (owner < F.col("first"))).groupBy("digest").agg(F.min(owner).alias("owner")), "repeated")
        copy = F.coalesce(F.col("owner") < F.struct(now.alias("batch"), F.col("doc_id")), F.lit(False))
        marked = tables.put(join_ids(described, repeated, ["digest"], "left").withColumn("copy", copy).drop("owner"), "marked")
        tables.drop(described, repeated)

        # this batch's run and log
        with writing(self.spark):
            marked.filter("not copy").select(F.explode("hashes").alias("h"), "doc_id").write.mode("overwrite").parquet(log.format("postings"))
            src.filter(F.octet_length("text") >= 2 * WINDOW - 1).write.mode("overwrite").parquet(log.format("texts"))
        postings = self._logged("postings", self.batch + 1)
        keys = postings.groupBy("h").agg((F.count("*") > 1).alias("many"))
        fresh = self._new_run(self.fingerprints, keys.select("h", "many", F.array(now).alias("batches")))

        # merge join with history
        seen = self.fingerprints.read(fresh)
        for k, path in enumerate(self.fingerprints.paths):
            seen = seen.join(self.fingerprints.read(path).select("h", F.col("batches").alias(f"b{k}")), "h", "left")
        past = [F.coalesce(f"b{k}", F.array().cast("array<int>")) for k in range(len(self.fingerprints.paths))]
        batches = F.concat("batches", *past).alias("batches")
        shared = tables.put(seen.select("h", "many", batches).filter("many or size(batches) > 1").select("h", F.explode("batches").alias("batch")), "shared-hashes")
        hit = sorted(r.batch for r in shared.select("batch").distinct().collect())  # one number a batch

        self.batch += 1
        found = self._found(shared, hit, tables)
        who = F.struct("batch", "doc_id")
        owners = found.mapInArrow(_windows, "w1 long, w2 long, batch int, doc_id long").groupBy("w1", "w2").agg(F.min(who).alias("o"))
        owned = owners.filter(F.col("o.batch") == now).groupBy(F.col("o.doc_id").alias("doc_id")).agg(F.collect_list("w1").alias("owned"))
        changed = join_same(found.filter(F.col("batch") == now), owned, ["doc_id"], "left").mapInArrow(_removed, "doc_id long, digest binary, n_removed long, kept string")
        changed = tables.put(changed.filter("n_removed > 0").dropDuplicates(["doc_id", "digest"]), "changed")
        copied = F.struct(F.col("n_words").alias("n_removed"), F.lit("").alias("kept"))
        cut = F.struct(F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.col("kept"))
        done = join_same(marked.drop("hashes"), changed, ["doc_id", "digest"], "left").withColumn("r", F.when(F.col("copy"), copied).otherwise(cut))
        out = tables.put(done.select("doc_id", "n_words", "r.n_removed", "r.kept", "digest"), "deduplicated")
        tables.drop(marked, shared, changed, *([found] if hit else []))

        self.fingerprints.paths.append(fresh)
        self.digests.paths.append(run)
        either = [F.coalesce(f"{x}.batches", F.array().cast("array<int>")) for x in "ab"]
        self._merge(self.fingerprints, {"many": F.lit(True), "batches": F.concat(*either)})
        self._merge(self.digests, {"digest": F.coalesce("a.digest", "b.digest"), "many": F.lit(True), "first": F.coalesce(F.least("a.first", "b.first"), "a.first", "b.first")})
        self._commit()
        return out

    def _found(self, shared: DataFrame, hit: list[int], tables: Tables) -> DataFrame:
        """batch, doc_id, text, shared: the documents that hold fingerprints in ``shared`` (h, batch), with these."""
        if not hit:
            return self.spark.createDataFrame([], "batch int, doc_id long, text binary, shared array<long>")
        postings, texts = self._logged("postings", hit[0]), self._logged("texts", hit[0])
        for b in hit[1:]:
            postings, texts = postings.unionByName(self._logged("postings", b)), texts.unionByName(self._logged("texts", b))
        by_doc = postings.join(shared, ["h", "batch"]).groupBy("doc_id", "batch").agg(F.collect_set("h").alias("shared"))
        return tables.put(join_same(texts, by_doc, ["doc_id", "batch"]).select("batch", "doc_id", "text", "shared"), "found")


def dedup_substrings(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, **columns: str) -> DataFrame:
    """``docs`` added to an empty index in ``batches`` ranges of rising doc_id; the rows of ``FingerprintIndex.add``."""
    src = id_and_text(docs, **columns)
    with Tables(docs.sparkSession, "substring-dedup") as tables:
        index = FingerprintIndex(docs.sparkSession, f"{tables.folder}/index", fanout=fanout)
        cuts = src.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
        bounds = [None, *sorted({int(x) for x in cuts}), None]
        out = None
        for low, high in zip(bounds, bounds[1:], strict=False):
            own = src
            if low is not None:
                own = own.filter(F.col("doc_id") >= low)
            if high is not None:
                below = F.col("doc_id") < high
                own = own.filter(below | F.col("doc_id").isNull() if low is None else below)
            rows = index.add(own, tables)
            out = rows if out is None else out.unionByName(rows)
        index.fingerprints.forget()
        index.digests.forget()
        return result(out, "deduplicated")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    rows = dedup_substrings(table(spark, sf_dir, "documents"))
    kept = F.when(F.col("kept").isNull(), F.lower(F.hex("digest"))).otherwise(F.sha2(F.col("kept").cast("binary"), 256))
    return rows.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
own AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN own USING (h) WHERE doc_id > first),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) k
         WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = k.doc_id AND g.p = k.p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
