"""Best-fit packing of token pieces by a grouping genetic algorithm on islands.

Documents are tokenised and closed by id 0; those longer than ``CAPACITY`` ids are cut into full pieces and a rest.  Full
pieces are sequences of their own.  The others are dealt by size into blocks of about ``BLOCK`` pieces, each of which gets
its even share of every size, so the work and memory of a block stay the same however many blocks there are.  ``ISLANDS`` islands evolve packings of each block, from best-fit
packings of its pieces, largest first and in random orders.  Genes are whole bins: crossover injects a choice of the other
parent's well-filled bins, drops the bins that hold one of the same pieces, and best-fits the displaced pieces, largest
first; mutation dissolves the emptiest bins in the same way.  After each epoch every island's elite migrates to all islands of its block.  An island stops early
at the lower bound, or when its best has not changed for ``STALE`` generations.  The badly filled bins of all blocks then meet once more in new blocks, as whole bins; the result
replaces them only where it needs fewer.

Null and empty texts are the single id 0.  Repeated rows are packed each on its own; a null doc_id stays null.  Pieces of
one length are interchangeable, and ties between packings go to the one found first.  An empty table gives no rows; other
columns, whatever their names, take no part.  Ids are those of the tokenizer for the whole text: it drops white space and
never joins across it, so ids are kept per white-space-separated word, by 128 bits of it, in a bounded cache of flat arrays.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables, id_and_text, result, ship, table
from .textwords import SPACE_WORDS, Words, byte_hashes, chunks

CAPACITY, BLOCK, ISLANDS, EPOCHS, GENERATIONS, POPULATION, MUTATION, STALE = 2048, 4096, 2, 2, 60, 4, 0.1, 20
#: words whose ids a worker keeps; at this many, or eight times as many ids, it starts afresh.
CACHE = 1 << 20
#: new words that are encoded as one text
JOINED = 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


class WordIds:
    """Token ids of words, kept by two hashes of 64 bits in arrays: some 50 bytes a word, where a dict of the words takes 160."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocab.values(), default=0) + 1, bool)  # ids that end a run of letters or of marks
        self.final[[i for x, i in vocab.items() if x.endswith("</w>")]] = True
        self.joins = all(f"{x}</w>" in vocab for x in ByteLevel.alphabet())  # so every run has such an id at its end
        self._clear()

    def _clear(self) -> None:
        self.keys, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # first hashes in order, and the row of each
        self.check, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)  # of each row
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of the words in another order, all their ids in it, and how many each has.

        Words of letters are one run, and two with marks behind them.  They are encoded many at a time and cut where their
        runs end; where a text has more runs than its words should have, the words are encoded one by one.
        """
        texts = [x.decode("utf-8", "replace") for x in words]
        runs = np.fromiter((1 if x.isalpha() else 2 * x.rstrip(".,;:!?").isalpha() for x in texts), np.int64, len(texts)) * self.joins
        order, flat, size = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        alone = [np.flatnonzero(runs == 0)]
        for k in (1, 2):
            own = np.flatnonzero(runs == k)
            groups = np.split(own, range(JOINED, len(own), JOINED)) if len(own) else []
            for g, x in zip(groups, self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in g.tolist()]) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(x.ids, dtype=np.uint32)
                ends = np.flatnonzero(self.final[ids]) + 1
                if len(ends) == k * len(g) and ends[-1] == len(ids):
                    order.append(g)
                    flat.append(ids)
                    size.append(np.diff(ends[k - 1 :: k], prepend=0))
                else:
                    alone.append(g)
        order.append(np.concatenate(alone))
        found = [x.ids for x in self.tokenizer.encode_batch_fast([texts[i] for i in order[-1].tolist()], add_special_tokens=False)]
        size.append(np.fromiter(map(len, found), np.int64, len(found)))
        flat.append(np.array([i for x in found for i in x], dtype=np.uint32))
        return np.concatenate(order), np.concatenate(flat), np.concatenate(size)

    def _add(self, keys: np.ndarray, check: np.ndarray, words: list[bytes]) -> None:
        """Encodes and keeps words; ``keys``, their first hashes, ascend and are new."""
        order, flat, size = self._encoded(words)
        row = np.empty(len(words), np.int32)
        row[order] = np.arange(len(self.at), len(self.at) + len(words))
        place = np.searchsorted(self.keys, keys)
        self.keys, self.row = np.insert(self.keys, place, keys), np.insert(self.row, place, row)
        self.check = np.concatenate((self.check, check[order]))
        self.at = np.concatenate((self.at, self._pooled(flat) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size.astype(np.int32)))

    def _pooled(self, flat: np.ndarray) -> int:
        """Where ``flat`` has been put in the pool."""
        if self.used + len(flat) > len(self.pool):
            pool = np.empty(max(2 * len(self.pool), self.used + len(flat)), np.uint32)  # pages beyond ``used`` stay untouched
            pool[: self.used] = self.pool[: self.used]
            self.pool = pool
        at, self.used = self.used, self.used + len(flat)
        self.pool[at : self.used] = flat
        return at

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in order, and how many each word has."""
        end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        data, start = b"".join(words), np.concatenate((np.zeros(1, np.int64), end))[:-1]
        return self.slices(data, start, end, byte_hashes(data, start, end))

    def slices(self, data: bytes, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``ids`` of the slices data[start:end], whose first hashes are ``first``."""
        if len(self.keys) > CACHE or self.used > 8 * CACHE:
            self._clear()
        second = byte_hashes(data, start, end, 1)
        keys, one, which = np.unique(first, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = self.keys[place] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            own = one[new]
            self._add(keys[new], second[own], [data[a:b] for a, b in zip(start[own].tolist(), end[own].tolist(), strict=True)])
        row = self.row[np.searchsorted(self.keys, keys)][which]
        at, size = self.at[row], self.size[row].astype(np.int64)
        other = np.flatnonzero(self.check[row] != second)  # words whose first hash is another word's
        if len(other):
            order, flat, n = self._encoded([data[a:b] for a, b in zip(start[other].tolist(), end[other].tolist(), strict=True)])
            at[other[order]], size[other[order]] = self._pooled(flat) + np.cumsum(n) - n, n
        return self.pool[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))], size


_WORD_IDS: dict[str, WordIds] = {}


def document_ids(texts: list[bytes | None], path: str) -> list[np.ndarray]:
    """The ids of each text, closed by 0."""
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    words = Words(texts, SPACE_WORDS, False)
    ids, size = _WORD_IDS[path].slices(words.data, words.start, words.end, words.hash)
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))[words.first]
    zero = np.zeros(1, np.uint32)
    return [np.concatenate((ids[a:b], zero)) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 (and the ids, if wanted)."""
    ship(docs.sparkSession)
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            doc, piece, start, length, crc, own = [], [], [], [], [], []
            for d, ids in zip(part.column("doc_id").to_pylist(), document_ids(texts, path), strict=True):
                for k, a in enumerate(range(0, len(ids), capacity)):
                    cut = ids[a : a + capacity]
                    doc.append(d)
                    piece.append(k)
                    start.append(a)
                    length.append(len(cut))
                    crc.append(zlib.crc32(cut.astype("<u4").tobytes()))
                    own.append(cut.astype(np.int32))
            cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                offsets = pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32())
                cols.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(own) if own else np.zeros(0, np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return id_and_text(docs).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


class Bins:
    """Bins under way, found by the space they have left."""

    def __init__(self, capacity: int, fill: list[int]) -> None:
        self.capacity, self.count = capacity, len(fill)
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0  # bit s: some bin has s left
        for b, f in enumerate(fill):
            self.by_space[capacity - f].append(b)
            self.mask |= 1 << (capacity - f)

    def best_fit(self, size: int) -> int:
        fits = self.mask >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            b = self.by_space[space].pop()
            if not self.by_space[space]:
                self.mask &= ~(1 << space)
        else:
            space, b = self.capacity, self.count
            self.count += 1
        self.by_space[space - size].append(b)
        self.mask |= 1 << (space - size)
        return b


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int, assign: np.ndarray, fill: list[int]) -> np.ndarray:
    """Puts the pieces of ``order``, in that order, into the bins of ``fill`` or new ones; the others keep their bins."""
    bins = Bins(capacity, fill)
    put = [bins.best_fit(s) for s in sizes[order].tolist()]
    out = assign.copy()
    out[order] = put
    return out


def _fitness(sizes: np.ndarray, assign: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    fill = np.bincount(assign, sizes) / capacity
    return len(fill), -float((fill**2).sum())


def _rebuilt(sizes: np.ndarray, assign: np.ndarray, lose: np.ndarray, capacity: int, extra: list[np.ndarray]) -> np.ndarray:
    """``assign`` without the bins ``lose`` (a mask), with the bins ``extra`` injected whole; displaced pieces are best-fitted."""
    free = lose[assign]
    number = np.cumsum(~lose) - 1
    out = np.where(free, -1, number[assign])
    n = int((~lose).sum())
    for k, items in enumerate(extra):
        out[items] = n + k
    n += len(extra)
    fill = np.bincount(out[out >= 0], sizes[out >= 0], n).astype(np.int64).tolist() if n else []
    left = np.flatnonzero(out < 0)
    return best_fit(sizes, left[np.argsort(-sizes[left], kind="stable")], capacity, out, fill)


def crossover(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """``a`` with a choice of the well-filled bins of ``b`` injected whole; bins of ``a`` that hold one of their pieces go."""
    fill = np.bincount(b, sizes)
    well = np.flatnonzero(fill >= np.median(fill))
    pick = rng.choice(well, int(rng.integers(1, max(2, len(well) // 2 + 1))), replace=False)
    chosen = np.zeros(len(fill), bool)
    chosen[pick] = True
    items = np.flatnonzero(chosen[b])
    items = items[np.argsort(b[items], kind="stable")]
    groups = np.split(items, np.flatnonzero(np.diff(b[items])) + 1)
    lose = np.zeros(int(a.max()) + 1, bool)
    lose[a[items]] = True
    return _rebuilt(sizes, a, lose, capacity, groups)


def mutate(sizes: np.ndarray, a: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """``a`` with its emptiest bins, and a few others, dissolved."""
    fill = np.bincount(a, sizes)
    lose = np.zeros(len(fill), bool)
    share = int(len(fill) * MUTATION)
    lose[np.argsort(fill, kind="stable")[: max(2, share)]] = True
    lose[rng.choice(len(fill), max(1, share), replace=False)] = True
    return _rebuilt(sizes, a, lose, capacity, [])


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    return max(-(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum()))


def evolve(sizes: np.ndarray, elites: list[np.ndarray], seed: int | list[int], capacity: int = CAPACITY, generations: int = GENERATIONS, population: int = POPULATION, log: dict | None = None) -> np.ndarray:
    """The best packing (a bin for each piece) that one island finds from the elites it has been sent.

    Beside its elites an island starts from best-fit packings of the pieces, largest first and in random orders.  ``log`` counts what happens:
    crossovers, those whose child needed fewer bins than both parents, and the bins of the first and last best.
    """
    rng = np.random.default_rng(seed)
    none = np.full(len(sizes), -1)
    pop = list(elites)
    pop.append(best_fit(sizes, np.argsort(-sizes, kind="stable"), capacity, none, []))
    while len(pop) < population:
        pop.append(best_fit(sizes, rng.permutation(len(sizes)), capacity, none, []))
    least = lower_bound(sizes, capacity)
    pop = sorted(((*_fitness(sizes, x, capacity), k, x) for k, x in enumerate(pop)), key=lambda x: x[:3])
    log = {} if log is None else log
    log |= {"crossovers": 0, "fewer": 0, "first": pop[0][0]}
    born, stale = len(pop), 0
    for _ in range(generations):
        if pop[0][0] <= least or stale == STALE:
            break
        best = pop[0][:2]
        i, j = sorted(rng.choice(len(pop), 2, replace=False).tolist())
        child = crossover(sizes, pop[i][3], pop[j][3], capacity, rng)
        other = mutate(sizes, child, capacity, rng)
        log["crossovers"] += 1
        log["fewer"] += len(np.unique(child)) < pop[i][0]
        for x in (child, other):
            born += 1
            fit = _fitness(sizes, x, capacity)
            if all(fit != y[:2] for y in pop):  # twins would take the place of other parents
                pop.append((*fit, born, x))
        pop = sorted(pop, key=lambda x: x[:3])[:population]
        stale = 0 if pop[0][:2] < best else stale + 1
    log["last"] = pop[0][0]
    return pop[0][3]


_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]
#: what a block holds of its pieces, each as one binary of numbers; no_id: 1 where doc_id is null
_KINDS = {"doc_id": np.int64, "no_id": np.int8, "piece": np.int32, "start": np.int64, "length": np.int64, "ids_crc32": np.int64, "bin": np.int64}


def _pack_blocks(items: DataFrame, tables: Tables, capacity: int, blocks: int) -> DataFrame:
    """items (block, the piece's columns, bin) -> the same with the evolved bins, offset and fill; bin -1: none yet."""

    def gather(t: pa.Table) -> pa.Table:
        raw = [pa.array([t.column(c).to_numpy().astype(k).tobytes()], pa.binary()) for c, k in _KINDS.items()]
        return pa.Table.from_arrays([t.column("block").combine_chunks()[:1], *raw], ["block", *_KINDS])

    plain = items.withColumn("no_id", F.col("doc_id").isNull().cast("byte")).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    # the islands' rows are few and their work is long, so their tasks go by number and not by size
    tasks = min(blocks * ISLANDS, max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), items.sparkSession.sparkContext.defaultParallelism))
    blocks = tables.put(plain.groupBy("block").applyInArrow(gather, "block long, " + ", ".join(f"{c} binary" for c in _KINDS)), "blocks")

    def island(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for block, k, epoch, raw, sent in zip(*(b.column(c).to_pylist() for c in ("block", "island", "epoch", "length", "elites")), strict=True):
                elites = [np.frombuffer(x, np.int64) for x in sent]
                seed = [block & 0xFFFFFFFF, k, epoch]
                out.append(evolve(np.frombuffer(raw, np.int64), [x for x in elites if len(x) and x[0] >= 0], seed, capacity).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("island"), pa.array(out, pa.binary())], ["block", "island", "elite"])

    sizes = blocks.select("block", "length")
    elites = blocks.select("block", F.array("bin").alias("elites"))
    for epoch in range(EPOCHS):
        isle = sizes.join(elites, "block").select("block", "length", "elites", F.lit(epoch).alias("epoch"), F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
        done = tables.put(isle.repartition(tasks, "block", "island").mapInArrow(island, "block long, island int, elite binary"), "elites")
        elites = done.groupBy("block").agg(F.sort_array(F.collect_list("elite")).alias("elites"))  # ISLANDS of them: every elite goes to every island

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                own = {c: np.frombuffer(row[c], k) for c, k in _KINDS.items()}
                tried = [np.frombuffer(x, np.int64) for x in row["elites"]]
                if len(own["bin"]) and own["bin"][0] >= 0:
                    tried.append(own["bin"])
                best = min(tried, key=lambda x: _fitness(own["length"], x, capacity))
                order = np.argsort(best, kind="stable")
                fill = np.cumsum(own["length"][order]) - own["length"][order]
                first = np.concatenate((np.ones(1, bool), np.diff(best[order]) != 0))
                offset = fill - np.repeat(fill[first], np.diff(np.append(np.flatnonzero(first), len(order))))
                total = np.bincount(best, own["length"]).astype(np.int64)
                doc_id = pa.array(own["doc_id"][order], mask=own["no_id"][order] > 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), row["block"])), doc_id, *(pa.array(own[c][order]) for c in _COLUMNS[1:]), pa.array(best[order]), pa.array(offset), pa.array(total[best[order]])], ["block", *_COLUMNS, "bin", "offset", "fill"])

    return tables.put(blocks.join(elites, "block").mapInArrow(settle, "block long, " + PIECES + ", bin long, offset long, fill long"), "packed")


def _blocks_of_like_sizes(rest: DataFrame, blocks: int, tables: Tables) -> DataFrame:
    """rest (the piece's columns, slot) with block: pieces in the order of length and slot are dealt in turn."""
    names = [*_COLUMNS, "slot"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], [*names, "part", "place"])
            at += n

    ordered = rest.select(*names).repartitionByRange("length", "slot").sortWithinPartitions("length", "slot")
    numbered = tables.put(ordered.mapInArrow(number, PIECES + ", slot long, part int, place long"), "numbered")
    counts = sorted(numbered.groupBy("part").count().collect())  # a row for each partition
    before = np.cumsum([0, *(n for _, n in counts)]).tolist()
    offsets = rest.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], "part int, before long")
    return numbered.join(F.broadcast(offsets), "part").select(F.pmod(F.col("place") + F.col("before"), F.lit(blocks)).alias("block"), *_COLUMNS)


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Pieces with sequence_id and offset; sequences hold at most ``capacity`` ids."""
    spark, cols = pieces.sparkSession, _COLUMNS
    ship(spark)
    with Tables(spark, "packing") as tables:
        pieces = tables.put(pieces.select(*cols).withColumn("slot", F.monotonically_increasing_id()), "pieces")
        full = pieces.filter(F.col("length") >= capacity).select(*cols, (F.col("slot") * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
        rest = pieces.filter(F.col("length") < capacity)
        blocks = max(1, -(-rest.count() // block))
        dealt = _blocks_of_like_sizes(rest, blocks, tables) if blocks > 1 else rest.select(F.lit(0).cast("long").alias("block"), *cols)
        first = _pack_blocks(dealt.withColumn("bin", F.lit(-1).cast("long")), tables, capacity, blocks)
        number = (F.col("block") * (1 << 24) + F.col("bin")).alias("group")
        poor = F.col("fill") < int(0.97 * capacity)
        good = first.filter(~poor).select(*cols, (F.col("block") * (1 << 24) * 4 + F.col("bin") * 4 + 1).alias("sequence_id"), "offset")
        # the badly filled bins, whole, in new blocks; bins are numbered anew within each
        again = first.filter(poor).select(*cols, number)
        blocks = max(1, -(-again.count() // block))
        again = again.withColumn("block", F.pmod(F.xxhash64("group", F.lit(5)), F.lit(blocks)))

        def renumber(t: pa.Table) -> pa.Table:
            _, bin_ = np.unique(t.column("group").to_numpy(), return_inverse=True)
            return t.select(["block", *cols]).append_column("bin", pa.array(bin_.astype(np.int64)))

        again = again.groupBy("block").applyInArrow(renumber, "block long, " + PIECES + ", bin long")
        second = _pack_blocks(again, tables, capacity, blocks).select(*cols, (F.col("block") * (1 << 24) * 4 + F.col("bin") * 4 + 2).alias("sequence_id"), "offset")
        return result(full.unionByName(good).unionByName(second), "sequences")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(token_pieces(docs, tokenizer, capacity), capacity)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The packed token sequences themselves: sequence_id, ids. ``docs`` must have distinct doc_ids."""
    ids = token_pieces(docs, tokenizer, capacity, with_ids=True).select("doc_id", "piece", "ids")
    parts = packed.join(ids, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"))


def op6_bestfit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
