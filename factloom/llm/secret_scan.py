"""Secret scans with probabilistic automata that are inferred from labelled credentials.

Three patterns label credentials wherever they match (the base).  From a sample of the labelled values of each kind a
prefix tree is grown and its states are merged while they are statistically compatible: two states are, if their
frequencies of ending and of each next character, and those of all states that both reach by the same characters, differ
by less than Hoeffding's bound at level ``ALPHA``.  What remains is a probabilistic automaton of the kind's format; one
more is inferred from ordinary strings.  Every string of ``LEAST`` characters or more (the shortest of any kind) of the credentials' alphabet, in
every whole text, is a candidate and is scored by the likelihood of its format against that of ordinary strings, per
character.  Candidates above ``RATIO`` that touch no base match are spans of their own, of kind ``like_`` and the
likeliest format.

The automata learn from at most ``SAMPLE`` different labelled values of each kind and ``ORDINARY`` ordinary strings below
``LONG`` characters and as many longer ones, all those of the smallest hashes in the corpus (the bound of this classifier's sample; values above ``LONGEST`` characters
teach nothing).  Base places cover all texts.

A null text is empty; an empty text has no spans.  Repeated rows are scanned alike.  A kind without labelled values adds
no spans; without any table rows there are no rows.  A null doc_id is kept as it is.  Other columns take no part.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import id_and_text, ship, table
from .textwords import chunks

#: kinds in the contract's order: (pattern, group that must be long enough, its least length) (fixed values)
BASE = {
    "assign": (re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE), 2, 6),
    "access": (re.compile(rb"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(rb"[0-9a-f]{24,}"), 0, 24),
}
#: lower-case words without which a text has no match of the kind (fixed values)
HINTS = {"assign": (b"password", b"passwd", b"secret", b"token", b"api"), "access": (b"akia",)}
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_.=-]{6,}")
ALPHABET = 68
LEAST, LONG, LONGEST, SAMPLE, ORDINARY = 6, 16, 256, 400, 2000
ALPHA, RATIO, RARE = 0.05, 2.5, 8
KINDS = [*BASE, *(f"like_{k}" for k in BASE)]
RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string, n_like long, score double"


class Automaton:
    """Probabilities of the next character and of the end, by state; state 0 begins."""

    def __init__(self, values: list[bytes]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.count: list[dict[int, int]] = [{}]
        self.ends, self.total = [0], [0]
        for value in values:
            s = 0
            for c in value:
                self.total[s] += 1
                self.count[s][c] = self.count[s].get(c, 0) + 1
                if c not in self.next[s]:
                    self.next[s][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.ends.append(0)
                    self.total.append(0)
                s = self.next[s][c]
            self.total[s] += 1
            self.ends[s] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / ALPHA))
        self._merge_states()

    def _merge_states(self) -> None:
        kept, edge = [0], [(0, c) for c in sorted(self.next[0])]
        known = {0}
        while edge:
            edge.sort(key=lambda x: (-self.total[self.next[x[0]][x[1]]], x))
            parent, c = edge.pop(0)
            s = self.next[parent][c]
            if s in known:
                continue
            home = next((k for k in [parent, *kept] if self._compatible(k, s)), None)
            if home is None:
                kept.append(s)
                known.add(s)
                edge += [(s, x) for x in sorted(self.next[s])]
            else:
                self.next[parent][c] = home
                self._fold(home, s)
                edge = [(k, x) for k in kept for x in sorted(self.next[k]) if self.next[k][x] not in known]
        number = {s: i for i, s in enumerate(kept)}
        self.step = [{c: (number[t], math.log((self.count[s][c] + 1 / ALPHABET) / (self.total[s] + 1))) for c, t in self.next[s].items()} for s in kept]
        self.other = [math.log(1 / ALPHABET / (self.total[s] + 1)) for s in kept]
        self.end = [math.log((self.ends[s] + 1 / ALPHABET) / (self.total[s] + 1)) for s in kept]
        del self.next, self.count, self.ends, self.total

    def _apart(self, f: int, n: int, g: int, m: int) -> bool:
        return abs(f / n - g / m) > self.bound * (n**-0.5 + m**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.total[a], self.total[b]
            if m < RARE or n < RARE:
                continue
            if self._apart(self.ends[a], n, self.ends[b], m):
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if self._apart(self.count[a].get(c, 0), n, self.count[b].get(c, 0), m):
                    return False
            todo += [(self.next[a][c], t) for c, t in self.next[b].items() if c in self.next[a] and self.next[a][c] != t]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds state b, and what hangs below it, to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.total[a] += self.total[b]
            self.ends[a] += self.ends[b]
            for c, t in self.next[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + self.count[b][c]
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def log_likelihood(self, value: bytes) -> float:
        s, out = 0, 0.0
        for c in value:
            to = self.step[s].get(c)
            if to is None:
                out += self.other[s]
            else:
                s = to[0]
                out += to[1]
        return out + self.end[s]


class Formats:
    """An automaton for each kind that has labelled values, and one for ordinary strings."""

    def __init__(self, labelled: dict[str, list[bytes]], ordinary: list[bytes]) -> None:
        self.kinds = {k: Automaton(v) for k, v in labelled.items() if v}
        self.ordinary = Automaton(ordinary)

    def score(self, value: bytes) -> tuple[float, str]:
        """Log-likelihood ratio per character of the likeliest kind, and that kind."""
        if not self.kinds:
            return float("-inf"), ""
        best, kind = max((a.log_likelihood(value), k) for k, a in self.kinds.items())
        return (best - self.ordinary.log_likelihood(value)) / len(value), kind


def base_matches(text: bytes) -> dict[str, list[re.Match]]:
    """The base matches of each kind, in order."""
    low = text.lower()
    out = {}
    for kind, (pattern, group, least) in BASE.items():
        found = []
        if kind not in HINTS or any(x in low for x in HINTS[kind]):
            found = [m for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
        out[kind] = found
    return out


def _free(text: bytes, base: dict[str, list[re.Match]]) -> Iterator[re.Match]:
    """The candidates that touch no base match."""
    taken = sorted(m.span() for own in base.values() for m in own)
    at, reach = 0, 0
    for m in CANDIDATE.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= m.start():
            yield m


def _hash(kind: str, value: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(value, digest_size=8, key=kind.encode()).digest()) >> 1


def learn(docs: DataFrame, **columns: str) -> Formats:
    """The formats of the credentials in ``docs``."""
    ship(docs.sparkSession)
    most = {**dict.fromkeys(BASE, SAMPLE), "short": ORDINARY, "long": ORDINARY}

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, bytes]] = {k: {} for k in most}

        def put(kind: str, value: bytes) -> None:
            if len(value) <= LONGEST:
                own = held[kind]
                own[_hash(kind, value)] = value
                if len(own) > 4 * most[kind]:
                    held[kind] = {h: own[h] for h in sorted(own)[: most[kind]]}

        for _, texts in chunks(batches):
            for text in texts:
                base = base_matches(text or b"")
                for kind, found in base.items():
                    for m in found:
                        put(kind, m.group(BASE[kind][1]))
                for m in _free(text or b"", base):
                    put("long" if m.end() - m.start() >= LONG else "short", m.group())
        rows = [(k, h, own[h].decode()) for k, own in held.items() for h in sorted(own)[: most[k]]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["kind", "h", "value"])

    # a part hands on its smallest hashes only; they are ranked by part first, so none but a bounded few meet in a task
    found = id_and_text(docs, **columns).mapInArrow(sample, "kind string, h long, value string").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    rank = lambda *by: F.dense_rank().over(Window.partitionBy("kind", *by).orderBy("h"))
    limit = F.when(F.col("kind").isin("short", "long"), ORDINARY).otherwise(SAMPLE)
    near = found.distinct().withColumn("r", rank("part")).filter(F.col("r") <= limit)
    rows = near.select("kind", "h", "value").distinct().withColumn("r", rank()).filter(F.col("r") <= limit).collect()
    by: dict[str, list[bytes]] = {k: [] for k in most}
    for r in sorted(rows, key=lambda r: (r.kind, r.h)):
        by[r.kind].append(r.value.encode())
    return Formats({k: by[k] for k in BASE}, by["short"] + by["long"])


def find_secrets(docs: DataFrame, formats: Formats, **columns: str) -> DataFrame:
    """One row per document: base counts, base and all spans (kind:start:end in code points), n_like, the best candidate's score."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(formats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = lru_cache(1 << 15)(shared.value.score)
        for part, texts in chunks(batches):
            counts, base_spans, all_spans, likes, scores = [], [], [], [], []
            for text in texts:
                text = text or b""
                base = base_matches(text)
                spans = [(m.start(), k, m.end()) for k, own in base.items() for m in own]
                n, top, like = len(spans), None, []
                for m in _free(text, base):
                    value = m.group()
                    s, kind = score_of(value) if len(value) <= LONGEST else shared.value.score(value)
                    if s > RATIO:
                        like.append((m.start(), f"like_{kind}", m.end()))
                    if kind:
                        top = s if top is None else max(top, s)
                if n or like:
                    place = np.concatenate((np.zeros(1, np.int64), np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
                    join = lambda x, place=place: ",".join(f"{k}:{place[a]}:{place[b]}" for a, k, b in sorted(x, key=lambda y: (y[0], KINDS.index(y[1]))))
                    base_spans.append(join(spans))
                    all_spans.append(join(spans + like))
                else:
                    base_spans.append("")
                    all_spans.append("")
                counts.append([len(base[k]) for k in BASE])
                likes.append(len(like))
                scores.append(top)
            n = np.array(counts, dtype=np.int64).reshape(-1, len(BASE))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(n[:, i]) for i in range(len(BASE))), pa.array(base_spans, pa.string()), pa.array(all_spans, pa.string()), pa.array(likes, pa.int64()), pa.array(scores, pa.float64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans", "n_like", "score"],
            )

    return id_and_text(docs, **columns).mapInArrow(run, RESULT)


def scan_secrets(docs: DataFrame, **columns: str) -> DataFrame:
    return find_secrets(docs, learn(docs, **columns), **columns)


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    rows = scan_secrets(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_like", "score")
