"""Words, word hashes and shingle hashes of whole texts, computed over Arrow batches with numpy.

A batch of documents is cut into chunks of about ``CHUNK`` bytes (a longer document is a chunk of its own); every
function here works on one chunk, so memory follows the chunk and never the partition.  Null texts count as empty.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK = 1 << 20
#: words are hashed by a quarter of this many at a time; bounds the temporaries of very long documents.
BLOCK = 1 << 20

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
#: word bytes of ``[^\x20\x09-\x0D]+``
SPACE_WORDS = ~_SPACES
_ALNUM = np.zeros(256, dtype=bool)
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _ALNUM[_a : _b + 1] = True
#: word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z have been lower-cased
ALNUM_WORDS = _ALNUM

#: keys of the two families of word hashes
_KEYS = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
#: words of at most this many bytes are hashed from two machine words, longer ones by xxh3
SHORT = 16
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1] * (SHORT + 1 - 8), dtype=np.uint64)


def mix(z: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; spreads every input bit over the whole word."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def byte_hashes(data: bytes, start: np.ndarray, end: np.ndarray, family: int = 0) -> np.ndarray:
    """64-bit hashes of the slices data[start:end]. Up to 8 bytes, slices of one length differ surely; else with chance 2**-64."""
    one, two = (np.uint64(k) for k in _KEYS[family])
    out = np.empty(len(start), dtype=np.uint64)
    padded = data + bytes(SHORT)
    eight = np.ndarray((len(data) + 8,), dtype="<u8", buffer=padded, strides=(1,))
    size = end - start
    for a in range(0, len(start), BLOCK >> 2):
        s, n = start[a : a + (BLOCK >> 2)], np.minimum(size[a : a + (BLOCK >> 2)], SHORT)
        low = eight[s] & _MASK[n]
        high = np.where(n > 8, eight[np.minimum(s + 8, len(data))] & _MASK[np.maximum(n - 8, 0)], np.uint64(0))
        out[a : a + (BLOCK >> 2)] = mix(mix(low ^ one) + high * two + n.astype(np.uint64))
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]], _KEYS[family][0])
    return out


class Words:
    """Words of a chunk of documents: byte ``start``/``end`` in ``data``, 64-bit ``hash``, ``first[d]:first[d+1]`` by document."""

    def __init__(self, texts: list[bytes | None], table: np.ndarray, lower: bool) -> None:
        texts = [x or b"" for x in texts]
        data = b"\n".join(texts) + b"\n"
        self.data = data.lower() if lower else data
        lengths = np.fromiter((len(x) + 1 for x in texts), dtype=np.int64, count=len(texts))
        self.doc_start = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))
        buf = np.frombuffer(self.data, dtype=np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate((np.zeros(1, np.int8), table[buf].view(np.int8), np.zeros(1, np.int8)))))
        self.start, self.end = edges[::2], edges[1::2]
        self.hash = byte_hashes(self.data, self.start, self.end)
        self.first = np.searchsorted(self.start, self.doc_start)

    def __len__(self) -> int:
        return len(self.hash)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(start word, hash) of every ``k`` consecutive words inside one document."""
        h = window_hashes(self.hash, k)
        if not len(h):
            return np.zeros(0, np.int64), h
        last = np.repeat(self.first[1:], self.counts())[: len(h)]
        at = np.flatnonzero(np.arange(len(h)) + k <= last)
        return at, h[at]

    def text(self, i: int, j: int) -> list[bytes]:
        return [self.data[s:e] for s, e in zip(self.start[i:j].tolist(), self.end[i:j].tolist(), strict=True)]


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each ``k`` consecutive entries of ``words``, in order: halves are hashed and mixed, so no sum or power of entries can cancel."""
    if k < 1 or len(words) < k:
        return np.zeros(0, np.uint64)
    out, done, power, size = None, 0, words, 1
    while True:
        if k & size:
            own = power[: len(words) - size + 1]
            out = own if out is None else joined(out[: len(words) - done - size + 1], own[done : len(words) - size + 1])
            done += size
        if done == k:
            return mix(out + np.uint64(k))
        power = joined(power[: len(power) - size], power[size:])
        size *= 2


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(0x2545F4914F6CDD1D) + (right ^ np.uint64(0x9E6C63D0876A9A47)))


def hash_words(words: list[str]) -> np.ndarray:
    """Hashes that ``Words`` gives to these words."""
    return Words([b" ".join(x.encode() for x in words)], SPACE_WORDS, False).hash


def release() -> None:
    """Gives memory that is free inside this worker back to the machine, so that waiting workers hold little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Cuts Arrow batches into slices of about ``most`` text bytes: (slice, its texts). Only one slice's texts are made at a time."""
    for batch in batches:
        n, at = batch.num_rows, 0
        if not n:
            continue
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
        while at < n:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, stop - at), texts.slice(at, stop - at).to_pylist()
            at = stop
        del texts
    release()
