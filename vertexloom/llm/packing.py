"""Words, word n-grams and their 64-bit hashes for whole batches of texts, and packed arrays.

A word is a run of bytes other than 0x20 and 0x09-0x0D; lower-casing maps A-Z only. N-grams of a
document never reach into the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard

#: Bytes of text that a task takes up at once.
CHUNK_BYTES = 2 << 20

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose high and low bits depend on all of the input."""
    x = (x ^ (x >> np.uint64(32))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M1
    return x ^ (x >> np.uint64(32))


def words_of(text: bytes | None, lower: bool) -> list[bytes]:
    """The words of UTF-8 text; null: none. bytes.split() parts at exactly the six bytes above."""
    return (text.lower() if lower else text).split() if text else []


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Words:
    """The words of some documents in a row, as hashes."""

    def __init__(self, texts: list[bytes | None], lower: bool, keep: bool = False):
        lists = [words_of(t, lower) for t in texts]
        self._place(hashes([w for x in lists for w in x]), np.array([len(x) for x in lists], np.int64))
        self.lists = lists if keep else None

    def _place(self, hash: np.ndarray, counts: np.ndarray) -> None:
        self.hash, self.counts = hash, counts
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)

    @classmethod
    def of(cls, hash: np.ndarray, counts: np.ndarray) -> Words:
        """From the hashes of all words in a row, and how many each document has."""
        out = cls.__new__(cls)
        out._place(hash, counts)
        out.lists = None
        return out

    def room(self, n: int) -> np.ndarray:
        """Whether n words of one document start at each position."""
        return np.arange(len(self.hash)) + n <= self.ends[self.doc]

    def ngrams(self, n: int) -> np.ndarray:
        """The hash of the n words from each position on (garbage where ``room`` is false)."""
        return ngram_hashes(self.hash, n)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes and their documents, in order: all n-grams, or, of a document with fewer
        words, its whole sequence as one. No words: no shingle."""
        ok = self.room(n)
        full, doc = self.ngrams(n)[ok], self.doc[ok]
        short = np.flatnonzero((self.counts > 0) & (self.counts < n))
        if len(short):
            whole = np.zeros(len(short), np.uint64)
            for k in range(1, n):
                has = self.counts[short] == k
                whole[has] = ngram_hashes(self.hash, k)[self.starts[short[has]]] + np.uint64(k)
            full, doc = np.append(full, mix(whole)), np.append(doc, short.astype(np.int32))
        return full, doc

    def sequences(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams, hashed as ``shingles`` does the whole sequence of a document of n words, and their documents."""
        ok = self.room(n)
        return mix(self.ngrams(n)[ok] + np.uint64(n)), self.doc[ok]


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """By doubling: the hash of 2k words joins two hashes of k words."""
    size, done, reach, out = 1, words, 0, None
    while True:
        if n & size:
            if out is None:
                out, reach = done, size
            else:
                out, reach = _join(out, done, reach), reach + size
        size *= 2
        if size > n:
            return out
        done = _join(done, done, size // 2)


def _join(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
    after = np.zeros_like(b)
    if shift < len(b):
        after[: len(b) - shift] = b[shift:]
    return mix(a * _M1 + after)


def distinct_sets(shingles: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingles in ascending order, and where each document's begin (and the end)."""
    order = np.lexsort((shingles, doc))
    s, d = shingles[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    s, d = s[new], d[new]
    return s, np.searchsorted(d, np.arange(n_docs + 1))


def pack(a: np.ndarray, level: int = 1) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), level)


def unpack(b: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype)


def pack_ints(a: np.ndarray) -> bytes:
    """Numbers that are not negative, as planes of as many bytes as the largest needs."""
    a = np.ascontiguousarray(a, "<u8")
    width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + pack(a.view("u1").reshape(-1, 8)[:, :width].T)


def unpack_ints(b: bytes) -> np.ndarray:
    width = b[0]
    planes = unpack(b[1:], "u1").reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending 64-bit keys: the first one, and the differences."""
    a = np.ascontiguousarray(a).view("<u8")
    return a[:1].tobytes().ljust(8, b"\0") + pack_ints(np.diff(a))[: None if len(a) else 0]


def unpack_sorted(b: bytes) -> np.ndarray:
    if len(b) == 8:
        return np.zeros(0, np.uint64)
    first = np.frombuffer(b, "<u8", 1)
    return np.cumsum(np.concatenate([first, unpack_ints(b[8:])]), dtype=np.uint64)


def pack_bits(a: np.ndarray) -> bytes:
    return pack(np.packbits(a))


def unpack_bits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(unpack(b, "u1"), count=n).astype(bool)


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def text_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def chunks(batches: Iterable[pa.RecordBatch], text: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text; a longer text is a batch of its own.

    Rows that wait for the next batch are copied, so that the batch that they came in can go."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        first = 0
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield _joined([*held, batch.slice(first, i - first)])
                held, size, first = [], 0, i
            size += n + 64
        if first < batch.num_rows:
            held.append(batch.take(pa.array(range(first, batch.num_rows), pa.int32())))
        del batch
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def sharded(key: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key, by its high bits, so that a shard's keys are one range."""
    return ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def by_shard(sorted_keys: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """The shards of ascending keys and where their keys are."""
    cut = np.searchsorted(sharded(sorted_keys, shards), np.arange(shards + 1)) if len(sorted_keys) else np.zeros(shards + 1, int)
    for s in np.flatnonzero(np.diff(cut)):
        yield int(s), slice(int(cut[s]), int(cut[s + 1]))


def map_chunks(f: Callable[[pa.RecordBatch], Iterator[dict]], text: int, schema: pa.Schema, limit: int = CHUNK_BYTES):
    """For mapInArrow: ``f`` gives the columns of some output batches for each chunk of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, text, limit):
            for columns in f(chunk):
                yield pa.RecordBatch.from_pydict(columns, schema=schema)

    return run
