"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, and decoding with offsets.

Texts of a batch become one array of code points, then one array of symbols (the class of a code
point and what the next one is). A small automaton over those symbols tells where pieces start.
Its transition functions compose associatively, so blocks of the array are scanned side by side:
each block's function is composed, the functions are combined by a prefix scan, and each block is
then run from its own first state. No regular expression is involved. The pieces are slices of the
UTF-8 bytes; each distinct piece is merged once and cached.

Null texts count as empty: no ids, no offsets, empty bytes. Bytes that are not UTF-8 are replaced
by U+FFFD before encoding. Repeated rows are encoded each for itself. Of equal merges the leftmost
comes first. A text of any length is encoded whole, in slices that end where a piece ends; an empty table
gives no rows. All other columns pass through; a column that clashes with an output name is dropped in favour of the output.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vertexloom.llm.workspace import ship

LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, SPACE_JOINS, SPACE_ALONE, SPACE_RUN, RESET = range(9)
SYMBOLS, STATES = 9, 8
#: States: a break follows; in letters; in numbers; in others; after a joining space; in white
#: space; one letter of a contraction to go; two letters to go.
BREAK, IN_L, IN_N, IN_O, JOIN, IN_W, LEFT1, LEFT2 = range(STATES)
BLOCK = 256
#: Characters of text that are scanned at once; bounds the arrays of a task.
CHARS_AT_ONCE = 400_000
#: Distinct pieces in each of the two generations that a worker remembers; when the younger is
#: full, it becomes the older one, and what was not met again is forgotten.
CACHED_PIECES = 80_000


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece starts, by state * SYMBOLS + symbol."""
    step, start = np.zeros((STATES, SYMBOLS), np.uint8), np.zeros((STATES, SYMBOLS), bool)
    run = {LETTER: IN_L, NUMBER: IN_N, OTHER: IN_O}
    for s in range(STATES):
        for symbol, state in run.items():
            step[s, symbol], start[s, symbol] = state, s not in (state, JOIN)
        step[s, QUOTE1], start[s, QUOTE1] = (IN_O, False) if s in (IN_O, JOIN) else (LEFT1, True)
        step[s, QUOTE2], start[s, QUOTE2] = (IN_O, False) if s in (IN_O, JOIN) else (LEFT2, True)
        step[s, SPACE_JOINS], start[s, SPACE_JOINS] = JOIN, True
        step[s, SPACE_ALONE], start[s, SPACE_ALONE] = BREAK, True
        step[s, SPACE_RUN], start[s, SPACE_RUN] = IN_W, s != IN_W
        step[s, RESET] = BREAK
    step[LEFT1, LETTER], start[LEFT1, LETTER] = BREAK, False
    step[LEFT2, LETTER], start[LEFT2, LETTER] = LEFT1, False
    return step.ravel(), start.ravel()


STEP, START = _automaton()


#: Letters and numbers of Unicode 16.0 that Python's tables may lack, first and last.
UNICODE_16_LETTERS = """
1c89 1c8a  a7cb a7cd  a7da a7dc  105c0 105f3  10d4a 10d65  10d6f 10d85  10ec2 10ec4  11380 11389
1138b 1138b  1138e 1138e  11390 113b5  113b7 113b7  113d1 113d1  113d3 113d3  11bc0 11be0
13460 143fa  16100 1611d  16d40 16d6c  18cff 18cff  1e5d0 1e5ed  1e5f0 1e5f0
"""
UNICODE_16_NUMBERS = """
10d40 10d49  116d0 116e3  11bf0 11bf9  16130 16139  16d70 16d79  1ccf0 1ccf9  1e5f1 1e5fa
"""


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE_RUN for each code point; one entry more, RESET, parts texts."""
    kinds = np.full(0x110001, OTHER, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))[0]
        if c == "L":
            kinds[cp] = LETTER
        elif c == "N":
            kinds[cp] = NUMBER
        elif c == "Z":
            kinds[cp] = SPACE_RUN
    for kind, ranges in ((LETTER, UNICODE_16_LETTERS), (NUMBER, UNICODE_16_NUMBERS)):
        ends = [int(x, 16) for x in ranges.split()]
        for a, b in zip(ends[::2], ends[1::2]):
            kinds[a : b + 1] = kind
    kinds[[*range(9, 14), 0x85]] = SPACE_RUN
    kinds[0x110000] = RESET
    return kinds


def _symbols(cps: np.ndarray) -> np.ndarray:
    """The symbol of each code point; cps ends with the parting code point."""
    kind = code_point_classes()[cps]
    after = np.empty_like(kind)
    after[:-1], after[-1] = kind[1:], RESET
    out = kind.copy()
    solid = (kind == SPACE_RUN) & (after <= OTHER)
    out[solid] = np.where(cps[solid] == 32, SPACE_JOINS, SPACE_ALONE)
    quotes = np.flatnonzero(cps == 39)
    if len(quotes):
        a = cps[np.minimum(quotes + 1, len(cps) - 1)]
        b = cps[np.minimum(quotes + 2, len(cps) - 1)]
        out[quotes[np.isin(a, [ord(x) for x in "stmd"])]] = QUOTE1
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        out[quotes[two]] = QUOTE2
    return out


def piece_starts(cps: np.ndarray) -> np.ndarray:
    """Where pieces start, as booleans, by an associative scan over blocks of symbols."""
    n = len(cps)
    blocks = -(-n // BLOCK)
    sym = np.full(blocks * BLOCK, RESET, np.uint8)
    sym[:n] = _symbols(cps)
    sym = np.ascontiguousarray(sym.reshape(blocks, BLOCK).T)
    # The function of each block: its last few symbols often map every state to one; else all of it.
    function = np.empty((blocks, STATES), np.uint8)
    todo, tail = np.arange(blocks), 32
    while len(todo):
        f = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (len(todo), STATES)).copy()
        for row in sym[BLOCK - tail :]:
            f = STEP[f * np.uint8(SYMBOLS) + row[todo][:, None]]
        function[todo] = f
        todo = todo[(f != f[:, :1]).any(1)] if tail < BLOCK else todo[:0]
        tail = min(BLOCK, tail * 4)
    # Prefix scan over the functions by doubling: composed[b] = blocks 0 to b in a row.
    composed, reach = function, 1
    while reach < blocks:
        later = composed.copy()
        later[reach:] = np.take_along_axis(composed[reach:], composed[:-reach].astype(np.intp), 1)
        composed, reach = later, reach * 2
    state = np.full(blocks, BREAK, np.uint8)
    state[1:] = composed[:-1, BREAK]
    flags = np.empty((BLOCK, blocks), bool)
    for j, row in enumerate(sym):
        at = state * np.uint8(SYMBOLS) + row
        flags[j], state = START[at], STEP[at]
    return flags.T.ravel()[:n]


def pieces_of(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, the byte offsets of pieces (and the end), pieces before each text."""
    parting = np.array([0x110000], "<u4").tobytes()
    cps = np.frombuffer(b"".join(x for t in texts for x in (t.encode("utf-32-le"), parting)), "<u4")
    if not len(cps):
        return b"", np.zeros(1, np.int64), np.zeros(1, np.int64)
    flags = piece_starts(cps)
    real = cps != 0x110000
    width = np.where(real, 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000), 0)
    at = np.cumsum(width) - width
    starts = np.append(at[flags], width.sum())
    before = np.concatenate([[0], np.cumsum(flags)[~real]])
    return "".join(texts).encode(), starts, before


class Vocabulary:
    """Ranks of byte strings, with the cache of merged pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.width = np.array([len(x) for x in self.token], np.int32)
        blob = b"".join(self.token)
        self.blob, self.begin = np.frombuffer(blob, np.uint8), np.cumsum(self.width, dtype=np.int64) - self.width
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    @staticmethod
    def parse(content: bytes) -> Vocabulary:
        """From the lines "base64 rank" of a rank file."""
        rows = (line.split() for line in content.splitlines() if line.strip())
        return Vocabulary({base64.b64decode(a): int(b) for a, b in rows})

    def merge(self, piece: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, leftmost first, until none has a rank."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > 48:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        while pairs and (low := min(pairs)) < 1 << 60:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
        return [ranks[x] for x in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap of pairs over linked parts, in n log n for pieces of any length."""
        ranks, n = self.ranks, len(piece)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if j >= n or not end[j] or end[j] != stop:
                continue  # one side was merged in the meantime
            end[i], end[j], after[i] = stop, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        data, starts, before = pieces_of(texts)
        at, cache = starts.tolist(), self._young
        pieces = [data[a:b] for a, b in zip(at, at[1:])]
        for p in set(pieces).difference(cache):
            cache[p] = self._old.get(p) or np.array(self.merge(p), np.int32).tobytes()
        packed = list(map(cache.__getitem__, pieces))
        if len(cache) > CACHED_PIECES:
            self._old, self._young = cache, {}
        cut = before.tolist()
        return [np.frombuffer(b"".join(packed[a:b]), np.int32) for a, b in zip(cut, cut[1:])]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The bytes of all tokens, each put where its offset says."""
        width = self.width[ids]
        source = np.repeat(self.begin[ids] - offsets, width)
        return self.blob[source + np.arange(len(source))].tobytes()


@lru_cache(4)
def _parsed(content: bytes) -> Vocabulary:
    return Vocabulary.parse(content)


def load_vocabulary(df: DataFrame, path: str):
    """Broadcast a rank file's content; its size is that of a vocabulary and checked here."""
    ship(df.sparkSession)
    with open(path, "rb") as f:
        content = f.read(64 << 20)
    if len(content) == 64 << 20:
        raise ValueError("a rank file of 64 MB or more is no vocabulary")
    return df.sparkSession.sparkContext.broadcast(content)


def in_parts(sizes: list[int], limit: int) -> Iterator[slice]:
    """Slices of rows whose sizes add up to limit at most, one row at least."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if i > first and total + size > limit:
            yield slice(first, i)
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield slice(first, len(sizes))


def _strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Texts of a column; null: empty; broken UTF-8: replaced."""
    raw = column.cast(pa.large_binary()).to_pylist()
    return [x.decode("utf-8", "replace") if x else "" for x in raw]


def list_column(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    lengths = np.array([len(x) for x in arrays], np.int64)
    offsets = np.zeros(len(arrays) + 1, np.int32)
    offsets[1:] = np.cumsum(lengths)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _others(df: DataFrame, *new: str) -> list[str]:
    return [c for c in df.columns if c not in new]


def _encoder(content, keep: list[str], text: str, ids: str, offsets: str | None):
    """For mapInArrow over the columns ``keep``: those that stay, the ids and the offsets."""
    new = [ids] + [offsets] * bool(offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _parsed(content.value)
        for batch in filter(len, batches):
            sizes = pc.fill_null(pc.binary_length(batch.column(keep.index(text))), 0).to_pylist()
            for part in in_parts(sizes, CHARS_AT_ONCE):
                rows = batch.slice(part.start, part.stop - part.start)
                got = vocabulary.encode(_strings(rows.column(keep.index(text))))
                columns = [list_column(got, pa.int32())]
                if offsets:
                    at = []
                    for x in got:
                        w = vocabulary.width[x]
                        at.append(np.cumsum(w, dtype=np.int32) - w)
                    columns.append(list_column(at, pa.int32()))
                kept = [rows.column(i) for i, c in enumerate(keep) if c not in new]
                names = [c for c in keep if c not in new]
                yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*names, *new])
            del batch, rows  # before the next one comes

    return run


def _encoded(src: DataFrame, ids: str, offsets: str | None) -> T.StructType:
    new = [ids] + [offsets] * bool(offsets)
    fields = [f for f in src.schema.fields if f.name not in new]
    return T.StructType(fields + [T.StructField(c, T.ArrayType(T.IntegerType(), False), False) for c in new])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", offsets: str | None = "offsets") -> DataFrame:
    """Add the token ids of ``text``, and for each the byte offset at which it starts."""
    keep = [c for c in df.columns if c not in (ids, offsets) or c == text]
    src = df.select(*keep)
    run = _encoder(load_vocabulary(df, path), keep, text, ids, offsets)
    return src.mapInArrow(run, _encoded(src, ids, offsets))


def _decoder(content, keep: list[str], ids: str, offsets: str, decoded: str):
    """For mapInArrow over the columns ``keep``: these and the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _parsed(content.value)
        for batch in filter(len, batches):
            counts = pc.fill_null(pc.list_value_length(batch.column(keep.index(ids))), 0).to_pylist()
            for part in in_parts(counts, CHARS_AT_ONCE // 4):
                rows = batch.slice(part.start, part.stop - part.start)
                flat, at = (rows.column(keep.index(c)).flatten().to_numpy(zero_copy_only=False) for c in (ids, offsets))
                # Offsets start anew with each text; here the texts stand one behind the other.
                sizes = np.array(counts[part], np.int64)
                ends = np.cumsum(sizes)
                total = np.concatenate([[0], np.cumsum(vocabulary.width[flat], dtype=np.int64)])
                before = total[ends - sizes]
                data = vocabulary.decode(flat, at + np.repeat(before, sizes))
                out = [data[a:b] for a, b in zip(before.tolist(), total[ends].tolist())]
                arrays = [*(rows.column(i) for i in range(len(keep))), pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, decoded])
            del batch, rows, arrays  # before the next one comes

    return run


def decode(df: DataFrame, path: str, ids: str = "ids", offsets: str = "offsets", decoded: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for, each token's where its offset says; null ids: empty
    bytes. An id without a rank raises."""
    keep = [c for c in df.columns if c != decoded]
    src = df.select(*keep)
    fields = [*src.schema.fields, T.StructField(decoded, T.BinaryType(), False)]
    return src.mapInArrow(_decoder(load_vocabulary(df, path), keep, ids, offsets, decoded), T.StructType(fields))


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", offsets: str = "offsets", decoded: str = "decoded") -> DataFrame:
    """``decode(encode(df))`` in one Python worker of a task, with one vocabulary, and not in two."""
    keep = [c for c in df.columns if c not in (ids, offsets, decoded) or c == text]
    src = df.select(*keep)
    content = load_vocabulary(df, path)
    schema = _encoded(src, ids, offsets)
    coded = [i for i, f in enumerate(schema.fields) if f.name != decoded]
    schema = T.StructType([schema.fields[i] for i in coded])
    there = _encoder(content, keep, text, ids, offsets)
    back = _decoder(content, schema.names, ids, offsets, decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return back(b.select(coded) for b in there(batches))

    return src.mapInArrow(run, T.StructType([*schema.fields, T.StructField(decoded, T.BinaryType(), False)]))


def digests(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """One row per document: number of ids, hex digest of the ids, hex digest of the decoded bytes."""
    joined = F.array_join(F.col(ids).cast("array<string>"), ",")
    return encoded.select(
        key,
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    )
