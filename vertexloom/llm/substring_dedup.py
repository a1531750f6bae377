"""Substring dedup: windows of words that occur in a document with a smaller id are cut out.

Suffixes (word positions of documents) are put into suffix trees that are partitioned by prefix.

1. Documents are taken up in chunks, their words as places in the chunk's vocabulary of hashes. Suffixes that
   can't repeat are left out: of the word sequences of half a window's length in a window the one with the
   least hash is its anchor; equal windows have equal anchors, so only windows whose anchor occurs in several
   documents are looked at further. Shards of the anchors' hashes find these out, and then shards of
   the windows' hashes whether a window repeats, and whether different words precede it.
2. A suffix begins where a match with the document of the least id that has a window begins: where the word
   before it is another one there, or where that document changes; and, in both alike, at content-chosen
   places in between, one at least in as many windows as a window has words. (For maximal repeats: wherever a
   repeated window has different words before it.) It ends where its windows stop to repeat, or after
   ``most`` words, two windows; what is longer goes on at the next such place, which all its copies share.
3. Suffixes are grouped by their first words; a group that is too large for a task is split by longer
   prefixes, up to a window's length. A chunk of documents sends equal suffixes once, so that a passage of
   a third of all documents is one suffix a chunk. Each group builds its suffix tree: suffixes in the order
   of their words, depths of common prefixes, nodes. A node has its depth and the least id below it.
4. A document loses, from each of its suffixes, as many words as the deepest node above it has that has a
   smaller id below. Nodes preceded by different words are the maximal repeats (``maximal_repeats``). Only
   texts that lose words are read again.

Texts with fewer words than a window, null and empty texts lose nothing; an empty table gives no rows.
Texts of any length are taken whole, a long one as a chunk of its own. Rows with a null id neither lose
words nor take any from others. Rows that share an id take nothing from each other, and each has its
own result. Columns other than doc_id and text are only passed through, whatever their names. Windows
are equal if their 64-bit hashes are; these are made of words' hashes of 48 bits, of which the trees compare 40.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm import packing
from vertexloom.llm.packing import Words, mix
from vertexloom.llm.prefilter import maybe
from vertexloom.llm.workspace import Workspace, tidy

#: Windows of a shard, and words of a group's suffixes, about.
SHARD_WINDOWS, GROUP_WORDS = 2_000_000, 8_000_000
#: Bytes of text of a chunk, whose equal windows and suffixes are sent once; bits of words' hashes that chunks and trees drop.
CHUNK_BYTES, CHUNK_DROPS, TREE_DROPS, BEFORE_DROPS = 4 << 20, 16, 8, 24


def _anchors(words: Words, window: int, anchor: int) -> np.ndarray:
    """For each position the least hash of the ``anchor``-word sequences in the window from there."""
    return _slide(words.ngrams(anchor), window - anchor + 1, np.minimum)


def _slide(a: np.ndarray, span: int, of) -> np.ndarray:
    """The least or greatest (``of``: minimum, maximum) of ``span`` values from each position on."""

    def ahead(a: np.ndarray, shift: int) -> np.ndarray:
        out = a.copy()
        if shift < len(a):
            of(a[: len(a) - shift], a[shift:], out=out[: len(a) - shift])
        return out

    reach = 1
    while reach * 2 <= span:
        a, reach = ahead(a, reach), reach * 2
    return ahead(a, span - reach) if span > reach else a


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


SCANNED = "doc_id long, text_hash long, n_words long, kept_sha256 string, chunk long, ids binary, hashes binary, vocabulary binary, words binary, lengths binary"
CHUNK = ("chunk", "ids", "hashes", "vocabulary", "words", "lengths")


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema({name: kinds[kind] for name, kind in (c.split() for c in ddl.split(", "))})


def scan(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: for each row of ``docs`` the number and the digest of its words; and chunks of them,
    in which rows with a null id have no words."""
    schema = _schema(SCANNED)

    def out(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({f.name: columns.get(f.name, pa.nulls(n, f.type)) for f in schema}, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for chunk in packing.chunks(batches, 2, CHUNK_BYTES):
            lists = [packing.words_of(t, False) for t in packing.text_bytes(chunk.column(2))]
            yield out(len(lists), doc_id=chunk.column(0), text_hash=chunk.column(1), n_words=[len(x) for x in lists], kept_sha256=[_digest(x) for x in lists])
            ids, hashes = chunk.column(0).fill_null(0).to_numpy(), chunk.column(1).to_numpy()
            lists = [x if ok else [] for x, ok in zip(lists, chunk.column(0).is_valid().to_pylist())]
            vocabulary, words = np.unique(packing.hashes([w for x in lists for w in x]) >> np.uint64(CHUNK_DROPS), return_inverse=True)
            lengths = np.array([len(x) for x in lists], np.int64)
            yield out(1, chunk=[number], ids=[packing.pack(ids)], hashes=[packing.pack(hashes)], vocabulary=[packing.pack_sorted(vocabulary)], words=[packing.pack_ints(words)], lengths=[packing.pack_ints(lengths)])
            number += 1

    return _keyed(docs).mapInArrow(run, SCANNED)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows by id and text: rows that share both have the same result."""
    return docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"), "text")


class _Anchors:
    """The words of a chunk, and its windows' anchors: the distinct ones, and whether several of its ids have them."""

    def __init__(self, row: dict, window: int):
        self.vocabulary, self.place = packing.unpack_sorted(row["vocabulary"]), packing.unpack_ints(row["words"]).astype(np.int64)
        self.words = words = Words.of(mix(self.vocabulary)[self.place], packing.unpack_ints(row["lengths"]).astype(np.int64))
        self.ids = packing.unpack(row["ids"], "<i8")
        self.at = np.flatnonzero(words.room(window))
        self.keys, self.key = np.unique(_anchors(words, window, max(1, window // 2))[self.at], return_inverse=True)
        least, most = np.full(len(self.keys), np.iinfo(np.int64).max), np.full(len(self.keys), np.iinfo(np.int64).min)
        own = self.ids[words.doc[self.at]] if len(self.at) else self.at
        np.minimum.at(least, self.key, own)
        np.maximum.at(most, self.key, own)
        self.several = least < most


class _Windows:
    """The windows of a chunk whose anchors repeat: where they start, and the distinct ones; of each of these the
    least id that has it, the word before it there (its hash, or 0 if there are several or a text
    begins), and whether it has another one elsewhere in the chunk."""

    def __init__(self, a: _Anchors, repeats: np.ndarray, window: int):
        self.chunk, self.words = a, a.words
        words, self.at = a.words, a.at[repeats[a.key]]
        at = self.at
        self.keys, self.key, count = np.unique(words.ngrams(window)[at], return_inverse=True, return_counts=True)
        self.several = count > 1
        self.before = before = np.where(at > words.starts[words.doc[at]], words.hash[at - 1] >> np.uint64(BEFORE_DROPS) | np.uint64(1), np.uint64(0)) if len(at) else np.zeros(0, np.uint64)
        self.least = np.full(len(self.keys), np.iinfo(np.int64).max)
        self.id = a.ids[words.doc[at]] if len(at) else at
        np.minimum.at(self.least, self.key, self.id)
        self.base = int(self.least.min(initial=np.iinfo(np.int64).max))
        there = np.flatnonzero(self.id == self.least[self.key])
        low, self.common = np.full(len(self.keys), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(self.keys), np.uint64)
        np.minimum.at(low, self.key[there], before[there])
        np.maximum.at(self.common, self.key[there], before[there])
        self.common[low != self.common] = 0
        self.mixed = np.zeros(len(self.keys), bool)
        self.mixed[self.key[before != self.common[self.key]]] = True


def _bits(rows: list[dict], column: str, keys: np.ndarray, shards: int, width: int = 1) -> np.ndarray:
    """``width`` bits for each of ascending keys, from the answers of the shards."""
    bits, place = np.zeros((len(keys), width), bool), dict(packing.by_shard(keys, shards))
    for r in rows:
        if r[column] is not None:
            at = place[r["shard"]]
            bits[at] = packing.unpack_bits(r[column], width * (at.stop - at.start)).reshape(-1, width)
    return bits


def _ask_anchors(chunks: DataFrame, window: int, shards: int) -> DataFrame:
    """For each chunk and shard its distinct anchors."""
    schema = _schema("chunk long, shard long, keys binary, several binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a = _Anchors(row, window)
                rows = [{"chunk": row["chunk"], "shard": s, "keys": packing.pack_sorted(a.keys[k]), "several": packing.pack_bits(a.several[k])} for s, k in packing.by_shard(a.keys, shards)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return chunks.mapInArrow(run, "chunk long, shard long, keys binary, several binary")


def _grouped(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The packed keys of all rows: their order, where each new one begins in it, how many rows have it or
    whether one has it several times, and the cuts between rows."""
    keys = [packing.unpack_sorted(r["keys"]) for r in rows]
    flat, several = np.concatenate(keys), np.concatenate([packing.unpack_bits(r["several"], len(k)) for r, k in zip(rows, keys)])
    order = np.argsort(flat, kind="stable")
    new = np.ones(len(flat), bool)
    new[1:] = flat[order][1:] != flat[order][:-1]
    first, node = np.flatnonzero(new), np.cumsum(new) - 1
    again = (np.bincount(node) > 1) | np.logical_or.reduceat(several[order], first)
    return order, first, node, again, np.cumsum([len(k) for k in keys])[:-1]


def _repeated_anchors(group: pa.Table) -> pa.Table:
    """For each chunk, a bit for each of its anchors: it occurs elsewhere too."""
    order, _, node, again, cut = _grouped(group.to_pylist())
    bits = np.empty(len(order), bool)
    bits[order] = again[node]
    return pa.table({"chunk": group["chunk"], "shard": group["shard"], "anchors": pa.array([packing.pack_bits(x) for x in np.split(bits, cut)], pa.binary())})


WINDOWS = "chunk long, shard long, base long, keys binary, common binary, least binary, several binary, mixed binary"


def _ask_windows(window: int, anchor_shards: int, shards: int):
    """For each chunk and shard the distinct windows whose anchors repeat."""
    schema = _schema(WINDOWS)

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        a = _Anchors(row, window)
        w = _Windows(a, _bits(answers.to_pylist(), "anchors", a.keys, anchor_shards)[:, 0], window)
        least = (w.least - w.base).view(np.uint64) if len(w.least) else w.least
        out = [
            {"chunk": row["chunk"], "shard": s, "base": w.base, "keys": packing.pack_sorted(w.keys[k]), "common": packing.pack_ints(w.common[k]), "least": packing.pack_ints(least[k]), "several": packing.pack_bits(w.several[k]), "mixed": packing.pack_bits(w.mixed[k])}
            for s, k in packing.by_shard(w.keys, shards)
        ]
        return pa.Table.from_pylist(out, schema=schema)

    return run


def _repeats(every: bool):
    """For each chunk, three bits for each of its windows: it repeats; the word before, in the chunk's least id, is that
    in the least id of all; this one is in the chunk and the word before is another one somewhere. And how much
    less than the chunk's the least id of all is. With ``every`` no words before are alike if any differ."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        order, first, node, again, cut = _grouped(rows)
        common = np.concatenate([packing.unpack_ints(r["common"]) for r in rows])[order]
        least = np.concatenate([packing.unpack_ints(r["least"]).view(np.int64) + r["base"] for r in rows])[order]
        mixed = np.concatenate([packing.unpack_bits(r["mixed"], n) for r, n in zip(rows, np.diff([0, *cut, len(order)]))])[order]
        lowest = np.minimum.reduceat(least, first)
        mine = least == lowest[node]
        low, there = np.minimum.reduceat(np.where(mine, common, np.uint64((1 << 64) - 1)), first), np.maximum.reduceat(np.where(mine, common, np.uint64(0)), first)
        alike = (common == there[node]) & ((low == there) & (there > 0))[node]
        differs = np.logical_or.reduceat(~alike | mixed, first)
        if every:
            alike = ~differs[node]
        bits, back = np.empty((len(order), 3), bool), np.empty(len(order), np.uint64)
        bits[order] = np.stack([again[node], alike, mine & differs[node]], 1)
        back[order] = (least - lowest[node]).view(np.uint64)
        answers = [(packing.pack_bits(x.ravel()), packing.pack_ints(y)) for x, y in zip(np.split(bits, cut), np.split(back, cut))]
        return pa.table({"chunk": group["chunk"], "shard": group["shard"], "windows": pa.array([x for x, _ in answers], pa.binary()), "back": pa.array([y for _, y in answers], pa.binary())})

    return run


SUFFIXES = "chunk long, place long, n_words long, vocabulary binary, words binary, lengths binary, common binary, times binary, doc binary, start binary, id binary"
_ARROW = _schema(SUFFIXES)


class Suffixes:
    """Distinct suffixes, their words in a row, as places in the ascending ``vocabulary`` of hashes, and where
    they occur: document (its place in the chunk), first word, and id, those of a suffix in a row."""

    def __init__(self, vocabulary, words, lengths, common, times, doc, start, id):
        self.vocabulary, self.words, self.lengths, self.common, self.times, self.doc, self.start, self.id = vocabulary, words, lengths, common, times, doc, start, id

    @staticmethod
    def unpacked(row: dict) -> Suffixes:
        words, lengths, times, doc, start = (packing.unpack_ints(row[k]).astype(np.int64) for k in ("words", "lengths", "times", "doc", "start"))
        return Suffixes(packing.unpack_sorted(row["vocabulary"]), words, lengths, packing.unpack(row["common"], "<u8"), times, doc, start, packing.unpack(row["id"], "<i8"))

    def some(self, at: np.ndarray) -> Suffixes:
        """The suffixes at these places, with the words that they have."""
        words = self.words[_spans(self.lengths, at)]
        used = np.zeros(len(self.vocabulary), bool)
        used[words] = True
        words = (np.cumsum(used, dtype=np.int32) - 1)[words]
        return Suffixes(self.vocabulary[used], words, self.lengths[at], self.common[at], self.times[at], *(x[_spans(self.times, at)] for x in (self.doc, self.start, self.id)))

    def packed(self, chunk: int, place: int) -> dict:
        numbers = {k: packing.pack_ints(getattr(self, k)) for k in ("words", "lengths", "times", "doc", "start")}
        return {"chunk": chunk, "place": place, "n_words": len(self.words), "vocabulary": packing.pack_sorted(self.vocabulary), "common": packing.pack(self.common), "id": packing.pack(self.id), **numbers}

    def prefixes(self, n: int) -> np.ndarray:
        """The hash of the first n words of each suffix."""
        begin = np.cumsum(self.lengths) - self.lengths
        return packing.ngram_hashes(self.vocabulary[self.words[begin[:, None] + np.arange(n)]].ravel(), n)[::n]

    def placed(self, chunk: int, prefix: int, place: int, parts: int) -> list[dict]:
        """Rows by the place that the prefix chooses, of ``parts`` below ``place``."""
        own = packing.sharded(mix(self.prefixes(prefix) + np.uint64(prefix)), parts)
        order = np.argsort(own, kind="stable")
        cut = [0, *(np.flatnonzero(np.diff(own[order])) + 1).tolist(), len(order)]
        name = lambda k: int(mix(np.array([place], np.int64).view(np.uint64) * np.uint64(3) + np.uint64(k + 1)).view(np.int64)[0])
        return [self.some(order[a:b]).packed(chunk, name(int(own[order[a]]))) for a, b in zip(cut, cut[1:]) if b > a]


def _spans(lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places of the spans ``at`` of an array that is made up of spans of these lengths."""
    first, n = (np.cumsum(lengths) - lengths)[at], lengths[at]
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def _chosen(window: int, most: int, anchor_shards: int, shards: int, groups: int):
    """The suffixes of a chunk, given which of its windows repeat."""

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row, rows = chunk.to_pylist()[0], answers.to_pylist()
        a = _Anchors(row, window)
        w = _Windows(a, _bits(rows, "anchors", a.keys, anchor_shards)[:, 0], window)
        again, alike, first = _bits(rows, "windows", w.keys, shards, 3).T
        least, place = w.least.copy(), dict(packing.by_shard(w.keys, shards))
        for r in rows:
            if r["back"] is not None:
                least[place[r["shard"]]] -= packing.unpack_ints(r["back"]).view(np.int64)
        found = suffixes_of(w, again, alike, first, least, window, most)
        return pa.Table.from_pylist(found.placed(row["chunk"], max(1, window // 4), 0, groups) if len(found.lengths) else [], schema=_ARROW)

    return run


def _span(window: int) -> int:
    """Windows in a row of which one at least begins a suffix."""
    return max(1, window)


def suffixes_of(w: _Windows, again: np.ndarray, alike: np.ndarray, first: np.ndarray, least: np.ndarray, window: int, most: int) -> Suffixes:
    """The suffixes of a chunk, given for each window whether it repeats, whether the word before it in the chunk's
    least id is that in the least id of all, whether this is in the chunk and matches begin there, and this id."""
    words, at = w.words, w.at[again[w.key]]
    key = w.key[again[w.key]]
    n = len(words.hash)
    before = np.zeros(n, np.uint64)
    before[w.at] = w.before
    value = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    value[at] = mix(w.keys[key]) >> np.uint64(1)
    begins = np.zeros(n, bool)
    # Where the word before is not that of the least id, or may not be; and at the least id itself.
    starts = ~alike[w.key] | (w.before != w.common[w.key]) | (first[w.key] & (w.id == least[w.key]))
    begins[at] = starts[again[w.key]]
    # Also where the document of the least id is another one than that of the window before.
    if len(at):
        begins[at[np.append(True, (np.diff(at) > 1) | (words.doc[at[1:]] != words.doc[at[:-1]]) | (least[key[1:]] != least[key[:-1]]))]] = True
    # The least of some ``span`` windows in a row: wherever these repeat elsewhere, it is so there too.
    span = _span(window)
    low = _slide(value, span, np.minimum)
    low = _slide(np.concatenate([np.zeros(span - 1, np.uint64), low]), span, np.maximum)[:n]
    repeats = np.zeros(n + 1, bool)
    repeats[at] = True
    begins |= repeats[:n] & (value == low)
    start = np.flatnonzero(begins)
    ends = np.flatnonzero(repeats[:n] & ~(repeats[1:] & np.append(words.doc[1:] == words.doc[:-1], False)))
    length = np.minimum(ends[np.searchsorted(ends, start)] - start + window, most) if len(start) else start
    # Equal suffixes by a polynomial of their words' hashes.
    r = np.uint64(0x9E3779B97F4A7C15)
    up, down = np.full(n + 1, r, np.uint64), np.full(n + 1, np.uint64(pow(int(r), -1, 1 << 64)), np.uint64)
    up[0] = down[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words.hash) * np.cumprod(up)[:n], dtype=np.uint64)])
    content = mix((sums[start + length] - sums[start]) * np.cumprod(down)[start]) ^ mix(length.astype(np.uint64))
    order = np.lexsort((start, content))
    start, length, content = start[order], length[order], content[order]
    new = np.ones(len(start), bool)
    new[1:] = content[1:] != content[:-1]
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(start)))
    common = before[start[first]] if len(first) else np.zeros(0, np.uint64)
    common[(np.cumsum(new) - 1)[before[start] != np.repeat(common, times)]] = 0
    flat = np.arange(length[first].sum()) + np.repeat(start[first] - (np.cumsum(length[first]) - length[first]), length[first])
    doc = words.doc[start]
    vocabulary, word = np.unique(w.chunk.vocabulary >> np.uint64(TREE_DROPS), return_inverse=True)
    ids = w.chunk.ids
    return Suffixes(vocabulary, word.astype(np.int32)[w.chunk.place][flat], length[first], common, times, doc.astype(np.int64), start - words.starts[doc] if len(start) else start, ids[doc] if len(start) else start)


class SuffixTree:
    """The suffix tree of a group below ``window`` words: nodes by depth, interval of suffixes in the order of
    their words, parent (-1: none), least and greatest id, times, and the word before, 0 if it differs."""

    def __init__(self, s: Suffixes, window: int):
        self.suffixes, n = s, len(s.lengths)
        width = int(s.lengths.max())
        rows = np.zeros((n, width), ">u4")
        begin = np.cumsum(s.lengths) - s.lengths
        row = np.repeat(np.arange(n), s.lengths)
        rows[row, np.arange(len(row)) - begin[row]] = s.words + 1
        self.order = order = np.argsort(rows.view(f"S{4 * width}").ravel(), kind="stable")
        rows = rows[order]
        same = (rows[1:] == rows[:-1]) & (rows[1:] != 0)
        common = np.where(same.all(1), width, same.argmin(1)) if n > 1 else np.zeros(0, np.int64)
        common[common < window] = 0
        self._build(common.tolist(), n)
        first = np.cumsum(s.times) - s.times
        least, most = np.minimum.reduceat(s.id, first)[order], np.maximum.reduceat(s.id, first)[order]
        self.row_least, self.row_most = least, most
        m = len(self.depth)
        self.least, self.most, self.times = np.full(m, np.iinfo(np.int64).max), np.full(m, np.iinfo(np.int64).min), np.zeros(m, np.int64)
        low, high = np.full(m, np.iinfo(np.uint64).max, np.uint64), np.zeros(m, np.uint64)
        has = np.flatnonzero(self.leaf >= 0)
        for mine, of, rows_ in ((self.least, np.minimum, least), (self.most, np.maximum, most), (self.times, np.add, s.times[order]), (low, np.minimum, s.common[order]), (high, np.maximum, s.common[order])):
            of.at(mine, self.leaf[has], rows_[has])
        # Children end before their parents.
        for k in self.ended:
            up = self.parent[k]
            if up >= 0:
                self.least[up], self.most[up] = min(self.least[up], self.least[k]), max(self.most[up], self.most[k])
                self.times[up] += self.times[k]
                low[up], high[up] = min(low[up], low[k]), max(high[up], high[k])
        self.common = np.where(low == high, low, 0)

    def _build(self, common: list[int], n: int) -> None:
        """Nodes from the common prefixes of neighbours, by a stack of those that are still open."""
        depth, left, right, parent, ended, leaf, stack = [], [], [], [], [], [-1] * n, []
        for i in range(1, n + 1):
            now = common[i - 1] if i < n else 0
            top = depth[stack[-1]] if stack else 0
            if now <= top and stack:
                leaf[i - 1] = stack[-1]
            begin, last = i - 1, -1
            while stack and depth[stack[-1]] > now:
                last = stack.pop()
                right[last], begin = i - 1, left[last]
                ended.append(last)
                if stack and depth[stack[-1]] >= now:
                    parent[last], last = stack[-1], -1
            if now > (depth[stack[-1]] if stack else 0):
                depth.append(now), left.append(begin), right.append(0), parent.append(-1)
                stack.append(len(depth) - 1)
                if last >= 0:
                    parent[last] = stack[-1]
                if now > top:
                    leaf[i - 1] = stack[-1]
        self.depth, self.left, self.right, self.parent, self.leaf, self.ended = (np.array(x, np.int64) for x in (depth, left, right, parent, leaf, ended))

    def reach(self) -> np.ndarray:
        """For each occurrence how many of its words a smaller id has too: the depth of the deepest node above it."""
        s = self.suffixes
        back = np.empty(len(self.order), np.int64)
        back[self.order] = np.arange(len(self.order))
        row = np.repeat(back, s.times)
        own = s.id > self.row_least[row]
        out = np.where(own, np.repeat(s.lengths, s.times), 0)
        at = np.where(own, -1, self.leaf[row])
        while (open_ := np.flatnonzero(at >= 0)).size:
            node = at[open_]
            hit = self.least[node] < s.id[open_]
            out[open_[hit]] = self.depth[node[hit]]
            at[open_] = np.where(hit, -1, self.parent[node])
        return out

    def maximal(self, most: int) -> Iterator[dict]:
        """Nodes of several documents that different words precede."""
        s = self.suffixes
        first = np.cumsum(s.times) - s.times

        def found(rows: np.ndarray, depth: int, times: int) -> dict:
            row = self.order[rows[self.row_least[rows].argmin()]]
            at = first[row] + s.id[first[row] : first[row] + s.times[row]].argmin()
            return {"n_words": int(depth), "n_times": int(times), "doc_id": int(s.id[at]), "start": int(s.start[at]), "cut": bool(depth == most)}

        for k in np.flatnonzero((self.least < self.most) & (self.common == 0)):
            yield found(np.arange(self.left[k], self.right[k] + 1), self.depth[k], self.times[k])
        # A suffix that several documents of one chunk share, and no other chunk has whole.
        whole = np.zeros(len(self.order), np.int64)
        whole[self.leaf >= 0] = self.depth[self.leaf[self.leaf >= 0]]
        length = s.lengths[self.order]
        for i in np.flatnonzero((whole < length) & (self.row_least < self.row_most) & (s.common[self.order] == 0)):
            yield found(np.array([i]), length[i], s.times[self.order[i]])


def _joined(rows: list[dict]) -> tuple[Suffixes, list[int]]:
    """The suffixes of several chunks, and how many occurrences each has."""
    each = [Suffixes.unpacked(r) for r in rows]
    vocabulary, place = np.unique(np.concatenate([x.vocabulary for x in each]), return_inverse=True)
    first = np.cumsum([0] + [len(x.vocabulary) for x in each])
    words = np.concatenate([place[x.words + a] for x, a in zip(each, first)])
    return Suffixes(vocabulary, words, *(np.concatenate([getattr(x, k) for x in each]) for k in ("lengths", "common", "times", "doc", "start", "id"))), [len(x.id) for x in each]


def _cuts(window: int):
    """The tree of a group; for each chunk the spans of words that it loses."""
    schema = pa.schema({"chunk": pa.int64(), "doc": pa.binary(), "start": pa.binary(), "length": pa.binary()})

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        s, sizes = _joined(rows)
        length, out, first = SuffixTree(s, window).reach(), [], 0
        for r, n in zip(rows, sizes):
            at = first + np.flatnonzero(length[first : first + n])
            first += n
            if len(at):
                out.append({"chunk": r["chunk"], "doc": packing.pack_ints(s.doc[at]), "start": packing.pack_ints(s.start[at]), "length": packing.pack_ints(length[at])})
        return pa.Table.from_pylist(out, schema=schema)

    return run


REPEATS = "n_words long, n_times long, doc_id long, start long, cut boolean"


def _nodes(window: int, most: int):
    schema = pa.schema({"n_words": pa.int64(), "n_times": pa.int64(), "doc_id": pa.int64(), "start": pa.int64(), "cut": pa.bool_()})

    def run(group: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(list(SuffixTree(_joined(group.to_pylist())[0], window).maximal(most)), schema=schema)

    return run


LOST = "doc_id long, text_hash long, n_removed long, spans binary"


def _lost(group: pa.Table) -> pa.Table:
    """The documents of a chunk that lose words, and which: first word and end of each span, in a row."""
    rows = group.to_pylist()
    row = next(r for r in rows if r["ids"] is not None)
    ids, hashes, counts = packing.unpack(row["ids"], "<i8"), packing.unpack(row["hashes"], "<i8"), packing.unpack_ints(row["lengths"]).astype(np.int64)
    starts = np.cumsum(counts) - counts
    edge = np.zeros(int(counts.sum()) + 1, np.int64)
    for r in rows:
        if r["ids"] is None:
            doc, start, length = (packing.unpack_ints(r[k]).astype(np.int64) for k in ("doc", "start", "length"))
            np.add.at(edge, starts[doc] + start, 1)
            np.add.at(edge, starts[doc] + start + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    out = []
    for i, (a, n) in enumerate(zip(starts.tolist(), counts.tolist())):
        spans = np.flatnonzero(np.diff(gone[a : a + n], prepend=False, append=False))
        if len(spans):
            out.append({"doc_id": int(ids[i]), "text_hash": int(hashes[i]), "n_removed": int((spans[1::2] - spans[::2]).sum()), "spans": packing.pack_ints(spans)})
    return pa.Table.from_pylist(out, schema=_schema(LOST))


def _rewritten(rows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_removed, spans, text) -> the words kept, joined by spaces, instead of the spans and the text."""
    schema = _schema("doc_id long, text_hash long, n_removed long, kept string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in packing.chunks(batches, 4):
            kept = []
            for packed, text in zip(chunk.column(3).to_pylist(), packing.text_bytes(chunk.column(4))):
                words, cut = packing.words_of(text, False), [0, *packing.unpack_ints(packed).tolist()]
                rest = [w for a, b in zip(cut[::2], [*cut[1::2], len(words)]) for w in words[a:b]]
                kept.append(b" ".join(rest).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*chunk.columns[:3], pa.array(kept, pa.string())], schema=schema)

    return rows.select("doc_id", "text_hash", "n_removed", "spans", "text").mapInArrow(run, "doc_id long, text_hash long, n_removed long, kept string")


def _split(suffixes: DataFrame, work: Workspace, window: int) -> DataFrame:
    """Groups of more than twice ``GROUP_WORDS`` are split by longer prefixes."""
    for step, prefix in enumerate((max(1, window // 2), window)):
        parts = F.ceil(F.sum("n_words") / GROUP_WORDS).alias("parts")
        large = suffixes.groupBy("place").agg(parts).filter("parts > 2")
        if not large.take(1):
            break

        def run(batches: Iterator[pa.RecordBatch], prefix=prefix) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    yield pa.RecordBatch.from_pylist(Suffixes.unpacked(r).placed(r["chunk"], prefix, r["place"], int(r["parts"])) if r["parts"] else [{k: r[k] for k in _ARROW.names}], schema=_ARROW)

        suffixes = work.save(suffixes.join(large, "place", "left").mapInArrow(run, SUFFIXES), f"suffixes{step + 1}")
    return suffixes


def _scanned(docs: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written: the rows of documents, the chunks without their words, and, until the suffixes are known, with them."""
    both = work.save(scan(docs), "scanned")
    rows = work.save(both.filter("words is null").select("doc_id", "text_hash", "n_words", "kept_sha256"), "rows")
    chunks = both.filter("words is not null")
    return rows, work.save(chunks.select("chunk", "ids", "hashes", "lengths"), "slim"), chunks.select(*CHUNK)


def _suffixes(rows: DataFrame, chunks: DataFrame, work: Workspace, window: int, most: int, every: bool = False) -> DataFrame:
    """The suffixes of all chunks, by group."""
    total = rows.agg(F.sum("n_words")).first()[0] or 0
    # Of the words one in a quarter of a window begins an anchor.
    anchor_shards = max(1, round(total / max(1, window // 4) / SHARD_WINDOWS))
    shards, groups = max(1, round(total / 2 / SHARD_WINDOWS)), max(1, round(total * 2 / GROUP_WORDS))
    anchors = _ask_anchors(chunks, window, anchor_shards).groupBy("shard").applyInArrow(_repeated_anchors, "chunk long, shard long, anchors binary")
    anchors = work.save(anchors, "anchors")
    # Both times the chunks are shuffled alike, so that Spark does it once.
    by_chunk = chunks.groupBy("chunk")
    windows = by_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(_ask_windows(window, anchor_shards, shards), WINDOWS)
    bits = windows.groupBy("shard").applyInArrow(_repeats(every), "chunk long, shard long, windows binary, back binary")
    answers = anchors.unionByName(bits, allowMissingColumns=True)
    suffixes = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(_chosen(window, most, anchor_shards, shards, groups), SUFFIXES)
    suffixes = work.save(suffixes, "suffixes0")
    work.drop("scanned")
    del by_chunk, windows, bits, answers
    tidy(rows.sparkSession)
    return _split(suffixes, work, window)


def _cut(docs: DataFrame, rows: DataFrame, slim: DataFrame, chunks: DataFrame, work: Workspace, window: int, most: int | None) -> DataFrame:
    """The documents that lose words: doc_id, text_hash, n_removed, kept."""
    suffixes = _suffixes(rows, chunks, work, window, max(most or 0, window + _span(window)))
    cuts = suffixes.groupBy("place").applyInArrow(_cuts(window), "chunk long, doc binary, start binary, length binary")
    lost = work.save(slim.unionByName(cuts, allowMissingColumns=True).groupBy("chunk").applyInArrow(_lost, LOST), "lost")
    del suffixes, cuts
    for k in range(3):
        work.drop(f"suffixes{k}")
    tidy(docs.sparkSession)
    lost = lost.dropDuplicates(["doc_id", "text_hash"])
    texts = maybe(_keyed(docs), "text_hash", lost.select("text_hash").distinct(), lost.count(), "may").filter("may").drop("may")
    # What is lost grows with the input, so it is not broadcast at any size.
    return _rewritten(texts.join(lost.hint("merge"), ["doc_id", "text_hash"])).dropDuplicates(["doc_id", "text_hash"])


def maximal_repeats(docs: DataFrame, window: int = 50, most: int | None = None) -> DataFrame:
    """Word sequences of ``window`` or more words in several documents that occur fewer times with any word
    more before or behind: n_words, n_times (occurrences), doc_id and start (the first word's place) of one in
    the document with the least id. Depths end at ``most`` words (two windows at least); such rows are ``cut``."""
    work, most = Workspace(docs.sparkSession, "repeats"), max(most or 0, window + _span(window))
    rows, _, chunks = _scanned(docs, work)
    suffixes = _suffixes(rows, chunks, work, window, most, every=True)
    return suffixes.groupBy("place").applyInArrow(_nodes(window, most), REPEATS)


def digests(docs: DataFrame, window: int = 50, most: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256."""
    work = Workspace(docs.sparkSession, "substrings")
    rows, slim, chunks = _scanned(docs, work)
    cut = _cut(docs, rows, slim, chunks, work, window, most).select("doc_id", "text_hash", "n_removed", F.sha2("kept", 256).alias("cut_sha256"))
    return rows.join(cut, ["doc_id", "text_hash"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("cut_sha256", "kept_sha256").alias("kept_sha256")
    )


def dedup(docs: DataFrame, window: int = 50, most: int | None = None) -> DataFrame:
    """``docs`` with each text that loses words replaced by the words kept; all columns and rows stay."""
    work = Workspace(docs.sparkSession, "substrings")
    cut = work.save(_cut(docs, *_scanned(docs, work), work, window, most), "cut")
    own, hashed = uuid.uuid4().hex, uuid.uuid4().hex  # no columns of docs have these names
    rows = docs.withColumn(hashed, F.coalesce(F.xxhash64("text"), F.lit(0)))
    rows = maybe(rows, hashed, cut.select("text_hash").distinct(), cut.count(), own)
    found = cut.select(F.struct("doc_id", "text_hash", "kept").alias("_cut"))
    # Only rows that may lose words are shuffled.
    hit = (F.col("doc_id") == F.col("_cut.doc_id")) & (F.col(hashed) == F.col("_cut.text_hash"))
    changed = rows.filter(own).select(F.struct("*").alias("_row"), "doc_id", hashed).join(found, hit, "left")
    changed = changed.select(*[F.coalesce("_cut.kept", "_row.text").alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
    return rows.filter(~F.col(own)).select(*docs.columns).unionByName(changed)
