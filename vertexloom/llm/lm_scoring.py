"""Language-model scores by stupid backoff over n-gram count tables.

Documents are taken up in chunks. A chunk's exploded n-grams of all orders are grouped by n-gram
before they are sent, so that a frequent n-gram is one entry a chunk, and packed by shard, a range
of the n-gram's hash. A shard is one partition of the count tables: its task adds up the counts of
all chunks and joins them to the n-grams that each chunk asks for. Chunks then sum the logarithms of
each document's backoff scores.

A hash has as many bits as the corpus needs for one n-gram in 2^24 to share its own by chance, 64 at
most. Many n-grams occur in one chunk only, whose own count is then the whole one: shards answer which
n-grams other chunks have too, and the counts of these.

The score of a word after its n-1 words before is count(n-gram) / count(context) for the longest
n-gram with a count, times ``alpha`` for each order that was skipped; that of a single word is
count / number of words, and that of an unknown word alpha / (number of words + 1). With
``leave_out`` a document's own counts are subtracted, so that it is scored by the other documents.
Words are lower-cased (A-Z). N-grams don't cross documents.

Null and empty texts have no words and score null. Every row is scored for itself, also rows with
null or repeated ids; a repeated row counts as another document. An empty table gives no rows. A text
of any length is scored whole, a long one as a chunk of its own. Columns other than doc_id and text are
not looked at, whatever their names. N-grams are equal if their hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm import packing
from vertexloom.llm.packing import Words, mix
from vertexloom.llm.workspace import Workspace

#: N-grams of a shard, about; bytes of text of a chunk, whose repeated n-grams are sent once.
SHARD_NGRAMS, CHUNK_BYTES = 2_000_000, 6 << 20
#: Bits that a hash has beyond the logarithm of the number of n-grams.
SPARE_BITS = 24

CHUNK = pa.schema({"chunk": pa.int64(), "n_words": pa.int64(), "doc_id": pa.list_(pa.int64()), "texts": pa.binary(), "ends": pa.list_(pa.int64())})


class _Ngrams:
    """The n-grams of a chunk: for each order where they end, the distinct ones (hashes whose first ``bits``
    bits count, in ascending order) and their counts."""

    def __init__(self, row: dict, order: int, bits: int):
        data, ends = packing.unpack(row["texts"], "u1").tobytes(), [0, *row["ends"]]
        self.words = words = Words([data[a:b] for a, b in zip(ends, ends[1:])], lower=True)
        del data
        drop = np.uint64(64 - bits)
        self.at, self.node, keys, counts = [], [], [], []
        for n in range(1, order + 1):
            start = np.flatnonzero(words.room(n))
            self.at.append(start + n - 1)
            k, node, c = np.unique(mix(words.ngrams(n)[start] + np.uint64(n)) >> drop << drop, return_inverse=True, return_counts=True)
            self.node.append(node + sum(map(len, keys)))
            keys.append(k)
            counts.append(c)
        # Of all orders together; equal hashes of different orders are one.
        self.keys, place = np.unique(np.concatenate(keys), return_inverse=True)
        self.counts = np.bincount(place, np.concatenate(counts), minlength=len(self.keys)).astype(np.int64)
        self.node = [place[node] for node in self.node]

    def own(self) -> list[np.ndarray]:
        """How often each n-gram occurs in its own document, by order."""
        out, docs = [], len(self.words.counts)
        for at, node in zip(self.at, self.node):
            _, back, count = np.unique(node * docs + self.words.doc[at], return_inverse=True, return_counts=True)
            out.append(count[back])
        return out


def _gather(docs: DataFrame, first: int = 0) -> DataFrame:
    """Chunks of texts, numbered from ``first``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = first + (TaskContext.get().partitionId() << 32)
        for chunk in packing.chunks(batches, 1, CHUNK_BYTES):
            texts = [t or b"" for t in packing.text_bytes(chunk.column(1))]
            row = {
                "chunk": number, "n_words": sum(len(t.split()) for t in texts), "doc_id": chunk.column(0).to_pylist(),
                "texts": packing.pack(np.frombuffer(b"".join(texts), "u1"), 3), "ends": np.cumsum([len(t) for t in texts]).tolist(),
            }
            yield pa.RecordBatch.from_pylist([row], schema=CHUNK)
            number += 1

    return docs.select("doc_id", "text").mapInArrow(run, "chunk long, n_words long, doc_id array<long>, texts binary, ends array<long>")


def _send(gathered: DataFrame, order: int, shards: int, bits: int, first_train: int) -> DataFrame:
    """For each chunk and shard its distinct n-grams and their counts, 0 where other texts are counted."""
    schema = pa.schema({"chunk": pa.int64(), "shard": pa.int64(), "keys": pa.binary(), "counts": pa.binary()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = _Ngrams(row, order, bits)
                counts = x.counts if not first_train or row["chunk"] >= first_train else np.zeros_like(x.counts)
                each = [(s, packing.pack_sorted(x.keys[a] >> np.uint64(64 - bits)), packing.pack_ints(counts[a])) for s, a in packing.by_shard(x.keys, shards)]
                yield pa.RecordBatch.from_pydict({"chunk": [row["chunk"]] * len(each), "shard": [e[0] for e in each], "keys": [e[1] for e in each], "counts": [e[2] for e in each]}, schema=schema)

    return gathered.mapInArrow(run, "chunk long, shard long, keys binary, counts binary")


def _answer(group: pa.Table) -> pa.Table:
    """The counts of a shard, joined to what each chunk asks for: which of its n-grams other chunks have
    too, and the counts of these."""
    keys = [packing.unpack_sorted(k) for k in group["keys"].to_pylist()]
    flat, count = np.concatenate(keys), np.concatenate([packing.unpack_ints(c) for c in group["counts"].to_pylist()])
    order = np.argsort(flat, kind="stable")
    new = np.ones(len(flat), bool)
    new[1:] = flat[order][1:] != flat[order][:-1]
    several, total = np.empty(len(flat), bool), np.empty(len(flat), np.uint64)
    several[order] = ~(new & np.append(new[1:], True))
    total[order] = np.add.reduceat(count[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    cut = np.cumsum([len(k) for k in keys])[:-1]
    answers = [(packing.pack_bits(w), packing.pack_ints(t[w])) for w, t in zip(np.split(several, cut), np.split(total, cut))]
    return pa.table({"chunk": group["chunk"], "shard": group["shard"], "which": pa.array([a[0] for a in answers], pa.binary()), "counts": pa.array([a[1] for a in answers], pa.binary())})


def _score(order: int, shards: int, bits: int, total: int, alpha: float, leave_out: bool):
    schema = pa.schema({"doc_id": pa.int64(), "n_words": pa.int64(), "log_score": pa.float64(), "n_backed_off": pa.int64()})

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        chunk = next(r for r in rows if r["texts"] is not None)
        x = _Ngrams(chunk, order, bits)
        # What no other chunk has occurs here only, or not at all in texts that are counted.
        counts = x.counts.astype(np.int64) if leave_out else np.zeros(len(x.keys), np.int64)
        place = dict(packing.by_shard(x.keys, shards))
        for r in rows:
            if r["texts"] is None:
                at = place[r["shard"]]
                counts[at][packing.unpack_bits(r["which"], at.stop - at.start)] = packing.unpack_ints(r["counts"]).astype(np.int64)
        words, n = x.words, len(x.words.hash)
        own = x.own() if leave_out else [np.zeros(len(a), np.int64) for a in x.at]
        seen = [counts[node] - o for node, o in zip(x.node, own)]
        size = total - (words.counts[words.doc] if leave_out else 0) + np.zeros(n)
        score = np.where(seen[0] > 0, seen[0] / np.maximum(size, 1), alpha / (np.maximum(size, 0) + 1))
        used = np.ones(n, np.int64)
        for k in range(1, order):
            # The n-gram of k + 1 words that ends here, and its context of k words that ends one before.
            context = np.zeros(n, np.int64)
            context[x.at[k - 1]] = seen[k - 1]
            at = x.at[k]
            found = seen[k] > 0
            score[at] = np.where(found, seen[k] / np.maximum(context[at - 1], 1), alpha * score[at])
            used[at[found]] = k + 1
        room = np.minimum(np.arange(n) - words.starts[words.doc] + 1, order) if n else used
        docs = len(words.counts)
        sums = np.bincount(words.doc, np.log(score), minlength=docs)
        backed = np.bincount(words.doc[used < room], minlength=docs)
        logs = [float(s) if c else None for s, c in zip(sums, words.counts)]
        return pa.Table.from_pydict({"doc_id": chunk["doc_id"], "n_words": words.counts, "log_score": logs, "n_backed_off": backed}, schema=schema)

    return run


def scores(docs: DataFrame, train: DataFrame | None = None, order: int = 3, alpha: float = 0.4) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, log_score (sum of natural logarithms), n_backed_off
    (words scored by less than the longest n-gram there is room for). The counts are those of ``train``;
    without it, those of all other rows of ``docs``."""
    work, first_train = Workspace(docs.sparkSession, "lm"), 1 << 62 if train is not None else 0
    asking = work.save(_gather(docs), "chunks")
    telling = work.save(_gather(train, first_train), "train") if train is not None else asking
    total = telling.agg(F.sum("n_words")).first()[0] or 0
    shards = max(1, round(total * order / SHARD_NGRAMS))
    bits = min(64, max(32, (total * order).bit_length() + SPARE_BITS))
    every = asking if train is None else asking.unionByName(telling)
    sent = _send(every, order, shards, bits, first_train)
    answers = sent.groupBy("shard").applyInArrow(_answer, "chunk long, shard long, which binary, counts binary")
    if train is not None:
        answers = answers.filter(F.col("chunk") < first_train)
    both = asking.unionByName(answers, allowMissingColumns=True)
    return both.groupBy("chunk").applyInArrow(_score(order, shards, bits, total, alpha, train is None), "doc_id long, n_words long, log_score double, n_backed_off long")
