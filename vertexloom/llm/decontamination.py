"""Benchmark decontamination: short test items that are contained in documents.

Items are partitioned by size, the number n of distinct word shingles, into classes of sizes less
than 1.5 times apart. An item's MinHash sketch is the least s of its shingle hashes; s is the number
of shingles that the largest item of its class may lack, plus one, so that whoever contains the
wanted share of an item has a shingle of its sketch: the search loses no item. The sketches are an
index from shingles to items. Documents stream past it, however long; where a shingle is found, the
item's containment is then counted exactly, over all its shingles and the whole text.

The index of at most ``BLOCK_SHINGLES`` is broadcast; more items are taken in blocks of that size,
one pass over the documents each. There is no shuffle.

Words are lower-cased (A-Z). An item with fewer words than a shingle is one shingle, its whole
sequence of k words. With ``inside`` it is looked up among the k-word sequences of all texts; without,
it is only found in texts with just this sequence. Null and empty items are found
nowhere; null and empty texts contain nothing. Rows with null or repeated ids are treated each for
itself. An item is found from exactly the wanted share on. An empty table of items finds nothing and
cleans nothing away; an empty table of documents gives no rows. Texts of any length are searched whole, a
long one as a batch of its own. ``search`` looks at doc_id and text only; ``clean`` keeps all columns,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm import packing
from vertexloom.llm.packing import Words
from vertexloom.llm.workspace import ship

#: Shingles of the items that are looked for in one pass, 16 bytes each.
BLOCK_SHINGLES = 2_000_000


class Index:
    """The sketches and full shingle sets of a block of items."""

    def __init__(self, ids: list[int], texts: list[bytes | None], shingle: int, num: int, den: int, inside: bool = False):
        words = Words(texts, lower=True)
        sets, cuts = packing.distinct_sets(*words.shingles(shingle), len(ids))
        self.short = np.unique(words.counts[(words.counts > 0) & (words.counts < shingle)]).tolist() if inside else []
        self.ids, self.sizes, self.shingle = ids, np.diff(cuts), shingle
        self.needed = -(-self.sizes * num // den)
        upper = self._upper_sizes(int(self.sizes.max(initial=0)))
        # All items of a size class have sketches of one length.
        top = upper[np.searchsorted(upper, self.sizes)]
        sketch = np.minimum(top - (-(-top * num // den)) + 1, self.sizes)
        owner = np.repeat(np.arange(len(ids)), self.sizes)
        order = np.argsort(sets, kind="stable")
        self.tokens, self.owners = sets[order], owner[order]
        in_sketch = np.arange(len(sets)) - np.repeat(cuts[:-1], self.sizes) < np.repeat(sketch, self.sizes)
        self.sketches = np.unique(sets[in_sketch])
        self.coarse = np.zeros(1 << 22, bool)
        self.coarse[self.sketches >> np.uint64(42)] = True

    @staticmethod
    def _upper_sizes(largest: int) -> np.ndarray:
        out = [1]
        while out[-1] < largest:
            out.append(max(out[-1] + 1, out[-1] * 3 // 2))
        return np.array(out, np.int64)

    def search(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, items and the number of the item's shingles found, for enough of them."""
        words = Words(texts, lower=True)
        token, doc = words.shingles(self.shingle)
        for k in self.short:
            some, of = words.sequences(k)
            at = np.flatnonzero(self.coarse[some >> np.uint64(42)])
            at = at[np.isin(some[at], self.sketches)]
            token, doc = np.append(token, some[at]), np.append(doc, of[at])
        near = np.flatnonzero(self.coarse[token >> np.uint64(42)])
        near = near[np.isin(token[near], self.sketches)]
        hit = np.zeros(len(texts), bool)
        hit[doc[near]] = True
        # Exactly, over all shingles of the documents with a sketch's shingle.
        of = np.flatnonzero(hit[doc])
        of = of[np.isin(token[of], self.tokens)]
        sets, cuts = packing.distinct_sets(token[of], doc[of], len(texts))
        d = np.repeat(np.arange(len(texts)), np.diff(cuts))
        a, b = np.searchsorted(self.tokens, sets, "left"), np.searchsorted(self.tokens, sets, "right")
        at = np.arange((b - a).sum()) + np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a)
        pair, found = np.unique(np.repeat(d, b - a) * len(self.ids) + self.owners[at], return_counts=True)
        d, item = np.divmod(pair, max(1, len(self.ids)))
        ok = found >= self.needed[item]
        return d[ok], item[ok], found[ok]


def _blocks(benchmark: DataFrame, shingle: int, num: int, den: int, inside: bool) -> Iterator[Index]:
    """Indexes of blocks of items; the sizes of blocks are checked before a block is fetched."""
    ship(benchmark.sparkSession)
    items = benchmark.select("item_id", "text").filter("text is not null")
    weight = F.octet_length("text") / 4 + 1
    total = items.agg(F.sum(weight)).first()[0] or 0
    blocks = int(total // BLOCK_SHINGLES) + 1
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        yield Index([r["item_id"] for r in part], [r["text"].encode() for r in part], shingle, num, den, inside)


FOUND = pa.schema({"doc_id": pa.int64(), "item_id": pa.int64(), "n_found": pa.int64(), "n_item_shingles": pa.int64()})


def search(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, num: int = 4, den: int = 5, inside: bool = False) -> DataFrame:
    """A row for each document and item of which it contains num / den or more: doc_id, item_id,
    n_found, n_item_shingles, containment."""
    out = None
    for index in _blocks(benchmark, shingle, num, den, inside):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(chunk: pa.RecordBatch, shared=shared) -> Iterator[dict]:
            x = shared.value
            doc, item, found = x.search(packing.text_bytes(chunk.column(1)))
            ids = chunk.column(0).to_pylist()
            yield {"doc_id": [ids[i] for i in doc], "item_id": [x.ids[i] for i in item], "n_found": found, "n_item_shingles": x.sizes[item]}

        rows = docs.select("doc_id", "text").mapInArrow(packing.map_chunks(run, 1, FOUND), "doc_id long, item_id long, n_found long, n_item_shingles long")
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("containment", F.col("n_found") / F.col("n_item_shingles"))


def clean(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, num: int = 4, den: int = 5, inside: bool = False) -> DataFrame:
    """The rows of ``docs`` that contain no item."""
    text = docs.columns.index("text")
    for index in _blocks(benchmark, shingle, num, den, inside):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for chunk in packing.chunks(batches, text):
                keep = np.ones(chunk.num_rows, bool)
                keep[shared.value.search(packing.text_bytes(chunk.column(text)))[0]] = False
                yield chunk.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
