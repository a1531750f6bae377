"""Training-order materialisation: token sequences in fixed-stride shards, in a keyed random order.

Texts are encoded and cut into sequences of ``length`` tokens, the last one of a text padded. Sequence
p of a document has the number (doc_id - least id) * parts + p, where parts is how many the longest
text can have; it depends on the data alone, so a task that is run again deals its sequences to the
same places, and no pass over the texts only counts. A Feistel network over the least even number of
bits that holds all numbers permutes them under a key; results that are too large go through it again
until they fit (cycle-walking), which permutes exactly the numbers of the domain. The permuted number
is the sequence's global slot; key and number alone give it. Equal ranges of slots are the shards: a task
gets one range, sorts it and writes it as one file of records of one stride. Numbers that short
documents don't use leave slots empty; these have no record, so a sequence also has a position, its place
among the records of all shards, which the files' sizes and arithmetic give.

A record is the slot and doc_id (int64, little endian), part (int32), number of tokens (int32), a flag
byte (1: the row has an id), the tokens (uint16, padded with ``PAD``) and a line feed, which lets Spark's
own writer commit the files to any store it can write to. Shards are written as ``shard=<s>/part-*``.
A reader's tasks seek to ranges of positions; nothing before the first wanted one is read.

Null and empty texts give no sequence; a text of any length is encoded whole. Rows with a null id are
numbered by their text's hash; these and rows that share an id may have equal slots, and then stand side by
side, ordered by their records. Ids so far apart that their numbers need more than 62 bits are hashed first.
An empty table gives no shard. Columns other than doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vertexloom.llm import packing
from vertexloom.llm.bpe import load_vocabulary
from vertexloom.llm.workspace import ship
from vertexloom.sources.csrbin import open_path

HEAD, PAD, ROUNDS = 25, 50256, 6
#: Records of a reading task, and of a batch of it.
TASK_RECORDS, BATCH_RECORDS = 200_000, 20_000


def permute(numbers: np.ndarray, total: int, key: int) -> np.ndarray:
    """The slots of some numbers below ``total``; numbers below it have slots below it, each its own."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    with np.errstate(over="ignore"):
        keys = packing.mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (1 << 64) - 1))
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in keys:
            left, right = right, left ^ packing.mix(right ^ k) & mask
        out[todo] = left << shift | right
        todo = todo[out[todo] >= np.uint64(total)]
    return out.astype(np.int64)


@lru_cache(2)
def _encoding(content: bytes, pattern: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _numbers(docs: DataFrame, length: int) -> tuple[DataFrame, int, int]:
    """Rows (first, doc_id, text), where ``first`` numbers a row's first sequence; the number of numbers, and
    of bytes of text."""
    t = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.max(F.octet_length("text")).alias("longest"), F.sum(F.octet_length("text")).alias("bytes")).first()
    # A token has a byte at least.
    parts = max(1, -(-(t["longest"] or 0) // length))
    a, b = t["a"] or 0, t["b"] or 0
    wide = (b - a + 1) * parts >= 1 << 62
    span = (1 << 62) // parts if wide else b - a + 1
    hashed = F.pmod(F.coalesce(F.xxhash64("doc_id") if wide else F.lit(None).cast("long"), F.xxhash64("text")), F.lit(span))
    place = hashed if wide else F.coalesce(F.col("doc_id") - F.lit(a), hashed)
    return docs.select((place * parts).alias("first"), "doc_id", "text"), span * parts, t["bytes"] or 0


def sequences(rows: DataFrame, path: str, pattern: str, length: int, domain: int, shards: int, key: int) -> DataFrame:
    """The sequences of each text, with their shard and slot (``number``, permuted), compressed."""
    content = load_vocabulary(rows, path)
    schema = pa.schema({"shard": pa.int32(), "number": pa.int64(), "doc_id": pa.int64(), "part": pa.int32(), "n_tokens": pa.int32(), "tokens": pa.binary()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(content.value, pattern)
        pack = zstandard.ZstdCompressor(1, write_content_size=True, write_checksum=False).compress
        for chunk in packing.chunks(batches, 2, 2 << 20):
            out = []
            for first, doc_id, raw in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist(), packing.text_bytes(chunk.column(2))):
                if raw:
                    tokens = encoding.encode_to_numpy(raw.decode("utf-8", "replace"), allowed_special=set(), disallowed_special=()).astype("<u2")
                    for part, at in enumerate(range(0, len(tokens), length)):
                        own = tokens[at : at + length]
                        out.append((first + part, doc_id, part, len(own), pack(own.tobytes())))
            number = permute(np.array([o[0] for o in out], np.uint64), domain, key)
            shard = [int(x) * shards // domain for x in number.tolist()]
            rest = {k: [o[i] for o in out] for i, k in enumerate(("doc_id", "part", "n_tokens", "tokens"), 1)}
            yield pa.RecordBatch.from_pydict({"shard": shard, "number": number, **rest}, schema=schema)

    return rows.mapInArrow(run, "shard int, number long, doc_id long, part int, n_tokens int, tokens binary")


def _records(length: int):
    """Rows of ``sequences`` to (shard, number, value): the records without their line feed."""
    stride = HEAD + 2 * length + 1
    kind = np.dtype([("slot", "<i8"), ("doc_id", "<i8"), ("part", "<i4"), ("n", "<i4"), ("known", "u1"), ("tokens", "<u2", (length,)), ("end", "u1")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out = np.zeros(b.num_rows, kind)
            out["slot"] = b.column(1).to_numpy()
            out["doc_id"], out["known"] = b.column(2).fill_null(0).to_numpy(), b.column(2).is_valid().to_numpy(zero_copy_only=False)
            out["part"], out["n"], out["tokens"] = b.column(3).to_numpy(), b.column(4).to_numpy(), PAD
            for i, packed in enumerate(b.column(5).to_pylist()):
                own = np.frombuffer(unpack(packed), "<u2")
                out["tokens"][i, : len(own)] = own
            data = pa.py_buffer(np.ascontiguousarray(out.view((np.uint8, stride))[:, : stride - 1]).tobytes())
            ends = pa.py_buffer((np.arange(b.num_rows + 1, dtype=np.int32) * (stride - 1)).tobytes())
            value = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, ends, data])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), value], names=["shard", "number", "value"])

    return run


def write_shards(docs: DataFrame, folder: str, path: str, pattern: str, length: int = 256, key: int = 20240229, shard_bytes: int = 32 << 20) -> dict:
    """Write all shards, of about ``shard_bytes``, below ``folder``; returns what a reader needs to know."""
    rows, domain, size = _numbers(docs, length)
    stride = HEAD + 2 * length + 1
    shards = max(1, -(-size // shard_bytes))  # about a byte of record for a byte of text
    layout = {"folder": folder, "length": length, "stride": stride, "total": 0, "shards": [], "files": [], "starts": []}
    if not size:
        return layout
    dealt = sequences(rows, path, pattern, length, domain, shards, key).repartitionById(shards, "shard")
    made = dealt.mapInArrow(_records(length), "shard int, number long, value binary").sortWithinPartitions("shard", "number", "value")
    made.select("shard", F.col("value").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").text(folder)
    return read_layout(docs.sparkSession, folder, length)


def read_layout(spark: SparkSession, folder: str, length: int) -> dict:
    """What a reader needs to know of written shards: each file, and the position of its first record."""
    stride = HEAD + 2 * length + 1
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(folder).select("path", "length").collect()
    found = sorted((int(f["path"].rpartition("shard=")[2].partition("/")[0]), f["path"], f["length"] // stride) for f in files)
    starts = np.cumsum([0] + [n for *_, n in found]).tolist()
    return {"folder": folder, "length": length, "stride": stride, "total": starts[-1], "shards": [s for s, *_ in found], "files": [p for _, p, _ in found], "starts": starts[:-1]}


READ = "position long, slot long, shard long, record long, doc_id long, part int, n_tokens int, tokens binary"


@dataclass
class _Range(InputPartition):
    shard: int
    file: str
    start: int
    first: int
    stop: int


class ShardReader(DataSourceReader):
    """Tasks read ranges of positions of one shard each."""

    def __init__(self, options: dict):
        self.ranges, self.stride = [_Range(*r) for r in json.loads(options["ranges"])], int(options["stride"])

    def partitions(self) -> list[_Range]:
        return self.ranges or [_Range(0, "", 0, 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        kind = np.dtype([("slot", "<i8"), ("doc_id", "<i8"), ("part", "<i4"), ("n", "<i4"), ("known", "u1"), ("rest", "u1", (self.stride - HEAD,))])
        if part.stop <= part.first:
            return
        fs, path = open_path(part.file)
        with fs.open_input_file(path) as file:
            for first in range(part.first, part.stop, BATCH_RECORDS):
                stop = min(first + BATCH_RECORDS, part.stop)
                file.seek((first - part.start) * self.stride)
                r = np.frombuffer(file.read((stop - first) * self.stride), kind)
                position = np.arange(first, stop)
                tokens = [x[: 2 * n].tobytes() for x, n in zip(r["rest"], r["n"].tolist())]
                columns = [pa.array(position), pa.array(r["slot"].copy()), pa.array(np.full(len(r), part.shard)), pa.array(position - part.start), pa.array(r["doc_id"].copy(), mask=r["known"] == 0), pa.array(r["part"].copy()), pa.array(r["n"].copy()), pa.array(tokens, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["position", "slot", "shard", "record", "doc_id", "part", "n_tokens", "tokens"])


class ShardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tokenshards"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> DataSourceReader:
        return ShardReader(self.options)


def read_shards(spark: SparkSession, layout: dict, first: int = 0, count: int | None = None) -> DataFrame:
    """The sequences at positions ``first`` to ``first + count - 1``; tasks seek to them by the stride."""
    stop, ranges = layout["total"] if count is None else min(layout["total"], first + count), []
    for shard, file, start, end in zip(layout["shards"], layout["files"], layout["starts"], [*layout["starts"][1:], layout["total"]]):
        for a in range(max(start, first), min(end, stop), TASK_RECORDS):
            ranges.append((shard, file, start, a, min(a + TASK_RECORDS, end, stop)))
    ship(spark)
    spark.dataSource.register(ShardSource)
    return spark.read.format("tokenshards").options(ranges=json.dumps(ranges), stride=str(layout["stride"])).load()
