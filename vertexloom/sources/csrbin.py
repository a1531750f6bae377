"""CSR files: ``csr_vlist`` (offsets), ``csr_elist`` (int32 neighbours), ``csr_wlist`` (float32 weights),
and the same by destination, ``csc_vlist`` and ``csc_elist``.

The reader is a data source whose partitions are equal ranges of edge positions, so that a vertex
with very many edges is read by several tasks. A task finds the vertices of its range by bisecting
the offsets file, and reads just its slices. Files are opened through pyarrow's file systems, so the
folder may be local or in a store. Names may end in ``.bin`` or not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from vertexloom.functions import prefix
from vertexloom.operators import etl
from vertexloom.plans.workspace import ship

#: Edges, or vertices, of a partition.
EDGES_A_TASK = 8_000_000
BATCH = 1 << 20


def open_path(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path.removeprefix("file:"))


def _locate(path: str, name: str) -> str | None:
    """The file ``name`` in a folder, with or without the suffix."""
    fs, base = open_path(path)
    for full in (f"{base}/{name}.bin", f"{base}/{name}"):
        if fs.get_file_info(full).type == pa.fs.FileType.File:
            return full
    return None


class Numbers:
    """A file of numbers of one type, read by position."""

    def __init__(self, path: str, name: str, dtype: str):
        full = _locate(path, name)
        if full is None:
            raise FileNotFoundError(f"{path}/{name}.bin")
        fs, _ = open_path(path)
        self.dtype = np.dtype(dtype)
        self.file = fs.open_input_file(full)
        self.n = self.file.size() // self.dtype.itemsize

    def read(self, first: int, stop: int) -> np.ndarray:
        w = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((stop - first) * w, first * w), self.dtype)

    def bisect(self, value: int) -> int:
        """The first position whose number is larger than ``value``."""
        a, b = 0, self.n
        while a < b:
            m = (a + b) // 2
            if self.read(m, m + 1)[0] <= value:
                a = m + 1
            else:
                b = m
        return a


def offsets_type(path: str, long: bool | None = None, kind: str = "csr") -> str:
    """int32 or int64 offsets; without ``long`` the one whose last offset is the number of edges."""
    if long is not None:
        return "<i8" if long else "<i4"
    edges = Numbers(path, f"{kind}_elist", "<i4").n
    for dtype in ("<i4", "<i8"):
        x = Numbers(path, f"{kind}_vlist", dtype)
        if x.file.size() % x.dtype.itemsize == 0 and x.n and x.read(0, 1)[0] == 0 and x.read(x.n - 1, x.n)[0] == edges:
            return dtype
    raise ValueError("the last offset is not the number of edges")


@dataclass
class _Range(InputPartition):
    first: int
    stop: int


class CsrReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.weighted = options["path"], options.get("weighted", "false") == "true"
        self.kind = options.get("kind", "csr")
        self.dtype = offsets_type(self.path, None if "long" not in options else options["long"] == "true", self.kind)
        self.edges = Numbers(self.path, f"{self.kind}_elist", "<i4").n
        self.per_task = int(options.get("edgesPerTask", EDGES_A_TASK))
        if self.weighted and Numbers(self.path, "csr_wlist", "<f4").n != self.edges:
            raise ValueError("there are not as many weights as edges")

    def partitions(self) -> list[_Range]:
        return [_Range(a, min(a + self.per_task, self.edges)) for a in range(0, self.edges, self.per_task)] or [_Range(0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        offsets, targets = Numbers(self.path, f"{self.kind}_vlist", self.dtype), Numbers(self.path, f"{self.kind}_elist", "<i4")
        weights = Numbers(self.path, "csr_wlist", "<f4") if self.weighted else None
        for first in range(part.first, part.stop, BATCH):
            stop = min(first + BATCH, part.stop)
            low, high = offsets.bisect(first) - 1, offsets.bisect(stop - 1)
            ends = np.clip(offsets.read(low, high + 1), first, stop).astype(np.int64)
            own, other = np.repeat(np.arange(low, high), np.diff(ends)), targets.read(first, stop).astype(np.int64)
            columns = {"eid": np.arange(first, stop), "src": own if self.kind == "csr" else other, "dst": other if self.kind == "csr" else own}
            if weights:
                columns["w"] = weights.read(first, stop).astype(np.float64)
            yield pa.RecordBatch.from_pydict(columns)


class CsrSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "csrbin"

    def schema(self) -> str:
        return "eid bigint, src bigint, dst bigint" + (", w double" if self.options.get("weighted", "false") == "true" else "")

    def reader(self, schema) -> DataSourceReader:
        return CsrReader(self.options)


def read_edges(spark: SparkSession, path: str, long: bool | None = None, weighted: bool = False, edges_per_task: int = EDGES_A_TASK) -> DataFrame:
    """(eid, src, dst[, w]); a missing file raises FileNotFoundError."""
    for name in ("csr_vlist", "csr_elist", *["csr_wlist"] * weighted):
        if _locate(path, name) is None:
            raise FileNotFoundError(f"{path}/{name}.bin")
    ship(spark)
    spark.dataSource.register(CsrSource)
    options = {"path": path, "weighted": str(weighted).lower(), "edgesPerTask": str(edges_per_task)}
    if long is not None:
        options["long"] = str(long).lower()
    return spark.read.format("csrbin").options(**options).load()


def read_vertices(spark: SparkSession, path: str, long: bool | None = None) -> DataFrame:
    """(id): all numbers below the number of vertices."""
    return spark.range(max(0, Numbers(path, "csr_vlist", offsets_type(path, long)).n - 1))


def read_csc(spark: SparkSession, path: str, long: bool | None = None, edges_per_task: int = EDGES_A_TASK) -> DataFrame:
    """(pos, src, dst): the edges in the order of the CSC files."""
    for name in ("csc_vlist", "csc_elist"):
        if _locate(path, name) is None:
            raise FileNotFoundError(f"{path}/{name}.bin")
    ship(spark)
    spark.dataSource.register(CsrSource)
    options = {"path": path, "kind": "csc", "edgesPerTask": str(edges_per_task)}
    if long is not None:
        options["long"] = str(long).lower()
    return spark.read.format("csrbin").options(**options).load().withColumnRenamed("eid", "pos")


def read_csc_map(spark: SparkSession, edges: DataFrame, path: str | None = None) -> DataFrame:
    """(pos, eid): the CSR edge at each CSC position. Without CSC files at ``path`` the order by destination,
    source and edge id; with them theirs, where edges with the same ends keep the order of their ids."""
    if path is None or _locate(path, "csc_elist") is None:
        return etl.csc_positions(edges)
    nth = lambda order: F.row_number().over(Window.partitionBy("src", "dst").orderBy(order)).alias("nth")
    given = read_csc(spark, path).select("pos", "src", "dst", nth("pos"))
    return given.join(edges.select("eid", "src", "dst", nth("eid")), ["src", "dst", "nth"]).select("pos", "eid")


@dataclass
class _Part(WriterCommitMessage):
    number: int


class NumbersWriter(DataSourceArrowWriter):
    """One file of numbers: tasks write parts, the commit appends them in order, a block at a time."""

    def __init__(self, options: dict):
        self.path, self.dtype = options["path"], options["dtype"]

    def _part(self, number: int) -> str:
        return f"{self.path}.parts/{number:06d}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Part:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        fs, base = open_path(self._part(number))
        fs.create_dir(base.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(base) as out:
            for b in batches:
                out.write(b.column(0).to_numpy(zero_copy_only=False).astype(self.dtype).tobytes())
        return _Part(number)

    def commit(self, messages: list[_Part | None]) -> None:
        fs, base = open_path(self.path)
        fs.create_dir(base.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(base) as out:
            for m in sorted(m.number for m in messages if m):
                with fs.open_input_stream(open_path(self._part(m))[1]) as part:
                    while block := part.read(1 << 24):
                        out.write(block)
        self.abort(messages)

    def abort(self, messages: list[_Part | None]) -> None:
        fs, base = open_path(f"{self.path}.parts")
        if fs.get_file_info(base).type == pa.fs.FileType.Directory:
            fs.delete_dir(base)


class NumbersSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "numbers"

    def schema(self) -> str:
        return "value double"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return NumbersWriter(self.options)


def _write(values: DataFrame, order: str, path: str, dtype: str) -> None:
    ship(values.sparkSession)
    values.sparkSession.dataSource.register(NumbersSink)
    ordered = values.repartitionByRange(order).sortWithinPartitions(order).select("value")
    ordered.write.format("numbers").mode("append").options(path=path, dtype=dtype).save()


def write_csr(graph, path: str, long: bool = True, weight: str | None = None, csc: bool = False) -> None:
    """Write offsets (int64, or int32), int32 neighbours and, with ``weight``, float32 weights; with ``csc``
    also the files by destination. The vertices' ids are to be 0 to n - 1 (``renumber`` makes them so)."""
    if csc:
        begin = etl.offsets(graph.vertices, graph.edges, "dst")
        total = graph.edges.agg(F.count("*").alias("value")).select(F.lit((1 << 63) - 1).alias("id"), "value")
        _write(begin.select("id", F.col("begin").alias("value")).union(total), "id", f"{path}/csc_vlist.bin", "<i8" if long else "<i4")
        into = prefix.dense_index(graph.edges.select("dst", "src"), ["dst", "src"], "place")
        _write(into.select("place", F.col("src").alias("value")), "place", f"{path}/csc_elist.bin", "<i4")
    begin = etl.offsets(graph.vertices, graph.edges)
    total = graph.edges.agg(F.count("*").alias("value")).select(F.lit((1 << 63) - 1).alias("id"), "value")
    _write(begin.select("id", F.col("begin").alias("value")).union(total), "id", f"{path}/csr_vlist.bin", "<i8" if long else "<i4")
    rest = [weight] if weight else []
    edges = prefix.dense_index(graph.edges.select("src", "dst", *rest), ["src", "dst", *rest], "place")
    _write(edges.select("place", F.col("dst").alias("value")), "place", f"{path}/csr_elist.bin", "<i4")
    if weight:
        _write(edges.select("place", F.col(weight).cast("double").alias("value")), "place", f"{path}/csr_wlist.bin", "<f4")
