"""Text formats: edge lists, CSR/CSC text, and results in vertex order."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexloom.plans.workspace import Workspace

#: Edges, by their ids in order, that meet their sources in one group.
EDGES_A_GROUP = 1 << 16


def read_edgelist(spark: SparkSession, path: str, sep: str | None = None, attrs: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, attributes as doubles) from lines of numbers parted by ``sep``, or by white space.
    Blank lines are skipped; a missing attribute is null."""
    cells = F.split(F.trim("value"), sep if sep else r"\s+")
    lines = spark.read.text(path).filter(F.trim("value") != "").select(cells.alias("c"))
    more = [F.get("c", F.lit(i + 2)).cast("double").alias(a) for i, a in enumerate(attrs)]
    return lines.select(F.col("c")[0].cast("bigint").alias("src"), F.col("c")[1].cast("bigint").alias("dst"), *more)


def packs(spark: SparkSession, path: str, csr_only: bool = False) -> DataFrame:
    """(line, pos, numbers): the numbers of the first three lines in arrays of no more than an Arrow batch,
    and the place of the first of each in its line. Files are split at spaces, not at lines, so that a line
    is read by many tasks; line breaks before each block are counted first. Lines that other white space
    parts stay whole."""
    raw = spark.read.option("lineSep", " ").text(path).select("value", "_metadata.file_path", F.col("_metadata.file_block_start").alias("block"))
    breaks = F.when(F.contains("value", F.lit("\n")) | F.contains("value", F.lit("\r")), F.regexp_count("value", F.lit(LINE_END))).otherwise(0)
    counts = raw.groupBy("file_path", "block").agg(F.sum(breaks).alias("breaks")).collect()
    # A row for each block of the files.
    blocks, line = [], 1
    for place, (file, block, n) in enumerate(sorted(map(tuple, counts))):
        if line <= 3 or not csr_only:
            blocks.append((file, block, place, line))
        line += n
    at = F.broadcast(spark.createDataFrame(blocks, "file_path string, block long, place long, first long"))
    work = Workspace(spark, "csrc")
    parts = raw.join(at, ["file_path", "block"]).select("place", "first", "value").mapInArrow(_parse, PACKED)
    parts = work.save(parts, "packs")
    # As many rows as blocks and lines: a window over them all is small.
    ends = parts.groupBy("line", "place").agg(F.max(F.col("at") + F.size("numbers")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("line").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = F.broadcast(ends.select("line", "place", before.alias("before")))
    return parts.join(bases, ["line", "place"]).select("line", (F.col("before") + F.col("at")).alias("pos"), "numbers")


LINE_END = "\r\n|\r|\n"
PACKED = "line long, place long, at long, numbers array<bigint>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``PACKED`` from values between spaces, a block's in their order."""
    now, line, at = None, 0, 0
    for batch in filter(len, batches):
        place, first = batch.column(0).to_numpy(), batch.column(1)
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
        for a, b in zip(cuts, cuts[1:]):
            if place[a] != now:
                now, line, at = place[a], first[a].as_py(), 0
            for i, part in enumerate(re.split(LINE_END, " ".join(batch.column(2).slice(a, b - a).to_pylist()))):
                if i:
                    line, at = line + 1, 0
                if line > 3 or not (words := part.split()):
                    continue
                numbers = pa.array(words, pa.string()).cast(pa.int64())
                rows = [pa.array([x], pa.int64()) for x in (line, now, at)]
                yield pa.RecordBatch.from_arrays([*rows, pa.ListArray.from_arrays(pa.array([0, len(numbers)], pa.int32()), numbers)], names=["line", "place", "at", "numbers"])
                at += len(numbers)


def _edges_of_group(spans: pa.Table, targets: pa.Table) -> pa.Table:
    """The edges whose ids are in one range of ``EDGES_A_GROUP``."""
    n, dst, given = EDGES_A_GROUP, np.zeros(EDGES_A_GROUP, np.int64), np.zeros(EDGES_A_GROUP, bool)
    group = (spans if len(spans) else targets)["group"][0].as_py()
    for pos, numbers in zip(targets["pos"].to_pylist(), targets["numbers"]):
        at = pos - group * n
        dst[at : at + len(numbers)], given[at : at + len(numbers)] = numbers.values.to_numpy(), True
    begin, end = spans["begin"].to_numpy() - group * n, spans["end"].to_numpy() - group * n
    begin, end = np.maximum(begin, 0), np.minimum(end, n)
    size = end - begin
    at = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
    known = given[at]
    at, src = at[known], np.repeat(spans["src"].to_numpy(), size)[known]
    return pa.table({"eid": at + group * n, "src": src, "dst": dst[at]})


def read_csrc(spark: SparkSession, path: str, csr_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges from five lines: "n m", row offsets, columns, column offsets, rows. Only the
    first three are needed, so files of three lines will do; ``csr_only`` reads no further."""
    numbers = packs(spark, path, csr_only)
    head = numbers.filter("line = 1 and pos = 0").first()
    offsets = numbers.filter("line = 2").select("pos", "numbers")
    # A number for each array of offsets.
    after = offsets.select("pos", F.lead(F.col("numbers")[0]).over(Window.orderBy("pos")).alias("next"))
    offsets = offsets.select("pos", "numbers").join(F.broadcast(after), "pos")
    ends = F.concat(F.slice("numbers", 2, F.size("numbers")), F.array("next"))
    spans = offsets.select("pos", F.posexplode(F.arrays_zip(F.col("numbers").alias("begin"), ends.alias("end"))).alias("i", "span"))
    spans = spans.select((F.col("pos") + F.col("i")).alias("src"), "span.begin", "span.end").filter("end > begin")
    # Edges meet their sources by ranges of edge ids, so that a hub's edges are dealt out too.
    spans = spans.withColumn("group", F.explode(F.expr(f"sequence(begin div {EDGES_A_GROUP}, (end - 1) div {EDGES_A_GROUP})")))
    targets = numbers.filter("line = 3").select("pos", "numbers", F.explode(F.expr(f"sequence(pos div {EDGES_A_GROUP}, (pos + size(numbers) - 1) div {EDGES_A_GROUP})")).alias("group"))
    first = F.greatest("pos", F.col("group") * EDGES_A_GROUP)
    stop = F.least(F.col("pos") + F.size("numbers"), (F.col("group") + 1) * EDGES_A_GROUP)
    targets = targets.select("group", first.alias("pos"), F.slice("numbers", (first - F.col("pos") + 1).cast("int"), (stop - first).cast("int")).alias("numbers"))
    edges = spans.select("group", "src", "begin", "end").groupBy("group").cogroup(targets.groupBy("group")).applyInArrow(_edges_of_group, "eid long, src long, dst long")
    return spark.range(head["numbers"][0] if head else 0), edges


def _joined(line: int):
    """For mapInArrow: the numbers of each batch as text, and their place in the line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, batch in enumerate(filter(len, batches)):
            value = " ".join(batch.column(0).cast(pa.string()).to_pylist())
            yield pa.RecordBatch.from_pydict({"line": [line], "part": [part], "i": [i], "value": [value]}, schema=TEXTS)

    return run


TEXTS = pa.schema({"line": pa.int64(), "part": pa.int64(), "i": pa.int64(), "value": pa.string()})


def write_csrc(graph, path: str) -> None:
    """The five lines of ``read_csrc``, in order, in one file. Many tasks make the text of a line; one
    puts it together."""
    from vertexloom.operators import etl

    spark = graph.vertices.sparkSession
    work = Workspace(spark, "csrc")
    vertices, edges = work.save(graph.vertices.select("id"), "vertices"), work.save(graph.edges.select("src", "dst"), "edges")
    n, m = vertices.count(), edges.count()
    total = spark.createDataFrame([((1 << 62), m)], "id long, begin long")
    starts = lambda by: etl.offsets(vertices, edges, by).select("id", "begin").union(total)
    line = lambda i, df, order, value: df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(value).cast("long")).mapInArrow(_joined(i), "line long, part long, i long, value string")
    lines = [line(1, starts("src"), ["id"], "begin"), line(2, edges, ["src", "dst"], "dst"), line(3, starts("dst"), ["id"], "begin"), line(4, edges, ["dst", "src"], "src")]
    out = spark.createDataFrame([(0, 0, 0, f"{n} {m}")] + [(i, 0, 0, "") for i in (2, 4) if not m], "line long, part long, i long, value string")
    for i, df in enumerate(lines):
        out = out.unionByName(work.save(df, f"line{i}"))
    # The text writer ends each row with a space; a line begins with the break after the one before.
    first = out.groupBy("line").agg(F.min(F.struct("part", "i")).alias("first"))
    begins = (F.struct("part", "i") == F.col("first")) & (F.col("line") > 0)
    out = out.join(F.broadcast(first), "line").withColumn("value", F.when(begins, F.concat(F.lit("\n"), "value")).otherwise(F.col("value")))
    out.coalesce(1).sortWithinPartitions("line", "part", "i").select("value").write.mode("overwrite").option("lineSep", " ").text(path)


def write_values(vertices: DataFrame, columns: list[str], path: str, single_file: bool = False) -> None:
    """The columns of each vertex, parted by tabs, a line each in the order of ids; the part files are in
    order too. Null is an empty field."""
    ordered = vertices.orderBy("id")
    if single_file:
        ordered = vertices.coalesce(1).sortWithinPartitions("id")
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    ordered.select(F.concat_ws("\t", *fields).alias("value")).write.mode("overwrite").text(path)
