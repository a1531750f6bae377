import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexloom import cli
from vertexloom.model import Graph
from vertexloom.sources import csrbin, synthetic, text
from vertexloom.streaming.degrees import windowed_degrees


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


@pytest.mark.parametrize("long", [True, False])
def test_csr_round_trip(spark, tmp_path, long):
    g = synthetic.preset(spark, "small")
    g = Graph(spark.range(103), g.edges.withColumn("w", (F.col("src") % 7).cast("double")))
    csrbin.write_csr(g, str(tmp_path / "g"), long=long, weight="w")
    offsets = np.fromfile(tmp_path / "g/csr_vlist.bin", "<i8" if long else "<i4")
    assert len(offsets) == 104 and offsets[0] == 0 and offsets[-1] == 500 and (np.diff(offsets) >= 0).all()
    h = Graph.read_csr(spark, str(tmp_path / "g"), long=None, weighted=True)
    assert rows(h.edges, "eid", "src", "dst", "w") == rows(g.edges, "eid", "src", "dst", "w")
    assert h.num_vertices() == 103
    small = csrbin.read_edges(spark, str(tmp_path / "g"), long, False, edges_per_task=37)
    assert rows(small, "eid", "src", "dst") == rows(g.edges, "eid", "src", "dst")
    assert small.rdd.getNumPartitions() == 14


def test_csr_names_without_suffix(spark, tmp_path):
    np.array([0, 2, 2, 3], "<i4").tofile(tmp_path / "csr_vlist")
    np.array([1, 2, 0], "<i4").tofile(tmp_path / "csr_elist")
    assert rows(Graph.read_csr(spark, str(tmp_path), None).edges) == [(0, 0, 1), (1, 0, 2), (2, 2, 0)]


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        csrbin.read_edges(spark, str(tmp_path))


def test_edge_list(spark, tmp_path):
    (tmp_path / "e.txt").write_text("3 1 5\n\n1\t3 2\n  1 3 4 \n3 3\n")
    assert rows(text.read_edgelist(spark, str(tmp_path / "e.txt"), attrs=("w",)).fillna(-1.0)) == [(1, 3, 2.0), (1, 3, 4.0), (3, 1, 5.0), (3, 3, -1.0)]
    g = Graph.read_edgelist(spark, str(tmp_path / "e.txt"), directed=False)
    assert rows(g.edges, "src", "dst") == [(1, 3), (3, 1), (3, 3)]


def test_csrc_text_round_trip(spark, tmp_path):
    g = synthetic.preset(spark, "tiny")
    text.write_csrc(g, str(tmp_path / "t"))
    h = Graph.read_csrc_text(spark, str(tmp_path / "t"))
    assert rows(h.edges, "eid", "src", "dst") == rows(g.edges, "eid", "src", "dst") and h.num_vertices() == 20


def test_values_in_vertex_order(spark, tmp_path):
    v = spark.createDataFrame([(2, 0.5, 1.0), (0, None, 2.0), (1, 0.25, 3.0)], "id long, a double, b double")
    text.write_values(v, ["a", "b"], str(tmp_path / "v"), single_file=True)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "v")).collect()] == ["\t2.0", "0.25\t3.0", "0.5\t1.0"]


def test_command_line(spark, tmp_path):
    (tmp_path / "e.txt").write_text("10 20\n20 30\n20 20\n10 20\n40 50\n")
    run = lambda *a: cli.run(spark, cli.parser().parse_args(list(a)))
    csr = str(tmp_path / "csr")
    assert rows(run("-a", "convert", "--input", str(tmp_path / "e.txt"), "--output", csr, "--long")) == [(5, 6)]
    assert rows(run("-a", "wcc", "--input", csr, "--output", str(tmp_path / "out"))) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3)]
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts).split() == ["0", "0", "0", "3", "3"]
    assert rows(run("-a", "bfs", "--input", csr, "--source", "2").fillna(-1)) == [(0, 2), (1, 1), (2, 0), (3, -1), (4, -1)]
    assert run("-a", "pr", "--input", csr, "-n", "2").count() == run("-a", "hits", "--input", csr, "-n", "2").count() == 5


def test_streamed_degrees(spark, tmp_path):
    rows_in = [(0, 1, "2024-01-01 00:10:00"), (0, 2, "2024-01-01 00:20:00"), (1, 0, "2024-01-01 05:00:00")]
    edges = spark.createDataFrame(rows_in, "src long, dst long, ts string").withColumn("ts", F.to_timestamp("ts"))
    edges.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(edges.schema).parquet(str(tmp_path / "in"))
    q = windowed_degrees(stream).writeStream.outputMode("complete").format("memory").queryName("degrees").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("degrees"), "id", "deg") == [(0, 2), (1, 1)]


def test_csrc_text_in_parts(spark, tmp_path, monkeypatch):
    """No task holds a line as one value, and the edges are made once; blocks part lines anywhere."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    n, hub = 3000, 70_000
    pairs = spark.range(n).selectExpr("id AS src", "(id * 7 + 1) % 3000 AS dst").union(spark.range(hub).selectExpr("5L AS src", "id % 3000 AS dst"))
    g = Graph(spark.range(n + 2), pairs.mapInArrow(count, "src long, dst long"), True)
    text.write_csrc(g, str(tmp_path / "t"))
    assert seen.value == n + hub
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert all(x[0] != " " for x in lines)
    lines = [x.split() for x in lines]
    assert [len(x) for x in lines] == [2, n + 3, n + hub, n + 3, n + hub]
    by_dst = sorted([(i * 7 + 1) % 3000 * n + i for i in range(n)] + [i % 3000 * n + 5 for i in range(hub)])
    assert lines[0] == [str(n + 2), str(n + hub)] and list(map(int, lines[4])) == [x % n for x in by_dst]
    want = sorted([(i, (i * 7 + 1) % 3000) for i in range(n)] + [(5, i % 3000) for i in range(hub)])
    for size in ("20k", "128m"):
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert max(r[0] for r in text.packs(spark, str(tmp_path / "t")).selectExpr("size(numbers)").collect()) <= 10_000
            for csr_only in (False, True):
                v, e = text.read_csrc(spark, str(tmp_path / "t"), csr_only)
                assert v.count() == n + 2 and rows(e, "eid", "src", "dst") == [(i, *x) for i, x in enumerate(want)]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csrc_text_odd_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("3\t2\r\n0  1\t2 2 \r\n2 0\n")
    assert rows(text.read_csrc(spark, str(tmp_path / "a.txt"))[1]) == [(0, 0, 2), (1, 1, 0)]
    text.write_csrc(Graph(spark.range(0), spark.createDataFrame([], "src long, dst long"), True), str(tmp_path / "t"))
    v, e = text.read_csrc(spark, str(tmp_path / "t"))
    assert v.count() == 0 and rows(e) == []
