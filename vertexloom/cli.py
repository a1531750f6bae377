"""Command line: run an algorithm over a graph in files, or convert an edge list to CSR files.

    spark-submit -m vertexloom.cli --algorithm pr --input DIR --output DIR
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom import algorithms
from vertexloom.algorithms.bfs import summary
from vertexloom.functions.kernels import count_distinct
from vertexloom.model import Graph
from vertexloom.sources import csrbin, synthetic, text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vertexloom", description=__doc__)
    p.add_argument("-a", "--algorithm", choices=["pr", "bfs", "sssp", "wcc", "hits", "convert", "generate"], required=True)
    p.add_argument("--input", help="folder or file of the graph")
    p.add_argument("--format", choices=["csr", "csrc", "edgelist", "parquet"], default="csr")
    p.add_argument("--output", help="folder for the result")
    p.add_argument("--source", type=int, default=0)
    p.add_argument("-n", "--iterations", type=int)
    p.add_argument("--damping", type=float, default=0.85)
    p.add_argument("--teleport", choices=["one", "1/n"], default="one")
    p.add_argument("--tolerance", type=float)
    p.add_argument("--weight")
    p.add_argument("--directed", action="store_true")
    p.add_argument("--long", action="store_true", help="offsets are int64")
    p.add_argument("--push-pull", action="store_true")
    p.add_argument("--partitions", type=int, help="partitions of edges and shuffles")
    p.add_argument("--trace", help="folder for Spark's event log of the run")
    p.add_argument("--preset", choices=sorted(synthetic.PRESETS), default="small")
    p.add_argument("--seed", type=int, default=42)
    return p


def load(spark: SparkSession, a: argparse.Namespace) -> Graph:
    if a.format == "csr":
        return Graph.read_csr(spark, a.input, a.long or None, bool(a.weight), a.directed)
    if a.format == "csrc":
        return Graph.read_csrc_text(spark, a.input)
    if a.format == "edgelist":
        return Graph.read_edgelist(spark, a.input, directed=a.directed, attrs=("w",) if a.weight else ())
    return Graph.from_edges(spark.read.parquet(a.input), directed=a.directed)


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The result; written too if there is an output."""
    if a.partitions:
        spark.conf.set("spark.sql.shuffle.partitions", a.partitions)
    if a.algorithm in ("convert", "generate"):
        loops = duplicates = 0
        if a.algorithm == "generate":
            g = synthetic.preset(spark, a.preset, a.seed)
        else:
            lines = text.read_edgelist(spark, a.input)
            g = Graph.from_edges(lines, directed=False, drop_loops=True, renumber=True)
            loops, rest = lines.agg(F.count_if(F.col("src") == F.col("dst")), F.count_if(F.col("src") != F.col("dst"))).first()
            duplicates = 2 * rest - g.num_edges()
        csrbin.write_csr(g, a.output, a.long)
        return spark.createDataFrame([(g.num_vertices(), g.num_edges(), loops, duplicates)], "vertices long, edges long, loops long, duplicates long")
    g = load(spark, a)
    weight = {"csr": "w", "edgelist": "w"}.get(a.format, a.weight) if a.weight else None
    if a.algorithm == "pr":
        out, columns = algorithms.pagerank(g, a.iterations or 50, a.damping, a.teleport, tol=a.tolerance), ["rank"]
    elif a.algorithm == "bfs":
        out, columns = algorithms.bfs(g, [a.source], max_iter=a.iterations, push_pull=a.push_pull), ["dist"]
    elif a.algorithm == "sssp":
        out, columns = algorithms.sssp(g, a.source, weight, a.iterations), ["dist"]
    elif a.algorithm == "wcc":
        out, columns = algorithms.wcc(g, a.iterations), ["label"]
    else:
        out, columns = algorithms.hits(g, a.iterations or 50, a.tolerance), ["hub", "authority"]
    if a.output:
        text.write_values(out, columns, a.output)
    return out


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    builder = SparkSession.builder.appName("vertexloom")
    if a.trace:
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", a.trace)
    out = run(builder.getOrCreate(), a)
    if a.algorithm in ("bfs", "sssp"):
        out = summary(out)
    elif a.algorithm == "wcc":
        out = count_distinct(out, "label", "components")
    elif a.algorithm == "pr":
        out = out.selectExpr("count(*) AS vertices", "sum(rank) AS total_rank")
    out.show()


if __name__ == "__main__":
    main()
