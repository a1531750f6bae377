"""Algorithms against plain loops on generated graphs and on tiny ones with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexloom import algorithms
from vertexloom.algorithms import bfs as bfs_function
from vertexloom.algorithms.bfs import bfs_in_blocks
from vertexloom.algorithms import get_program, hits, pagerank, sssp, wcc
from vertexloom.model import Graph
from vertexloom.operators import partition
from vertexloom.plans import engine
from vertexloom.plans.program import VertexProgram
from vertexloom.sources import synthetic


@pytest.fixture(scope="module", params=["tiny", "small"])
def case(spark, request):
    g = synthetic.preset(spark, request.param).persist()
    e = np.array([(r["src"], r["dst"]) for r in g.edges.collect()])
    return g, e, synthetic.PRESETS[request.param][0]


@pytest.fixture(params=["broadcast", "shuffle"])
def placement(request, monkeypatch):
    if request.param == "shuffle":
        monkeypatch.setattr(engine, "BROADCAST_BYTES", 0)


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def graph(spark, n, edges, weights=None):
    rows = [(i, a, b, float(weights[i]) if weights else 1.0) for i, (a, b) in enumerate(edges)]
    return Graph(spark.range(n), spark.createDataFrame(rows, "eid long, src long, dst long, w double"))


def rank(e, n, rounds, damping=0.85, base=0.15):
    out, r = np.bincount(e[:, 0], minlength=n), np.ones(n)
    for _ in range(rounds):
        r = base + damping * np.bincount(e[:, 1], (r / np.maximum(out, 1))[e[:, 0]], minlength=n)
    return r


def test_pagerank(case, placement):
    g, e, n = case
    assert np.allclose(column(pagerank(g, 7), "rank"), rank(e, n, 7))


def test_pagerank_variants(case):
    g, e, n = case
    assert np.allclose(column(pagerank(g, 3, teleport="1/n"), "rank"), rank(e, n, 3, base=0.15 / n))
    assert np.allclose(column(pagerank(g, 3, damping=1.0), "rank"), rank(e, n, 3, 1.0, 0.0))
    assert np.allclose(column(pagerank(g, 12), "rank"), rank(e, n, 12))
    assert abs(sum(column(pagerank(g, 5), "rank")) - n) < 1e-6
    with pytest.raises(ValueError):
        pagerank(g, 3, teleport="two")


def test_pagerank_active(case):
    g, e, n = case
    out, r, active = np.bincount(e[:, 0], minlength=n), np.ones(n), np.ones(n, bool)
    for _ in range(6):
        new = 0.15 + 0.85 * np.bincount(e[:, 1], (r / np.maximum(out, 1))[e[:, 0]], minlength=n)
        moved = active & (np.abs(new - r) > 0.01)
        r = np.where(active, new, r)
        active = np.zeros(n, bool)
        active[e[moved[e[:, 0]], 1]] = True
    assert np.allclose(column(pagerank(g, 6, tol=0.01), "rank"), r)


def levels(e, n, sources):
    dist = {s: 0 for s in sources}
    front = list(sources)
    while front:
        front = list({b for a in front for x, b in e if x == a and b not in dist})
        dist |= {b: 1 + min(dist[a] for a, y in e if y == b and a in dist) for b in front}
    return [dist.get(i) for i in range(n)]


def test_bfs(case, placement):
    g, e, n = case
    pairs = [tuple(x) for x in e.tolist()]
    for push in (True, False):
        assert column(bfs_function(g, [0, n // 2], push_pull=push), "dist") == levels(pairs, n, [0, n // 2])


def test_unit_paths_are_levels(case):
    g, _, _ = case
    assert column(sssp(g, 3), "dist") == column(bfs_function(g, [3]), "dist")


def test_components_both_ways(case, placement):
    g, _, n = case
    assert column(wcc(g), "label") == column(wcc(g, method="labels"), "label") == [0] * n


def test_hits(case, placement):
    g, e, n = case
    hub = authority = np.full(n, 1 / n)
    for _ in range(4):
        h, a = np.bincount(e[:, 0], authority[e[:, 1]], minlength=n), np.bincount(e[:, 1], hub[e[:, 0]], minlength=n)
        hub, authority = h / np.linalg.norm(h), a / np.linalg.norm(a)
    got = hits(g, 4)
    assert np.allclose(column(got, "hub"), hub) and np.allclose(column(got, "authority"), authority)
    assert np.allclose(column(hits(g, 4, tol=0.0), "hub"), hub)


def test_unreachable_and_isolated(spark):
    g = graph(spark, 5, [(0, 1), (1, 2), (4, 3)])
    assert column(bfs_function(g, [0]), "dist") == [0, 1, 2, None, None]
    assert column(bfs_function(g, [2], direction="in"), "dist") == [2, 1, 0, None, None]
    assert column(bfs_function(g, [2], direction="both"), "dist") == [2, 1, 0, None, None]
    assert column(bfs_function(g, [99]), "dist") == [None] * 5
    assert column(bfs_function(g, [0], max_iter=1), "dist") == [0, 1, None, None, None]
    assert column(wcc(g), "label") == [0, 0, 0, 3, 3]
    assert column(wcc(graph(spark, 3, [(1, 1)])), "label") == [0, 1, 2]


def test_two_hops_beat_one(spark):
    g = graph(spark, 3, [(0, 1), (1, 2), (0, 2)], [1, 1, 5])
    assert column(sssp(g, 0, "w"), "dist") == [0.0, 1.0, 2.0]
    assert column(sssp(graph(spark, 3, [(0, 1), (1, 2), (0, 2)], [4, -3, 5]), 0, "w"), "dist") == [0.0, 4.0, 1.0]


def test_negative_cycle(spark):
    with pytest.raises(ValueError):
        sssp(graph(spark, 3, [(0, 1), (1, 2), (2, 1)], [1, -2, 1]), 0, "w")


def test_sinks_keep_the_base_rank(spark):
    assert np.allclose(column(pagerank(graph(spark, 3, [(0, 1), (2, 1)]), 5), "rank"), [0.15, 0.405, 0.15])


def test_chain_of_components(spark):
    n = 300
    g = graph(spark, n, [(i, i + 1) for i in range(n - 1) if i != 149])
    assert column(wcc(g), "label") == [0] * 150 + [150] * 150


def test_program_statistics_and_registry(spark, case):
    g, _, n = case
    r = algorithms.bfs.__globals__["run"](g, [0])
    assert r.converged and r.push_count + r.pull_count == r.iterations
    assert r.summary().count() == 1
    for name in ("BFS", "PageRank", "SSSP", "ConnectedComponents", "HITS"):
        p = {"BFS": {"sources": [0]}, "SSSP": {"source": 0}, "PageRank": {"max_iter": 2}, "HITS": {"max_iter": 2}}.get(name, {})
        assert get_program(name, **p)(g).count() == n
    with pytest.raises(ValueError):
        get_program("Louvain")


def test_programs_refuse_what_they_do_not_know():
    with pytest.raises(ValueError):
        VertexProgram({}, F.lit(1), "min", {}, direction="up")
    with pytest.raises(ValueError):
        VertexProgram({}, F.lit(1), "min", {}, fixed=True)


@pytest.mark.parametrize("k", [1, 2, 4, 8])
@pytest.mark.parametrize("method", ["range", "ebp", "greedy", "greedy_alpha"])
def test_parts_conserve_edges(case, k, method):
    g, e, n = case
    sizes = partition.part_sizes(g, partition.assign_parts(g, k, method, alpha=3)).collect()
    assert sum(r["n_edges"] for r in sizes) == len(e) and sum(r["n_vertices"] for r in sizes) == n
    assert len(sizes) == k
    if method != "range":
        assert max(r["n_edges"] for r in sizes) <= 2 * min(r["n_edges"] for r in sizes)
    with pytest.raises(ValueError):
        partition.assign_parts(g, k, "random")


def test_sums_hear_each_message_once(spark):
    """Walks of each length from vertex 0: only who received sends on."""
    g = graph(spark, 4, [(0, 1), (0, 2), (1, 3), (2, 3)])
    p = VertexProgram(
        init={"walks": F.when(F.col("id") == 0, 1.0)}, message=F.col("from_walks"), combine="sum", apply={"walks": F.col("msg")},
        changed=F.col("walks").isNotNull(), start=F.col("id") == 0, max_iter=2,
    )
    assert column(p.run(g).vertices, "walks") == [None, None, None, 2.0]


def test_hubs_are_kept_apart(spark, monkeypatch):
    monkeypatch.setattr(engine, "HUB_EDGES", 3)
    monkeypatch.setattr(engine, "HUB_SHARE", 0.5)
    g = graph(spark, 30, [(i, 0) for i in range(1, 30)] + [(0, i) for i in range(1, 4)])
    placed = engine.Placed(engine.directed_edges(g.edges, "out"), True)
    assert [r["to"] for r in placed.hubs.collect()] == [0] and [p.count() for p in placed.parts] == [3, 29] and placed.count == 32
    spread = placed.parts[1].groupBy(F.spark_partition_id()).count().count()
    assert spread > 1
    placed.unpersist()


def test_hubs_change_no_result(spark, placement, monkeypatch):
    rng = np.random.default_rng(4)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (60, 2)) if a != b} | {(i, 3) for i in range(40) if i != 3} | {(7, i) for i in range(40) if i != 7})
    g = graph(spark, 40, pairs).persist()
    run = lambda: [column(pagerank(g, 3), "rank"), column(sssp(g, 0), "dist"), column(hits(g, 2, tol=0.0), "hub")]
    plain = run()
    monkeypatch.setattr(engine, "HUB_EDGES", 3)
    monkeypatch.setattr(engine, "HUB_SHARE", 0.3)
    kept = run()
    assert plain[1] == kept[1] and np.allclose(plain[0], kept[0]) and np.allclose(plain[2], kept[2])
    g.unpersist()


@pytest.mark.parametrize("blocks", [1, 3])
def test_bfs_in_blocks_equals_bfs(case, blocks):
    g, _, _ = case
    assert column(bfs_in_blocks(g, [0, 7], blocks), "dist") == column(bfs_function(g, [0, 7]), "dist")
    assert column(bfs_in_blocks(g, [10**6], blocks), "dist") == column(bfs_function(g, [10**6]), "dist")
