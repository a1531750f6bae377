import numpy as np
import pytest

from vertexloom.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.9):
    ok = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    width = max((len(v) for _, v in ok), default=0)
    x = np.stack([np.pad(v, (0, width - len(v))) for _, v in ok])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= threshold
    up = {i: i for i, _ in ok}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in np.argwhere(near):
        a, b = find(ok[a][0]), find(ok[b][0])
        up[max(a, b)] = min(a, b)
    links = near.sum(1) - 1
    known = [(i, int(n), find(i)) for (i, _), n in zip(ok, links)]
    valid = {id(r) for r in rows if r[0] is not None and r[1] and None not in r[1] and np.isfinite(np.array(r[1], float)).all() and any(r[1])}
    return known + [(r[0], 0, r[0]) for r in rows if id(r) not in valid]


def made(n=1500, width=16):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, width))
    near = np.concatenate([x[k] + 0.18 * rng.standard_normal((m, width)) for k, m in ((0, 120), (1, 30), (2, 3), (3, 2))])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([x, near]).astype(np.float32))]
    m = len(rows)
    rows += [(m + k, rows[5][1], 0) for k in range(40)]
    rows += [(m + 50, [2 * c for c in rows[6][1]], 0), (m + 51, None, 0), (m + 52, [], 0), (m + 53, [0.0] * width, 0), (m + 54, [1.0, None], 0), (m + 55, [float("nan")] * width, 0), (m + 56, [float("inf")] * width, 0)]
    rows += [(None, rows[0][1], 0), (m + 57, [1.0], None), (m + 58, [3.0], None)]
    return rows


key = lambda t: tuple(map(str, t))


@pytest.mark.parametrize("chunked", [False, True])
def test_equals_brute_force(spark, monkeypatch, chunked):
    rows = made()
    if chunked:
        monkeypatch.setattr(embedding_dedup, "TASK_BYTES", 100 * 16 * 8)
    monkeypatch.setattr(embedding_dedup, "CELL_VECTORS", 30)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS rep", "2 AS cell", "3 AS x").repartition(3)
    got = embedding_dedup.dedup(df).collect()
    mine = {(r["vec_id"]): (r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None}
    want = {i: (n, c) for i, n, c in brute(rows) if i is not None}
    assert len(got) == len(rows) and mine.keys() == want.keys()
    found, there = sum(v[0] for v in mine.values()), sum(v[0] for v in want.values())
    assert 0.98 * there <= found <= there and all(mine[i][0] <= want[i][0] for i in want)
    assert sum(mine[i][1] == want[i][1] for i in want) >= 0.99 * len(want)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)


def test_few_and_no_vectors(spark):
    assert embedding_dedup.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(4, [1.0, 0.0], 0), (9, [1.0, 0.1], 1), (11, None, 1)], SCHEMA)
    assert sorted(map(tuple, embedding_dedup.dedup(one).collect())) == [(4, 1, 4, True), (9, 1, 4, False), (11, 0, 11, True)]
    assert [tuple(r) for r in embedding_dedup.dedup(one.filter("vec_id = 11")).collect()] == [(11, 0, 11, True)]
