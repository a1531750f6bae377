import random

import pytest
from helpers import corpus, prose, words

from vertexloom.llm import jaccard_join
from vertexloom.llm.jaccard_join import Rule


def shingles(text, k):
    w = words(text, lower=True)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)] if w else [])


def brute(rows, k, num, den):
    sets = [(d, shingles(t, k)) for d, t, *_ in rows]
    up = {d: d for d, _ in sets if d is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    known = [(d, s) for d, s in sets if d is not None and s]
    for i, (a, s) in enumerate(known):
        for b, t in known[:i]:
            if den * len(s & t) >= num * len(s | t) and find(a) != find(b):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return [(d, len(s), find(d) if d is not None else None) for d, s in sets]


key = lambda t: tuple(map(str, t))


def same(spark_rows, rows):
    return sorted([tuple(r) for r in spark_rows], key=key) == sorted(rows, key=key)


@pytest.mark.parametrize("k, num, den", [(3, 9, 10), (5, 4, 5), (1, 1, 2)])
def test_equals_brute_force(docs, k, num, den):
    assert same(jaccard_join.join(docs, k, num, den).collect(), brute(corpus(), k, num, den))


def near_copies():
    """Sets around the threshold, of all sizes, and a large group of near copies."""
    rng = random.Random(4)
    rows = []
    for n in [*range(1, 40), 60, 90, 200]:
        base = [f"t{n}x{i}" for i in range(n)]
        for k in range(4):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, n // 12) + 2)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = [f"new{rng.random()}"]
            rows.append((len(rows), " ".join(w)))
    hot = prose(rng, 80).split()
    for _ in range(60):
        w = list(hot)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "else"
        rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("split", [False, True])
def test_near_copies(spark, monkeypatch, split):
    rows = near_copies()
    if split:  # clusters in several tasks, many shards and tasks
        monkeypatch.setattr(jaccard_join, "CLUSTER_SHINGLES", 300)
        monkeypatch.setattr(jaccard_join, "SHARD_KEYS", 50)
        monkeypatch.setattr(jaccard_join, "TASK_BYTES", 500)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert same(jaccard_join.join(docs, 1, 9, 10).collect(), brute(rows, 1, 9, 10))
    if not split:
        assert same(jaccard_join.join(docs, 2, 4, 5).collect(), brute(rows, 2, 4, 5))


def test_no_rows(nothing):
    assert jaccard_join.join(nothing).count() == 0


def test_bands_reach_the_next_one_at_most():
    for num, den in ((9, 10), (4, 5), (1, 2), (1, 3)):
        rule = Rule(num, den)
        assert (rule.reach[:-1] <= rule.hi[1:]).all()
        assert (rule.parts >= rule.spare).all()


def test_traversal_holds_few_pairs():
    """A block of near copies has all node pairs plausible; they aren't expanded all at once."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng, n = np.random.default_rng(1), 2000
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = []
    for _ in range(n):
        s, k = base.copy(), rng.integers(5)
        s[rng.choice(60, k, replace=False)] = rng.integers(0, 1 << 63, k, dtype=np.uint64)
        sets.append(s)
    maps = [jaccard_join.bitmap(s).tobytes() for s in sets]
    group = pa.table({"block": [1] * n, "id": range(n), "component": range(n), "n_shingles": [60] * n, "bitmap": maps})
    tracemalloc.start()
    links = jaccard_join._plausible_links(Rule(4, 5, 1 << 20))(group)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(links["a"].to_pylist()) == list(range(1, n)) and set(links["b"].to_pylist()) == {0}
    assert peak < 16 << 20
