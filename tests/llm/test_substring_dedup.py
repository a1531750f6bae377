import hashlib
import random

import pytest
from helpers import corpus, words

from vertexloom.llm import substring_dedup


def brute(rows, window):
    first = {}
    for doc, text, *_ in rows:
        w = words(text)
        for i in range(len(w) - window + 1):
            if doc is not None:
                k = tuple(w[i : i + window])
                first[k] = min(doc, first.get(k, doc))
    out = []
    for doc, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        out.append((doc, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


key = lambda t: tuple(map(str, t))


@pytest.mark.parametrize("window", [50, 7, 2, 1])
def test_equals_brute_force(docs, window):
    got = [tuple(r) for r in substring_dedup.digests(docs, window).collect()]
    want = [(*r[:3], hashlib.sha256(r[3]).hexdigest()) for r in brute(corpus(), window)]
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("seed, window", [(1, 6), (3, 10)])
def test_patchworks_of_shared_passages(spark, monkeypatch, seed, window):
    """Documents put together from parts of the same passages, with edits; ids in no order, some repeated; small chunks."""
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 3000)
    rng = random.Random(seed)
    passages = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(30, 120))] for _ in range(6)]
    rows = []
    for _ in range(250):
        w = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(passages)
            at = rng.randrange(len(p))
            w += p[at : at + rng.randrange(60)]
        for _ in range(rng.randrange(4) if w else 0):
            w[rng.randrange(len(w))] = rng.choice(["x", "y", f"z{rng.random()}"])
        rows.append((rng.randrange(-50, 400), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = [tuple(r) for r in substring_dedup.digests(docs, window).collect()]
    want = [(*r[:3], hashlib.sha256(r[3]).hexdigest()) for r in brute(rows, window)]
    assert sorted(got, key=key) == sorted(want, key=key)


def split(monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_WINDOWS", 60)
    monkeypatch.setattr(substring_dedup, "GROUP_WORDS", 150)


def test_split_shards_and_groups(docs, monkeypatch):
    split(monkeypatch)
    got = [tuple(r)[:3] for r in substring_dedup.digests(docs, 20).collect()]
    assert sorted(got, key=key) == sorted([r[:3] for r in brute(corpus(), 20)], key=key)


def brute_repeats(rows, window):
    """(words, times, least id) of all sequences in several documents that can't be longer without occurring fewer times."""
    texts = [(d, words(t)) for d, t, *_ in rows if d is not None]
    found, n = {}, window
    while True:
        at = {}
        for k, (d, w) in enumerate(texts):
            for i in range(len(w) - n + 1):
                at.setdefault(tuple(w[i : i + n]), []).append((k, i))
        at = {s: o for s, o in at.items() if len({texts[k][0] for k, _ in o}) > 1}
        if not at:
            return found
        for s, o in at.items():
            before = {texts[k][1][i - 1] if i else (k, i) for k, i in o}
            after = {texts[k][1][i + n] if i + n < len(texts[k][1]) else (k, i) for k, i in o}
            if len(before) > 1 and len(after) > 1:
                found[s] = (len(o), min(texts[k][0] for k, _ in o))
        n += 1


@pytest.mark.parametrize("groups", ["one", "split"])
def test_nodes_are_the_maximal_repeats(docs, monkeypatch, groups):
    if groups == "split":
        split(monkeypatch)
    rows = substring_dedup.maximal_repeats(docs, 20, most=500).collect()
    texts = {}
    for d, t, *_ in corpus():
        texts[d] = words(t)
    got = [(tuple(texts[r["doc_id"]][r["start"] : r["start"] + r["n_words"]]), (r["n_times"], r["doc_id"])) for r in rows]
    want = brute_repeats(corpus(), 20)
    assert len(want) > 20 and len(got) == len(want) and dict(got) == want and not any(r["cut"] for r in rows)
    short = substring_dedup.maximal_repeats(docs, 20, most=60)
    assert {r["cut"] for r in short.collect()} == {True, False} and short.filter("n_words > 60").count() == 0


def test_tree_of_a_few_suffixes():
    import numpy as np

    texts = ["a b c d x", "a b c d y", "a b c z z", "q a b c d x"]
    name = {c: i for i, c in enumerate("abcdqxyz")}
    each = [[name[c] for c in t.split()] for t in texts]
    flat, length = np.array(sum(each, [])), np.array([len(x) for x in each])
    none = np.zeros(4, np.uint64)
    s = substring_dedup.Suffixes(np.arange(8, dtype=np.uint64), flat, length, none, np.ones(4, np.int64), np.arange(4), np.zeros(4, np.int64), np.array([10, 11, 12, 13]))
    tree = substring_dedup.SuffixTree(s, 2)
    nodes = sorted(zip(tree.depth.tolist(), tree.least.tolist(), tree.most.tolist(), tree.times.tolist(), [tree.depth[p] if p >= 0 else 0 for p in tree.parent]))
    assert nodes == [(3, 10, 12, 3, 0), (4, 10, 11, 2, 3)]
    assert tree.reach().tolist() == [0, 4, 3, 0]


def test_texts_of_all_rows(docs, nothing):
    got = substring_dedup.dedup(docs, 20)
    assert got.columns == docs.columns
    want = [(d, t if not n else k.decode()) for (d, t, *_), (_, _, n, k) in zip(corpus(), brute(corpus(), 20))]
    assert sorted([tuple(r) for r in got.select("doc_id", "text").collect()], key=key) == sorted(want, key=key)
    assert substring_dedup.digests(nothing).count() == substring_dedup.dedup(nothing).count() == 0
