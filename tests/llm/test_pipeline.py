"""Each stage against brute force on what the stage before kept, then the whole run."""

import random
import zlib

import pytest
from helpers import DOCS, prose, words

import corpus_pipeline
from corpus_pipeline import COLUMNS, STAGES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    folder = str(tmp_path_factory.mktemp("sf"))
    items = [(i, prose(rng, n, 3000)) for i, n in enumerate([8, 20, 45, 59])]
    passage = prose(rng, 80, 3000)
    docs, labels = [], []
    for i in range(400):
        w = prose(rng, rng.randrange(20, 200), 3000)
        toxic = rng.random() < 0.25
        if toxic:
            w = f"{w} you idiot {prose(rng, 20)} Zorkling"
        docs.append([i, w])
        labels.append((i, 1, int(toxic)))
    for i in range(60):  # near copies, shared passages and leaks
        base = rng.randrange(400)
        w = docs[base][1].split()
        kind = i % 4
        if kind == 0:
            w[len(w) // 2] = "changed"
        elif kind == 1:
            w = f"{prose(rng, 30, 3000)} {passage} {prose(rng, 200, 3000)}".split()
        elif kind == 2:
            w = f"{prose(rng, 90, 3000)} {items[i % len(items)][1].upper()} {prose(rng, 50, 3000)}".split()
        else:
            docs.append([400 + 60 + i, docs[base][1]])
        docs.append([400 + i, " ".join(w)])
    clean = next(i for i, _, toxic in labels if not toxic)
    docs += [[600, ""], [601, None], [602, "x"], [None, docs[clean][1]], [603, "long " * 20_000]]
    rows = [(d, t, "en", "s", len(t or "")) for d, t in docs]
    frame = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS rep", "'x' AS score", "2 AS digest").repartition(4)
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {d: t for d, _, t in labels}, items


def shingles(text):
    w = words(text, lower=True)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def by_brute_force(name, rows, truth, items):
    """The expected (doc_id, text) of a stage over (doc_id, text)."""
    if name == "ngram_jaccard":
        sets = {d: shingles(t) for d, t in rows if d is not None}
        up = {d: d for d in sets}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a in sets:
            for b in sets:
                if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
        return [(d, t) for d, t in rows if d is None or find(d) == d]
    if name == "substring_dedup":
        first, out = {}, []
        for d, t in rows:
            w = words(t)
            for i in range(len(w) - 49) if d is not None else ():
                k = tuple(w[i : i + 50])
                first[k] = min(d, first.get(k, d))
        for d, t in rows:
            w = words(t)
            gone = [False] * len(w)
            for i in range(len(w) - 49) if d is not None else ():
                if first[tuple(w[i : i + 50])] < d:
                    gone[i : i + 50] = [True] * 50
            out.append((d, b" ".join(x for x, g in zip(w, gone) if not g).decode() if any(gone) else t))
        return out
    if name == "decontamination":
        wanted = [shingles(t) for _, t in items]
        return [(d, t) for d, t in rows if not any(5 * len(x & shingles(t)) >= 4 * len(x) for x in wanted)]
    return rows


key = lambda t: tuple(map(str, t))


def test_stages(spark, tables):
    folder, truth, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == list(COLUMNS)
        after = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        if name == "toxicity":
            kept = {d for d, _ in after}
            assert set(after) <= set(before)
            held = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
            assert sum((d in kept) != bool(truth[d]) for d in held) >= 0.97 * len(held)
            assert {600, 601, 602, None} <= kept
        else:
            assert sorted(after, key=key) == sorted(by_brute_force(name, before, truth, items), key=key), name
            assert len(after) < len(before) or name == "substring_dedup" and after != before
        assert all(r["n_chars"] == len(r["text"] or "") for r in docs.collect())
    coded = STAGES[-1][1](spark, docs, folder).collect()
    assert len(coded) == docs.count() and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in coded)
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, whole.collect())) == sorted(map(str, coded))


def test_no_documents(spark, tables):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in STAGES:
        docs = stage(spark, docs, tables[0])
    assert docs.count() == 0


def test_registered():
    import __spark_entry__ as entry

    assert [n for n, _ in STAGES] == ["toxicity", "ngram_jaccard", "substring_dedup", "decontamination", "byte_bpe"]
    names = [q for q in entry.queries() if q.startswith("op")]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 11)) and "pipeline" in entry.queries()
