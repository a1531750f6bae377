import random

from helpers import prose, words

from vertexloom.llm import decontamination


def shingles(text, k=5):
    w = words(text, lower=True)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def made():
    rng = random.Random(3)
    items = [(i, prose(rng, n, 5000)) for i, n in enumerate([1, 3, 4, 5, 6, 9, 12, 17, 20, 33, 59, 59, 120])]
    items += [(50, items[8][1]), (51, None), (52, ""), (None, items[9][1]), (8, prose(rng, 15, 5000))]
    docs = [(0, ""), (1, None), (2, items[0][1]), (3, items[1][1].upper()), (4, prose(rng, 20_000, 5000))]
    for i, text in items[3:13]:
        w = text.split()
        cut = w[: max(5, int(len(w) * 0.9))]
        far = [x if k % 6 else "other" for k, x in enumerate(w)]
        for v in (w, cut, far, w[: len(w) // 2]):
            docs.append((len(docs), f"{prose(rng, 300)} {' '.join(v)}\n{prose(rng, 200)}"))
    docs += [docs[6], (None, docs[6][1])]
    return docs, items


def brute(docs, items):
    out = []
    for d, t in docs:
        s = shingles(t)
        for i, u in items:
            x = shingles(u)
            if x and 5 * len(x & s) >= 4 * len(x):
                out.append((d, i, len(x & s), len(x)))
    return out


key = lambda t: tuple(map(str, t))


def test_equals_brute_force(spark, monkeypatch):
    docs, items = made()
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 20
    for limit in (2_000_000, 100):  # all items at once, and in several blocks
        monkeypatch.setattr(decontamination, "BLOCK_SHINGLES", limit)
        got = decontamination.search(d, b)
        assert sorted([tuple(r)[:4] for r in got.collect()], key=key) == sorted(want, key=key)
        kept = decontamination.clean(d, b)
        found = {t for (x, t) in docs for w in want if w[0] == x}
        assert sorted(map(key, kept.collect())) == sorted(key(r) for r in docs if r[1] not in found)


def test_empty_tables(spark, docs, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.search(docs, none).count() == 0 and decontamination.clean(docs, none).count() == docs.count()
    item = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert decontamination.search(nothing, item).count() == decontamination.clean(nothing, item).count() == 0
    assert decontamination.clean(docs, item).count() == docs.count() - 2
    assert decontamination.clean(docs, item).columns == docs.columns


def test_short_items_inside_longer_texts(spark, tmp_path):
    import corpus_pipeline
    from vertexloom.llm.queries import QUERIES

    rng = random.Random(5)
    items = [(1, "Alpha"), (2, "beta gamma"), (3, "one two three four"), (4, "one two three four five six"), (5, ""), (6, None), (7, "beta gamma")]
    docs = [(0, f"{prose(rng, 400)} alpha {prose(rng, 30)}"), (1, "x beta\nGAMMA y z q"), (2, "beta x gamma beta"), (3, f"{prose(rng, 9)} one two three four"), (4, "beta gamma")]
    docs += [(5, "one two three"), (6, "beta"), (7, "gamma beta one two three four five six"), (8, None), (9, ""), (10, "alpha"), (11, "alphas")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t in docs:
        w = words(t, lower=True)
        for j, u in items:
            x, k = shingles(u), min(5, len(words(u)))
            n = len(x & {tuple(w[a : a + k]) for a in range(len(w) - k + 1)})
            if x and 5 * n >= 4 * len(x):
                want.append((i, j, n, len(x)))
    assert {(0, 1), (1, 2), (3, 3), (7, 3), (7, 4), (10, 1)} <= {r[:2] for r in want}
    d.write.parquet(f"{tmp_path}/documents.parquet")
    b.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = QUERIES["op5_benchmark_decontamination"](spark, str(tmp_path))
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(want)
    kept = corpus_pipeline.decontamination_stage(spark, d, str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {r[0] for r in want}
