import math
import random
import zlib

import numpy as np

from vertexloom.llm import toxicity
from vertexloom.llm.toxicity import LabelModel, fit_linear


def made(spark, n=900):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        w = [f"{rng.choice('bdfgklm')}{rng.choice('aeiou')}{rng.choice('nrst')}{rng.choice('aeiou')}{rng.randrange(9)}" for _ in range(rng.randrange(3, 80))]
        w = ["".join(c for c in x if c.isalpha()) + rng.choice("abcdefgh") * 2 for x in w]
        toxic = rng.random() < 0.2
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "Zorkan", "zorkel", "ZORKIX", "moron"]))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    docs += [(n, ""), (n + 1, None), (None, "idiot"), (n + 2, "word " * 20_000 + "zorkum")]
    labels += [(0, 1, labels[0][2]), (None, 0, 1), (n + 1, 0, None), (77777, 0, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels, rows, known = made(spark)
    got = toxicity.score(docs, toxicity.train(docs, labels)).withColumn("held_out", toxicity.held_out("doc_id")).collect()
    assert len(got) == len(rows)
    truth = {d: t for d, _, t in known if t is not None}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 100 and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[900] == by_id[901] < 0.3 and by_id[902] >= 0.3


def test_held_out_labels_are_not_used(spark):
    docs, labels, _, known = made(spark)
    turned = spark.createDataFrame([(d, q, 1 - t if d is not None and t is not None and zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, q, t in known], labels.schema)
    a, b = (sorted(map(str, toxicity.score(docs, toxicity.train(docs, x)).select("doc_id", "score").collect())) for x in (labels, turned))
    assert a == b


def test_without_labels_and_without_rows(spark, nothing):
    docs, labels, _, _ = made(spark, 30)
    none = labels.limit(0)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, toxicity.train(docs, none)).collect()}
    assert got[None] == 1 and got[30] == got[31] == 0
    assert toxicity.score(nothing, toxicity.train(nothing, labels)).count() == 0
    same = labels.selectExpr("doc_id", "quality", "1 AS toxic")
    assert all(r["score"] > 0.9 for r in toxicity.score(docs, toxicity.train(docs, same)).collect())


def test_columns_stay_and_clashing_ones_are_replaced(spark):
    df = spark.createDataFrame([(1, "you idiot", "x", 5)], "doc_id long, text string, score string, toxic long")
    out = toxicity.score(df, toxicity.Model({"idiot": 5.0}, -2.0))
    assert out.columns == ["doc_id", "text", "toxic", "score", "predicted"] and out.first()["predicted"] == 1


def test_label_model_finds_voters_worth():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    good, bad = np.where(y, rng.random(4000) < 0.8, rng.random(4000) < 0.02), rng.random(4000) < 0.3
    votes = np.stack([good, good, bad, rng.random(4000) < np.where(y, 0.6, 0.05)], 1).astype(float)
    slips = y ^ (rng.random(4000) < 0.03)
    m = LabelModel(votes, slips)
    assert m.fires_toxic[0] > 0.7 and m.fires_clean[0] < 0.05 and abs(m.fires_toxic[2] - m.fires_clean[2]) < 0.1
    # The first two say the same: one depends on the other and adds nothing of its own.
    assert sorted(m.parent[:2].tolist()) in ([-1, 0], [-1, 1]) and m.parent[2] == -1
    alone = LabelModel(votes[:, [0, 2, 3]], slips)
    assert abs(m.posterior(votes) - alone.posterior(votes[:, [0, 2, 3]])).max() < 0.02
    assert 0.95 < m.given_right[0] < 0.99 and ((m.labels > 0.5) != y).mean() < 0.03


def test_label_model_is_the_product_of_its_rates():
    rng = np.random.default_rng(5)
    y = rng.random(600) < 0.3
    a = rng.random(600) < np.where(y, 0.7, 0.1)
    votes = np.stack([a, np.where(rng.random(600) < 0.8, a, rng.random(600) < 0.2), rng.random(600) < np.where(y, 0.5, 0.05)], 1).astype(float)
    m = LabelModel(votes, y)
    for v, p in zip(votes[:40], m.posterior(votes[:40])):
        like = [1 - m.prior, m.prior]
        for label in (0, 1):
            j = m.joint[label]
            for i in range(3):
                up = m.parent[i]
                if up < 0:
                    rate = j[i, i]
                else:
                    both, other = min(j[i, up], j[i, i], j[up, up]), j[up, up]
                    rate = both / other if v[up] else (j[i, i] - both) / (1 - other)
                like[label] *= rate if v[i] else 1 - rate
        assert abs(p - like[1] / sum(like)) < 1e-6


def test_scores_equal_a_plain_sum():
    rng = random.Random(3)
    weights = {"idi-": 1.5, "idiot": 0.5, "wor-": -0.3, "zz": 2.0}
    model = toxicity.Model(weights, -1.0)
    texts = ["", "idiot idiots worm zz zz", "w0rd idi", "x " * 50] + [" ".join(rng.choice(["idiot", "idiom", "word", "zz", "a"]) for _ in range(9)) for _ in range(30)]
    for t, got in zip(texts, model.scores(texts)):
        hits = {f for w in toxicity.WORD.findall(t) for f in toxicity.features_of_word(w) if f in weights}
        assert abs(got - 1 / (1 + math.exp(1.0 - sum(weights[f] for f in hits)))) < 1e-9


def test_linear_fit_separates():
    rng = np.random.default_rng(1)
    x = (rng.random((500, 6)) < 0.3).astype(float)
    w, b = fit_linear(x, x[:, 2])
    assert w[2] > 5 and np.abs(np.delete(w, 2)).max() < 1.5 and b < 0
