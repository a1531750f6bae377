import math
from collections import Counter

import pytest
from helpers import corpus, words

from vertexloom.llm import lm_scoring


def counts(texts, order):
    c = Counter()
    for w in texts:
        for n in range(1, order + 1):
            c.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return c


def brute(texts, train, order, alpha, leave_out):
    total = counts(train, order)
    size = sum(map(len, train))
    out = []
    for w in texts:
        own = counts([w], order) if leave_out else Counter()
        c, n, score, backed = (lambda g: total[g] - own[g]), size - (len(w) if leave_out else 0), 0.0, 0
        for i in range(len(w)):
            room = min(i + 1, order)
            for k in range(room, 0, -1):
                g = tuple(w[i - k + 1 : i + 1])
                if c(g) > 0:
                    score += math.log(c(g) / (c(g[:-1]) if k > 1 else n)) + (room - k) * math.log(alpha)
                    break
            else:
                score += math.log(alpha / (n + 1)) + (room - 1) * math.log(alpha)
                k = 0
            backed += k < room and not (room == 1)
        out.append((len(w), round(score, 4) if w else None, backed))
    return out


key = lambda t: tuple(map(str, t))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_brute_force(docs, order, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD_NGRAMS", 300)
    rows = corpus()
    texts = [words(r[1], lower=True) for r in rows]
    got = [(r["doc_id"], r["n_words"], round(r["log_score"], 4) if r["log_score"] is not None else None, r["n_backed_off"]) for r in lm_scoring.scores(docs, order=order).collect()]
    want = [(r[0], *s) for r, s in zip(rows, brute(texts, texts, order, 0.4, True))]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_other_training_texts(spark, docs, nothing):
    train = [words(r[1], lower=True) for r in corpus(2)]
    table = spark.createDataFrame([(r[0], r[1]) for r in corpus(2)], "doc_id long, text string")
    rows = corpus()
    got = [(r["doc_id"], r["n_words"], round(r["log_score"], 4) if r["log_score"] is not None else None) for r in lm_scoring.scores(docs, table, order=2, alpha=0.3).collect()]
    want = [(r[0], *s[:2]) for r, s in zip(rows, brute([words(r[1], lower=True) for r in rows], train, 2, 0.3, False))]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert lm_scoring.scores(nothing).count() == 0
    assert lm_scoring.scores(docs, nothing).count() == len(rows)


def test_a_registered_query_scores_by_trigrams(spark, tmp_path):
    from vertexloom.llm.queries import QUERIES

    rows = [(1, "a b c d a b d"), (2, "x b c d"), (3, "a b c e"), (4, "q"), (5, ""), (6, None), (7, "a b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = [words(r[1], lower=True) for r in rows]
    got = [tuple(r) for r in QUERIES["op2_lm_scoring"](spark, str(tmp_path)).select("doc_id", "n_words", "log_score", "n_backed_off").collect()]
    want = [(r[0], *s) for r, s in zip(rows, brute(texts, texts, 3, 0.4, True))]
    assert sorted(got) == sorted(want)
    assert want != [(r[0], *s) for r, s in zip(rows, brute(texts, texts, 2, 0.4, True))]
