import base64
import hashlib
import random

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from vertexloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
VOCABULARY = bpe.Vocabulary(RANKS)
PARTS = [*"ab'strvelmd  \n\t\r12٣é中.,!-_", "'s", "'re", "'ll", "'ve", "  ", "̀", "🎉", "ⅷ", "\x85", "᠎", "​", " ", "\U00016d40"]


def check(texts):
    for text, ids in zip(texts, VOCABULARY.encode(texts)):
        assert ids.tolist() == REFERENCE.encode_ordinary(text), text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join))
def test_pieces_and_merges_equal_the_library(text):
    check([text])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_any_text(texts):
    check(texts)


def test_long_pieces_and_block_borders():
    rng = random.Random(5)
    check(["".join(rng.choice("abcdefghij") for _ in range(20_000)), " " * 3000, "a" * 256 + " " * 257 + "b", "'" * 1000, "x's" * 500])
    check(["".join(rng.choice(PARTS) for _ in range(n)) for n in range(200, 600, 7)])


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    check(["the cat sat on the mat"] * 3)
    check(["dog and the cat and a cow"] * 3)


def test_query_columns(docs, nothing):
    got = bpe.digests(bpe.decode(bpe.encode(docs, PATH), PATH)).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = REFERENCE.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    key = lambda t: tuple(map(str, t))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert bpe.digests(bpe.decode(bpe.encode(nothing, PATH), PATH)).count() == 0


def test_columns_of_the_outputs_names_are_replaced(spark):
    df = spark.createDataFrame([(1, "a b", "old", 3)], "doc_id long, text string, ids string, decoded long")
    row = bpe.decode(bpe.encode(df, PATH), PATH).first()
    assert row["ids"] == REFERENCE.encode_ordinary("a b") and row["decoded"] == b"a b" and row["offsets"] == [0, 1]


def test_round_trip_in_one_worker(spark, docs, nothing):
    from corpus_pipeline import bpe_stage

    key = lambda t: tuple(map(str, t))
    want = bpe.decode(bpe.encode(docs, PATH), PATH)
    got = bpe.round_trip(docs, PATH)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    df = spark.createDataFrame([(1, "a b", "old", 3)], "doc_id long, text string, ids string, decoded long")
    assert bpe.round_trip(df, PATH).first().asDict() == bpe.decode(bpe.encode(df, PATH), PATH).first().asDict()
    assert bpe.round_trip(nothing, PATH).count() == 0
    assert bpe_stage(spark, docs, "")._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
