import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import corpus

from vertexloom.llm import token_shards

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.mark.parametrize("total", [1, 2, 3, 10, 255, 256, 257, 5000])
def test_permutation_is_one_to_one(total):
    slots = token_shards.permute(np.arange(total), total, 99)
    assert sorted(slots.tolist()) == list(range(total))
    if total > 100:
        assert slots.tolist() != token_shards.permute(np.arange(total), total, 100).tolist()
        assert abs(np.corrcoef(slots, np.arange(total))[0, 1]) < 0.2


def mix64(x):
    m = (1 << 64) - 1
    x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & m
    x = (x ^ x >> 29) * 0x9E3779B97F4A7C15 & m
    return x ^ x >> 32


def slot_of(number, domain, key):
    """Cycle-walking over six Feistel rounds, one number at a time."""
    half = max(1, (max(domain - 1, 1).bit_length() + 1) // 2)
    keys = [mix64((i * 0x9E3779B97F4A7C15 + key) % (1 << 64)) for i in range(1, 7)]
    while True:
        left, right = number >> half, number & (1 << half) - 1
        for k in keys:
            left, right = right, left ^ mix64(right ^ k) & (1 << half) - 1
        number = left << half | right
        if number < domain:
            return number


def test_round_trip_and_resuming(spark, docs, tmp_path):
    layout = token_shards.write_shards(docs, str(tmp_path / "t"), PATH, public_tokenizers.PATTERN, length=16, shard_bytes=4000)
    want = []
    for doc, text, *_ in corpus():
        ids = REFERENCE.encode_ordinary(text or "")
        want += [(str(doc), i // 16, ids[i : i + 16]) for i in range(0, len(ids), 16)]
    shards = max(1, -(-sum(len((t or "").encode()) for _, t, *_ in corpus()) // 4000))
    rows = token_shards.read_shards(spark, layout).collect()
    got = [(str(r["doc_id"]), r["part"], np.frombuffer(r["tokens"], "<u2").tolist()) for r in rows]
    assert sorted(got) == sorted(want) and layout["total"] == len(want) and len(layout["shards"]) > 5
    assert sorted(r["position"] for r in rows) == list(range(len(want)))
    start = dict(zip(layout["shards"], layout["starts"]))
    assert all(r["position"] == start[r["shard"]] + r["record"] for r in rows)
    # The slot is that of an independent permutation of the number; positions follow the slots.
    ids = [d for d, *_ in corpus() if d is not None]
    parts = -(-max(len((t or "").encode()) for _, t, *_ in corpus()) // 16)
    domain = (max(ids) - min(ids) + 1) * parts
    for r in rows:
        if r["doc_id"] is not None:
            assert r["slot"] == slot_of((r["doc_id"] - min(ids)) * parts + r["part"], domain, 20240229)
            assert r["shard"] == r["slot"] * shards // domain
    order = [r["slot"] for r in sorted(rows, key=lambda r: r["position"])]
    assert order == sorted(order)
    some = token_shards.read_shards(spark, token_shards.read_layout(spark, str(tmp_path / "t"), 16), first=7, count=300)
    assert sorted(map(str, some.collect())) == sorted(str(r) for r in rows if 7 <= r["position"] < 307)
    again = token_shards.write_shards(docs.repartition(2), str(tmp_path / "u"), PATH, public_tokenizers.PATTERN, length=16, shard_bytes=4000)
    assert sorted(map(str, token_shards.read_shards(spark, again).collect())) == sorted(map(str, rows))
    files = list((tmp_path / "t").glob("shard=*/part-*"))
    assert len(files) == len(layout["shards"]) and sum(f.stat().st_size for f in files) == layout["stride"] * len(want)


def test_ids_far_apart(spark, tmp_path):
    rows = [(-(1 << 63) + 1, "a b c " * 50), ((1 << 63) - 1, "d e"), (0, "f")]
    layout = token_shards.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "t"), PATH, public_tokenizers.PATTERN, length=16)
    assert {r["doc_id"] for r in token_shards.read_shards(spark, layout).collect()} == {r[0] for r in rows}


def test_empty(spark, nothing, tmp_path):
    layout = token_shards.write_shards(nothing, str(tmp_path / "t"), PATH, public_tokenizers.PATTERN)
    assert layout["total"] == 0 and token_shards.read_shards(spark, layout).count() == 0
