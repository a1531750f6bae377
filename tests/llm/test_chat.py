import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vertexloom.llm import chat

SCHEMA = "tree_id long, message_id long, parent_id long, role string, text string, score double"


def spelled(paths):
    return {(r["tree_id"], r["rank"]): [x["text"] for x in r["t"]] for r in paths.groupBy("tree_id", "rank").agg(F.array_sort(F.collect_list(F.struct("depth", "text"))).alias("t")).collect()}


def test_paths_are_ranked_by_score(spark):
    rows = [(1, 10, None, "u", "a", 0.0), (1, 11, 10, "a", "b", 1.0), (1, 12, 10, "a", "c", 2.0), (1, 13, 12, "u", "d", None), (1, 14, 12, "u", "e", -3.0), (2, 10, 99, "u", "x", 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert spelled(chat.paths(df)) == {(1, 1): ["a", "c", "d"], (1, 2): ["a", "b"], (1, 3): ["a", "c", "e"], (2, 1): ["x"]}
    assert spelled(chat.paths(df, branches=1)) == {(1, 1): ["a", "c", "d"], (2, 1): ["x"]}


def test_circles_repeats_and_nulls(spark):
    rows = [(1, 1, 2, "u", "a", 0.0), (1, 2, 1, "u", "b", 0.0), (1, 3, 3, "u", "c", 0.0), (1, 4, 1, "u", "d", 0.0)]
    rows += [(2, 5, None, "u", "z", 0.0), (2, 5, None, "u", "y", 0.0), (2, 6, 5, "a", "w", 0.0), (None, 7, None, None, None, None), (None, 8, 7, "a", "v", 0.0)]
    got = spelled(chat.paths(spark.createDataFrame(rows, SCHEMA)))
    assert sorted(map(str, got.items())) == sorted(map(str, {(2, 1): ["z"], (2, 2): ["y", "w"], (None, 1): ["", "v"]}.items()))
    assert chat.paths(spark.createDataFrame([], SCHEMA)).count() == 0


def test_random_trees_equal_a_walk(spark):
    rng = random.Random(8)
    rows = []
    for t in range(4):
        for i in range(1, rng.randrange(2, 70)):
            rows.append((t, i, rng.choice([i - 1, i - 1, i - 1, rng.randrange(i)]) or None, "u", f"{t}.{i}", float(rng.randrange(5))))
    parent = {(t, i): p for t, i, p, *_ in rows}
    score = {(t, i): s for t, i, _, _, _, s in rows}
    want = {}
    for t in range(4):
        branches = []
        for i in [i for (x, i) in parent if x == t and not any(parent[y] == i for y in parent if y[0] == t)]:
            walk, at = [], i
            while at:
                walk.append(at)
                at = parent[t, at]
            branches.append((-sum(score[t, x] for x in walk), i, walk[::-1]))
        want |= {(t, k): [f"{t}.{x}" for x in w] for k, (_, _, w) in enumerate(sorted(branches), 1)}
    assert spelled(chat.paths(spark.createDataFrame(rows, SCHEMA).repartition(3))) == want


PIECES = st.lists(st.sampled_from([*chat.CONTROL, "\\", "\\\\", "<", "|", ">", "[", "]", "/", "x", "é", "\n", "<\\|end|>", "[/IN", "ST]"]), max_size=12).map("".join)


def test_escaping_is_reversible_and_hides_marks(spark):
    texts = []

    @settings(max_examples=300, deadline=None)
    @given(PIECES)
    def gather(t):
        texts.append(t)

    gather()
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r["u"] == r["t"] and not any(m in r["e"] for m in chat.CONTROL)


def test_conversations_are_read_back(spark):
    rng = random.Random(9)
    bits = [*chat.CONTROL, "\\", "ok ", "é\n", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a|<b", None]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randrange(9)))])) for c in (1, 2, 3, None) for t in range(rng.randrange(1, 12))]
    rows += [(4, 0, "user", "x"), (4, 0, "user", "x"), (4, 0, "assistant", "y"), (4, None, "assistant", "z"), (5, 0, "assistant", "long " * 50_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, rank int").repartition(4)
    got = {r["conv_id"]: r for r in chat.digests(chat.render(chat.paths(chat.chain(df)))).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.render(chat.paths(chat.chain(df.limit(0))))).count() == 0


def test_the_mask_spans_the_answers(spark):
    df = spark.createDataFrame([(1, 0, "user", "</s>[INST]"), (1, 1, "assistant", "é[/INST]"), (1, 2, "user", "y"), (1, 3, "assistant", "")], "conv_id long, turn long, role string, text string")
    r = chat.render(chat.paths(chat.chain(df))).first()
    assert r["formatted"] == "<|turn|>user<|text|><\\/s>[\\INST]<|end|><|turn|>assistant<|text|>é[\\/INST]<|end|><|turn|>user<|text|>y<|end|><|turn|>assistant<|text|><|end|>"
    assert [r["formatted"][m["start"] : m["start"] + m["length"]] for m in r["mask"]] == ["é[\\/INST]", ""]
