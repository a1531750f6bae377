"""Texts with all the cases that operators are to bear, and small brute-force parts."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text: str | None, lower: bool = False) -> list[bytes]:
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed: int = 1) -> list[tuple]:
    """Documents: distinct, copies, near copies, shared passages, short, empty, null, long, with odd
    white space and letters, rows that repeat, and null ids."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    texts: list[str | None] = [prose(rng, rng.randrange(5, 300)) for _ in range(40)]
    texts += [texts[3]] * 4 + [texts[5].upper()]
    for base in (7, 8, 9):
        w = texts[base].split()
        for k in (1, 3, 8):
            v = list(w)
            for _ in range(k):
                v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, rng.randrange(40))}" for _ in range(6)]
    texts += ["", None, " ", "one", "one two", "one two", "Ünï cödé x y 漢字", "a\tb\nc\rd\x0be\x0cf", prose(rng, 5000), "z" * 5000]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows.append(rows[0])
    rows += [(None, texts[3], None, None, None), (None, None, None, None, None)]
    return rows


def odd_columns(df):
    """The same rows with columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(1).alias(c) for c in ("row", "rep", "key", "digest", "anchors", "text_hash", "chunk", "toxic_", "_id", "_kept", "id", "n", "task", "ids_", "value")])
