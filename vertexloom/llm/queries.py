"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm import bpe, chat, decontamination, embedding_dedup, jaccard_join, licenses, lm_scoring, substring_dedup, token_shards, toxicity, workspace

#: The vocabulary of the tokenising queries, among the files of the installed public tokenizers.
RANKS = "byte_bpe_multi_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.decode(bpe.encode(docs, path).drop("text"), path))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "'</s>[INST] ok [/INST]'"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', {said}), (-7L, 1L, 'assistant', {said}) AS t(conv_id, turn, role, text)")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.render(chat.paths(chat.chain(rows))))


def _op1_sql() -> str:
    def escaped(c: str) -> str:
        out = f"replace({c}, chr(92), chr(92) || chr(92))"
        for mark in chat.CONTROL:
            out = f"replace({out}, '{mark}', '{mark[0]}' || chr(92) || '{mark[1:]}')"
        return out

    marks = len(chat.TURN + chat.TEXT + chat.END)
    return f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum({marks} + length({escaped("role")}) + length({escaped("text")}))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.scores(_read(spark, sf_dir, "documents"), order=3, alpha=0.4)
    return scored.withColumn("log_score", F.round("log_score", 4))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos
           FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[^\x20\x09-\x0D]+') AS words FROM documents)),
b AS (SELECT doc_id, pos, word, lag(word) OVER p AS before, lag(word, 2) OVER p AS first FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
n AS (SELECT count(*) AS n FROM w),
size AS (SELECT doc_id, count(*) AS n_words FROM w GROUP BY doc_id),
c1 AS (SELECT word, count(*) AS c FROM w GROUP BY word),
d1 AS (SELECT doc_id, word, count(*) AS c FROM w GROUP BY doc_id, word),
c2 AS (SELECT before, word, count(*) AS c FROM b WHERE before IS NOT NULL GROUP BY before, word),
d2 AS (SELECT doc_id, before, word, count(*) AS c FROM b WHERE before IS NOT NULL GROUP BY doc_id, before, word),
c3 AS (SELECT first, before, word, count(*) AS c FROM b WHERE first IS NOT NULL GROUP BY first, before, word),
d3 AS (SELECT doc_id, first, before, word, count(*) AS c FROM b WHERE first IS NOT NULL GROUP BY doc_id, first, before, word),
s AS (SELECT b.doc_id, b.before, b.first, c1.c - d1.c AS one, p1.c - q1.c AS context1, c2.c - d2.c AS two, p2.c - q2.c AS context2, c3.c - d3.c AS three,
             n.n - size.n_words AS rest
      FROM b JOIN size USING (doc_id) CROSS JOIN n
      JOIN c1 ON c1.word = b.word JOIN d1 ON d1.doc_id = b.doc_id AND d1.word = b.word
      LEFT JOIN c1 p1 ON p1.word = b.before LEFT JOIN d1 q1 ON q1.doc_id = b.doc_id AND q1.word = b.before
      LEFT JOIN c2 ON c2.before = b.before AND c2.word = b.word
      LEFT JOIN d2 ON d2.doc_id = b.doc_id AND d2.before = b.before AND d2.word = b.word
      LEFT JOIN c2 p2 ON p2.before = b.first AND p2.word = b.before
      LEFT JOIN d2 q2 ON q2.doc_id = b.doc_id AND q2.before = b.first AND q2.word = b.before
      LEFT JOIN c3 ON c3.first = b.first AND c3.before = b.before AND c3.word = b.word
      LEFT JOIN d3 ON d3.doc_id = b.doc_id AND d3.first = b.first AND d3.before = b.before AND d3.word = b.word),
t AS (SELECT doc_id, count(*) AS n_words,
             sum(ln(CASE WHEN three > 0 THEN three::DOUBLE / context2
                         ELSE (CASE WHEN first IS NULL THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END)
                              * (CASE WHEN two > 0 THEN two::DOUBLE / context1
                                      ELSE (CASE WHEN before IS NULL THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END)
                                           * (CASE WHEN one > 0 THEN one::DOUBLE / rest ELSE 0.4::DOUBLE / (rest + 1) END) END) END)) AS log_score,
             count(*) FILTER (WHERE CASE WHEN first IS NOT NULL THEN three = 0 ELSE before IS NOT NULL AND two = 0 END) AS n_backed_off
      FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n_words, 0) AS n_words, round(t.log_score, 4) AS log_score, coalesce(t.n_backed_off, 0) AS n_backed_off
FROM documents d LEFT JOIN t USING (doc_id)
"""


#: The words of a text, lower-cased (A-Z) or as they are.
LOWER_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"


def _components_sql(ids: str, links: str = "l") -> str:
    """A recursive table r (id, l): the least id that links (x, y), both ways, reach."""
    return f"""r(id, l) USING KEY (id) AS ({ids} UNION (SELECT {links}.y, min(r.l) FROM r JOIN {links} ON {links}.x = r.id JOIN recurring.r k ON k.id = {links}.y WHERE r.l < k.l GROUP BY 1))"""


OP3_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce({LOWER_WORDS}, []) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]
                                     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
{_components_sql("SELECT doc_id, doc_id FROM d")}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.l AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.id = d.doc_id
"""

OP5_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {LOWER_WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, {LOWER_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
k AS (SELECT DISTINCT least(len(w), 5) AS k FROM b WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, unnest([array_to_string(w[i:i + least(len(w), 5) - 1], ' ') for i in range(1, len(w) - least(len(w), 5) + 2)]) AS g FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
g AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS g FROM d, k WHERE len(w) >= k)
SELECT doc_id, item_id, count(*) AS n_found, any_value(n.n) AS n_item_shingles, count(*)::DOUBLE / any_value(n.n) AS containment
FROM g JOIN i USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 5 * count(*) >= 4 * any_value(n.n)
"""

OP7_SQL = f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x),
{_components_sql("SELECT vec_id, vec_id FROM embeddings")}
SELECT vec_id, coalesce(n.n, 0) AS n_links, r.l AS component_id, r.l = vec_id AS kept FROM embeddings JOIN r ON r.id = vec_id LEFT JOIN n ON n.x = vec_id
"""

OP9_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
g AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, unnest([md5(array_to_string(w[i:i + 49], ' ')) for i in range(1, len(w) - 48)]) AS g FROM d WHERE len(w) >= 50),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM g) WHERE least < doc_id),
x AS (SELECT p.doc_id, p.i, p.word, coalesce(max(f.i) OVER (PARTITION BY p.doc_id ORDER BY p.i) > p.i - 50, false) AS gone FROM p LEFT JOIN f ON f.doc_id = p.doc_id AND f.i = p.i),
t AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM x GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
"""


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_read(spark, sf_dir, "documents"), shingle=3, num=9, den=10)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), inside=True)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_read(spark, sf_dir, "documents"))
    return found.withColumn("dice", F.round("dice", 6))


def _op6_sql(threshold: float = 0.8) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in licenses.TEMPLATES.items())
    words = r"string_split(trim(regexp_replace(lower({0}), '[^\pL\pN]+', ' ', 'g')), ' ')"
    grams = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
    return f"""
WITH t AS (SELECT name, {grams} AS g FROM (SELECT name, {words.format("text")} AS w FROM (VALUES {rows}) AS v(name, text))),
u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM documents
      UNION ALL
      SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: contains(p, chr(10)))) FROM documents),
x AS (SELECT doc_id, {grams} AS g FROM (SELECT doc_id, {words.format("unit")} AS w FROM u) WHERE len(w) > 1),
m AS (SELECT doc_id, name, 2.0::DOUBLE * len(list_intersect(x.g, t.g)) / (len(x.g) + len(t.g)) AS dice
      FROM x JOIN t ON len(x.g) >= len(t.g) * {threshold} / (2 - {threshold}) AND len(x.g) <= len(t.g) * (2 - {threshold}) / {threshold})
SELECT doc_id, name AS license, round(max(dice), 6) AS dice, count(*) AS n_units FROM m WHERE dice >= {threshold} GROUP BY doc_id, name
"""


def op6_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.notices(_read(spark, sf_dir, "documents"))
    return found.withColumn("dice", F.round("dice", 6))


def _op6_notices_sql(threshold: float = 0.8) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in licenses.TEMPLATES.items())
    words = r"string_split(trim(regexp_replace(lower({0}), '[^\pL\pN]+', ' ', 'g')), ' ')"
    pairs = "[w[i] || ' ' || w[i + 1] for i in range(1, len(w))]"
    return f"""
WITH t AS (SELECT name, len(w) - 1 AS n, list_distinct({pairs}) AS g FROM (SELECT name, {words.format("text")} AS w FROM (VALUES {rows}) AS v(name, text))),
u AS (SELECT doc_id, false AS whole, unnest(string_split(text, chr(10))) AS unit FROM documents
      UNION ALL
      SELECT doc_id, false, unnest(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: contains(p, chr(10)))) FROM documents
      UNION ALL
      SELECT doc_id, true, text FROM documents),
p AS MATERIALIZED (SELECT doc_id, whole, {pairs} AS p FROM (SELECT doc_id, whole, {words.format("unit")} AS w FROM u) WHERE len(w) > 1),
x AS (SELECT doc_id, list_distinct(p) AS q, name, g FROM p JOIN t
      ON len(list_distinct(p)) >= len(g) * {threshold} / (2 - {threshold}) AND len(list_distinct(p)) <= len(g) * (2 - {threshold}) / {threshold}
      UNION ALL
      SELECT doc_id, unnest([list_distinct(p[i:i + n - 1]) for i in range(1, len(p) - n + 2)]), name, g FROM p JOIN t
      ON whole AND len(p) > n AND len(list_intersect(p, g)) >= len(g) * {threshold} / (2 - {threshold})),
m AS (SELECT doc_id, name, 2.0::DOUBLE * len(list_intersect(q, g)) / (len(q) + len(g)) AS dice FROM x)
SELECT doc_id, name AS license, round(max(dice), 6) AS dice, count(*) AS n_units FROM m WHERE dice >= {threshold} GROUP BY doc_id, name
"""


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(_read(spark, sf_dir, "embeddings"), threshold=0.9)


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workspace.Workspace(spark, "shards").folder
    docs = _read(spark, sf_dir, "documents")
    layout = token_shards.write_shards(docs, f"{folder}/tokens", public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    read = token_shards.read_shards(spark, layout)
    return read.select("position", "slot", "shard", "record", "doc_id", "part", "n_tokens", F.sha2("tokens", 256).alias("tokens_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(_read(spark, sf_dir, "documents"), window=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op1_chat_formatting": op1_chat_formatting,
    "op2_lm_scoring": op2_lm_scoring,
    "op4_toxicity": op4_toxicity,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_license_notices": op6_license_notices,
    "op6_license_scan": op6_license_scan,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_token_shards": op8_token_shards,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_byte_bpe": op10_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": _op1_sql(),
    "op2_lm_scoring": OP2_SQL,
    "op3_ngram_jaccard_join": OP3_SQL,
    "op5_benchmark_decontamination": OP5_SQL,
    "op6_license_notices": _op6_notices_sql(),
    "op6_license_scan": _op6_sql(),
    "op7_embedding_near_dedup": OP7_SQL,
    "op9_substring_dedup": OP9_SQL,
}
