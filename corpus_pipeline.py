"""A corpus pipeline of five stages, each by one operator of ``vertexloom.llm``.

1. toxicity: documents with a toxicity score of 0.3 or more go.
2. ngram_jaccard: of each group of documents that five-word shingles with a Jaccard similarity of 0.8
   or more connect, the one with the least id stays. Empty texts are in no group.
3. substring_dedup: words in windows of 50 that a document with a smaller id has too are cut out.
4. decontamination: documents that contain 0.8 or more of a benchmark item's five-word shingles go, and
   those that contain an item of fewer words.
5. byte_bpe: texts are encoded, and decoded again as a check.

Rows with a null id are in no group and lose no words; rows that share an id stay or go together in
stage 2, and each for itself in the others. Null texts are kept as they are and have no tokens. An
empty table stays empty. Texts of any length go through each stage whole. Of equal or equally similar
documents the least id stays, and scores and shares of exactly a threshold are over it. Columns beyond those of documents are dropped by the first stage, and a
missing one is null.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm import bpe, decontamination, jaccard_join, substring_dedup, toxicity
from vertexloom.llm.queries import RANKS
from vertexloom.llm.workspace import Workspace

#: The columns of documents.
COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c) for c, kind in COLUMNS.items()])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _columns(docs)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, threshold=0.3).filter("predicted = 0").select(*COLUMNS)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard_join.join(docs, shingle=5, num=4, den=5)
    others = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring_dedup.dedup(docs, window=50)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), shingle=5, num=4, den=5, inside=True)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(RANKS))
    whole = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", whole.alias("round_trip"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard", jaccard_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", bpe_stage),
]

#: SQL can't express the first stage; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row, each over all that the one before has kept."""
    work, docs = Workspace(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return docs
