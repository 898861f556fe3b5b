"""The corpus pipeline: five stages over ``documents``, each written and read again by its caller or by ``run``.

quality classifier -> SimHash near-dedup -> personal data -> mixing -> BPE encoding.  A stage takes
(spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of ``documents``;
the last returns the encoded documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeflow.llm import bpe, mixing, pii, quality_ftrl, simhash
from latticeflow.llm.common import shared_folder, shelved
from latticeflow.llm.queries import default_tokenizer, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the others stay as they are."""
    weights = quality_ftrl.train(docs, table(spark, sf_dir, "labels"))
    plain, back = shelved(docs, "text")
    scored = quality_ftrl.score(plain, weights, keep=tuple(plain.columns))
    return back(scored.where(F.col("score") >= quality_ftrl.THRESHOLD))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id (see :func:`simhash.keep_first`)."""
    return simhash.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; ``n_chars`` follows the text."""
    plain, back = shelved(docs, "text", "n_chars")
    found = pii.find(plain, keep=tuple(plain.columns))
    text = pii.redacted(F.col("text"), F.col("spans"))
    return back(found.withColumn("text", text).withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for."""
    return mixing.realised(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of their decoding."""
    done = bpe.encode(docs.select("doc_id", "source", "lang", "text"), default_tokenizer(), keep=("doc_id", "source", "lang"))
    return done.select("doc_id", "source", "lang", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mixture", mixture), ("encoding", encoding)]

#: SQL can't express the trained classifier, XXH64 or the tokenizer; tests/llm compares each stage with its operator, and the operators with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``; each is written as Parquet in the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
