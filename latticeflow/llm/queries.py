"""Queries of the operators over the standard tables, with the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeflow.llm import bpe, chat, embedding_lsh, exact_dedup, filter_audit, lexical, mixing, pii, quality_ftrl, quality_gbt, simhash, superkmers, toxicity_fm


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = bpe.encode(docs.select("doc_id", "text"), default_tokenizer())
    return done.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda c: c["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in pii.BASE], F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op3_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality_gbt.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return done.select("doc_id", *quality_gbt.COUNTS, "base_failed", "kept", "score")


def op4_superkmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = superkmers.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ftrl.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_embedding_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_lsh.near_duplicates(table(spark, sf_dir, "embeddings"))


#: A conversation whose texts are the template's own control strings.
HARD_CONVERSATION = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = " UNION ALL ".join(f"SELECT {c}L AS conv_id, {n}L AS turn, '{r}' AS role, '{x}' AS text" for c, n, r, x in HARD_CONVERSATION)
    return chat.digests(turns.unionByName(spark.sql(hard)))


OP7_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), moves AS (
  SELECT *, coalesce(lag(role) OVER w, 'start') AS before, lead(role) OVER w IS NULL AS final
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), told AS (
  SELECT *, CASE role WHEN 'system' THEN 24 WHEN 'user' THEN 13 WHEN 'assistant' THEN 13 END AS marks,
    (before || '>' || role) IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AND (NOT final OR role = 'assistant') AS fine
  FROM moves
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(marks + length(text)) + sum(length(regexp_replace(text, '[^' || chr(92) || chr(92) || ']', '', 'g')))
   + sum(length(regexp_replace(text, '<(?:/s>|s>|[|](?:says|system|end_system|reply|turn|end_turn)[|]>)|[[](?:INST|/INST)[]]', chr(1), 'g')) - length(replace(regexp_replace(text, '<(?:/s>|s>|[|](?:says|system|end_system|reply|turn|end_turn)[|]>)|[[](?:INST|/INST)[]]', chr(1), 'g'), chr(1), ''))))::BIGINT AS formatted_chars,
  bool_and(fine) AS valid
FROM told GROUP BY conv_id
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    done = mixing.mix(docs)
    return done.select("doc_id", "source", mixing.tokens(F.col("text")).alias("n_tokens"), F.round("exponent", 6).alias("exponent"), F.round("weight", 6).alias("weight"), "copies")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.group(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op10_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_fm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(table(spark, sf_dir, "documents"))


OP13_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_pii": op2_pii,
    "op3_quality_gbt": op3_quality_gbt,
    "op4_superkmers": op4_superkmers,
    "op5_quality_ftrl": op5_quality_ftrl,
    "op6_embedding_lsh": op6_embedding_lsh,
    "op7_chat": op7_chat,
    "op8_mixing": op8_mixing,
    "op9_simhash": op9_simhash,
    "op10_toxicity_fm": op10_toxicity_fm,
    "op11_filter_audit": op11_filter_audit,
    "op12_lexical_search": op12_lexical_search,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLES: dict[str, str] = {
    "op7_chat": OP7_SQL,
    "op8_mixing": mixing.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op12_lexical_search": lexical.SQL,
    "op13_exact_dedup": OP13_SQL,
}
