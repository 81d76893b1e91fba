"""The queries of the operators in this subpackage, over the supplied tables."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, decontam, embed, hostrules, lm, quality, secrets, simhash, suffix, tokenbin, trie
from .common import table
from .sql import ORACLE  # noqa: F401 (re-exported)

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _sha(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], convs.schema)
    return chat.conversation_digests(chat.format_windows(convs.unionByName(extra), RANKS, public_tokenizers.PATTERN))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, offsets=True, keep=["doc_id"])
    split = F.size(F.filter(F.arrays_zip(F.slice("char_end", 1, F.size("ids") - 1).alias("e"), F.slice("char_start", 2, F.size("ids") - 1).alias("s")),
                            lambda x: x["s"] < x["e"]))
    encoded = encoded.select("row", "ids", F.when(F.size("ids") < 2, 0).otherwise(split).cast("long").alias("n_split_chars"))
    decoded = bpe.decode(encoded, RANKS, public_tokenizers.PATTERN, ["row", "n_split_chars"])
    return decoded.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), _sha(F.array_join("ids", " ")).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"), "n_split_chars")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op5_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = tokenbin.token_table(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean natural logarithm of a byte's score (0 for no bytes)."""
    scored = lm.score(table(spark, sf_dir, "documents"))
    mean = F.when(F.col("n_bytes") > 0, F.round(F.col("sum_log") / F.col("n_bytes"), 6)).otherwise(F.lit(0.0))
    return scored.select("doc_id", "n_bytes", mean.alias("score"))


def op7_word_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean natural logarithm of a word's score (0 for no words)."""
    scored = lm.word_score(table(spark, sf_dir, "documents"))
    mean = F.when(F.col("n_words") > 0, F.round(F.col("sum_log") / F.col("n_words"), 6)).otherwise(F.lit(0.0))
    return scored.select("doc_id", "n_words", mean.alias("score"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    out = quality.classify(docs, model, keep=["doc_id"])
    return out.select("row.doc_id", quality.held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      decontam.items_digest("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("row.doc_id", "base", "spans")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in secrets.BASE], _sha(secrets.listed("base")).alias("base_sha256"), secrets.listed("spans").alias("spans"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"), block=20, heads=4)


def op12_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hostrules.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    out = align.align(table(spark, sf_dir, "documents"), a, b, public_tokenizers.PATTERN, keep=["doc_id"], digest=True)
    return out.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


QUERIES = {f.__name__: f for f in (op1_chat_windows, op2_byte_bpe, op3_simhash, op4_embedding_dedup, op5_repeated_bytes, op6_token_files,
                                   op7_lm_score, op7_word_lm_score, op8_quality, op9_decontaminate, op10_secrets, op11_prefix_trie, op12_host_rules, op13_token_alignment)}
