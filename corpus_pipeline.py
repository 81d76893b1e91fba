"""Corpus pipeline: each stage works on everything its predecessor kept.

Stages but the last return the columns of their input documents; the last
adds nothing to lose: it returns every document with its token ids.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import bpe, decontam, quality, secrets, simhash
from tillroll.llm.common import RunFolder, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects (score below 0.3) go.

    Null and empty texts are scored like any other, by their statistics; repeated rows get one score; without
    labelled rows the model is constant, and an empty table stays empty."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).where("predicted = 1").select("row.*")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays: the one with the least doc_id.

    Null, empty and blank texts have fingerprint zero and form one group; of rows with one id the one with the least
    hash of its columns stays; a row without an id stays only where its group has no other."""
    return simhash.deduplicate(docs, shingle=3, radius=3)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts have no words and stay, repeated rows share their fate, and without benchmark rows all stay."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0").select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark and n_chars follows; every document stays, a null text stays null."""
    found = secrets.scan(docs)
    text = F.when(F.col("row.text").isNotNull() & (F.size("spans") > 0), secrets.redacted()).otherwise(F.col("row.text"))
    found = found.select("row", text.alias("clean"))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("clean") != F.col("row.text"), F.length("clean")).otherwise(F.col("row.n_chars"))
    return found.select(*[(new[f.name] if f.name in new else F.col("row")[f.name]).cast(f.dataType).alias(f.name) for f in docs.schema])


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with token_ids, n_tokens and round_trip (the ids decode to the text) behind them.

    Null and empty texts have no ids; repeated rows are encoded each. An input column with the name of a result
    (letter case aside) gives way to it."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.decode(bpe.encode(docs, ranks, pattern), ranks, pattern)
    whole = F.coalesce(F.col("row.text"), F.lit("")).cast("binary") == F.col("decoded")
    new = [F.col("ids").alias("token_ids"), F.size("ids").cast("long").alias("n_tokens"), whole.alias("round_trip")]
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ("token_ids", "n_tokens", "round_trip")]
    return out.select(*kept, *new)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

#: The fitted model and XXH64 are beyond SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written as Parquet and reread."""
    folder = RunFolder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = folder.write(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            folder.drop(f"stage{k - 1}")
    return docs
