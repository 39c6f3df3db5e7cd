"""A training-data pipeline over `documents`: each stage works on all that the
one before kept, written as Parquet and read again. All but the last return the
columns of documents, whatever their names; rows with null ids or texts and
repeated rows go through, and empty tables give empty ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphshift.llm import bpe_trie, common, decontaminate, shingle_dedup, substring_dedup, toxicity
from glyphshift.llm.queries import WORD_BPE, table, tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject: a score below 0.7. Null and
    empty texts are scored like any other; repeated rows stay or go together."""
    return toxicity.accepted(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingle sets at a
    Jaccard similarity of 0.8 or more. SimHash links by pivot distance tables come
    first, each verified on the sets; keys of minhashes add the pairs beyond their
    radius. Documents without a word are one group."""
    return shingle_dedup.kept_documents(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the word windows that occur elsewhere. A null text
    stays null; a text that loses all its words stays as an empty one."""
    own, pairs = common.set_aside(docs, ["n_words", "n_removed"])
    done = substring_dedup.remove_repeats(own, join="source")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return common.given_back(done, pairs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Of rows that share a doc_id, or have
    none, those go whose own text holds one."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids and the digest of what they decode to. A
    worker that has served four stages has less memory left for known chunks."""
    done = bpe_trie.encoded(docs.select("doc_id", "text"), tokenizer_path(WORD_BPE), chunks_kept=100_000)
    return done.select("doc_id", "n_tokens", "token_ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: The stages learn, hash and tokenize; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
