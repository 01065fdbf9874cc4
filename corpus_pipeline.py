"""The corpus pipeline: quality classifier, near-duplicate join, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns the columns of documents; the last returns
one row per written document copy.  run() writes every stage's result as Parquet to the shared folder and reads it again, so an
executor that is lost costs only its tasks of the current stage; what a stage wrote on the way is deleted with the stage before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempora.llm import decontaminate, mixing, ngram_join, quality, token_files
from tempora.llm._shared import discard, settled


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.7; the model is fitted on labels that are not held out."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of every component of similar ones (5-word shingles, Jaccard of at least 0.8)."""
    return ngram_join.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate and the hash-seeded draw say."""
    return mixing.mix(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, occurrence, start, n_tokens, ids_crc32 of every copy, read back from the files through the index."""
    return token_files.write_and_verify(docs)


STAGES = [
    ("quality classifier", classify_quality),
    ("n-gram Jaccard join", join_near_copies),
    ("benchmark decontamination", decontaminate_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_token_files),
]

#: A fitted classifier and byte-pair tokens are beyond SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, f) in enumerate(STAGES):
        last, docs = docs, settled(lambda f=f, docs=docs: f(spark, docs, sf_dir), f"stage-{k}", "zstd")
        discard(last)
    return docs
