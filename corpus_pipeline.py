"""A training corpus in five stages, each one operator of ``keysift.llm``.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read
back as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm import decontam, dedup, mixing, quality, tokens
from keysift.llm.common import fresh, stored
from keysift.session import scratch_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects.

    The classifier learns from the documents and the table ``labels``. A null text is scored as an
    empty one; a null id only means that the row is no trusted example.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels)
    score = fresh(docs, "score")
    scored = quality.with_quality(docs, model, out=score)
    return scored.where(F.col(score) >= quality.CUT).select(docs.columns)


def unique_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: shingles of five words, similarity 0.8.

    Texts without words are linked with nothing and stay.
    """
    return dedup.drop_near_duplicates(docs, dedup.MinHash(words=5))


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of ``benchmark``, up to a tenth of its words edited."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents until each source has its target share of the words."""
    return mixing.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token ids as ORC; per document its id, place, size and checksum, from the files.

    A document that the mix repeats is written as often.
    """
    path = scratch_path(spark, "corpus-tokens")
    tokens.write_tokens(docs, path)
    return tokens.digest(spark, path)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", unique_texts),
    ("decontamination", clean_of_benchmarks),
    ("mix", mixed),
    ("tokens", token_files),
]

# The first stage learns its classifier and the last encodes with a tokenizer: SQL can express neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each result written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
