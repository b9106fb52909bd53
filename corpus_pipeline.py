"""From raw documents to a tokenised training mixture, in five stages.

Every stage works on all that the one before has kept and returns the columns of
``documents``; the last adds the token ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.blocks import cut_lineage, remove, shared_folder
from tracemill.llm.mixing import mix_sources
from tracemill.llm.near_dedup import MOST_BROADCAST, near_dedup
from tracemill.llm.quality_rules import quality_rules as judged
from tracemill.llm.queries import MIX_SEED, MIX_WEIGHTS, TOKENIZERS, mix_levels
from tracemill.llm.sentencepieces import Vocabulary, encode
from tracemill.llm.substring_dedup import substring_dedup as without_passages

#: what part of the kept tokens the mixture has
SHARE = 0.8
MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
#: rows of SQL can't hold stages that fit words to a vocabulary or follow links; tests use brute force
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return judged(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates (five-word shingles, 0.8)."""
    gone = cut_lineage(near_dedup(docs, shingle=5, percent=80).where("not kept").select("doc_id").distinct())
    few = gone.count() <= MOST_BROADCAST
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has, otherwise as they are; those that lose every word go."""
    done = without_passages(docs, layout=True).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    changed = done.withColumn("text", text)
    return changed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mixture of the sources to their target weights, each document once at most."""
    return mix_sources(docs, mix_levels(), MIX_WEIGHTS, SHARE, epochs=1, seed=MIX_SEED).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their texts."""
    return encode(docs, Vocabulary.load(MODEL))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again.

    A result is removed when the next one is written; the last stays until the rows
    that are returned have been read, and goes with the folder.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
