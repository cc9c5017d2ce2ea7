"""A training-data pipeline over `documents`: reject toxic documents, keep one of each
near-duplicate group, cut repeated passages, mix sources to their weights, and pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and reread for the next one. All but the last keep the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivane.llm import mixing, packing, repeats, simhash, toxicity
from scrivane.llm.common import free_name, write_table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches their language's threshold go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = free_name(docs, "toxicity")
    scored = toxicity.scored(docs, labels, out=out)
    return scored.where(~F.col(out)["flagged"]).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays whose five-word fingerprints are near and whose shingles have a Jaccard similarity of 0.8 or more."""
    return simhash.keep_one(docs, shingle=5, radius=16, least=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under repeated windows go; documents that lose none keep their text as it was."""
    out, cut = free_name(docs, "repeats"), free_name(docs, "_cut_text")
    done = repeats.remove_repeats(docs, out=out)
    text = F.when(F.col(out)["n_removed"] > 0, F.col(out)["kept"]).otherwise(F.col("text"))
    changed = done.withColumn(cut, text)
    return changed.select(*(F.col(cut).alias(c) if c == "text" else F.length(cut).cast("bigint").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands in the result as often as the mix takes it."""
    return mixing.emitted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The classifier, fingerprints and tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
