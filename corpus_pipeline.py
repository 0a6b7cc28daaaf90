"""A training corpus from documents: grade, drop boilerplate, drop copies, decontaminate, mix.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; run() writes every
stage's result as Parquet into the shared folder and reads it again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, linededup, mixing, quality, simhash
from tidemark.llm.base import drop_folder, free, shared_folder, table


def grade(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade reaches one half."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    names = tuple(free(docs.columns, *quality.NAMES))
    return quality.grade(docs, model, names=names).filter(f"`{names[-1]}`").drop(*names)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate in their source; n_chars follows the text."""
    (dropped,) = free(docs.columns, "n_dropped")
    done = linededup.drop_boilerplate(docs, F.col("source"), "text", dropped=dropped).drop(dropped)
    return done.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))) if "n_chars" in docs.columns else done


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near copies (Jaccard similarity 0.8 over five-word shingles)."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mixture."""
    return mixing.mix(docs)


STAGES = [("quality", grade), ("line_dedup", drop_lines), ("near_dedup", drop_copies), ("decontaminate", drop_leaks), ("mix", mix_sources)]

#: The stages include trained models and alignments, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after the other. A stage's folder goes once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    at, before = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            drop_folder(spark, before)
        before = f"{at}/{name}"
    return docs
