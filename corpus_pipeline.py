"""From raw documents to token ids in five stages, each written and read again before the next."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import bpe, line_runs, mixing, ngram_join, quality
from footfall.llm.common import spare
from footfall.session import scratch_folder

VOCABULARY = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, whole."""
    return quality.keep_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated runs of lines; what has no word left goes."""
    return line_runs.keep_first_runs(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return ngram_join.one_of_each(docs, width=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, whole and in part, until every source has its target weight."""
    (figures,) = spare(docs, "_mix_figures")
    tie = F.xxhash64("text")
    return mixing.repeated(mixing.mixed(docs, figures, mixing.n_words(F.col("text")), tie=tie), figures)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of the ids and of the text that decoding them gives."""
    import public_tokenizers

    return bpe.round_trip_digests(docs, public_tokenizers.path(VOCABULARY), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

# Suffix ranks, components and byte-pair merges are beyond one SQL statement; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows go to the shared folder and come back from there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES, 1):
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES):
            return out
        path = os.path.join(folder, f"{number}-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    raise ValueError("there are no stages")
