"""The registered queries of the subpackage: thin views of the operators in the columns that the checks compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from footfall.llm import (
    bpe, hard_negatives, line_runs, mixing, ngram_join, order_minhash, pii, quality, ranked_search, secrets, style_tree,
    suffix_levels, vector_graph,
)
from footfall.llm.common import written

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file; every executor has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def op1_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_first(documents(spark, sf_dir, "doc_id", "text"), with_text=False)


def op2_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(documents(spark, sf_dir, "doc_id", "text"), vocabulary())


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_components(documents(spark, sf_dir, "doc_id", "text"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir, "doc_id", "text"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = written(
        documents(spark, sf_dir, "doc_id", "source", "text").select(
            "doc_id", "source", mixing.n_words(F.col("text")).alias("size")
        ),
        "sizes",
    )
    return mixing.mixed(sized, "mix", F.col("size")).select(
        "doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken"
    )


def op7_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return line_runs.without_repeats(docs, "runs").select(
        "doc_id", "runs.n_removed", "runs.n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op8_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_levels.without_repeats(documents(spark, sf_dir, "doc_id", "text"))


def op9_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return vector_graph.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir, "doc_id", "text"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("bigint")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label")
    )
    return hard_negatives.hard_negatives(vectors, "id % 50 = 0")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return ranked_search.ranked_search(documents(spark, sf_dir, "doc_id", "text"), items)


def op13_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edit_comparison(documents(spark, sf_dir, "doc_id", "text"))


QUERIES: dict[str, Query] = {
    "op1_line_first_quality": op1_line_first_quality,
    "op2_style_tree": op2_style_tree,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_personal_data": op5_personal_data,
    "op6_source_mix": op6_source_mix,
    "op7_line_runs": op7_line_runs,
    "op8_suffix_levels": op8_suffix_levels,
    "op9_vector_graph": op9_vector_graph,
    "op10_secrets": op10_secrets,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_ranked_search": op12_ranked_search,
    "op13_order_minhash": op13_order_minhash,
    "pipeline": corpus_pipeline.run,
}
