"""Tables about training runs, told by their names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Datasets in the order in which a name is searched for them, defaults, and keyword presets.
DATASETS = ["NYC_Exploration", "TKY_Exploration", "NYC", "TKY"]
DEFAULT_DIV_WEIGHT = 0.25
DEFAULT_COMMITMENT_WEIGHT = 0.25
DEFAULT_LEARNING_RATE = 5e-5
QUANTISER_KEYWORDS = ["rqvae", "rq-vae", "rq_vae", "vae"]
LANGUAGE_MODEL_KEYWORDS = ["llm", "llama", "gpt", "bert", "roberta", "t5", "transformer"]
CODEBOOK_SIZE_NYC = 32
CODEBOOK_SIZE_OTHER = 64


def _number_after(name: Column, key: str, default: float) -> Column:
    found = F.regexp_extract(name, key + r"(\d+\.?\d*)", 1)
    return F.when(found != "", found.try_cast("double")).otherwise(F.lit(default))


def dataset_of(name: Column) -> Column:
    """The dataset a run name speaks of, case ignored; null when none is found."""
    lower = F.lower(name)
    return F.coalesce(*(F.when(F.contains(lower, F.lit(d.lower())), F.lit(d)) for d in DATASETS))


def parse_run_name(runs: DataFrame, column: str = "run_id") -> DataFrame:
    """Adds what a run's name encodes. A name without a dataset has a null ``dataset_name`` and an ``error`` text."""
    name = F.element_at(F.split(column, "/"), -1)
    lower = F.lower(name)
    mantissa, exponent = (F.regexp_extract(name, r"lr(\d+)e-(\d+)", i) for i in (1, 2))
    rate = F.concat(mantissa, F.lit("e-"), exponent)
    dataset = dataset_of(name)
    return runs.select(
        "*",
        name.alias("run_name"),
        dataset.alias("dataset_name"),
        _number_after(name, "div", DEFAULT_DIV_WEIGHT).alias("div_weight"),
        _number_after(name, "commit", DEFAULT_COMMITMENT_WEIGHT).alias("commitment_weight"),
        F.when(mantissa != "", rate.try_cast("double")).otherwise(F.lit(DEFAULT_LEARNING_RATE)).alias("lr"),
        F.when(F.contains(lower, F.lit("without_l_quant")), 0.0).otherwise(1.0).alias("quant_weight"),
        F.when(F.contains(lower, F.lit("without_l_reconstruction")), 0.0).otherwise(1.0).alias("recon_weight"),
        F.contains(lower, F.lit("withkl")).alias("use_kl_divergence"),
        F.when(dataset.isNull(), F.concat(F.lit("no known dataset in the run name "), name)).alias("error"),
    )


def filter_runs_by_keywords(runs: DataFrame, keywords: Sequence[str], column: str = "run_id") -> DataFrame:
    """Runs whose lower-cased id contains any keyword."""
    words = F.array(*(F.lit(k.lower()) for k in keywords))
    return runs.where(F.exists(words, lambda k: F.contains(F.lower(column), k)))


def codebook_size_for_dataset(dataset: Column) -> Column:
    return F.when(F.contains(F.lower(dataset), F.lit("nyc")), CODEBOOK_SIZE_NYC).otherwise(CODEBOOK_SIZE_OTHER)
