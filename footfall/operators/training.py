"""Codebook training over epochs: exponential moving averages, loss terms, early stop and resumption.

An epoch is one pass over the vectors, which leaves a small table with a row for each codeword; the next codewords and all loss terms
come from that table. Its state and its losses are committed together, so a training that was interrupted goes on after its last
whole epoch, with the result of one that was not.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.operators import quantizer as Q
from footfall.sources import files

EPOCH = "epoch-"
STATE = "level int, code int, ema_size double, ema_sum array<double>, centroid array<double>"
TERMS = ["reconstruction", "quantization", "utilization", "compactness", "kl_divergence"]
LOG = "epoch int, " + ", ".join(f"{term} double" for term in [*TERMS, "loss"])


def start_state(codewords: DataFrame, size: float = 0.0) -> DataFrame:
    """The moving averages before the first epoch: ``size`` rows at each codeword, none by default."""
    weighed = F.transform("centroid", lambda x: x * F.lit(size))
    return codewords.select("level", "code", F.lit(size).alias("ema_size"), weighed.alias("ema_sum"), "centroid")


def epoch_sums(vectors: DataFrame, codewords: DataFrame, dim: int = Q.VECTOR_DIM) -> DataFrame:
    """``level, code, n, s, sq``: rows of each used codeword, the sum of what it was given, and of the squared rest it left."""
    coded = vectors.select(Q.quantise(F.col("vector"), Q.load_codebooks(codewords), residuals=True).alias("q"))
    levels = F.arrays_zip(F.col("q.codes").alias("code"), F.col("q.residuals").alias("given"), F.col("q.level_sq").alias("sq"))
    rows = coded.select(F.posexplode(levels).alias("level", "e")).select("level", "e.*")
    sums = rows.groupBy("level", "code").agg(
        F.count(F.lit(1)).alias("n"), F.sum("sq").alias("sq"), *(F.sum(F.get("given", F.lit(i))).alias(f"s{i}") for i in range(dim))
    )
    return sums.select("level", "code", "n", F.array(*(f"s{i}" for i in range(dim))).alias("s"), "sq")


def epoch_losses(sums: DataFrame, codewords: DataFrame, dim: int = Q.VECTOR_DIM, commitment: float = 0.25) -> DataFrame:
    """One row with every loss term, summed over the levels; the reconstruction is what the last level leaves."""
    usage = Q.usage_of(sums, codewords)
    # All of these tables have a row for each level.
    errors = sums.groupBy("level").agg((F.sum("sq") / F.sum("n") / dim).alias("mse"))
    by_level = (
        errors.join(Q.utilization_of(usage), "level").join(Q.compactness_loss(codewords), "level").join(Q.kl_of(usage), "level")
    )
    return by_level.agg(
        F.max_by("mse", "level").alias("reconstruction"), (F.sum("mse") * (1 + commitment)).alias("quantization"),
        *(F.sum(term).alias(term) for term in Q.DIVERSITY_TERMS),
    )


def committed_epochs(spark: SparkSession, folder: str) -> list[str]:
    return [f"{folder}/{name}" for name in files.names_in(spark, folder) if name.startswith(EPOCH)]


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """``epoch``, every loss term and ``loss`` of the committed epochs."""
    done = committed_epochs(spark, folder)
    return spark.read.schema(LOG).parquet(*(f"{path}/log" for path in done)) if done else spark.createDataFrame([], LOG)


def read_state(spark: SparkSession, folder: str, epoch: int) -> DataFrame:
    """The moving averages and codewords after an epoch."""
    return spark.read.schema(STATE).parquet(f"{folder}/{EPOCH}{epoch:06d}/state")


def best_epoch(losses: list[float]) -> int:
    """The first epoch of the smallest loss; 0 before any."""
    return min(range(len(losses)), key=lambda e: (losses[e], e), default=0)


def train_codebooks(
    vectors: DataFrame,
    start: DataFrame,
    folder: str,
    epochs: int,
    weights: Mapping[str, float] | None = None,
    diversity_start_epoch: int = 0,
    patience: int | None = None,
    dim: int = Q.VECTOR_DIM,
    commitment: float = 0.25,
    decay: float = Q.EMA_DECAY,
) -> int:
    """Trains up to ``epochs`` epochs into ``folder``, going on after those it holds; returns the best one.

    ``start`` is the state before the first epoch. The diversity terms count from ``diversity_start_epoch`` on. With ``patience``
    training stops after the first epoch that lies more than so many behind the best. Losses are those of the codewords
    that an epoch began with, as its step does not change what it is judged by.
    """
    spark = vectors.sparkSession
    weights = dict(weights or Q.loss_weights())
    losses = [row.loss for row in read_log(spark, folder).orderBy("epoch").collect()]
    for epoch in range(len(losses), epochs):
        if patience is not None and losses and epoch - 1 - best_epoch(losses) > patience:
            break
        state = read_state(spark, folder, epoch - 1) if epoch else start.select("level", "code", "ema_size", "ema_sum", "centroid")
        words = state.select("level", "code", "centroid")
        made = files.scratch(spark, folder, "epoch")
        sums = epoch_sums(vectors, words, dim)
        sums.write.parquet(f"{made}/sums")
        sums = spark.read.schema(sums.schema).parquet(f"{made}/sums")
        Q.ema_move(sums, state, dim, decay).coalesce(1).write.parquet(f"{made}/state")
        terms = epoch_losses(sums, words, dim, commitment).select(F.lit("run").alias("run"), F.lit(epoch).alias("epoch"), *TERMS)
        total = Q.weighted_loss(terms, weights, diversity_start_epoch).select("epoch", "loss")
        terms.join(total, "epoch").select("epoch", *TERMS, "loss").coalesce(1).write.parquet(f"{made}/log")
        files.commit(spark, made, f"{folder}/{EPOCH}{epoch:06d}")
        losses.append(spark.read.schema(LOG).parquet(f"{folder}/{EPOCH}{epoch:06d}/log").first().loss)
    return best_epoch(losses)
