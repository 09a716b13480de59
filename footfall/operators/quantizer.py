"""Residual vector quantisation of given vectors.

Vectors table: ``pid, vector array<double>``. Codewords table: ``level, code, centroid array<double>`` with levels
and codes counted from 0 (training state adds ``ema_size`` and ``ema_sum``). The codewords are a model of a few
thousand rows at most: they are read once, checked against ``MAX_CODEWORDS`` and shipped to the tasks. The vectors
are only ever streamed through Arrow batches; encoding needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from footfall.functions.seeded import DEFAULT_SEED, digest
from footfall.session import staged

MAX_CODEWORDS = 16_384
MAX_CODEBOOK_VALUES = 4_000_000  # 32 MB of doubles in every task

# Fixed values of the quantiser.
CODEBOOK_LEVELS = 3
VECTOR_DIM = 64
EMA_DECAY = 0.99
EMA_EPSILON = 1e-5
KL_EPSILON = 1e-8
KMEANS_MAX_ITER = 100
# Codewords of one side of a pair of blocks.
PAIR_BLOCK = 512
# Parts of one in which Lloyd's steps add up residuals.
UNITS = 1 << 24
DIVERSITY_TERMS = ["utilization", "compactness", "kl_divergence"]

ENCODED_TYPE = "codes array<int>, vector array<double>, level_sq array<double>"
WITH_RESIDUALS = ENCODED_TYPE + ", residuals array<array<double>>"


def load_codebooks(codewords: DataFrame) -> list[list[list[float]]]:
    """The codewords as one list of centroids per level, codes 0..K-1 in order."""
    rows = codewords.select("level", "code", "centroid").limit(MAX_CODEWORDS + 1).collect()
    if len(rows) > MAX_CODEWORDS:
        raise ValueError(f"more than {MAX_CODEWORDS} codewords; a codebook has to fit every task's memory")
    if sum(len(row.centroid) for row in rows) > MAX_CODEBOOK_VALUES:
        raise ValueError(f"more than {MAX_CODEBOOK_VALUES} codebook values")
    levels: dict[int, dict[int, list[float]]] = {}
    for row in rows:
        levels.setdefault(row.level, {})[row.code] = list(row.centroid)
    if sorted(levels) != list(range(len(levels))):
        raise ValueError(f"levels have to run from 0 without gaps, got {sorted(levels)}")
    for level, words in levels.items():
        if sorted(words) != list(range(len(words))):
            raise ValueError(f"codes of level {level} have to run from 0 without gaps")
    return [[levels[level][code] for code in range(len(levels[level]))] for level in range(len(levels))]


def quantise(vector: Column, codebooks: Sequence[Sequence[Sequence[float]]], residuals: bool = False) -> Column:
    """``struct<codes, vector, level_sq>``: nearest codeword per level on the running residual.

    The smallest index wins among equally near codewords. ``level_sq`` is the squared residual norm after each level;
    ``residuals``, if asked for, what each level was given.
    """
    books = [[list(map(float, word)) for word in level] for level in codebooks]
    cells = 2_000_000

    @F.pandas_udf(WITH_RESIDUALS if residuals else ENCODED_TYPE)
    def encode(batch: pd.Series) -> pd.DataFrame:
        tables = [np.asarray(level, dtype=np.float64) for level in books]

        def nearest(rest, table):
            # The expanded form finds the candidates by matrix product; rounding could only mislead it among
            # codewords that are almost equally near, and those rows are settled on the exact distances.
            norms, sizes = (rest**2).sum(1)[:, None], (table**2).sum(1)[None, :]
            rough = norms + sizes - 2.0 * rest @ table.T
            near = rough <= rough.min(1)[:, None] + 1e-9 * (1.0 + norms + sizes.max())
            best = near.argmax(1)
            for i in np.flatnonzero(near.sum(1) > 1):
                among = np.flatnonzero(near[i])
                exact = ((rest[i][None, :] - table[among]) ** 2).sum(1)
                best[i] = among[exact.argmin()]
            return best

        if len(batch) == 0:
            names = ["codes", "vector", "level_sq", *(["residuals"] if residuals else [])]
            return pd.DataFrame({name: [] for name in names})
        x = np.stack(batch.to_numpy()).astype(np.float64)
        total = np.zeros_like(x)
        codes, errors, given = [], [], []
        for table in tables:
            rest = x - total
            given.append(rest)
            step = max(1, cells // len(table))  # bounds the distance matrix, whatever the codebook's size
            best = np.concatenate([nearest(rest[i : i + step], table) for i in range(0, len(rest), step)])
            total = total + table[best]
            codes.append(best)
            errors.append(((x - total) ** 2).sum(1))
        out = {
            "codes": list(np.stack(codes, 1).astype(np.int32)),
            "vector": list(total),
            "level_sq": list(np.stack(errors, 1)),
        }
        if residuals:
            out["residuals"] = [list(row) for row in np.stack(given, 1)]
        return pd.DataFrame(out)

    return encode(vector)


def nearest_codeword(vectors: DataFrame, codewords: DataFrame, level: int = 0) -> DataFrame:
    """``pid, code``: argmin of the squared L2 distance to the codewords of one level."""
    book = load_codebooks(codewords.where(F.col("level") == level).withColumn("level", F.lit(0)))
    return vectors.select("pid", quantise(F.col("vector"), book).alias("q")).select("pid", F.get("q.codes", F.lit(0)).alias("code"))


def encode_places(vectors: DataFrame, codewords: DataFrame) -> DataFrame:
    """``pid, codes, vector, level_sq`` keyed by place, whatever order the rows come in. The codebook stays frozen."""
    book = load_codebooks(codewords)
    return vectors.select("pid", quantise(F.col("vector"), book).alias("q")).select("pid", "q.*")


def residual_codes(vectors: DataFrame, codewords: DataFrame) -> DataFrame:
    return encode_places(vectors, codewords).select("pid", "codes")


def residuals_per_level(vectors: DataFrame, codewords: DataFrame) -> DataFrame:
    """``pid, level, code, residual``: what each level was asked to quantise and the code it gave.

    One pass over the vectors: all levels come from one call, and the rows per level are made from its result.
    """
    coded = vectors.select("pid", quantise(F.col("vector"), load_codebooks(codewords), residuals=True).alias("q"))
    levels = F.arrays_zip(F.col("q.codes").alias("code"), F.col("q.residuals").alias("residual"))
    return coded.select("pid", F.posexplode(levels).alias("level", "e")).select("pid", "level", "e.code", "e.residual")


def draw_codewords(vectors: DataFrame, vector_num: int, level: int, seed: int = DEFAULT_SEED) -> list[list[float]]:
    """The first centres of a level: the vectors of the places with the smallest digests, all of them where there are fewer."""
    drawn = vectors.select("vector", digest(f"{seed}|{level}", F.col("pid")).alias("_draw")).orderBy("_draw").limit(vector_num)
    return [list(row.vector) for row in drawn.collect()]


def lloyd_step(vectors: DataFrame, centres: Sequence[Sequence[float]]) -> list[list[float]]:
    """The mean of the vectors nearest to each centre; a centre that has none stays.

    Sums are of whole units of ``1 / UNITS``, so they are exact and depend on no order of rows, tasks or retries. They are map-side
    combined, one row per centre and task.
    """
    dim = len(centres[0])
    code = F.get(quantise(F.col("vector"), [centres])["codes"], F.lit(0))
    units = F.transform("vector", lambda x: F.floor(x * UNITS + 0.5).cast("decimal(28,0)"))
    sums = (
        vectors.select(code.alias("code"), units.alias("u")).groupBy("code")
        .agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.get("u", F.lit(i))).alias(f"s{i}") for i in range(dim)))
    )
    moved = [list(centre) for centre in centres]
    # One row for each centre, of which there are at most MAX_CODEWORDS.
    for row in sums.collect():
        moved[row.code] = [float(row[f"s{i}"]) / UNITS / row.n for i in range(dim)]
    return moved


def fit_codebooks(
    vectors: DataFrame,
    vector_num: int,
    levels: int = CODEBOOK_LEVELS,
    max_iter: int = KMEANS_MAX_ITER,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """k-means per level on the residual left by the levels before, over all rows; returns the codewords table.

    Lloyd's steps from centres drawn by digest, the nearest centre of the smallest code, until none moves or ``max_iter`` steps are
    done: the result is a function of the rows alone. Each level's residuals are written once; a step is one pass over them.
    No rows give no codewords.
    """
    spark: SparkSession = vectors.sparkSession
    rest = staged(vectors.select("pid", F.col("vector").cast("array<double>").alias("vector")), "rest")
    rows = []
    for level in range(levels):
        centres = draw_codewords(rest, vector_num, level, seed)
        if not centres:
            break
        for _ in range(max_iter):
            moved = lloyd_step(rest, centres)
            if moved == centres:
                break
            centres = moved
        rows += [(level, code, centre) for code, centre in enumerate(centres)]
        if level < levels - 1:
            left = F.zip_with("vector", quantise(F.col("vector"), [centres])["vector"], lambda a, b: a - b)
            rest = staged(rest.select("pid", left.alias("vector")), "rest")
    return spark.createDataFrame(rows, "level int, code int, centroid array<double>")


def usage_of(counts: DataFrame, codewords: DataFrame) -> DataFrame:
    """``level, code, n`` for every codeword, used or not, from the counts of the used ones."""
    spine = codewords.select("level", "code")
    return spine.join(counts, ["level", "code"], "left").select("level", "code", F.coalesce("n", F.lit(0)).alias("n"))


def _usage(assigned: DataFrame, codewords: DataFrame) -> DataFrame:
    return usage_of(assigned.groupBy("level", "code").agg(F.count(F.lit(1)).alias("n")), codewords)


def explode_codes(encoded: DataFrame) -> DataFrame:
    """``pid, level, code`` from the codes array."""
    return encoded.select("pid", F.posexplode("codes").alias("level", "code"))


def ema_codebook_update(
    assigned: DataFrame,
    state: DataFrame,
    dim: int = VECTOR_DIM,
    decay: float = EMA_DECAY,
    eps: float = EMA_EPSILON,
) -> DataFrame:
    """One exponential-moving-average step: ``level, code, ema_size, ema_sum, centroid``.

    ``assigned`` is ``level, code, residual``. All sums are map-side combined, one row per codeword and task, so a
    code that holds most rows costs no more than any other.
    """
    sums = assigned.groupBy("level", "code").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(F.get("residual", F.lit(i))).alias(f"s{i}") for i in range(dim))
    )
    return ema_move(sums.select("level", "code", "n", F.array(*(f"s{i}" for i in range(dim))).alias("s")), state, dim, decay, eps)


def ema_move(
    sums: DataFrame, state: DataFrame, dim: int = VECTOR_DIM, decay: float = EMA_DECAY, eps: float = EMA_EPSILON
) -> DataFrame:
    """The same from ``level, code, n, s``: the rows of each used codeword and the sum of what it was given."""
    zero = F.array_repeat(F.lit(0.0), dim)
    fresh = sums.select("level", "code", "n", "s")
    joined = state.select("level", "code", "ema_size", "ema_sum").join(fresh, ["level", "code"], "left")
    moved = joined.select(
        "level",
        "code",
        (F.col("ema_size") * decay + F.coalesce("n", F.lit(0)) * (1 - decay)).alias("ema_size"),
        F.zip_with("ema_sum", F.coalesce("s", zero), lambda a, b: a * decay + b * (1 - decay)).alias("ema_sum"),
    )
    level = W.partitionBy("level")  # at most MAX_CODEWORDS rows
    total, words = F.sum("ema_size").over(level), F.count(F.lit(1)).over(level)
    smoothed = (F.col("ema_size") + eps) / (total + words * eps) * total
    return moved.withColumn("_size", smoothed).select(
        "level", "code", "ema_size", "ema_sum",
        F.transform("ema_sum", lambda v: v / F.col("_size")).alias("centroid"),
    )


def quantization_loss(encoded: DataFrame, commitment: float = 0.25, dim: int = VECTOR_DIM) -> DataFrame:
    """``level, mse, loss`` with ``loss = mse * (1 + commitment)``; the reported total is their sum."""
    return (
        encoded.select(F.posexplode("level_sq").alias("level", "sq"))
        .groupBy("level")
        .agg((F.avg("sq") / dim).alias("mse"))
        .select("level", "mse", (F.col("mse") * (1 + commitment)).alias("loss"))
    )


def utilization_loss(assigned: DataFrame, codewords: DataFrame) -> DataFrame:
    """``level, utilization``: mean distance of a codeword's count from an even share, unused codewords included."""
    return utilization_of(_usage(assigned, codewords))


def utilization_of(usage: DataFrame) -> DataFrame:
    level = W.partitionBy("level")
    even = F.sum("n").over(level) / F.count(F.lit(1)).over(level)
    gaps = usage.withColumn("gap", F.abs(F.col("n") - even))
    return gaps.groupBy("level").agg(F.avg("gap").alias("utilization"))


def compactness_loss(codewords: DataFrame) -> DataFrame:
    """``level, compactness``: twice the mean L2 distance over the pairs of codewords.

    A level's codewords are cut into blocks of ``PAIR_BLOCK``; pairs of blocks are rows, and each adds up the distances between its
    two small matrices. No pair of words becomes a row, and no row holds more than two blocks.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for level, i, j, left, right in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                a, b = np.array(left), np.array(right)
                # Row by row: the differences are exact, and a block's matrix of them stays small.
                lengths = [np.sqrt(((word - (b[k + 1 :] if i == j else b)) ** 2).sum(axis=1)) for k, word in enumerate(a)]
                out.append((level, float(sum(x.sum() for x in lengths)), sum(len(x) for x in lengths)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[c] for row in out], type=kind) for c, kind in enumerate((pa.int32(), pa.float64(), pa.int64()))],
                names=["level", "total", "pairs"],
            )

    blocks = codewords.groupBy("level", F.floor(F.col("code") / PAIR_BLOCK).cast("int").alias("block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("code", "centroid"))), lambda w: w["centroid"]).alias("words")
    )
    other = blocks.select("level", F.col("block").alias("other"), F.col("words").alias("other_words"))
    pairs = blocks.join(other, "level").where("block <= other").select("level", "block", "other", "words", "other_words")
    per_pair = pairs.repartition("level", "block", "other").mapInArrow(sums, "level int, total double, pairs bigint")
    return per_pair.groupBy("level").agg((2 * F.sum("total") / F.sum("pairs")).alias("compactness"))


def kl_usage(assigned: DataFrame, codewords: DataFrame, eps: float = KL_EPSILON) -> DataFrame:
    """``level, kl_divergence``: mean over codewords of ``(1/K) * (ln(1/K) - ln(share + eps))``."""
    return kl_of(_usage(assigned, codewords), eps)


def kl_of(usage: DataFrame, eps: float = KL_EPSILON) -> DataFrame:
    level = W.partitionBy("level")
    words = F.count(F.lit(1)).over(level)
    share = F.col("n") / F.sum("n").over(level)
    term = (1 / words) * (F.log(1 / words) - F.log(share + eps))
    return usage.withColumn("term", term).groupBy("level").agg(F.avg("term").alias("kl_divergence"))


def loss_weights(
    recon_weight: float = 1.0, quant_weight: float = 1.0, div_weight: float = 0.25, use_kl_divergence: bool = False
) -> dict[str, float]:
    weights = {"reconstruction": recon_weight, "quantization": quant_weight}
    for term in ["kl_divergence"] if use_kl_divergence else ["utilization", "compactness"]:
        weights[term] = div_weight
    return weights


def weighted_loss(losses: DataFrame, weights: dict[str, float], diversity_start_epoch: int = 0) -> DataFrame:
    """``epoch, loss``: weighted sum of the terms; the diversity terms count from ``diversity_start_epoch`` on.

    ``losses`` has ``run, epoch`` and one column per term.
    """
    started = F.col("epoch") >= diversity_start_epoch
    total = F.lit(0.0)
    for term, weight in weights.items():
        part = F.col(term) * F.lit(float(weight))
        total = total + (F.when(started, part).otherwise(0.0) if term in DIVERSITY_TERMS else part)
    return losses.select("run", "epoch", total.alias("loss"))


def reconstruction_mse(encoded: DataFrame, dim: int = VECTOR_DIM) -> DataFrame:
    """One row ``mse``: the quantised vector against the input vector, over all entries."""
    return encoded.agg((F.avg(F.element_at("level_sq", -1)) / dim).alias("mse"))
