"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Every source gets the share of the budget that its weight asks for, but at most ``max_epochs`` times its own size; what a
capped source leaves goes to the others by weight, until none is above its cap. A document is then repeated as often as
whole epochs fit into its source's target; the rest of the target is filled with the source's documents in the order of
a seeded digest, the last of them in part, so that a source's taken words differ from its target by less than one word.

The order inside a source is never sorted as a whole: sizes are summed per digest bucket, the bucket that holds the cut is
found on those sums, and only the rows of that bucket are ordered. All columns are DataFrame expressions.

Null texts have no words. Null sources are a source of their own, the last one. Rows with one key are ordered by size and
by a digest of the text; rows equal in all of them share one place, so results do not depend on partitioning. Empty tables give empty
tables. Added figures stand in one struct column, so no column of the input clashes with them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from footfall.llm.common import spare, written

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
# Between a word and the white space after it: cuts a text into pieces of one word each.
AFTER_WORD = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2.0
SEED = "mix-1"
# Sources up to which the table of their targets is broadcast (some 100 bytes each); beyond it the join shuffles.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def seeded_digest(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("-"))))


def water_filled(sizes: DataFrame, weights: Sequence[int], budget: float, max_epochs: float) -> DataFrame:
    """``source, source_size, target`` from one row per source: ``source, source_size``.

    Weights repeat in the order of the sources. Sorted by the water level at which a source is full, the first source that
    the level of the rest does not fill marks the level of all that follow.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    everything = W.partitionBy()
    full = F.col("cap") / F.col("weight")
    filling = W.orderBy("full_at", F.col("source").asc_nulls_last())
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
        .withColumn("full_at", full)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn(
            "level",
            (F.lit(budget) * F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
            / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))),
        )
        .withColumn("free", F.col("level") <= F.col("full_at"))
        .withColumn("water", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(
            filling.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        .select(
            "source",
            "source_size",
            F.when(F.col("free"), F.col("weight") * F.col("water")).otherwise(F.col("cap")).alias("target"),
        )
    )


def mixed(
    df: DataFrame,
    out: str,
    size: Column,
    source: str = "source",
    key: str = "doc_id",
    tie: Column | None = None,
    weights: Sequence[int] = WEIGHTS,
    budget: float = BUDGET,
    max_epochs: float = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """``df`` and a struct ``out``: ``size, source_size, target, whole`` (full repetitions), ``extra`` (words of one more),
    ``taken`` (all words taken)."""
    if out in df.columns:
        raise ValueError(f"the input has a column {out}")
    # Three hex digits: 4,096 buckets for each source, of which only the one with the cut is ordered.
    digest = seeded_digest(F.col(f"`{key}`"), seed)
    facts = F.struct(
        size.alias("size"),
        F.col(f"`{source}`").alias("source"),
        digest.alias("digest"),
        F.substring(digest, 1, 3).alias("bucket"),
        (F.lit(0) if tie is None else tie).alias("tie"),
    )
    rows = df.withColumn(out, facts)
    figures = rows.select(f"{out}.*")
    by_bucket = figures.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sources = water_filled(
        by_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, max_epochs
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    sources = sources.withColumn("whole", whole.cast("bigint")).withColumn(
        "cut", F.col("target") - F.col("whole") * F.col("source_size")
    )
    # The one bucket of each source in which its cut lies: the last that starts below it.
    running = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = by_bucket.withColumn("start", F.coalesce(F.sum("words").over(running), F.lit(0)))
    plan = (
        starts.alias("b")
        .join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")))
        .where(F.col("start") <= F.col("cut"))
        .groupBy("s.source", "source_size", "target", "whole", "cut")
        .agg(F.max(F.struct("bucket", "start")).alias("last"))
        .select(F.struct("source", "source_size", "target", "whole", "cut", "last").alias("_plan"))
    )
    # One row per source, written so that its size is known: the rows are not dealt out by source, of which one may be hot.
    own, plans, of, extra = spare(rows, "_mix", "_plan", "_plan_source", "_extra")
    plan = written(plan.select(F.col("_plan").alias(plans), F.col("_plan.source").alias(of)), "mix-plan")
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    joined = rows.withColumn(own, F.col(out)).drop(out)
    joined = joined.join(plan, F.col(f"{own}.source").eqNullSafe(F.col(of))).drop(of)
    here = F.col(f"{own}.bucket") == F.col(f"{plans}.last.bucket")
    order = W.partitionBy(f"{own}.source").orderBy(f"{own}.digest", f"{own}.size", f"{own}.tie")
    before = F.coalesce(
        F.sum(f"{own}.size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    ) + F.col(f"{plans}.last.start")
    room = F.floor(F.col(f"{plans}.cut") - before + F.lit(0.5)).cast("bigint")
    in_cut = joined.where(here).withColumn(
        extra, F.greatest(F.lit(0), F.least(F.col(f"{own}.size"), room)).cast("bigint")
    )
    elsewhere = joined.where(~here).withColumn(
        extra, F.when(F.col(f"{own}.bucket") < F.col(f"{plans}.last.bucket"), F.col(f"{own}.size")).otherwise(F.lit(0))
    )
    result = F.struct(
        F.col(f"{own}.size").alias("size"),
        F.col(f"{plans}.source_size").alias("source_size"),
        F.col(f"{plans}.target").alias("target"),
        F.col(f"{plans}.whole").alias("whole"),
        F.col(extra).alias("extra"),
        (F.col(f"{plans}.whole") * F.col(f"{own}.size") + F.col(extra)).alias("taken"),
    )
    return elsewhere.unionByName(in_cut).withColumn(out, result).drop(own, plans, extra)


def repeated(df: DataFrame, mix: str, text: str = "text") -> DataFrame:
    """The mix as rows: each document as often as it is taken, its last copy cut after the words taken of it."""
    whole, extra, size = F.col(f"{mix}.whole"), F.col(f"{mix}.extra"), F.col(f"{mix}.size")
    copies = (whole + F.when(extra > 0, 1).otherwise(0)).cast("int")
    part = F.array_join(F.slice(F.split(F.col(f"`{text}`"), AFTER_WORD), 1, extra.cast("int")), "")
    (copy,) = spare(df, "_copy")
    last = (F.col(copy) > whole) & (extra < size)
    rows = df.where(copies > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), copies)))
    return rows.withColumn(text, F.when(last, part).otherwise(F.col(f"`{text}`"))).drop(copy, mix)
