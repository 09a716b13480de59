"""Ordered work inside groups that stays spread out when one group is huge.

A plain ``Window.partitionBy(key)`` hands a whole group to one task. That is right for groups of up to ``GROUP_ROWS`` rows, which
are shuffled once. A larger group is first cut into blocks:
``block`` is any expression that never decreases along the requested order and holds a bounded number of rows.
Windows then run inside ``(key, block)``, and the blocks of a group are stitched together on a table that has one
row per block. Results do not depend on where the block borders lie.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 1_000_000
SEGMENT_SIZE = 10_000
# Rows up to which one task orders a group by itself, and the digest buckets in which the rows are counted first.
GROUP_ROWS = 100_000
_BUCKETS = 1 << 14

Way = Callable[[DataFrame], DataFrame]


def integer_block(column: Column, width: int = ROWS_PER_BLOCK) -> Column:
    """Block number of a unique integer order key: at most ``width`` rows share one."""
    return F.floor(column / F.lit(width)).cast("bigint")


def large_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """The keys of the groups with more than ``GROUP_ROWS`` rows, ``None`` where there are none.

    Rows are counted by digest bucket first, which moves next to nothing; only keys of buckets above the bound are counted
    one by one. At most one key for ``GROUP_ROWS`` rows comes back.
    """
    keys = list(keys)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(_BUCKETS))
    above = F.col("_rows") > GROUP_ROWS
    full = df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_rows")).where(above).collect()
    if not full:
        return None
    found = df.where(bucket.isin([r["_bucket"] for r in full])).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(above)
    held = found.select(*keys).collect()
    return df.sparkSession.createDataFrame(held, df.select(*keys).schema) if held else None


def in_groups(df: DataFrame, keys: Sequence[str], groups: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose keys, nulls included, are in ``groups``; with ``left_anti`` the others. ``groups`` come from ``large_groups``."""
    listed = groups.toDF(*(f"_large_{k}" for k in keys))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_large_{k}")) for k in keys))
    return df.join(F.broadcast(listed), same, how)


def by_group_size(
    df: DataFrame, keys: Sequence[str], large: DataFrame | None, small_way: Way, large_way: Way
) -> DataFrame:
    """``small_way`` of the rows of ordinary groups and ``large_way`` of those of large ones, in one table."""
    if large is None:
        return small_way(df)
    rest, held = in_groups(df, keys, large, "left_anti"), in_groups(df, keys, large)
    return small_way(rest).unionByName(large_way(held))


def position_in_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], block: Column, name: str = "position"
) -> DataFrame:
    """Adds the 1-based position of each row in its group; rows without a key or block are left out."""
    keys = list(keys)
    return numbered_groups(df, keys, order, block, large_groups(df, keys), name) if keys else _by_blocks(df, keys, order, block, name)


def numbered_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], block: Column, large: DataFrame | None, name: str = "position"
) -> DataFrame:
    """The same where it is known which groups are large: ordinary ones are numbered by a window over the keys, large ones by blocks."""

    def plain(rows: DataFrame) -> DataFrame:
        present = reduce(and_, (c.isNotNull() for c in (block, *map(F.col, keys))))
        return rows.where(present).withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint"))

    return by_group_size(df, keys, large, plain, lambda rows: _by_blocks(rows, keys, order, block, name))


def _by_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], block: Column, name: str) -> DataFrame:
    blocked = df.withColumn("_block", block)
    spot = [*keys, "_block"]
    # The block table is small: one row per group and block, counted map-side before its shuffle.
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    bases = (
        blocked.groupBy(*spot)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*spot, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    )
    numbered = blocked.withColumn("_local", F.row_number().over(W.partitionBy(*spot).orderBy(*order)))
    joined = numbered.join(bases, spot)
    return joined.withColumn(name, (F.col("_base") + F.col("_local")).cast("bigint")).drop("_block", "_local", "_base")


def consecutive_pairs(df: DataFrame, key: str, value: str, order: str, block: str) -> DataFrame:
    """Every pair of neighbouring rows of a group: ``key, value, block, at, next_value, next_block, next_at``.

    ``block, at`` order the rows of a group as ``order`` does, equal ones included, in few bytes: ``at`` is the rank in the block, and an
    ordinary group is one block, null. Inside a block the partner comes from ``lead``; the last row of a block of a large group meets the first row
    of the group's next block on the block table, so no large group is ever walked by one task.
    """
    shape = [key, value, block, "at", f"next_{value}", f"next_{block}", "next_at"]

    def ranked(rows: DataFrame) -> DataFrame:
        inside = W.partitionBy(key, block).orderBy(order)
        here = F.struct(F.col(value), F.col(block), F.col("at"))
        return rows.select(key, value, order, block).withColumn("at", F.rank().over(inside)).withColumn("_next", F.lead(here).over(inside))

    def shaped(rows: DataFrame) -> DataFrame:
        following = (F.col(f"_next.{name}").alias(f"next_{name}") for name in (value, block, "at"))
        return rows.where("_next is not null").select(key, value, block, "at", *following).select(*shape)

    def small(rows: DataFrame) -> DataFrame:
        inside = W.partitionBy(key).orderBy(order)
        here = rows.select(key, value, order).withColumn("at", F.rank().over(inside))
        after = here.withColumns({f"next_{value}": F.lead(value).over(inside), "next_at": F.lead("at").over(inside)})
        none = F.lit(None).cast(df.schema[block].dataType)
        return after.where("next_at is not null").withColumns({block: none, f"next_{block}": none}).select(*shape)

    def large(rows: DataFrame) -> DataFrame:
        steps = ranked(rows)
        here = F.struct(F.col(value), F.col(block), F.col("at"))
        ends = steps.groupBy(key, block).agg(F.min_by(here, order).alias("_first"), F.max_by(here, order).alias("_last"))
        after = F.lead("_first").over(W.partitionBy(key).orderBy(block)).alias("_next")
        bridges = ends.select(key, F.col(f"_last.{value}").alias(value), block, F.col("_last.at").alias("at"), after)
        return shaped(steps).unionByName(shaped(bridges))

    return by_group_size(df, [key], large_groups(df, [key]), small, large)


def segment_of(position: Column, size: int = SEGMENT_SIZE) -> Column:
    """Number of the piece a list position falls in; pieces keep list columns below ``size`` elements."""
    return F.floor((position - 1) / F.lit(size)).cast("bigint")


def ordered_list(position: Column, value: Column, when: Column | None = None) -> Column:
    """Aggregate: the values of a group ordered by position (nulls from ``when`` are left out)."""
    entry = F.struct(position.alias("p"), value.alias("v"))
    collected = F.collect_list(entry if when is None else F.when(when, entry))
    return F.transform(F.array_sort(collected), lambda e: e["v"])
