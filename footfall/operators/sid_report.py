"""What the semantic ids say: collisions, frequent prefixes and what lies behind them.

A prefix is a code column or two: level 1, level 2, or the combination of the first two. All reports are one
aggregation plus a bounded ranking, never a pass per prefix.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from footfall.functions.seeded import digest
from footfall.functions.text import sid_text

TOP_PREFIXES_LEVEL = 50
TOP_PREFIXES_FIRST_BY_REGION = 20
TOP_COMBOS = 30
TOP_ITEMS = 5
SELECTED_PREFIXES = 4
# How often a prefix has to occur before it can be drawn.
MIN_COUNT_LEVEL = 50
MIN_COUNT_COMBO_CATEGORY = 18
MIN_COUNT_COMBO_REGION = 15


def sid_collisions(codebooks: DataFrame, by: Sequence[str] = ("dataset", "model")) -> DataFrame:
    """Per group: distinct ids, ids shared by two or more places, rows."""
    per_sid = (
        codebooks.withColumn("sid", sid_text(F.col("codes")))
        .groupBy(*by, "sid")
        .agg(F.min("pid").alias("low"), F.max("pid").alias("high"), F.count(F.lit(1)).alias("n"))
    )
    # Two distinct places exist exactly when the smallest and the largest differ: no distinct count is needed.
    shared = (F.col("low") != F.col("high")).cast("bigint")
    return per_sid.groupBy(*by).agg(
        F.count(F.lit(1)).alias("unique_sid"),
        F.coalesce(F.sum(shared), F.lit(0)).alias("collided_sid_buckets"),
        F.sum("n").alias("total_pois"),
    )


def enrich_codebook(codebook: DataFrame, profile: DataFrame, categories: DataFrame) -> DataFrame:
    """Adds ``cat_id, catname, region_id, cat_and_region``. ``profile``: pid, catname id, region id; ``categories``: original, mapped."""
    info = profile.select("pid", F.col("catname").alias("cat_id"), F.col("region").alias("region_id"))
    names = categories.select(F.col("mapped").alias("cat_id"), F.col("original").alias("catname"))
    joined = codebook.join(info, "pid", "left").join(names, "cat_id", "left")
    label = F.concat("catname", F.lit(" @ Region "), F.col("region_id").cast("string"))
    return joined.select(*codebook.columns, "cat_id", "catname", "region_id", label.alias("cat_and_region"))


def level_prefix(level: int) -> Column:
    """The code at a level counted from 1 as text; null where the id is shorter."""
    return F.get("codes", F.lit(level - 1)).cast("string")


def combo_prefix() -> Column:
    """The first two codes as ``first,second``; null where the id is shorter."""
    pair = F.concat_ws(",", level_prefix(1), level_prefix(2))
    return F.when(F.size("codes") > 1, pair)


def with_prefix(codebook: DataFrame, prefix: Column) -> DataFrame:
    """Adds the text ``prefix``; rows without one drop."""
    return codebook.withColumn("prefix", prefix).where("prefix is not null")


def _prefix_order() -> list[Column]:
    # Equal counts: the smaller codes first.
    return [F.desc("n"), F.asc(F.split("prefix", ",").cast("array<int>"))]


def prefix_counts(prefixed: DataFrame) -> DataFrame:
    return prefixed.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))


def prefix_frequency(prefixed: DataFrame, top: int = TOP_PREFIXES_LEVEL) -> DataFrame:
    """``prefix, n``: the ``top`` most frequent prefixes."""
    return prefix_counts(prefixed).orderBy(*_prefix_order()).limit(top)


def top_items_per_prefix(prefixed: DataFrame, item: str, top_prefixes: int, top_items: int = TOP_ITEMS) -> DataFrame:
    """``prefix, item, n, rank``: the most frequent items of each of the most frequent prefixes, ties by item."""
    # At most ``top_prefixes`` rows: the limit bounds the broadcast.
    leading = F.broadcast(prefix_frequency(prefixed, top_prefixes).select("prefix"))
    return rank_items(prefixed.join(leading, "prefix", "left_semi"), item, top_items)


def rank_items(prefixed: DataFrame, item: str, top_items: int = TOP_ITEMS) -> DataFrame:
    counts = (
        prefixed.where(F.col(item).isNotNull())
        .groupBy("prefix", F.col(item).alias("item"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = W.partitionBy("prefix").orderBy(F.desc("n"), F.asc("item"))
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_items)


def sample_frequent_prefixes(
    prefixed: DataFrame, min_count: int, k: int = SELECTED_PREFIXES, seed: object = 42
) -> DataFrame:
    """``prefix, n, slot``: ``k`` prefixes drawn by digest among those that occur at least ``min_count`` times."""
    frequent = prefix_counts(prefixed).where(F.col("n") >= min_count)
    drawn = frequent.withColumn("_draw", digest(seed, F.col("prefix"))).orderBy("_draw").limit(k)
    slot = F.row_number().over(W.orderBy("_draw"))  # k rows
    return drawn.select("prefix", "n", slot.alias("slot"))


def aligned_prefix_matrix(
    prefixed: DataFrame, selected: DataFrame, item: str, k: int = SELECTED_PREFIXES, top_items: int = TOP_ITEMS
) -> DataFrame:
    """Items in any selected prefix's top list by ``slot_1..slot_k``: the count in that prefix's top list, else 0."""
    chosen = F.broadcast(selected.select("prefix", "slot"))  # k rows
    top = rank_items(prefixed.join(chosen, "prefix", "left_semi"), item, top_items).join(chosen, "prefix")
    slots = list(range(1, k + 1))
    wide = top.groupBy("item").pivot("slot", slots).agg(F.sum("n"))
    return wide.select("item", *(F.coalesce(F.col(str(s)), F.lit(0)).alias(f"slot_{s}") for s in slots))


def projection_subset(
    prefixed: DataFrame, selected: DataFrame, item: str, top_items: int = TOP_ITEMS
) -> DataFrame:
    """Rows in a selected prefix whose item is in the union of the selected prefixes' top lists."""
    chosen = F.broadcast(selected.select("prefix"))  # k rows
    inside = prefixed.join(chosen, "prefix", "left_semi")
    # At most k * top_items rows.
    items = F.broadcast(rank_items(inside, item, top_items).select(F.col("item").alias(item)).distinct())
    return inside.join(items, item, "left_semi").select(*prefixed.columns)


def covariance(rows: DataFrame, vector: str = "vector") -> np.ndarray | None:
    """Covariance matrix of the vectors, by merged sums of outer products; none for no rows.

    A task adds up its own rows and sends one small table; the sums over tasks are an aggregation. The matrix has the size of the
    vectors squared, whatever the number of rows.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                # A column of ones makes the sums and the count entries of the same matrix.
                x = np.stack([np.append(v, 1.0) for v in batch.column(0).to_numpy(zero_copy_only=False)])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "s": total[i, j]})

    wide = rows.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    cells = wide.mapInArrow(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    if not cells:
        return None
    size = max(cell.j for cell in cells) + 1
    sums = np.zeros((size, size))
    for cell in cells:
        sums[cell.i, cell.j] = sums[cell.j, cell.i] = cell.s
    n, mean = sums[-1, -1], sums[-1, :-1] / sums[-1, -1]
    return sums[:-1, :-1] / n - np.outer(mean, mean)


def principal_axes(matrix: np.ndarray, k: int = 2) -> np.ndarray:
    """The ``k`` leading eigenvectors as rows, zeros where there are fewer; of each the entry of largest magnitude, the first of equals, is positive."""
    _, columns = np.linalg.eigh(matrix)
    axes = np.zeros((k, len(matrix)))
    axes[: len(matrix)] = columns.T[::-1][:k]
    largest = axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)]
    return axes * np.where(largest < 0, -1.0, 1.0)[:, None]


def project_2d(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """Adds ``x, y``: the vectors along their first two principal axes, of fixed sign. No rows give no rows."""
    matrix = covariance(rows, vector)
    if matrix is None:
        return rows.withColumns({"x": F.lit(0.0), "y": F.lit(0.0)})
    axes = [F.array(*[F.lit(float(v)) for v in axis]) for axis in principal_axes(matrix)]

    def along(axis: Column) -> Column:
        return F.aggregate(F.zip_with(vector, axis, lambda a, b: a * b), F.lit(0.0), lambda total, p: total + p)

    return rows.withColumns({name: along(axis) for name, axis in zip(("x", "y"), axes)})
