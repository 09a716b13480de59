"""Visit sequences and the place transition graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.operators.ordering import (
    SEGMENT_SIZE,
    by_group_size,
    consecutive_pairs,
    large_groups,
    numbered_groups,
    ordered_list,
    position_in_group,
    segment_of,
)
from footfall.operators.profiles import profile_lists, with_heads

def user_place_steps(df: DataFrame) -> DataFrame:
    """``uid, position, pid, catname`` in input row order (not time order)."""
    return position_in_group(df, ["uid"], [F.col("row_id")], F.col("row_block")).select(
        "uid", "position", "pid", "catname"
    )


def user_place_sequence(df: DataFrame, size: int = SEGMENT_SIZE) -> DataFrame:
    """Per user the lists of places and categories, cut into segments of at most ``size`` visits."""
    steps = user_place_steps(df).withColumn("segment", segment_of(F.col("position"), size))
    return steps.groupBy("uid", "segment").agg(
        ordered_list(F.col("position"), F.col("pid")).alias("pids"),
        ordered_list(F.col("position"), F.col("catname")).alias("catnames"),
    )


def _large_sources(df: DataFrame) -> DataFrame | None:
    """Places with so many visits that their edges are not counted and ranked by one task."""
    return large_groups(df.select(F.col("pid").alias("src")), ["src"])


def _count_edges(pairs: DataFrame, min_freq: int, large: DataFrame | None) -> DataFrame:
    """``src, dst, freq`` and the first encounter, which breaks frequency ties.

    The pairs of an ordinary place meet in one task, where they are ranked later on too; those of a large one are counted map-side.
    """

    def counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy("src", "dst").agg(
            F.count(F.lit(1)).alias("freq"), F.min(F.struct("uid", "row_block", "at", "side")).alias("first")
        )

    edges = by_group_size(pairs, ["src"], large, lambda rows: counted(rows.repartition("src")), counted)
    return edges.withColumn("first_block", F.col("first.row_block")).where(F.col("freq") >= min_freq)


def forward_edges(df: DataFrame, min_freq: int = 1) -> DataFrame:
    """Ordered consecutive pairs within a user, self pairs included."""
    return _forward_edges(df, min_freq, _large_sources(df))


def _forward_edges(df: DataFrame, min_freq: int, large: DataFrame | None) -> DataFrame:
    pairs = consecutive_pairs(df, "uid", "pid", "row_id", "row_block").select(
        F.col("pid").alias("src"), F.col("next_pid").alias("dst"), "uid", "row_block", "at", F.lit(1).alias("side")
    )
    return _count_edges(pairs, min_freq, large)


def undirected_edges(df: DataFrame, min_freq: int = 1) -> DataFrame:
    """Both neighbours of every visit count, so a self pair adds two; at one visit the earlier neighbour comes first."""
    return _undirected_edges(df, min_freq, _large_sources(df))


def _undirected_edges(df: DataFrame, min_freq: int, large: DataFrame | None) -> DataFrame:
    steps = consecutive_pairs(df, "uid", "pid", "row_id", "row_block")
    later = F.struct(
        F.col("pid").alias("src"), F.col("next_pid").alias("dst"), F.col("row_block").alias("row_block"), F.col("at").alias("at"),
        F.lit(1).alias("side"),
    )
    earlier = F.struct(
        F.col("next_pid").alias("src"), F.col("pid").alias("dst"), F.col("next_row_block").alias("row_block"),
        F.col("next_at").alias("at"), F.lit(0).alias("side"),
    )
    pairs = steps.select("uid", F.explode(F.array(later, earlier)).alias("e")).select("e.*", "uid")
    return _count_edges(pairs, min_freq, large)


def ranked_edges(edges: DataFrame) -> DataFrame:
    """``src, dst, freq, rank``: frequency descending, ties by first encounter."""
    return _ranked_edges(edges, large_groups(edges, ["src"]))


def _ranked_edges(edges: DataFrame, large: DataFrame | None) -> DataFrame:
    """A block holds the edges of one frequency that one user met first in one block of rows, so it is as bounded as that."""
    block = F.struct((-F.col("freq")).alias("f"), F.col("first.uid").alias("u"), F.col("first_block").alias("b"))
    ranked = numbered_groups(edges, ["src"], [F.desc("freq"), F.asc("first")], block, large, name="rank")
    return ranked.select("src", "dst", "freq", "rank")


def forward_neighbors(df: DataFrame, min_freq: int = 1) -> DataFrame:
    large = _large_sources(df)
    return _ranked_edges(_forward_edges(df, min_freq, large), large)


def neighbors(df: DataFrame, min_freq: int = 1) -> DataFrame:
    large = _large_sources(df)
    return _ranked_edges(_undirected_edges(df, min_freq, large), large)


def neighbor_lists(df: DataFrame, ranked: DataFrame, name: str = "neighbors", size: int = SEGMENT_SIZE) -> DataFrame:
    """``pid, segment, <name>`` for every place of ``df``; a place without neighbours has one empty list."""
    lists = (
        ranked.withColumn("segment", segment_of(F.col("rank"), size))
        .groupBy(F.col("src").alias("pid"), "segment")
        .agg(ordered_list(F.col("rank"), F.col("dst")).alias(name))
    )
    kind = lists.schema[name].dataType
    places = df.select("pid").distinct()
    return places.join(lists, "pid", "left").select(
        "pid",
        F.coalesce("segment", F.lit(0)).alias("segment"),
        F.coalesce(name, F.array().cast(kind)).alias(name),
    )


def attach_neighbors(
    df: DataFrame, both: DataFrame, forward: DataFrame, size: int = SEGMENT_SIZE, with_recency: bool = False
) -> DataFrame:
    """The place profile of the visits ``df`` with both neighbour lists, segment by segment.

    ``both`` and ``forward`` are ranked edges. The lists of visitors, times and neighbours are rows of one table, which is
    aggregated once; a place with more neighbour segments than visitor segments has its category and region in all.
    """
    lists = profile_lists(df, size, with_recency)
    for name, ranked in (("neighbors", both), ("forward_neighbors", forward)):
        entry = ordered_list(F.col("rank"), F.col("dst"), F.col("dst").isNotNull()).alias(name)
        lists.append(ranked.groupBy(F.col("src").alias("pid"), segment_of(F.col("rank"), size).alias("segment")).agg(entry))
    return with_heads(df, lists)
