"""Place profiles: who came, when, and the first category and region seen."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.operators.ordering import (
    SEGMENT_SIZE,
    Way,
    by_group_size,
    large_groups,
    numbered_groups,
    ordered_list,
    segment_of,
)

MISSING_RECENCY = 100  # fixed value: recency of a visit whose month is unknown


def place_heads(df: DataFrame) -> DataFrame:
    """First category and region per place, in row order."""
    head = F.min_by(F.struct("catname", "region"), "row_id").alias("_head")
    return df.groupBy("pid").agg(head).select("pid", F.col("_head.catname").alias("catname"), F.col("_head.region").alias("region"))


def _by_place(df: DataFrame, large: DataFrame | None, work: Way) -> DataFrame:
    """``work`` on the rows of each place: ordinary places meet in one task, where later steps find them, large ones stay spread."""
    return by_group_size(df, ["pid"], large, lambda rows: work(rows.repartition("pid")), work)


def first_visits(df: DataFrame, column: str) -> DataFrame:
    """``pid, <column>, first_row, first_block``: distinct visitors (``uid``) or times (``time``), not yet numbered."""
    return _first_visits(df, column, large_groups(df, ["pid"]))


def _first_visits(df: DataFrame, column: str, large: DataFrame | None) -> DataFrame:
    first = [F.min("row_id").alias("first_row"), F.min("row_block").alias("first_block")]
    return _by_place(df.select("pid", column, "row_id", "row_block"), large, lambda rows: rows.groupBy("pid", column).agg(*first))


def _first_seen(df: DataFrame, column: str, large: DataFrame | None) -> DataFrame:
    seen = numbered_groups(_first_visits(df, column, large), ["pid"], [F.col("first_row")], F.col("first_block"), large)
    return seen.select("pid", "position", column, "first_row")


def place_users(df: DataFrame) -> DataFrame:
    """``pid, position, uid, first_row``: distinct visitors in first-seen order."""
    return _first_seen(df, "uid", large_groups(df, ["pid"]))


def place_times(df: DataFrame) -> DataFrame:
    """``pid, position, time, first_row``: distinct times in first-seen order."""
    return _first_seen(df, "time", large_groups(df, ["pid"]))


def visitor_recency(df: DataFrame) -> DataFrame:
    """``pid, uid, recency, least, first_row, first_block``: the smallest recency of each visitor, 100 where all are missing."""
    return _visitor_recency(df, large_groups(df, ["pid"]))


def _visitor_recency(df: DataFrame, large: DataFrame | None) -> DataFrame:
    first = [F.min("recency").alias("least"), F.min("row_id").alias("first_row"), F.min("row_block").alias("first_block")]
    rows = df.select("pid", "uid", "recency", "row_id", "row_block")
    best = _by_place(rows, large, lambda held: held.groupBy("pid", "uid").agg(*first))
    return best.withColumn("recency", F.coalesce("least", F.lit(MISSING_RECENCY)).cast("int"))


def latest_visit_per_user(df: DataFrame) -> DataFrame:
    """``pid, position, uid, recency``: most recent visitors first, those without a recency last."""
    return _latest_visit_per_user(df, large_groups(df, ["pid"]))


def _latest_visit_per_user(df: DataFrame, large: DataFrame | None) -> DataFrame:
    block = F.struct(F.coalesce("least", F.lit(2**31 - 1)).alias("r"), F.col("first_block").alias("b"))
    order = [F.asc_nulls_last("least"), F.col("first_row")]
    return numbered_groups(_visitor_recency(df, large), ["pid"], order, block, large).select("pid", "position", "uid", "recency")


def profile_lists(df: DataFrame, size: int, with_recency: bool = False) -> list[DataFrame]:
    """``pid, segment`` and lists of at most ``size`` elements: a table of the visitors of each place, and one of its times."""
    large = large_groups(df, ["pid"])
    position = F.col("position")
    who = _latest_visit_per_user(df, large) if with_recency else _first_seen(df, "uid", large)
    when = _first_seen(df, "time", large)

    def lists(rows: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
        made = (ordered_list(position, F.col(c), F.col(key).isNotNull()).alias(name) for c, name in names.items())
        return rows.groupBy("pid", segment_of(position, size).alias("segment")).agg(*made)

    return [lists(who, "uid", {"uid": "uids", **({"recency": "recencies"} if with_recency else {})}), lists(when, "time", {"time": "times"})]


def with_heads(df: DataFrame, lists: Sequence[DataFrame]) -> DataFrame:
    """One row per place and segment from tables of lists, with the place's category and region in every segment.

    The lists are made where the rows of a place are, so whole lists travel here and not their entries.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lists)
    names = [c for c in rows.columns if c not in ("pid", "segment")]
    held = (F.coalesce(F.first(c, ignorenulls=True), F.array().cast(rows.schema[c].dataType)).alias(c) for c in names)
    segments = rows.groupBy("pid", "segment").agg(*held)
    return segments.join(place_heads(df), "pid").select("pid", "segment", "catname", "region", *names)


def place_profile(df: DataFrame, size: int = SEGMENT_SIZE) -> DataFrame:
    return with_heads(df, profile_lists(df, size))


def place_profile_with_recency(df: DataFrame, size: int = SEGMENT_SIZE) -> DataFrame:
    return with_heads(df, profile_lists(df, size, with_recency=True))
