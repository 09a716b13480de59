"""Train/test split by time, without sorting the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TRAIN_FRACTION = 0.8


def _descend(df: DataFrame, hit: DataFrame | None, keys: list[str], level: str) -> DataFrame:
    """Counts per value of ``level`` inside the spot found so far, and picks the value in which the wanted row lies.

    ``hit`` has one row (the spot and the row's rank inside it), so broadcasting it is always safe.
    """
    inside = df if hit is None else df.join(F.broadcast(hit), keys)
    need = F.lit(None).cast("bigint") if hit is None else F.first("_need")
    counts = inside.groupBy(*keys, level).agg(F.count(F.lit(1)).alias("_rows"), need.alias("_need"))
    upto = W.orderBy(level).rowsBetween(W.unboundedPreceding, W.currentRow)
    running = counts.withColumn("_upto", F.sum("_rows").over(upto))
    if hit is None:
        everything = F.sum("_rows").over(W.orderBy(level).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        running = running.withColumn("_need", F.floor(everything * F.lit(TRAIN_FRACTION)).cast("bigint"))
    found = running.where((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_rows") < F.col("_need")))
    return found.select(*keys, level, (F.col("_need") - (F.col("_upto") - F.col("_rows"))).alias("_need"))


def split_point(df: DataFrame) -> DataFrame:
    """The last train row in ``(time, row_id)`` order as one row ``cut``; no row when the train part is empty.

    Day, then second, then row block: each step counts map-side and only looks inside the spot found before, so the
    tables that meet in one task have at most one row per day, per second of a day, or per row block.
    """
    rows = df.select(F.to_date("time").alias("_day"), "time", "row_block", "row_id")
    day = _descend(rows, None, [], "_day")
    second = _descend(rows, day, ["_day"], "time")
    block = _descend(rows, second, ["_day", "time"], "row_block")
    last = (
        rows.join(F.broadcast(block), ["_day", "time", "row_block"])
        .withColumn("_rank", F.row_number().over(W.orderBy("row_id")))
        .where(F.col("_rank") == F.col("_need"))
    )
    return last.select(F.struct("time", "row_id").alias("cut"))


def _in_train(cut: DataFrame) -> Column:
    return F.coalesce(F.struct("time", "row_id") <= cut.scalar(), F.lit(False))


def time_split(df: DataFrame) -> DataFrame:
    """Adds ``is_train``: true for the first ``int(0.8 * n)`` rows by ``(time, row_id)``."""
    return df.withColumn("is_train", _in_train(split_point(df)))


def drop_cold_test_rows(train: DataFrame, test: DataFrame) -> DataFrame:
    """Test rows whose user and place both occur in train."""
    known_users = train.select("uid").distinct()
    known_places = train.select("pid").distinct()
    return test.join(known_users, "uid", "left_semi").join(known_places, "pid", "left_semi").select(*test.columns)


def split_data(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train rows and the test rows that are not cold."""
    marked = time_split(df)
    train = marked.where("is_train").drop("is_train")
    test = marked.where("not is_train").drop("is_train")
    return train, drop_cold_test_rows(train, test)


def union_train_test(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.unionByName(test)
