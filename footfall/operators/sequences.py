"""User histories cut into training and evaluation sequences.

Every example needs only a bounded number of a user's latest visits (80 for training, 51 for evaluation), so a
user's whole history is never collected: Spark keeps the latest visits per map task before it shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from footfall.functions.seeded import DEFAULT_SEED, unit_interval
from footfall.functions.text import TIME_FORMAT, format_times

WINDOW = 50
STEP = 10
HISTORY_CAP = 80
MIN_TRAIN_VISITS = 10
MASK_PROBABILITY = 0.1

SEQUENCE_COLUMNS = ["uid", "seq_no", "pids", "times", "target", "target_time"]


def recent_visits(df: DataFrame, cap: int) -> DataFrame:
    """``uid, visits``: each user's last ``cap`` visits by ``(time, row_id)``, oldest first."""
    newest_first = W.partitionBy("uid").orderBy(F.desc("time"), F.desc("row_id"))
    kept = (
        df.select("uid", "pid", "time", "row_id")
        .withColumn("_rank", F.row_number().over(newest_first))
        .where(F.col("_rank") <= cap)
    )
    return kept.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("time", "row_id", "pid"))).alias("visits"))


def cap_history(df: DataFrame, cap: int = HISTORY_CAP) -> DataFrame:
    return recent_visits(df, cap)


def _examples(windows: DataFrame, window: str = "window") -> DataFrame:
    """The last visit of a window is the target, the others are the input."""
    visits = F.col(window)
    inputs = F.slice(visits, F.lit(1), F.size(visits) - 1)
    return windows.withColumns({"inputs": inputs, "goal": F.element_at(visits, -1)})


def _finish(examples: DataFrame, others: Sequence[str] = ()) -> DataFrame:
    return examples.select(
        *others,
        "uid",
        F.col("seq_no").cast("int").alias("seq_no"),
        F.transform("inputs", lambda v: v["pid"]).alias("pids"),
        format_times(F.transform("inputs", lambda v: v["time"])).alias("times"),
        F.col("goal.pid").alias("target"),
        F.date_format("goal.time", TIME_FORMAT).alias("target_time"),
    )


def train_windows(history: DataFrame, window: int = WINDOW, step: int = STEP) -> DataFrame:
    """``uid, seq_no, end, window``: windows taken back from the newest visit, ``step`` apart.

    A history shorter than ``window`` with at least ten visits gives a single example over all of it.
    """
    n = F.size("visits")
    # A descending sequence fails where its start is below its end, so the long branch is guarded.
    ends = F.when(n >= window, F.sequence(F.greatest(n, F.lit(window)), F.lit(window), F.lit(-step))).otherwise(F.array(n))
    return (
        history.where(n >= min(MIN_TRAIN_VISITS, window))
        .select("uid", "visits", F.posexplode(ends).alias("seq_no", "end"))
        .select(
            "uid",
            "seq_no",
            "end",
            F.slice("visits", F.greatest(F.col("end") - window, F.lit(0)) + 1, F.least(F.col("end"), F.lit(window))).alias("window"),
        )
    )


def mask_augment(
    examples: DataFrame, mask_prob: float | Column = MASK_PROBABILITY, window: int = WINDOW, seed: int = DEFAULT_SEED
) -> DataFrame:
    """With probability ``mask_prob`` a random input visit becomes the target and the old target joins the input.

    Only full windows take part. The draw depends on the seed, the user and the window's end.
    """
    draw = unit_interval(seed, F.lit("mask"), F.col("uid"), F.col("end"))
    spot = F.floor(unit_interval(seed, F.lit("spot"), F.col("uid"), F.col("end")) * F.size("inputs")).cast("int")
    masked = (F.size("window") == window) & (F.size("inputs") >= 1) & (draw < mask_prob)
    marked = examples.withColumns({"masked": masked, "_spot": spot})
    others = F.filter("inputs", lambda v, i: i != F.col("_spot"))
    return marked.withColumns(
        {
            "inputs": F.when(F.col("masked"), F.concat(others, F.array("goal"))).otherwise(F.col("inputs")),
            "goal": F.when(F.col("masked"), F.get("inputs", F.col("_spot"))).otherwise(F.col("goal")),
        }
    ).drop("_spot")


def train_sequences(
    train: DataFrame,
    window: int = WINDOW,
    step: int = STEP,
    mask_prob: float = MASK_PROBABILITY,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    examples = _examples(train_windows(cap_history(train), window, step))
    return _finish(mask_augment(examples, mask_prob, window, seed))


def _evaluation_windows(df: DataFrame, window: int) -> tuple[DataFrame, Column]:
    """The newest ``window + 1`` visits tell every case apart: fewer than, exactly, or more than a window."""
    return recent_visits(df, window + 1).withColumn("seq_no", F.lit(0)), F.size("visits")


def test_examples(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """The final window, or all of a history of three visits up to a window."""
    history, n = _evaluation_windows(df, window)
    final = F.slice("visits", F.greatest(n - window, F.lit(0)) + 1, F.least(n, F.lit(window)))
    return _finish(_examples(history.where((n >= window) | (n > 2)).withColumn("window", final)))


def val_examples(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """The same one visit earlier; a history of exactly one window gives no row."""
    history, n = _evaluation_windows(df, window)
    earlier = F.slice("visits", F.greatest(n - window, F.lit(1)), F.least(n - 1, F.lit(window)))
    return _finish(_examples(history.where((n > window) | ((n < window) & (n > 2))).withColumn("window", earlier)))


def user_histories(train: DataFrame, test: DataFrame, cap: int = HISTORY_CAP) -> DataFrame:
    """``uid, train, test``: each user's last ``cap`` visits of either part, oldest first, empty where there are none.

    The rank is limited before the shuffle, so one pass over the visits and at most ``2 * cap`` of a user's travel.
    """
    newest_first = W.partitionBy("uid").orderBy(F.desc("time"), F.desc("row_id"))

    def newest(rows: DataFrame, part: str) -> DataFrame:
        ranked = rows.select("uid", "pid", "time", "row_id").withColumn("_rank", F.row_number().over(newest_first))
        return ranked.where(F.col("_rank") <= cap).groupBy("uid").agg(
            F.array_sort(F.collect_list(F.struct("time", "row_id", "pid"))).alias(part)
        )

    # Both tables lie by user already, so putting them together moves nothing.
    lists = newest(train, "train").unionByName(newest(test, "test"), allowMissingColumns=True)
    none = F.array().cast(lists.schema["train"].dataType)
    return lists.groupBy("uid").agg(
        *(F.coalesce(F.first(part, ignorenulls=True), none).alias(part) for part in ("train", "test"))
    )


def _cut(split: str, visits: Column, window: int, step: int) -> Column:
    """``array<struct<split, seq_no, end, window>>`` of one split from the newest visits of a user."""
    n = F.size(visits)

    def piece(end: Column, seq_no: Column) -> Column:
        part = F.slice(visits, F.greatest(end - window, F.lit(0)) + 1, F.least(end, F.lit(window)))
        return F.struct(F.lit(split).alias("split"), seq_no.cast("int").alias("seq_no"), end.alias("end"), part.alias("window"))

    if split == "train":
        # A descending sequence fails where its start is below its end, so the long branch is guarded.
        ends = F.when(n >= window, F.sequence(F.greatest(n, F.lit(window)), F.lit(window), F.lit(-step))).otherwise(F.array(n))
        return F.transform(F.when(n >= min(MIN_TRAIN_VISITS, window), ends).otherwise(F.array().cast("array<int>")), piece)
    if split == "val":
        has, end = (n > window) | ((n < window) & (n > 2)), n - 1
    else:
        has, end = (n >= window) | (n > 2), n
    one = F.when(has, F.array(end)).otherwise(F.array().cast("array<int>"))
    return F.transform(one, piece)


def generate_sequences(
    train: DataFrame,
    test: DataFrame,
    window: int = WINDOW,
    step: int = STEP,
    mask_prob: float = MASK_PROBABILITY,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """All splits in one table, told apart by ``split``; write it partitioned by that column.

    Every split needs only the newest visits of a user's train or test part, or of both together, so all four are cut from
    one row for each user.
    """
    users = user_histories(train, test, max(HISTORY_CAP, window + 1))
    # Only the newest HISTORY_CAP train visits are cut into windows, however wide these are.
    capped = F.slice("train", F.greatest(F.size("train") - HISTORY_CAP, F.lit(0)) + 1, F.lit(HISTORY_CAP))
    parts = {"train": capped, "val": F.col("test"), "test": F.col("test"), "test_all": F.array_sort(F.concat("train", "test"))}
    held = users.select("uid", *(visits.alias(split) for split, visits in parts.items()))
    cuts = F.concat(*(_cut(split, F.col(split), window, step) for split in parts))
    rows = held.select("uid", F.explode(cuts).alias("_cut")).select("uid", "_cut.*")
    # A draw below zero never comes up: only train examples are masked.
    examples = mask_augment(_examples(rows), F.when(F.col("split") == "train", F.lit(mask_prob)).otherwise(-1.0), window, seed)
    return _finish(examples, ["split"]).select("split", *SEQUENCE_COLUMNS)
