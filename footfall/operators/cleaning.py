"""From raw text rows to clean check-ins.

Raw columns: ``uid, pid, cat_id, catname, lat, lon, tz_offset, utc_time`` plus the order columns ``row_id``
(unique, in input order) and ``row_block`` (never decreases with ``row_id``, a bounded number of rows each).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.geo import plus_code_region
from footfall.functions.text import TIME_FORMAT
from footfall.session import staged

ORDER_COLUMNS = ["row_id", "row_block"]
CLEAN_COLUMNS = ["uid", "pid", "catname", "region", "time", *ORDER_COLUMNS]

# The weekday names of the raw time stamp, which Spark's parser does not read.
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
UTC_PATTERN = "MMM d HH:mm:ss Z yyyy"

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(text: Column) -> Column:
    """Double from text; null for anything that is not a plain number."""
    text = text.cast("string")
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def to_whole_number(text: Column) -> Column:
    """Int from text; null for anything that is not a whole number, a fraction included."""
    number = to_number(text)
    return F.when(number == F.floor(number), number.try_cast("int"))


def coerce_numeric(df: DataFrame) -> DataFrame:
    """Numbers from text, null where there is none; an offset with a fraction of a minute is none."""
    return df.withColumns(
        {
            "lat": to_number(F.col("lat")),
            "lon": to_number(F.col("lon")),
            "tz_offset": to_whole_number(F.col("tz_offset")),
        }
    )


def valid_coords(df: DataFrame) -> DataFrame:
    """Both ends inclusive; a null coordinate drops the row."""
    return df.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))


def with_region(df: DataFrame) -> DataFrame:
    return df.withColumn("region", plus_code_region(F.col("lat"), F.col("lon")))


def utc_from_text(text: Column) -> Column:
    """``Tue Apr 03 18:00:09 +0000 2012`` as a UTC wall-clock time, names in any case; null when it does not parse."""
    text = F.initcap(text)
    named = F.substring(text, 1, 3).isin(WEEKDAYS) & (F.substring(text, 4, 1) == " ")
    return F.when(named, F.try_to_timestamp(F.substr(text, F.lit(5)), F.lit(UTC_PATTERN)).cast("timestamp_ntz"))


def parse_utc(df: DataFrame) -> DataFrame:
    return df.withColumn("utc_time", utc_from_text(F.col("utc_time"))).where("utc_time is not null")


def local_wall_clock(utc: Column, offset_minutes: Column) -> Column:
    """UTC plus the offset, cut to whole seconds as the text form of the time has no fraction."""
    shifted = utc + F.make_dt_interval(F.lit(0), F.lit(0), offset_minutes, F.lit(0))
    return F.date_trunc("second", shifted).cast("timestamp_ntz")


def local_time(df: DataFrame) -> DataFrame:
    """Adds ``time``; rows without an offset drop."""
    return df.where("tz_offset is not null").withColumn(
        "time", local_wall_clock(F.col("utc_time"), F.col("tz_offset"))
    )


def local_time_text(df: DataFrame) -> DataFrame:
    return local_time(df).withColumn("time_text", F.date_format("time", TIME_FORMAT))


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"the table lacks {missing} among its columns {df.columns}")
    return df


def project_rename(df: DataFrame, columns: Sequence[str] = CLEAN_COLUMNS, rename: Mapping[str, str] | None = None) -> DataFrame:
    """Renames by name, then keeps ``columns``; a missing column is an error before any job starts."""
    renamed = df.withColumnsRenamed(dict(rename or {}))
    return require_columns(renamed, columns).select(*columns)


def rename_positional(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Renames all columns by position."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(df.columns)} columns cannot take {len(names)} names")
    return df.toDF(*names)


def with_row_order(raw: DataFrame) -> DataFrame:
    """Adds ``row_id`` and ``row_block`` to raw rows that carry no order: by UTC time, equal times by content.

    Identical rows are counted map-side and then told apart by a copy number, a million copies per generated piece, so
    copies that make up much of the input are spread again instead of being numbered by one task.
    """
    columns = raw.columns
    piece = 1_000_000
    counted = raw.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    pieces = counted.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / piece))))
    content = F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    spread = pieces.withColumn("_content", content).repartition("_content", "_piece")
    first = F.col("_piece") * piece + 1
    copies = spread.withColumn("_copy", F.explode(F.sequence(first, F.least(first + (piece - 1), F.col("_copies")))))
    seconds = F.coalesce(F.unix_seconds(utc_from_text(F.col("utc_time")).cast("timestamp")), F.lit(0))
    # Shifted so that the text form sorts like the number, years before 1970 included.
    key = F.lpad((seconds + 10**11).cast("string"), 12, "0")
    return copies.select(
        *columns,
        F.concat(key, F.lit("-"), F.col("_content"), F.lit("-"), F.lpad(F.col("_copy").cast("string"), 15, "0")).alias("row_id"),
        F.floor((seconds + 10**11) / 3600).cast("bigint").alias("row_block"),
    )


def visit_recency(df: DataFrame) -> DataFrame:
    """Adds ``recency``: months between the row's UTC month and the newest UTC month of ``df``.

    Call it before rows without an offset are dropped; those still count for the newest month.
    """
    month = F.year("utc_time") * 12 + F.month("utc_time")
    newest = df.select(F.max(month).alias("newest"))
    return df.withColumn("recency", (newest.scalar() - month).cast("int"))


def frequency_filter(df: DataFrame, poi_min_freq: int = 10, user_min_freq: int = 10) -> DataFrame:
    """Places with enough check-ins, then users with enough remaining ones. One pass, not a fixpoint.

    Counts are taken map-side and joined back, rather than by a window over the place: a place or user that holds
    a large share of the rows is then never sorted by one task. The kept places are written first, so that Spark knows their size:
    as long as it sends tables of that size to all tasks, the rows are not shuffled for them.
    """
    places = staged(df.groupBy("pid").agg(F.count("uid").alias("n")).where(F.col("n") >= poi_min_freq).select("pid"), "places")
    kept = df.join(places, "pid", "left_semi")
    users = kept.groupBy("uid").agg(F.count("pid").alias("n")).where(F.col("n") >= user_min_freq).select("uid")
    return kept.join(users, "uid", "left_semi").select(*df.columns)


def clean_checkins(raw: DataFrame, with_recency: bool = False) -> DataFrame:
    """Raw text rows to clean check-ins, before the frequency filter."""
    located = with_region(valid_coords(coerce_numeric(raw)))
    timed = parse_utc(located)
    if with_recency:
        timed = visit_recency(timed)
    extra = ["recency"] if with_recency else []
    return project_rename(local_time(timed), [*CLEAN_COLUMNS, *extra])


def process_raw_data(
    raw: DataFrame, poi_min_freq: int = 10, user_min_freq: int = 10, with_recency: bool = False
) -> DataFrame:
    return frequency_filter(clean_checkins(raw, with_recency), poi_min_freq, user_min_freq)
