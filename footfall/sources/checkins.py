"""Raw check-in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.sources.records import QuotedLines, records

CHARSET = "ISO-8859-1"
RAW_COLUMNS = ["uid", "pid", "cat_id", "catname", "lat", "lon", "tz_offset", "utc_time"]
RAW_SCHEMA = ", ".join(f"{name} string" for name in RAW_COLUMNS)


def read_checkins(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """Comma-separated latin-1 files with a header, all text; casting is the cleaning step's business.

    Columns are taken by position, as the header's names differ between sources. Rows have no order here unless order columns
    travel in the file, named in ``extra`` (``"row_id bigint, row_block bigint"``), and a line is a row;
    ``read_checkins_in_order`` knows the files' order and quoted line breaks.
    """
    schema = RAW_SCHEMA + (f", {extra}" if extra else "")
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("encoding", CHARSET)
        .option("escape", '"')
        .csv(path)
    )


def read_checkins_in_order(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The same columns with ``row_id, row_block`` by place in the files, whose order is that of their paths.

    A line break between quotes belongs to its field. The first record of every file is its header; blank lines are skipped.
    """
    rows = records(spark, path, QuotedLines()).where("not starts_file")
    text = rows.select("row_id", "row_block", QuotedLines.text(F.col("body"), CHARSET).alias("_text")).where("_text is not null")
    parsed = F.from_csv("_text", F.lit(RAW_SCHEMA), {"escape": '"'})
    return text.select(parsed.alias("_row"), "row_id", "row_block").select("_row.*", "row_id", "row_block")
