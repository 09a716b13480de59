"""Codebook tables: ``pid, codes, vector``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.text import parse_list


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    """Parquet as written by this library."""
    return spark.read.parquet(path).select("pid", "codes", "vector")


def read_codebook_csv(spark: SparkSession, path: str) -> DataFrame:
    """The text exchange form ``Pid,Codebook,Vector`` with list literals."""
    rows = spark.read.schema("Pid int, Codebook string, Vector string").csv(path, header=True, escape='"')
    return rows.select(
        F.col("Pid").alias("pid"),
        parse_list(F.col("Codebook"), "int").alias("codes"),
        parse_list(F.col("Vector"), "double").alias("vector"),
    )


def write_codebook_csv(codebook: DataFrame, path: str) -> None:
    def literal(column: str):
        return F.concat(F.lit("["), F.array_join(F.col(column).cast("array<string>"), ", "), F.lit("]"))

    codebook.select(
        F.col("pid").alias("Pid"), literal("codes").alias("Codebook"), literal("vector").alias("Vector")
    ).write.mode("errorifexists").csv(path, header=True, escape='"')
