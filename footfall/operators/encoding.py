"""Dense dictionary ids."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from footfall.functions.seeded import DEFAULT_SEED, digest
from footfall.session import staged

ENCODED_COLUMNS = ["uid", "pid", "catname", "region"]
_BUCKET_DIGITS = 3  # 16**3 buckets


def build_dictionary(df: DataFrame, column: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """A seeded bijection from the distinct values onto 1..N: ``(original, mapped)``.

    Values are shuffled by digest and written once, as buckets are counted and ranked. Ranks are taken inside digest buckets, which are even because the values are
    distinct, and shifted by the sizes of the buckets before; only the 4,096 bucket sizes meet in one task.
    """
    hashed = (
        df.select(F.col(column).alias("original"))
        .where("original is not null")
        .distinct()
        .withColumn("_digest", digest(seed, F.col("original")))
        .withColumn("_bucket", F.substring("_digest", 1, _BUCKET_DIGITS))
    )
    hashed = staged(hashed, "distinct")
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = (
        hashed.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    )
    inside = F.row_number().over(W.partitionBy("_bucket").orderBy("_digest"))
    return (
        hashed.withColumn("_local", inside)
        .join(F.broadcast(bases), "_bucket")
        .select("original", (F.col("_base") + F.col("_local")).cast("int").alias("mapped"))
    )


def build_dictionaries(df: DataFrame, seed: int = DEFAULT_SEED) -> dict[str, DataFrame]:
    return {column: build_dictionary(df, column, seed) for column in ENCODED_COLUMNS}


def apply_dictionary(df: DataFrame, dictionaries: Mapping[str, DataFrame]) -> DataFrame:
    """Replaces each listed column by its id; a value the dictionary lacks becomes null.

    No broadcast hint: Spark broadcasts a dictionary whose size is below its threshold and otherwise joins by shuffle,
    where AQE splits the partitions of hot values. Hand in written dictionaries, whose size Spark knows beforehand:
    small ones, such as categories, then never cause a shuffle of the visits.
    """
    columns = df.columns
    for column, dictionary in dictionaries.items():
        lookup = dictionary.select(F.col("original").alias(column), F.col("mapped").alias("_mapped"))
        df = df.join(lookup, column, "left").drop(column).withColumnRenamed("_mapped", column)
    return df.select(*columns)


def reverse_dictionary(df: DataFrame, column: str, dictionary: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: the original value behind the id in ``column``, null for an unknown id."""
    lookup = dictionary.select(F.col("mapped").alias(column), F.col("original").alias(name))
    return df.join(lookup, column, "left").select(*df.columns, name)
