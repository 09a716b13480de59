"""Sparse place features in long form: ``pid, idx, value`` with 0-based ``idx``.

Blocks: category one-hot, region one-hot, 24 hours multi-hot, users. The users block is as wide as the user
dictionary, so a dense matrix is never built.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.operators.encoding import ENCODED_COLUMNS
from footfall.operators.ordering import position_in_group
from footfall.session import scratch_folder

HOURS = 24
TOP_K = 10
RECENCY_PADDING = 100  # fixed value: at or above it a visitor weighs nothing
_PLACES_PER_BLOCK = 65_536


def feature_metadata(df: DataFrame) -> DataFrame:
    """One row: sizes of the blocks and where each starts, counted on the visits; each column is scanned by itself."""
    return metadata_of_dictionaries({c: df.select(c).where(F.col(c).isNotNull()).distinct() for c in ENCODED_COLUMNS})


def metadata_of_dictionaries(dictionaries: Mapping[str, DataFrame]) -> DataFrame:
    """The same from the dictionaries ``pid, catname, region, uid``, whose rows are the distinct values already."""
    names = {"pid": "num_pois", "catname": "num_categories", "region": "num_regions", "uid": "num_users"}
    counts = None
    for column, name in names.items():
        one = dictionaries[column].select(F.lit(name).alias("name"), F.lit(1).alias("n"))
        counts = one if counts is None else counts.unionByName(one)
    total = [F.count(F.when(F.col("name") == name, 1)).alias(name) for name in names.values()]
    return _metadata(counts.agg(*total))


def _metadata(sizes: DataFrame) -> DataFrame:
    c, r, u = F.col("num_categories"), F.col("num_regions"), F.col("num_users")
    return sizes.select(
        "num_pois",
        "num_categories",
        "num_regions",
        "num_users",
        F.lit(HOURS).cast("bigint").alias("num_time_bins"),
        (c + r + HOURS + u).alias("total_dim"),
        F.struct(
            c.alias("category"), r.alias("region"), F.lit(HOURS).cast("bigint").alias("temporal"), u.alias("collaborative")
        ).alias("feature_dims"),
        F.struct(
            F.lit(0).cast("bigint").alias("category"),
            c.alias("region"),
            (c + r).alias("temporal"),
            (c + r + HOURS).alias("collaborative"),
        ).alias("feature_offsets"),
    )


def _inside(index: Column, dim: Column | int) -> Column:
    return (index > 0) & (index <= dim)


def onehot_block(df: DataFrame, index: str, dim: Column | int, offset: Column | int = 0) -> DataFrame:
    """1-based index to one entry; an index outside 1..dim gives no entry."""
    at = F.col(index)
    place = (at + offset - 1).cast("bigint").alias("idx")
    return df.where(_inside(at, dim)).select("pid", place, F.lit(1.0).alias("value"))


def multihot_topk_users(
    users: DataFrame, dim: Column | int, offset: Column | int = 0, top_k: int = TOP_K
) -> DataFrame:
    """The ``top_k`` most frequent indices, ties first-seen. Visitors are distinct, so all counts are one and first-seen decides."""
    first = W.partitionBy("pid").orderBy("first_row")
    top = users.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= top_k)
    return onehot_block(top, "uid", dim, offset)


def multihot_topk_hours(times: DataFrame, offset: Column | int = 0, top_k: int = TOP_K) -> DataFrame:
    """The ``top_k`` busiest hours over a place's distinct times, ties first-seen; index is hour + 1, so midnight counts."""
    per_hour = times.groupBy("pid", (F.hour("time") + 1).alias("slot")).agg(
        F.count(F.lit(1)).alias("n"), F.min("first_row").alias("first_row")
    )
    busiest = W.partitionBy("pid").orderBy(F.desc("n"), "first_row")
    top = per_hour.withColumn("_rank", F.row_number().over(busiest)).where(F.col("_rank") <= top_k)
    return onehot_block(top, "slot", HOURS, offset)


def recency_weighted_users(visitors: DataFrame, dim: Column | int, offset: Column | int = 0) -> DataFrame:
    """Weight ``0.5 ** recency`` for every visitor, zero from recency 100 on."""
    weight = F.when(F.col("recency") < RECENCY_PADDING, F.pow(F.lit(0.5), F.col("recency"))).otherwise(0.0)
    at = F.col("uid")
    return visitors.where(_inside(at, dim)).select("pid", (at + offset - 1).cast("bigint").alias("idx"), weight.alias("value"))


def assemble_features(
    heads: DataFrame,
    times: DataFrame,
    visitors: DataFrame,
    metadata: DataFrame,
    top_k: int = TOP_K,
) -> DataFrame:
    """All four blocks at their offsets. ``visitors`` with a ``recency`` column selects the weighted users block.

    The one metadata row is read first: block sizes are part of the plan, as they would be from a metadata file.
    """
    meta = metadata.first()
    at = meta.feature_offsets
    if "recency" in visitors.columns:
        users = recency_weighted_users(visitors, meta.num_users, at.collaborative)
    else:
        users = multihot_topk_users(visitors, meta.num_users, at.collaborative, top_k)
    blocks = [
        onehot_block(heads, "catname", meta.num_categories, at.category),
        onehot_block(heads, "region", meta.num_regions, at.region),
        multihot_topk_hours(times, at.temporal, top_k),
        users,
    ]
    long_form = blocks[0]
    for block in blocks[1:]:
        long_form = long_form.unionByName(block)
    return long_form


def sparse_vectors(long_form: DataFrame, dim: Column | int) -> DataFrame:
    """``pid, dim, indices, values``: one sparse vector per place, indices ascending."""
    entries = F.sort_array(F.collect_list(F.struct("idx", "value")))
    return long_form.groupBy("pid").agg(entries.alias("_e")).select(
        "pid",
        F.lit(dim).cast("bigint").alias("dim") if isinstance(dim, int) else dim.cast("bigint").alias("dim"),
        F.transform("_e", lambda e: e["idx"]).alias("indices"),
        F.transform("_e", lambda e: e["value"]).alias("values"),
    )


def ml_vectors(vectors: DataFrame) -> DataFrame:
    """``pid, features`` as the sparse vectors that the machine-learning stages of Spark read.

    In files such a vector is a struct of its kind, size, indices and values, so the table is written as structs and read as vectors:
    no row passes through Python.
    """
    struct = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.col("dim").cast("int").alias("size"),
        F.col("indices").cast("array<int>").alias("indices"), F.col("values").cast("array<double>").alias("values"),
    )
    path = scratch_folder(vectors.sparkSession, "vectors")
    vectors.select("pid", struct.alias("features")).write.parquet(path)
    schema = T.StructType([vectors.schema["pid"], T.StructField("features", VectorUDT())])
    return vectors.sparkSession.read.schema(schema).parquet(path)


def pid_to_index(heads: DataFrame) -> DataFrame:
    """0-based row position of each place in the profile, which is sorted by place id."""
    block = F.floor(F.col("pid") / F.lit(_PLACES_PER_BLOCK))
    return position_in_group(heads.select("pid"), [], [F.col("pid")], block).select(
        "pid", (F.col("position") - 1).alias("index")
    )

