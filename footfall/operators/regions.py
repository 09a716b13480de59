"""Where the regions of a prefix lie and how far apart they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from footfall.functions.geo import CELL_DEGREES, KM_PER_DEGREE, cell_south_west, flat_km

MAP_URL = "https://www.google.com/maps/search/?api=1&query="  # fixed value: prefix of a map link


def decode_region(regions: DataFrame, code: str = "region") -> DataFrame:
    """Adds ``lat_min, lat_max, lon_min, lon_max, center_lat, center_lon, map_url`` of a six-character cell.

    A text that is not a cell gives nulls.
    """
    south, west = cell_south_west(F.col(code))
    # Cell borders are multiples of 0.05 degrees; rounding removes the binary residue of the multiplication.
    cells = regions.withColumns({"lat_min": F.round(south, 6), "lon_min": F.round(west, 6)}).withColumns(
        {
            "lat_max": F.round(F.col("lat_min") + CELL_DEGREES, 6),
            "lon_max": F.round(F.col("lon_min") + CELL_DEGREES, 6),
            "center_lat": F.round(F.col("lat_min") + CELL_DEGREES / 2, 6),
            "center_lon": F.round(F.col("lon_min") + CELL_DEGREES / 2, 6),
        }
    )
    point = F.concat(F.lit(MAP_URL), F.format_string("%.3f,%.3f", F.col("center_lat"), F.col("center_lon")))
    return cells.withColumn("map_url", F.when(F.col("center_lat").isNotNull(), point))


def combo_region_lists(top_regions: DataFrame, centers: DataFrame) -> DataFrame:
    """``combo, regions``: the located top regions of each combo, as one short list ordered by region.

    ``top_regions`` is ``prefix, item, n, rank`` from a ranked report, so a list has at most as many entries as the
    report ranks (five); ``centers`` is ``region, center_lat, center_lon``.
    """
    known = centers.select(F.col("region").alias("item"), "center_lat", "center_lon")
    located = top_regions.join(known, "item")
    entry = F.struct(F.col("item").alias("region"), F.col("center_lat").alias("lat"), F.col("center_lon").alias("lon"))
    return located.groupBy(F.col("prefix").alias("combo")).agg(F.array_sort(F.collect_list(entry)).alias("regions"))


def region_pair_distance(lists: DataFrame) -> DataFrame:
    """``combo, region_1, region_2, km`` for the pairs of a combo's short region list."""

    def partners(entry: Column) -> Column:
        later = F.filter("regions", lambda o: o["region"] > entry["region"])
        return F.transform(
            later,
            lambda o: F.struct(
                entry["region"].alias("region_1"),
                o["region"].alias("region_2"),
                flat_km(entry["lat"], entry["lon"], o["lat"], o["lon"]).alias("km"),
            ),
        )

    pairs = F.flatten(F.transform("regions", partners))
    return lists.select("combo", F.explode(pairs).alias("p")).select("combo", "p.*")


def combo_distance_stats(pairs: DataFrame) -> DataFrame:
    """Mean, extremes, population deviation, nearest and farthest pair per combo; one region alone gives no row."""
    pair = F.struct("region_1", "region_2")
    # Equal distances differ in their last bits, so ties are settled on rounded kilometres and then by region.
    rounded = F.round("km", 9).alias("km")
    near = F.struct(rounded, "region_1", "region_2")
    far = F.struct((-rounded).alias("km"), "region_1", "region_2")
    stats = pairs.groupBy("combo").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg("km").alias("mean_km"),
        F.min("km").alias("min_km"),
        F.max("km").alias("max_km"),
        F.stddev_pop("km").alias("std_km"),
        F.min_by(pair, near).alias("nearest"),
        F.min_by(pair, far).alias("farthest"),
    )
    return stats


def rank_combos_by_compactness(stats: DataFrame) -> DataFrame:
    """``combo, mean_km, rank``: the tightest combo first. One row per combo of a top report, so one task ranks them."""
    order = W.orderBy(F.round("mean_km", 9), "combo")
    return stats.select("combo", "mean_km", F.row_number().over(order).alias("rank"))


def first_combo_of_region(top_regions: DataFrame, combo_ranks: DataFrame) -> DataFrame:
    """``region, combo``: a region listed by several combos goes to the one ranked first. ``combo_ranks``: combo, rank."""
    ranks = combo_ranks.select(F.col("combo").alias("prefix"), F.col("rank").alias("combo_rank"))
    return (
        top_regions.select("prefix", "item")
        .join(ranks, "prefix")
        .groupBy(F.col("item").alias("region"))
        .agg(F.min_by("prefix", "combo_rank").alias("combo"))
    )


def geo_extent(points: DataFrame, lat: str = "center_lat", lon: str = "center_lon") -> DataFrame:
    """One row: latitude and longitude range, north-south and east-west kilometres."""
    span = points.agg(
        F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"), F.min(lon).alias("lon_min"), F.max(lon).alias("lon_max"),
        F.avg(lat).alias("lat_mean"),
    )
    return span.select(
        "lat_min",
        "lat_max",
        "lon_min",
        "lon_max",
        ((F.col("lat_max") - F.col("lat_min")) * KM_PER_DEGREE).alias("north_south_km"),
        ((F.col("lon_max") - F.col("lon_min")) * KM_PER_DEGREE * F.cos(F.radians("lat_mean"))).alias("east_west_km"),
    )
