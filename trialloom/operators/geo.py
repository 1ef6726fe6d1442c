"""Building rows of a map and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR_METRES, FOOT = 3.0, 0.3048


def height_metres(tag: Column) -> Column:
    """The first number of a height tag, feet converted; null without one."""
    t = F.lower(F.trim(tag))
    num = F.nullif(F.regexp_extract(t, r"([-+]?\d*\.?\d+)", 1), F.lit("")).try_cast("double")
    return F.when(t.contains("ft") | t.contains("feet"), num * FOOT).otherwise(num)


def building_rows(elements: DataFrame) -> DataFrame:
    """One row an element (type, id, lat, lon, center, tags): place from its centre, height from its tag, else its levels."""
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    return elements.select(
        F.col("type").alias("osm_type"), F.col("id").alias("osm_id"), F.coalesce("center.lat", "lat").alias("lat"), F.coalesce("center.lon", "lon").alias("lon"),
        F.coalesce(height_metres(tag("height")), tag("building:levels").try_cast("double") * FLOOR_METRES).alias("height_m"),
        tag("height").isNotNull().alias("has_height_tag"), tag("building:levels").alias("building_levels"), tag("building").alias("building"), tag("name").alias("name"),
    )


def building_stats(rows: DataFrame) -> DataFrame:
    """One row: buildings, those with a height, coverage, and mean, median, extremes and sample deviation of heights (that of two or more)."""
    h = F.count("height_m")
    return rows.agg(
        F.count("*").alias("total_buildings"), h.alias("height_available"), F.coalesce(F.try_divide(h, F.count("*")), F.lit(0.0)).alias("coverage_ratio"),
        F.avg("height_m").alias("mean_m"), F.percentile("height_m", F.lit(0.5)).alias("median_m"), F.min("height_m").alias("min_m"), F.max("height_m").alias("max_m"),
        F.when(h > 1, F.stddev_samp("height_m")).alias("std_m"),
    )


def sample_buildings(rows: DataFrame, order: str, n: int = 5) -> DataFrame:
    """The first rows shown beside the statistics."""
    return rows.orderBy(order).limit(n).select("osm_type", "osm_id", "name", "height_m", "building", "lat", "lon")
