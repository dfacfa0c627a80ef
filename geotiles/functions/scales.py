"""Display scales of counts, and the category dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Codes of the categories of a point.
LANGUAGES = {1: "en", 2: "es", 3: "de", 5: "fr", 6: "it", 8: "ko", 9: "nl", 10: "pl", 11: "pt", 12: "ru"}
DEVICES = {0: "other", 1: "apple", 2: "android", 3: "apple", 4: "windows"}
APPS = {0: "browser", 1: "twitter", 2: "foursquare", 3: "instagram"}


def dimension(spark: SparkSession, values: dict[int, str], key: str, name: str) -> DataFrame:
    return spark.createDataFrame(sorted(values.items()), f"{key} int, {name} string")


def red_yellow_white(count: Column) -> Column:
    """struct<r, g, b> on a log10 scale, each 0..256 (the top value is 256)."""
    level = F.log10(count + 1)
    part = lambda k: F.floor(256 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), level - k))).cast("int")
    return F.struct(part(0).alias("r"), part(1).alias("g"), part(2).alias("b"))


def to_range(value: Column, source: tuple[float, float], target: tuple[float, float]) -> Column:
    """Linear map of one range on another; NaN outside the source range."""
    inside = (value - source[0]) * (target[1] - target[0]) / (source[1] - source[0]) + target[0]
    return F.when((value < source[0]) | (value > source[1]), F.lit(float("nan"))).otherwise(inside)
