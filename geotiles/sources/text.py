"""Workload files, web logs and messages as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geotiles.plans.region import Region

MESSAGE_JSON = (
    "coordinates struct<coordinates: array<double>>, created_at string, geo string, id long, lang string, place string, "
    "text string, timestamp_ms string, entities struct<hashtags: array<struct<text: string>>>, _bad string"
)


def read_workload(spark: SparkSession, path: str, n: int | None = None) -> list[tuple[int, Region]]:
    """Boxes of a headerless CSV, north-west then south-east, numbered from 0: a driver-side list."""
    lines = spark.read.text(path).withColumn("id", F.monotonically_increasing_id()).orderBy("id")
    rows = (lines.limit(n) if n is not None else lines).collect()
    return [(k, Region(*map(float, r["value"].split(",")))) for k, r in enumerate(rows) if r["value"].strip()]


def log_queries(lines: DataFrame, column: str = "value") -> DataFrame:
    """Query paths of a web log (url, id, time): ``path`` is null for what is no query."""
    fields = F.split(column, ",")
    part = lambda k: F.get(F.split(fields[0], "/"), F.lit(k))
    zoom = F.when(part(7) == "undefined", "1").otherwise(part(7))
    tile = F.concat_ws("/", F.lit("/rest/query/tile"), part(6), part(8), part(9), part(8), part(9), F.lit("resolution"), part(7))
    region = F.concat_ws("/", F.lit("/rest/query/region"), zoom, part(8), part(9), part(10), part(11))
    good = (F.size(fields) == 3) & (F.length(column) > 0)
    path = F.when(good & (part(5) == "tile") & part(9).isNotNull(), tile).when(good & (part(5) == "query") & part(11).isNotNull(), region)
    return lines.withColumn("path", path).withColumn("id", F.get(fields, F.lit(1)).try_cast("long")).withColumn("timestamp_ms", F.get(fields, F.lit(2)).try_cast("long"))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages, a JSON object a line; other lines are left out and missing values are "none"."""
    raw = spark.read.schema(MESSAGE_JSON).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    text = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    tags = F.transform("entities.hashtags", lambda h: h["text"])
    return raw.where("_bad IS NULL").select(
        F.col("coordinates.coordinates").alias("coordinates"), *[text(F.col(c)).alias(c) for c in ("created_at", "geo", "id", "lang", "place", "text", "timestamp_ms")], F.coalesce(tags, F.array().cast("array<string>")).alias("hashtags")
    )


def created_seconds(created_at: Column) -> Column:
    """Seconds of a time like ``Wed Aug 27 13:08:45 +0000 2008``; the weekday is not needed."""
    return F.unix_timestamp(F.try_to_timestamp(F.substring(created_at, 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy")))


def to_points(messages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Messages with coordinates as (time, lat, lon, text) and the columns to ``keep``, text cut to the record's 140 bytes' worth of characters."""
    at = F.col("coordinates")
    return messages.where("coordinates IS NOT NULL AND size(coordinates) = 2").select(
        created_seconds(F.col("created_at")).alias("time"), F.get(at, F.lit(1)).cast("float").alias("lat"), F.get(at, F.lit(0)).cast("float").alias("lon"), F.left("text", F.lit(140)).alias("text"), *keep
    )


def write_benchmark_log(log: DataFrame, path: str) -> None:
    """Timings as ``;``-separated rows with a header."""
    log.write.option("sep", ";").option("header", True).mode("append").csv(path)
