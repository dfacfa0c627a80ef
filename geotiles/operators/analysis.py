"""Queries over benchmark logs: rows (algo, t, ms, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def amortized(log: DataFrame, by: str = "algo", order: str = "t", ms: str = "ms") -> DataFrame:
    """Running mean cost: cumulative time over the number of operations so far."""
    so_far = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.withColumn("amortized", F.sum(ms).over(so_far) / F.row_number().over(Window.partitionBy(by).orderBy(order)))


def best_configuration(log: DataFrame, by: str = "algo", removal: str = "avg_rm", run: str = "avg_run") -> DataFrame:
    """Per algorithm the rows with the least geometric mean of both averages; ties stay."""
    rated = log.withColumn("ratio", F.sqrt(F.col(removal) * F.col(run)))
    return rated.withColumn("place", F.rank().over(Window.partitionBy(by).orderBy("ratio"))).where("place = 1").drop("place")


def before_first_removal(log: DataFrame, by: str = "algo", order: str = "t", ms: str = "ms", removed: str = "removed") -> DataFrame:
    """Per algorithm the first operation that removed rows and the mean cost before it (all of it without one)."""
    first = log.where(F.col(removed) > 0).groupBy(by).agg(F.min(order).alias("first_removal"))
    joined = log.join(first, by, "left")
    prefix = joined.where(F.col("first_removal").isNull() | (F.col(order) < F.col("first_removal")))
    return prefix.groupBy(by, "first_removal").agg(F.avg(ms).alias("mean_before"))


def summary(log: DataFrame, by: str = "algo", ms: str = "ms") -> DataFrame:
    return log.groupBy(by).agg(F.avg(ms).alias("mean"), F.stddev_samp(ms).alias("sd"), F.sum(ms).alias("total"))


def speedups(log: DataFrame, base: str, others: list[str], key: str = "query_id", group: str = "width", ms: str = "ms") -> DataFrame:
    """Per group and other algorithm: mean speed-up of ``base`` and per cent of queries that it wins; a base of 0 has no ratio."""
    wide = log.groupBy(key, group).pivot("algo", [base, *others]).agg(F.avg(ms))
    tall = wide.unpivot([key, group, base], list(others), "other", "other_ms").withColumn("ratio", F.try_divide(F.col("other_ms"), F.col(base)))
    return tall.groupBy(group, "other").agg(F.avg("ratio").alias("speedup"), (F.avg((F.col("ratio") > 1).cast("double")) * 100).alias("wins"))


def width_classes(spark, rows: int, levels: int = 8) -> DataFrame:
    """Box widths 180 / 2**k and the rows that a uniform stream of ``rows`` puts into one."""
    k = spark.range(1, levels + 1).select(F.col("id").alias("level"))
    width = k.withColumn("width", F.lit(180.0) / F.pow(F.lit(2.0), F.col("level")))
    return width.withColumn("expected", F.lit(float(rows)) * (F.col("width") / 360.0) * (F.col("width") / 180.0))


def latin_boxes(spark, per_width: int = 10, levels: int = 8, lat: tuple[float, float] = (-85.0, 85.0), lon: tuple[float, float] = (-180.0, 180.0), turn: int = 7) -> DataFrame:
    """A workload (query_id, level, lat0, lon0, lat1, lon1): per width class, a Latin hypercube of box centres.

    The ranges of centres are cut into ``per_width`` strata each; every class has one centre in the
    middle of each stratum of latitudes and one in each of longitudes, paired by ``turn * i + level`` modulo
    ``per_width`` (``turn`` shares no factor with it).  Boxes are held within the ranges.
    """
    rows = spark.range(levels * per_width).select((F.col("id") / per_width + 1).cast("long").alias("level"), (F.col("id") % per_width).alias("i"), F.col("id").alias("query_id"))
    width = F.lit(180.0) / F.pow(F.lit(2.0), F.col("level"))
    j = (F.col("i") * turn + F.col("level")) % per_width
    centre = lambda ends, k, half: ends[0] + half + (k + 0.5) / per_width * (ends[1] - ends[0] - 2 * half)
    half_lat, half_lon = F.least(width / 2, F.lit((lat[1] - lat[0]) / 2)), F.least(width / 2, F.lit((lon[1] - lon[0]) / 2))
    y, x = centre(lat, F.col("i"), half_lat), centre(lon, j, half_lon)
    return rows.select("query_id", "level", (y + half_lat).alias("lat0"), (x - half_lon).alias("lon0"), (y - half_lat).alias("lat1"), (x + half_lon).alias("lon1"))


def centred_boxes(points: DataFrame, order: str, per_width: int = 10, levels: int = 8) -> DataFrame:
    """A workload whose boxes are centred on data: the first points by ``order``, ``per_width`` for each width class."""
    first = points.orderBy(order).limit(levels * per_width).withColumn("query_id", F.row_number().over(Window.orderBy(order)) - 1)  # as many rows as boxes
    half = F.lit(90.0) / F.pow(F.lit(2.0), F.floor(F.col("query_id") / per_width) + 1)
    lat, lon = F.col("lat").cast("double"), F.col("lon").cast("double")
    return first.select(F.col("query_id").cast("long").alias("query_id"), (lat + half).alias("lat0"), (lon - half).alias("lon0"), (lat - half).alias("lat1"), (lon + half).alias("lon1"))
