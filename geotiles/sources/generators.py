"""Synthetic points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform_stream(seed: int, n: int, rate: int = 1000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(time, lat, lon) of the standard uniform stream, bit by bit.

    One 32-bit Mersenne twister; two draws a double, low word first; a point
    draws its longitude, then its latitude; both become 32-bit floats.
    """
    bits = np.random.MT19937()
    bits.state = np.random.RandomState(seed).get_state(legacy=False)
    raw = bits.random_raw(4 * n).astype(np.float64)
    unit = (raw[0::2] + raw[1::2] * 2.0**32) / 2.0**64
    lon, lat = (unit[0::2] * 360 - 180).astype(np.float32), (unit[1::2] * 170 - 85).astype(np.float32)
    return np.arange(n) // rate, lat, lon


def random_points(spark: SparkSession, n: int, seed: int = 123, rate: int = 1000, payload: int = 0) -> DataFrame:
    """Uniform points made in parallel from their index; the same on every run."""
    unit = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 53)).cast("double") / float(1 << 53)
    rows = spark.range(n).select(
        F.floor(F.col("id") / rate).alias("time"), (unit(1) * 170.0 - 85.0).cast("float").alias("lat"), (unit(0) * 360.0 - 180.0).cast("float").alias("lon"), F.col("id")
    )
    return rows.withColumn("extra", F.repeat(F.lit("\0"), payload).cast("binary")) if payload else rows


def synthetic_coordinates(event_id: Column) -> tuple[Column, Column, Column]:
    """(lon, lat, time) made from any number by exact integer arithmetic."""
    lon = ((event_id * 7919) % 35999).cast("double") * F.lit(0.01) - F.lit(179.99)
    lat = ((event_id * 104729) % 16999).cast("double") * F.lit(0.01) - F.lit(84.99)
    return lon.cast("float"), lat.cast("float"), F.floor(event_id / 100)


def points_of_events(events: DataFrame) -> DataFrame:
    lon, lat, time = synthetic_coordinates(F.col("event_id"))
    return events.withColumn("lon", lon).withColumn("lat", lat).withColumn("time", time)
