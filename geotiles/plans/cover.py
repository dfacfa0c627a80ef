"""The cover of a box as a table function of SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from geotiles.plans.region import Region


class BoxCover:
    """Quadrants (z, quadrant, low, high, is_full) of the box's cover, in Z-order."""

    def eval(self, lat0: float, lon0: float, lat1: float, lon1: float, ref_level: int) -> Iterator[tuple[int, int, int, int, bool]]:
        for q in Region(lat0, lon0, lat1, lon1).box.cover(ref_level):
            yield q.z, q.code, q.low, q.high, bool(q.full)


def register(spark: SparkSession) -> None:
    """``SELECT * FROM box_cover(lat0, lon0, lat1, lon1, ref_level)``; a query may also join it laterally."""
    spark.udtf.register("box_cover", udtf(BoxCover, returnType="z int, quadrant long, low long, high long, is_full boolean"))
