"""A stored point table: built once in Z-order with its pyramid, then asked many times."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geotiles.operators import regions
from geotiles.plans import layout
from geotiles.plans.region import REF_LEVEL, Region, TileBox


@dataclass(frozen=True)
class PointStore:
    """``path`` holds ``points`` (Z-ordered files with their keys) and ``pyramid`` (z, code, n).

    Each batch that is inserted adds sorted files and its own pyramid rows, so an
    insert never rewrites what is there; readers sum the rows of a quadrant.
    """

    spark: SparkSession
    path: str

    @classmethod
    def create(cls, points: DataFrame, path: str, ref_level: int = REF_LEVEL) -> PointStore:
        """Bulk load; ``points`` need no keys yet.  Whatever lies at ``path`` stays, and the call fails."""
        made = cls(points.sparkSession, path)
        layout.write_zordered(layout.with_keys(points), f"{path}/points")
        layout.pyramid(made.points, range(ref_level + 1)).write.parquet(f"{path}/pyramid")
        return made

    @property
    def points(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/points")

    @property
    def pyramid(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/pyramid")

    def insert(self, points: DataFrame, ref_level: int = REF_LEVEL) -> None:
        keyed = layout.with_keys(points)
        layout.append(keyed, f"{self.path}/points")
        layout.pyramid(keyed, range(ref_level + 1)).write.mode("append").parquet(f"{self.path}/pyramid")

    def scan(self, region: Region | TileBox) -> DataFrame:
        """Rows of the box in Z-order; code ranges go to the scan."""
        return regions.scan(self.points, region, stored=True)

    def count(self, region: Region | TileBox, ref_level: int = REF_LEVEL) -> DataFrame:
        """One row ``n``: full quadrants from the pyramid, only the box's edge from the points."""
        box = region.box if isinstance(region, Region) else region
        return layout.pyramid_count(box, self.pyramid, self.points, ref_level)

    def apply(self, region: Region | TileBox, visit: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """What ``visit`` makes of the box's rows."""
        return visit(regions.select(self.points, region, stored=True))

    def survivors(self, oldest: int, most: int, expired: Column | None = None) -> DataFrame:
        """Lazy eviction: all rows while there are at most ``most``, and beyond that those that have not expired.

        Expired are rows before the time ``oldest``, or what ``expired`` says.
        """
        gone = F.col("time") < oldest if expired is None else F.coalesce(expired, F.lit(False))
        total = self.pyramid.where("z = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0]["n"]
        return self.points.where(~gone) if total > most else self.points
