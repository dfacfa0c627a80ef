"""Keyed points and their layout on disk, and the tile pyramid."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotiles.functions import mercator, morton
from geotiles.functions.mercator import DEPTH
from geotiles.plans.region import TileBox

POINT = "time long, lat float, lon float, extra binary"
METADATA = "lat float, lon float, time long, language short, device short, app short"
MESSAGE = "lat float, lon float, time long, text string"


def with_keys(points: DataFrame, out_of_range: str = "drop") -> DataFrame:
    """Add ``x, y, code`` at the deepest level.  out_of_range: drop rows, clamp or wrap them.

    Rows with a null coordinate have no key and are dropped.
    """
    keyed = points.withColumn("x", mercator.tile_x(F.col("lon"), DEPTH, out_of_range)).withColumn("y", mercator.tile_y(F.col("lat"), DEPTH, out_of_range))
    return keyed.where("x IS NOT NULL AND y IS NOT NULL").withColumn("code", morton.encode(F.col("x"), F.col("y")))


def same_record() -> list[str]:
    """Columns that make two records equal; the payload does not count."""
    return ["time", "lat", "lon"]


def write_zordered(keyed: DataFrame, path: str, partitions: int | None = None, mode: str = "errorifexists", cell_level: int | None = None) -> None:
    """Bulk load: ranges of codes, sorted inside, so that row groups' bounds prune.

    ``cell_level`` also partitions the folder by the quadrant of that level.
    """
    parted = keyed.repartitionByRange(partitions, "code") if partitions else keyed.repartitionByRange("code")
    if cell_level is None:
        parted.sortWithinPartitions("code").write.mode(mode).parquet(path)
    else:
        cell = morton.ancestor(F.col("code"), cell_level)
        parted.withColumn("cell", cell).sortWithinPartitions("cell", "code").write.mode(mode).partitionBy("cell").parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the session's checkpoint folder; only where none is set, as in tests, below one of our own."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="geotiles-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stored(keyed: DataFrame) -> DataFrame:
    """The points written in Z-order below the session's checkpoint folder, and read again."""
    path = scratch(keyed.sparkSession, "zordered")
    write_zordered(keyed, path)
    return keyed.sparkSession.read.schema(keyed.schema).parquet(path)


def append(keyed: DataFrame, path: str) -> None:
    """Batch insert: sorted files next to those already there."""
    keyed.sortWithinPartitions("code").write.mode("append").parquet(path)


def pyramid(keyed: DataFrame, levels: range | list[int]) -> DataFrame:
    """Counts of every quadrant of the given levels: (z, code, n).

    Points are first counted at the deepest level asked for, so only that
    aggregate, not the points, is repeated for the levels above.
    """
    deepest = max(levels)
    base = keyed.groupBy(morton.ancestor(F.col("code"), deepest).alias("leaf")).agg(F.count("*").alias("n"))
    each = base.withColumn("z", F.explode(F.array(*[F.lit(z) for z in sorted(levels)])))
    # Spark shifts by a column only in SQL
    coded = each.withColumn("code", F.expr(f"shiftright(leaf, 2 * ({deepest} - z))"))
    return coded.groupBy("z", "code").agg(F.sum("n").cast("long").alias("n"))


def pyramid_count(box: TileBox, levels: DataFrame, keyed: DataFrame, ref_level: int) -> DataFrame:
    """Count of a box: full quadrants from the pyramid, the rest from the points.  One row ``n``."""
    spark = keyed.sparkSession
    cover = box.cover(ref_level)
    full = spark.createDataFrame([(q.z, q.code) for q in cover if q.full], "z int, code long")
    inside = levels.join(F.broadcast(full), ["z", "code"]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    edges = {z: [(q.code,) for q in cover if not q.full and q.z == z] for z in {q.z for q in cover}}
    outside_of = [
        keyed.where(box.contains()).join(F.broadcast(spark.createDataFrame(codes, "q long")), morton.ancestor(F.col("code"), z) == F.col("q"), "left_semi").agg(F.count("*").alias("n"))
        for z, codes in edges.items()
        if codes
    ]
    return functools.reduce(DataFrame.union, outside_of, inside).agg(F.sum("n").cast("long").alias("n"))
