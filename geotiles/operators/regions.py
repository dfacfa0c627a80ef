"""Scans, counts, tiles and pages of map boxes."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from geotiles.functions import mercator, morton
from geotiles.functions.mercator import DEPTH
from geotiles.plans.region import REF_LEVEL, Quadrant, Region, TileBox

#: Rows of a page.
PAGE_ROWS = 100
#: Levels between a map's zoom and its tiles.
GRID_STEP = 8


def _box(region: Region | TileBox) -> TileBox:
    return region.box if isinstance(region, Region) else region


def select(keyed: DataFrame, region: Region | TileBox, ref_level: int = REF_LEVEL, stored: bool = False) -> DataFrame:
    """Rows whose tile is in the box.

    stored: the keys are columns of files, so the box's code ranges go to the
    scan as well and prune row groups.  Keys that are made on the fly would only
    be made once more for every range.
    """
    box = _box(region)
    if box.empty:
        return keyed.limit(0)
    return keyed.where(box.contains() & box.prefilter(ref_level=ref_level) if stored else box.contains())


def select_exactly(points: DataFrame, region: Region) -> DataFrame:
    """Rows whose 32-bit coordinates are in the box."""
    return points.where(region.contains_exactly())


def scan(keyed: DataFrame, region: Region | TileBox, ref_level: int = REF_LEVEL, stored: bool = False) -> DataFrame:
    """Rows of the box in Z-order."""
    return select(keyed, region, ref_level, stored).orderBy("code")


def count(keyed: DataFrame, region: Region | TileBox, ref_level: int = REF_LEVEL, stored: bool = False) -> DataFrame:
    return select(keyed, region, ref_level, stored).agg(F.count("*").alias("n"))


def brute_force_count(keyed: DataFrame, region: Region | TileBox) -> DataFrame:
    """The same without code ranges."""
    return keyed.where(_box(region).contains()).agg(F.count("*").alias("n"))


def cover_table(keyed: DataFrame, cover: Sequence[Quadrant], query_id: int = 0) -> DataFrame:
    rows = [(query_id, q.z, q.code, q.full) for q in cover]
    return keyed.sparkSession.createDataFrame(rows, "query_id long, z int, quadrant long, is_full boolean")


def _raised(cells: DataFrame, depths: Sequence[int]) -> DataFrame:
    """Rows with a ``cell`` of the last of ``depths``, once for each of them, with ``at`` (z, quadrant)."""
    up = lambda z: F.shiftright("cell", 2 * (depths[-1] - z)) if z < depths[-1] else F.col("cell")
    return cells.withColumn("at", F.explode(F.array(*[F.struct(F.lit(z).alias("z"), up(z).alias("quadrant")) for z in depths])))


def count_by_quadrant(keyed: DataFrame, region: Region | TileBox, ref_level: int = REF_LEVEL, include_empty: bool = False) -> DataFrame:
    """Count of each quadrant of the cover: (z, quadrant, n).

    Points are first counted by cells of the cover's deepest level, of which every
    quadrant is made; only those counts meet the cover, an equi-join on each level that the
    cover has.  The cover's size depends on the box alone, so it is broadcast.
    """
    box = _box(region)
    cover = box.cover(ref_level)
    table = cover_table(keyed, cover).drop("query_id", "is_full")
    depths = sorted({q.z for q in cover})
    if not depths:
        return table.select("z", "quadrant", F.lit(0).cast("long").alias("n")).limit(0)
    cells = select(keyed, box, ref_level).groupBy(morton.ancestor(F.col("code"), depths[-1]).alias("cell")).agg(F.count("*").alias("n"))
    met = _raised(cells, depths).join(F.broadcast(table), (F.col("at.z") == F.col("z")) & (F.col("at.quadrant") == F.col("quadrant")))
    counted = met.groupBy("z", "quadrant").agg(F.sum("n").alias("n"))
    if include_empty:
        return table.join(counted, ["z", "quadrant"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counted


def region_total(points: DataFrame, region: Region) -> DataFrame:
    """One row (lat, lon, z, n): the box's centre and its exact count."""
    lat0, lon0, lat1, lon1 = region.corners()
    total = select_exactly(points, region).agg(F.count("*").alias("n"))
    return total.select(F.lit((lat0 + lat1) / 2).alias("lat"), F.lit((lon0 + lon1) / 2).alias("lon"), F.lit(0).alias("z"), "n")


def tile_grid(keyed: DataFrame, region: Region | TileBox, z: int, resolution: int = GRID_STEP) -> DataFrame:
    """Counts of the tiles of level z + resolution that lie wholly in the box: (z, tile, n).

    Nothing when that level is the deepest one or beyond.
    """
    box, level = _box(region), z + resolution
    if level >= DEPTH or box.empty:
        return keyed.select(F.lit(level).alias("z"), F.col("code").alias("tile"), F.lit(0).cast("long").alias("n")).limit(0)
    up = DEPTH - level
    x0, y0, x1, y1 = -(-box.x0 >> up), -(-box.y0 >> up), ((box.x1 + 1) >> up) - 1, ((box.y1 + 1) >> up) - 1
    if x0 > x1 or y0 > y1:
        return keyed.select(F.lit(level).alias("z"), F.col("code").alias("tile"), F.lit(0).cast("long").alias("n")).limit(0)
    whole = TileBox(x0 << up, y0 << up, ((x1 + 1) << up) - 1, ((y1 + 1) << up) - 1)
    return select(keyed, whole).groupBy(F.lit(level).alias("z"), morton.ancestor(F.col("code"), level).alias("tile")).agg(F.count("*").alias("n"))


def tile_response(grid: DataFrame) -> DataFrame:
    """Tiles by their centres: (lat, lon, n)."""
    x, y = morton.decode_x(F.col("tile")), morton.decode_y(F.col("tile"))
    return grid.select(mercator.tile_lat(y + 0.5, F.col("z")).alias("lat"), mercator.tile_lon(x + 0.5, F.col("z")).alias("lon"), "n")


def tile_extent(grid: DataFrame) -> DataFrame:
    """Least and greatest count; null and 0 without tiles."""
    return grid.agg(F.min("n").alias("min_n"), F.coalesce(F.max("n"), F.lit(0)).alias("max_n"))


def page(keyed: DataFrame, region: Region | TileBox, rows: int = PAGE_ROWS, tie: Iterable[str] = ("time",)) -> DataFrame:
    """The first rows of the box in Z-order, ties by ``tie``: a top-k, not a full sort."""
    return select(keyed, region).orderBy("code", *tie).limit(rows)


def workload(keyed: DataFrame, regions: Sequence[tuple[int, Region]], ref_level: int = REF_LEVEL) -> DataFrame:
    """Count of every box of a workload, empty ones too: (query_id, n).

    Points are counted by cells of the deepest level of full quadrants, and those
    counts meet the full quadrants.  Points themselves meet only the quadrants at the boxes'
    edges, which are nearly all of one level, then the boxes' tile bounds.  The
    covers are broadcast; their size follows the boxes, and a workload of too many
    quadrants is refined less.
    """
    spark = keyed.sparkSession
    while True:
        covers = [(k, r.box, q) for k, r in regions for q in r.box.cover(ref_level)]
        if len(covers) <= 100_000 or ref_level <= 1:
            break
        ref_level -= 1
    ids = spark.createDataFrame([(k,) for k, _ in regions], "query_id long")
    found = [ids.select("query_id", F.lit(0).cast("long").alias("n"))]
    on = (F.col("at.z") == F.col("z")) & (F.col("at.quadrant") == F.col("quadrant"))
    full = [(k, q.z, q.code) for k, _, q in covers if q.full]
    if full:
        depths = sorted({z for _, z, _ in full})
        cells = keyed.groupBy(morton.ancestor(F.col("code"), depths[-1]).alias("cell")).agg(F.count("*").alias("n"))
        quadrants = spark.createDataFrame(full, "query_id long, z int, quadrant long")
        found.append(_raised(cells, depths).join(F.broadcast(quadrants), on).select("query_id", "n"))
    edge = [(k, q.z, q.code, b.x0, b.y0, b.x1, b.y1) for k, b, q in covers if not q.full]
    if edge:
        levels = sorted({z for _, z, *_ in edge})
        quadrants = spark.createDataFrame(edge, "query_id long, z int, quadrant long, x0 long, y0 long, x1 long, y1 long")
        at = F.explode(F.array(*[F.struct(F.lit(z).alias("z"), morton.ancestor(F.col("code"), z).alias("quadrant")) for z in levels]))
        met = keyed.select("x", "y", at.alias("at")).join(F.broadcast(quadrants), on)
        found.append(met.where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1").groupBy("query_id").agg(F.count("*").alias("n")))
    return functools.reduce(DataFrame.union, found).groupBy("query_id").agg(F.sum("n").cast("long").alias("n"))


def workload_exactly(points: DataFrame, regions: Sequence[tuple[int, Region]]) -> DataFrame:
    """The same by 32-bit coordinates, as one aggregate per box in a single scan."""
    counts = [F.count_if(r.contains_exactly()).alias(str(k)) for k, r in regions]
    wide = points.agg(*counts)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("query_id"), F.col(str(k)).alias("n")) for k, _ in regions])).alias("q")).select("q.*")


def statistics(keyed: DataFrame, region: Region | TileBox, ref_level: int = REF_LEVEL) -> DataFrame:
    """(refinements, total, true_positives, false_positives) of a box.

    Refinements are quadrants of the cover that hold data; positives are what
    the residual filter keeps and rejects in quadrants not wholly inside.
    """
    box = _box(region)
    cover = box.cover(ref_level)
    depths = sorted({q.z for q in cover})
    table = cover_table(keyed, cover).drop("query_id")
    inside: Column = box.contains()
    cells = keyed.groupBy(morton.ancestor(F.col("code"), (depths or [0])[-1]).alias("cell")).agg(F.count("*").alias("n"), F.count_if(inside).alias("hits"))
    met = _raised(cells, depths or [0]).join(F.broadcast(table), (F.col("at.z") == F.col("z")) & (F.col("at.quadrant") == F.col("quadrant")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return met.agg(
        F.count_distinct("z", "quadrant").alias("refinements"),
        total("hits").alias("total"),
        total(F.when(~F.col("is_full"), F.col("hits"))).alias("true_positives"),
        total(F.when(~F.col("is_full"), F.col("n") - F.col("hits"))).alias("false_positives"),
    )


def observed(keyed: DataFrame, region: Region | TileBox, ref_level: int = REF_LEVEL) -> tuple[DataFrame, Observation]:
    """Rows of the box, and what its scan saw: probed and matching rows."""
    box, seen = _box(region), Observation()
    probed = keyed.where(box.prefilter(ref_level=ref_level))
    inside = box.contains()
    return probed.observe(seen, F.count("*").alias("probed"), F.count_if(inside).alias("matching")).where(inside), seen


def size(keyed: DataFrame) -> DataFrame:
    return keyed.agg(F.count("*").alias("n"))


def now(points: DataFrame, order: str) -> DataFrame:
    """Time of the last element by arrival, not the greatest time."""
    return points.agg(F.max_by("time", order).alias("now"))


def top_k(keyed: DataFrame, lat: float, lon: float, k: int, alpha: float, radius_km: float, at: int, horizon: int, tie: str) -> DataFrame:
    """The ``k`` best rows near a place and recent before a time.

    score = alpha * distance / radius + (1 - alpha) * age / horizon, least first,
    over rows within the radius and the horizon; distances are great-circle ones.
    A radius or horizon of 0 leaves its part of the score out.
    """
    part = lambda c, most: F.col(c) / most if most else F.lit(0.0)
    half = lambda c, v: F.pow(F.sin((F.radians(c.cast("double")) - F.radians(F.lit(v))) / 2), 2)
    near = half(F.col("lat"), lat) + F.cos(F.radians(F.lit(lat))) * F.cos(F.radians(F.col("lat").cast("double"))) * half(F.col("lon"), lon)
    # a band of latitudes that holds the circle, for the scan
    degrees = radius_km / 111.0 + 0.01
    rows = keyed.where(F.col("lat").between(lat - degrees, lat + degrees)).withColumn("km", F.lit(2 * 6371.0) * F.asin(F.sqrt(F.least(near, F.lit(1.0)))))
    rows = rows.withColumn("age", F.lit(at) - F.col("time")).where((F.col("km") <= radius_km) & F.col("age").between(0, horizon))
    return rows.withColumn("score", alpha * part("km", radius_km) + (1 - alpha) * part("age", horizon)).orderBy("score", tie).limit(k)


def heat_cells(points: DataFrame, x: str, y: str, weight: str, cell: float, most: float, offset: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Pixels rebinned: per cell the weighted centre, rounded half up, and the capped sum of weights.

    A cell whose weights sum to zero has no centre: null.
    """
    at = lambda c, o: F.floor((F.col(c) - o) / cell).alias(f"cell_{c}")
    centre = lambda c: F.floor(F.try_divide(F.sum(F.col(c) * F.col(weight)), F.sum(weight)) + 0.5).cast("long").alias(c)
    cells = points.groupBy(at(x, offset[0]), at(y, offset[1])).agg(centre(x), centre(y), F.least(F.sum(weight), F.lit(most)).alias("intensity"))
    return cells.select(x, y, "intensity")
