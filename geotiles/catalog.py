"""The engine's queries over the driver's tables, each with DuckDB SQL that states its result anew.

``events`` has no coordinates; they are made from its number by exact
arithmetic (see ``geotiles.sources.generators``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotiles.functions import dates, mercator, morton, scales
from geotiles.operators import analysis, regions, windows
from geotiles.plans import cover as covers
from geotiles.plans import layout
from geotiles.plans.region import Region, viewport
from geotiles.plans.store import PointStore
from geotiles.sources import generators, text
from geotiles.streaming import ingest

#: Boxes of the fixed queries: four widths, nearly the world, a point, and swapped corners.
BOXES: list[tuple[int, Region]] = [
    (0, Region(30.6506453551166, 61.1919214383233, -59.3493546448834, 151.191921438323)),
    (1, Region(60.0, -100.0, 15.0, -55.0)),
    (2, Region(20.0, 10.0, -2.5, 32.5)),
    (3, Region(50.0, -10.0, 38.75, 1.25)),
    (4, Region(90.0, -180.0, -90.0, 180.0)),
    (5, Region(12.5, 33.25, 12.5, 33.25)),
    (6, Region(-10.0, 20.0, 10.0, -20.0)),
]
MAIN = BOXES[0][1]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.points_of_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.with_keys(points(spark, sf_dir))


_STORES: dict[tuple[str, str], PointStore] = {}


def store(spark: SparkSession, sf_dir: str) -> PointStore:
    """The session's stored points of a folder, built when first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        _STORES[key] = PointStore.create(points(spark, sf_dir), layout.scratch(spark, "store"))
    return _STORES[key]


POINTS = """p AS (SELECT event_id, ts, user_id, event_type, value, event_id // 100 AS time,
  CAST(CAST((event_id * 7919) % 35999 AS DOUBLE) * 0.01 - 179.99 AS FLOAT) AS lon,
  CAST(CAST((event_id * 104729) % 16999 AS DOUBLE) * 0.01 - 84.99 AS FLOAT) AS lat FROM events)"""


def _spread(name: str, of: str, source: str) -> str:
    """CTEs that spread the bits of column ``of`` into ``name``."""
    out, at = [], source
    for k, (shift, mask) in enumerate(((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))):
        value = of if k == 0 else name
        cols = f"*, ({value} | ({value} << {shift})) & {mask} AS {name}" if k == 0 else f"* REPLACE (({value} | ({value} << {shift})) & {mask} AS {name})"
        out.append(f"{name}{k} AS (SELECT {cols} FROM {at})")
        at = f"{name}{k}"
    return ",\n".join(out)


KEYED = f"""WITH RECURSIVE {POINTS},
t AS (SELECT *, CAST(floor((CAST(lon AS DOUBLE) + 180.0) / 360.0 * 33554432) AS BIGINT) & 33554431 AS x,
  CAST(floor((1.0 - ln(tan(CAST(lat AS DOUBLE) * (pi() / 180.0)) + 1.0 / cos(CAST(lat AS DOUBLE) * (pi() / 180.0))) / pi()) / 2.0 * 33554432) AS BIGINT) & 33554431 AS y FROM p),
{_spread("sx", "x", "t")},
{_spread("sy", "y", "sx4")},
k AS (SELECT *, sx | (sy << 1) AS code FROM sy4)"""


# Boxes and covers are worked out in SQL from the corners in degrees: 32-bit, clamped, and keyed like points.
_CORNERS = ", ".join(f"({k}, {r.lat0}, {r.lon0}, {r.lat1}, {r.lon1})" for k, r in BOXES)
_TILE_X = "CAST(floor(({0} + 180.0) / 360.0 * 33554432) AS BIGINT) & 33554431"
_TILE_Y = "CAST(floor((1.0 - ln(tan({0} * (pi() / 180.0)) + 1.0 / cos({0} * (pi() / 180.0))) / pi()) / 2.0 * 33554432) AS BIGINT) & 33554431"
_CLAMPED = "greatest(-{1}::FLOAT, least({1}::FLOAT, {0}::FLOAT))::DOUBLE"
BOX = f"""corner(query_id, lat0, lon0, lat1, lon1) AS (VALUES {_CORNERS}),
clamped AS (SELECT query_id, {_CLAMPED.format("lat0", 85.0511)} AS lat0, {_CLAMPED.format("lon0", 179.9)} AS lon0, {_CLAMPED.format("lat1", 85.0511)} AS lat1, {_CLAMPED.format("lon1", 179.9)} AS lon1 FROM corner),
box AS (SELECT query_id, {_TILE_X.format("lon0")} AS x0, {_TILE_Y.format("lat0")} AS y0, {_TILE_X.format("lon1")} AS x1, {_TILE_Y.format("lat1")} AS y1 FROM clamped)"""


def _inside(query_id: int) -> str:
    of = lambda c: f"(SELECT {c} FROM box WHERE query_id = {query_id})"
    return f"x BETWEEN {of('x0')} AND {of('x1')} AND y BETWEEN {of('y0')} AND {of('y1')}"


def _cover(query_id: int, ref: int = 8) -> str:
    """Quadrants q(z, quadrant, lo, hi, is_full) from the root down: those that meet the box are split until they lie in it or have the reference level."""
    w = "(1 << (25 - z))"
    full = f"qx * {w} >= x0 AND (qx + 1) * {w} - 1 <= x1 AND qy * {w} >= y0 AND (qy + 1) * {w} - 1 <= y1"
    meets = f"qx * {w} <= x1 AND (qx + 1) * {w} - 1 >= x0 AND qy * {w} <= y1 AND (qy + 1) * {w} - 1 >= y0"
    return f"""one AS (SELECT x0, y0, x1, y1 FROM box WHERE query_id = {query_id} AND x0 <= x1 AND y0 <= y1),
split(z, qx, qy, quadrant) AS (SELECT 0, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM one UNION ALL
  SELECT n.z, n.qx, n.qy, n.quadrant FROM (SELECT z + 1 AS z, qx * 2 + dx AS qx, qy * 2 + dy AS qy, quadrant * 4 + dx + 2 * dy AS quadrant FROM
    (SELECT split.* FROM split, one WHERE z < {ref} AND NOT ({full})), (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) d(dx, dy)) n, one WHERE {meets}),
q AS (SELECT z, quadrant, quadrant << (2 * (25 - z)) AS lo, ((quadrant + 1) << (2 * (25 - z))) - 1 AS hi, {full} AS is_full FROM split, one WHERE z = {ref} OR {full})"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark log made from events: kinds of events are algorithms, users are queries; events without a value have no timing."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("value IS NOT NULL")
    return rows.select(F.col("event_type").alias("algo"), F.col("event_id").alias("t"), F.col("value").alias("ms"), (F.col("user_id") % 50).alias("query_id"), (F.col("user_id") % 8).alias("width"), (F.col("event_id") % 997 == 0).cast("int").alias("removed"))


LOG = "WITH g AS (SELECT event_type AS algo, event_id AS t, value AS ms, user_id % 50 AS query_id, user_id % 8 AS width, CAST(event_id % 997 = 0 AS INTEGER) AS removed FROM events WHERE value IS NOT NULL)"

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- keys ---------------------------------------------------------------------------------


@query(f"{KEYED} SELECT event_id, x, y, code FROM k")
def point_keys(spark, sf_dir):
    """Tiles and codes of all points."""
    return keyed(spark, sf_dir).select("event_id", "x", "y", "code")


@query(f"{KEYED} SELECT event_id, x, y, code >> 34 AS quadrant8, (code >> 34) << 34 AS low8, ((code >> 34) << 34) + 17179869183 AS high8 FROM k")
def quadrants(spark, sf_dir):
    """Decoded codes, and the level-8 quadrants' ranges."""
    code = F.col("code")
    low, high = morton.quadrant_range(morton.ancestor(code, 8), 8)
    return keyed(spark, sf_dir).select("event_id", morton.decode_x(code).alias("x"), morton.decode_y(code).alias("y"), morton.ancestor(code, 8).alias("quadrant8"), low.alias("low8"), high.alias("high8"))


@query(f"""{KEYED} SELECT event_id, round(CAST((x + 0.5) / 33554432 * 360.0 - 180 AS FLOAT)::DOUBLE, 4) AS lon,
round(CAST(180.0 / pi() * atan(0.5 * (exp(pi() - 2 * pi() * (y + 0.5) / 33554432) - exp(-(pi() - 2 * pi() * (y + 0.5) / 33554432)))) AS FLOAT)::DOUBLE, 4) AS lat FROM k""")
def tile_centres(spark, sf_dir):
    """Centres of the points' tiles."""
    return keyed(spark, sf_dir).select("event_id", F.round(mercator.tile_lon(F.col("x") + 0.5, 25).cast("double"), 4).alias("lon"), F.round(mercator.tile_lat(F.col("y") + 0.5, 25).cast("double"), 4).alias("lat"))


# -- scans and counts ----------------------------------------------------------------------


@query(f"{KEYED}, {BOX} SELECT event_id, time, code FROM k WHERE {_inside(0)}")
def region_scan(spark, sf_dir):
    """All rows of a box, in Z-order."""
    return store(spark, sf_dir).scan(MAIN).select("event_id", "time", "code")


@query(f"{KEYED}, {BOX} SELECT count(*) AS n FROM k WHERE {_inside(0)}")
def region_count(spark, sf_dir):
    """Count of a box by code ranges and tile bounds, over the stored points."""
    return regions.count(store(spark, sf_dir).points, MAIN, stored=True)


@query(f"{KEYED}, {BOX} SELECT count(*) AS n FROM k WHERE {_inside(0)}")
def region_count_brute_force(spark, sf_dir):
    """Q16."""
    return regions.brute_force_count(keyed(spark, sf_dir), MAIN)


@query(f"{KEYED}, {BOX} SELECT event_id FROM k WHERE {_inside(6)}")
def region_scan_swapped(spark, sf_dir):
    """F1 with swapped corners: nothing."""
    return regions.scan(keyed(spark, sf_dir), BOXES[6][1]).select("event_id")


@query(f"WITH {POINTS} SELECT event_id FROM p WHERE lat BETWEEN {MAIN.lat1}::FLOAT AND {MAIN.lat0}::FLOAT AND lon BETWEEN {MAIN.lon0}::FLOAT AND {MAIN.lon1}::FLOAT")
def region_scan_exact(spark, sf_dir):
    """the box over 32-bit coordinates."""
    return regions.select_exactly(points(spark, sf_dir), MAIN).select("event_id")


@query(f"{KEYED}, {BOX}, {_cover(0)} SELECT z::INTEGER AS z, quadrant, count(*) AS n FROM k JOIN q ON code BETWEEN lo AND hi WHERE {_inside(0)} GROUP BY ALL")
def quadrant_counts(spark, sf_dir):
    """Counts by quadrant of the cover, none for empty ones."""
    return regions.count_by_quadrant(store(spark, sf_dir).points, MAIN)


@query(f"{KEYED}, {BOX} SELECT query_id::BIGINT AS query_id, count(k.x) AS n FROM box LEFT JOIN k ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY query_id")
def workload_counts(spark, sf_dir):
    """Q15: every box of a workload in one pass."""
    return regions.workload(store(spark, sf_dir).points, BOXES)


@query(
    f"WITH {POINTS}, box(query_id, lat0, lon0, lat1, lon1) AS (VALUES "
    + ", ".join(f"({k}, {r.lat0}::FLOAT, {r.lon0}::FLOAT, {r.lat1}::FLOAT, {r.lon1}::FLOAT)" for k, r in BOXES)
    + ") SELECT query_id::BIGINT AS query_id, count(p.lat) AS n FROM box LEFT JOIN p ON lat BETWEEN lat1 AND lat0 AND lon BETWEEN lon0 AND lon1 GROUP BY query_id"
)
def workload_counts_exact(spark, sf_dir):
    """F2 over the workload."""
    return regions.workload_exactly(points(spark, sf_dir), BOXES)


@query(f"WITH {POINTS} SELECT ({MAIN.lat0}::FLOAT::DOUBLE + {MAIN.lat1}::FLOAT::DOUBLE) / 2 AS lat, ({MAIN.lon0}::FLOAT::DOUBLE + {MAIN.lon1}::FLOAT::DOUBLE) / 2 AS lon, 0 AS z, count(*) AS n FROM p WHERE lat BETWEEN {MAIN.lat1}::FLOAT AND {MAIN.lat0}::FLOAT AND lon BETWEEN {MAIN.lon0}::FLOAT AND {MAIN.lon1}::FLOAT")
def region_total(spark, sf_dir):
    """One row for the box."""
    return regions.region_total(points(spark, sf_dir), MAIN)


@query(f"""{KEYED}, {BOX}, {_cover(0)}, m AS (SELECT *, {_inside(0)} AS hit FROM k JOIN q ON code BETWEEN lo AND hi)
SELECT count(DISTINCT lo) AS refinements, count(*) FILTER (hit) AS total, count(*) FILTER (hit AND NOT is_full) AS true_positives, count(*) FILTER (NOT hit AND NOT is_full) AS false_positives FROM m""")
def region_statistics(spark, sf_dir):
    """Q14."""
    return regions.statistics(store(spark, sf_dir).points, MAIN)


# -- tiles, pages, ranks ---------------------------------------------------------------------

ZOOM = 2


def _tiles_sql(query_id: int, level: int) -> str:
    w = 1 << 25 - level
    return f"""{KEYED}, {BOX}, c AS (SELECT x // {w} AS tx, y // {w} AS ty, code >> {2 * (25 - level)} AS tile FROM k),
g AS (SELECT {level} AS z, tile, tx, ty, count(*) AS n FROM c, box
  WHERE query_id = {query_id} AND tx * {w} >= x0 AND (tx + 1) * {w} - 1 <= x1 AND ty * {w} >= y0 AND (ty + 1) * {w} - 1 <= y1 GROUP BY ALL)"""


@query(f"{_tiles_sql(0, ZOOM + 8)} SELECT z, tile, n FROM g")
def tile_grid(spark, sf_dir):
    """Q4, Q7: counts of the map's tiles, eight levels below its zoom."""
    return regions.tile_grid(keyed(spark, sf_dir), MAIN, ZOOM)


@query(f"""{_tiles_sql(0, ZOOM + 8)} SELECT round(CAST(180.0 / pi() * atan(0.5 * (exp(pi() - 2 * pi() * (ty + 0.5) / 1024) - exp(-(pi() - 2 * pi() * (ty + 0.5) / 1024)))) AS FLOAT)::DOUBLE, 4) AS lat,
round(CAST((tx + 0.5) / 1024 * 360.0 - 180 AS FLOAT)::DOUBLE, 4) AS lon, n FROM g""")
def tile_heatmap(spark, sf_dir):
    """Q5: tiles by their centres."""
    out = regions.tile_response(regions.tile_grid(keyed(spark, sf_dir), MAIN, ZOOM))
    return out.select(F.round(F.col("lat").cast("double"), 4).alias("lat"), F.round(F.col("lon").cast("double"), 4).alias("lon"), "n")


@query(f"{_tiles_sql(0, ZOOM + 8)} SELECT min(n) AS min_n, coalesce(max(n), 0) AS max_n FROM g")
def tile_extent(spark, sf_dir):
    """Q5: least and greatest count."""
    return regions.tile_extent(regions.tile_grid(keyed(spark, sf_dir), MAIN, ZOOM))


@query(f"{KEYED}, {BOX} SELECT event_id, time, event_type, code FROM k WHERE {_inside(0)} ORDER BY code, time, event_id LIMIT 100")
def data_page(spark, sf_dir):
    """Q6, P10, S3: the first hundred rows in Z-order."""
    return regions.page(keyed(spark, sf_dir), MAIN, tie=("time", "event_id")).select("event_id", "time", "event_type", "code")


@query(f"""WITH {POINTS}, d AS (SELECT event_id, time, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(lat::DOUBLE) - radians(20.0)) / 2), 2)
  + cos(radians(20.0)) * cos(radians(lat::DOUBLE)) * pow(sin((radians(lon::DOUBLE) - radians(10.0)) / 2), 2)))) AS km, 90 - time AS age FROM p)
SELECT event_id, round(km, 6) AS km, round(0.3 * km / 3000.0 + 0.7 * age / 60, 6) AS score FROM d WHERE km <= 3000 AND age BETWEEN 0 AND 60 ORDER BY 0.3 * km / 3000.0 + 0.7 * age / 60, event_id LIMIT 25""")
def top_k(spark, sf_dir):
    """Q9: near and recent rows, by a score of our own."""
    best = regions.top_k(points(spark, sf_dir), 20.0, 10.0, 25, 0.3, 3000.0, 90, 60, "event_id")
    return best.select("event_id", F.round("km", 6).alias("km"), F.round("score", 6).alias("score"))


@query(f"{KEYED} SELECT z::INTEGER AS z, code >> (2 * (25 - z)) AS code, count(*) AS n FROM k, (SELECT unnest([0, 2, 4, 8]) AS z) GROUP BY 1, 2")
def tile_pyramid(spark, sf_dir):
    """Counts of the quadrants of several levels."""
    return layout.pyramid(keyed(spark, sf_dir), [0, 2, 4, 8])


@query(f"{KEYED}, {BOX} SELECT count(*) AS n FROM k WHERE {_inside(4)}")
def pyramid_count(spark, sf_dir):
    """The world's count from the pyramid and its edge from the points."""
    return store(spark, sf_dir).count(BOXES[4][1])


# -- windows and triggers ----------------------------------------------------------------------


@query(f"WITH {POINTS} SELECT time // 100 AS batch, floor(lat::DOUBLE) AS lat0, floor(lon::DOUBLE) AS lon0, ceil(lat::DOUBLE) AS lat1, ceil(lon::DOUBLE) AS lon1, count(*) AS n FROM p GROUP BY ALL HAVING count(*) > 10000 * 0.015 / 100")
def hot_cells(spark, sf_dir):
    """Cells with more than 0.015 per cent of a batch of 10,000 rows, which are two or more."""
    return windows.hot_cells(points(spark, sf_dir).withColumn("batch", F.floor(F.col("time") / 100)), "batch", 10_000, 0.015)


@query(f"WITH {POINTS} SELECT event_id, time FROM p WHERE time >= 40")
def live_rows(spark, sf_dir):
    """Rows that have not expired."""
    return windows.live(points(spark, sf_dir), 40).select("event_id", "time")


@query(f"WITH {POINTS} SELECT event_id, time FROM p WHERE NOT coalesce(event_type = 'click' OR value > 50, false)")
def removed_rows(spark, sf_dir):
    """removal by a predicate."""
    return windows.remove(points(spark, sf_dir), (F.col("event_type") == "click") | (F.col("value") > 50)).select("event_id", "time")


@query(f"WITH {POINTS}, c AS (SELECT time AS tick, count(*) AS n FROM p GROUP BY 1) SELECT a.tick, a.tick - 29 AS oldest, sum(b.n)::BIGINT AS rows FROM c a JOIN c b ON b.tick BETWEEN a.tick - 29 AND a.tick GROUP BY 1, 2")
def window_sizes(spark, sf_dir):
    """W2, W3 strict: rows in the window after every tick."""
    return windows.strict_window(points(spark, sf_dir), 30)


@query(f"WITH {POINTS} SELECT count(*) AS n, (SELECT time FROM p ORDER BY event_id DESC LIMIT 1) AS now FROM p")
def size_and_now(spark, sf_dir):
    """Q12, Q13."""
    rows = points(spark, sf_dir)
    return regions.size(rows).crossJoin(regions.now(rows, "event_id"))


# -- scalar helpers and displays -----------------------------------------------------------------


@query("""WITH d AS (SELECT event_id, (event_id * 37) % 60000 - 20000 AS days FROM events), c AS (SELECT *, DATE '1970-01-01' + days::INTEGER AS date FROM d)
SELECT event_id, year(date)::INTEGER AS y, month(date)::INTEGER AS m, day(date)::INTEGER AS d, dayofweek(date)::INTEGER AS weekday, (day(last_day(date)))::INTEGER AS last,
 (year(date) % 4 = 0 AND (year(date) % 100 <> 0 OR year(date) % 400 = 0)) AS leap, ((dayofweek(date) + 1) % 7)::INTEGER AS next_day, ((dayofweek(date) + 6) % 7)::INTEGER AS prev_day,
 ((dayofweek(date) - 3 + 7) % 7)::INTEGER AS since_wednesday, days * 86400 + 3723 AS seconds, days AS days FROM c""")
def calendar(spark, sf_dir):
    """Date helpers."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", ((F.col("event_id") * 37) % 60000 - 20000).alias("days"))
    rows = rows.withColumn("c", dates.civil_from_days(F.col("days"))).select("event_id", F.col("c.year").alias("y"), F.col("c.month").alias("m"), F.col("c.day").alias("d"))
    days = dates.days_from_civil(F.col("y"), F.col("m"), F.col("d"))
    w = dates.weekday_from_days(days)
    return rows.select(
        "event_id", "y", "m", "d", w.alias("weekday"), dates.last_day_of_month(F.col("y"), F.col("m")).alias("last"), dates.is_leap(F.col("y")).alias("leap"),
        dates.next_weekday(w).alias("next_day"), dates.prev_weekday(w).alias("prev_day"), dates.weekday_difference(w, F.lit(3)).alias("since_wednesday"),
        dates.epoch_seconds(F.col("y"), F.col("m"), F.col("d"), F.lit(1), F.lit(2), F.lit(3)).alias("seconds"), days.cast("long").alias("days"),
    )


@query("""WITH l AS (SELECT event_id, log10(event_id + 1) AS l FROM events) SELECT event_id, floor(256 * least(1.0, greatest(0.0, l)))::INTEGER AS r,
floor(256 * least(1.0, greatest(0.0, l - 1)))::INTEGER AS g, floor(256 * least(1.0, greatest(0.0, l - 2)))::INTEGER AS b FROM l""")
def colour_scale(spark, sf_dir):
    """Colours of counts; logarithms of powers of ten are exact."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", scales.red_yellow_white(F.col("event_id")).alias("c")).select("event_id", "c.r", "c.g", "c.b")


@query("SELECT event_id, CASE WHEN value < 10 OR value > 90 THEN NULL ELSE round((value - 10) * 2.8 / 80 + 1.2, 6) END AS size FROM events")
def size_scale(spark, sf_dir):
    """Linear scale; outside the range there is no size."""
    scaled = scales.to_range(F.col("value"), (10.0, 90.0), (1.2, 4.0))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.when(~F.isnan(scaled), F.round(scaled, 6)).alias("size"))


@query(f"""{KEYED}, s AS (SELECT x // 32768 AS px, y // 32768 AS py, (1 + event_id % 3)::DOUBLE AS w FROM k),
g AS (SELECT floor(px / 12.5) AS cx, floor(py / 12.5) AS cy, sum(px * w) AS sx, sum(py * w) AS sy, sum(w) AS sw FROM s GROUP BY 1, 2)
SELECT floor(sx / sw + 0.5)::BIGINT AS px, floor(sy / sw + 0.5)::BIGINT AS py, least(sw, 20.0) AS intensity FROM g""")
def heat_cells(spark, sf_dir):
    """Pixels rebinned for display."""
    rows = keyed(spark, sf_dir).select(F.shiftright("x", 15).alias("px"), F.shiftright("y", 15).alias("py"), (F.col("event_id") % 3 + 1).cast("double").alias("w"))
    return regions.heat_cells(rows, "px", "py", "w", 12.5, 20.0)


@query("""WITH c AS (SELECT event_id % 15 AS language, event_id % 5 AS device, event_id % 4 AS app FROM events),
l(language, language_name) AS (VALUES (1,'en'),(2,'es'),(3,'de'),(5,'fr'),(6,'it'),(8,'ko'),(9,'nl'),(10,'pl'),(11,'pt'),(12,'ru')),
d(device, device_name) AS (VALUES (0,'other'),(1,'apple'),(2,'android'),(3,'apple'),(4,'windows')), a(app, app_name) AS (VALUES (0,'browser'),(1,'twitter'),(2,'foursquare'),(3,'instagram'))
SELECT coalesce(language_name, 'none') AS language_name, device_name, app_name, count(*) AS n FROM c LEFT JOIN l USING (language) JOIN d USING (device) JOIN a USING (app) GROUP BY ALL""")
def categories(spark, sf_dir):
    """Category dictionaries as small dimensions."""
    e = F.col("event_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select((e % 15).alias("language"), (e % 5).alias("device"), (e % 4).alias("app"))
    for name, values in (("language", scales.LANGUAGES), ("device", scales.DEVICES), ("app", scales.APPS)):
        rows = rows.join(F.broadcast(scales.dimension(spark, values, name, f"{name}_name")), name, "left")
    return rows.groupBy(F.coalesce("language_name", F.lit("none")).alias("language_name"), "device_name", "app_name").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '/rest/query/tile/' || event_id % 20 || '/' || event_id || '/7/' || event_id || '/7/resolution/8'
 WHEN event_id % 3 = 1 THEN '/rest/query/region/' || CASE WHEN event_id % 2 = 0 THEN '1' ELSE (event_id % 20)::VARCHAR END || '/1/2/3/' || event_id END AS path FROM events""")
def log_queries(spark, sf_dir):
    """Paths of a web log."""
    e = F.col("event_id").cast("string")
    zoom = (F.col("event_id") % 20).cast("string")
    tile = F.concat(F.lit("http://host/a/b/tile/"), zoom, F.lit("/8/"), e, F.lit("/7,"), e, F.lit(",5"))
    region = F.concat(F.lit("http://host/a/b/query/q/"), F.when(F.col("event_id") % 2 == 0, "undefined").otherwise(zoom), F.lit("/1/2/3/"), e, F.lit(","), e, F.lit(",5"))
    line = F.when(F.col("event_id") % 3 == 0, tile).when(F.col("event_id") % 3 == 1, region).otherwise(F.lit("nothing"))
    return text.log_queries(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", line.alias("value"))).select("event_id", "path")


# -- analysis of logs ------------------------------------------------------------------------------


@query(f"{LOG} SELECT algo, t, round(sum(ms) OVER (PARTITION BY algo ORDER BY t ROWS UNBOUNDED PRECEDING) / row_number() OVER (PARTITION BY algo ORDER BY t) + 1e-9, 6) AS amortized FROM g")
def log_amortized(spark, sf_dir):
    """A1."""
    return analysis.amortized(_log(spark, sf_dir)).select("algo", "t", F.round(F.col("amortized") + 1e-9, 6).alias("amortized"))


@query(f"{LOG}, a AS (SELECT algo, query_id, avg(ms) AS avg_run, avg(t) AS avg_rm FROM g GROUP BY ALL) SELECT algo, query_id, round(sqrt(avg_rm * avg_run), 6) AS ratio FROM a QUALIFY rank() OVER (PARTITION BY algo ORDER BY sqrt(avg_rm * avg_run)) = 1")
def log_best_configuration(spark, sf_dir):
    """A2."""
    means = _log(spark, sf_dir).groupBy("algo", "query_id").agg(F.avg("ms").alias("avg_run"), F.avg("t").alias("avg_rm"))
    return analysis.best_configuration(means).select("algo", "query_id", F.round("ratio", 6).alias("ratio"))


@query(f"{LOG}, f AS (SELECT algo, min(t) AS first_removal FROM g WHERE removed > 0 GROUP BY 1) SELECT algo, first_removal, round(avg(ms), 6) AS mean_before FROM g LEFT JOIN f USING (algo) WHERE first_removal IS NULL OR t < first_removal GROUP BY ALL")
def log_first_removal(spark, sf_dir):
    """A3."""
    return analysis.before_first_removal(_log(spark, sf_dir)).select("algo", "first_removal", F.round("mean_before", 6).alias("mean_before"))


@query(f"{LOG} SELECT algo, round(avg(ms), 6) AS mean, round(stddev_samp(ms), 6) AS sd, round(sum(ms), 4) AS total FROM g GROUP BY 1")
def log_summary(spark, sf_dir):
    """A4."""
    return analysis.summary(_log(spark, sf_dir)).select("algo", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round("total", 4).alias("total"))


@query(f"""{LOG}, w AS (SELECT query_id, width, avg(ms) FILTER (algo = 'click') AS base, avg(ms) FILTER (algo = 'view') AS v, avg(ms) FILTER (algo = 'purchase') AS p FROM g GROUP BY 1, 2),
u AS (SELECT width, 'view' AS other, v / base AS ratio FROM w UNION ALL SELECT width, 'purchase', p / base FROM w)
SELECT width, other, round(avg(ratio), 6) AS speedup, round(avg((ratio > 1)::INTEGER) * 100, 6) AS wins FROM u GROUP BY 1, 2""")
def log_speedups(spark, sf_dir):
    """A5: pivot, unpivot and ratios."""
    out = analysis.speedups(_log(spark, sf_dir), "click", ["view", "purchase"])
    return out.select("width", "other", F.round("speedup", 6).alias("speedup"), F.round("wins", 6).alias("wins"))


@query("SELECT k AS level, 180.0 / pow(2.0, k) AS width, 26000000.0 * (180.0 / pow(2.0, k) / 360.0) * (180.0 / pow(2.0, k) / 180.0) AS expected FROM (SELECT unnest(range(1, 9)) AS k)")
def width_classes(spark, sf_dir):
    """A6."""
    return analysis.width_classes(spark, 26_000_000)


# -- covers as a table, the client's windows, generated workloads ------------------------------------


@query(f"WITH RECURSIVE {BOX}, {_cover(0)} SELECT z::INTEGER AS z, quadrant, lo AS low, hi AS high, is_full FROM q")
def box_cover(spark, sf_dir):
    """the cover of a box as a table function."""
    covers.register(spark)
    return spark.sql(f"SELECT * FROM box_cover({MAIN.lat0}D, {MAIN.lon0}D, {MAIN.lat1}D, {MAIN.lon1}D, 8)")


@query(f"""WITH {BOX}, s AS (SELECT query_id, list_sum([(((x0 >> i) & 1) << (2 * i)) | (((y0 >> i) & 1) << (2 * i + 1)) for i in range(25)])::BIGINT AS a,
 list_sum([(((x1 >> i) & 1) << (2 * i)) | (((y1 >> i) & 1) << (2 * i + 1)) for i in range(25)])::BIGINT AS b FROM box),
p AS (SELECT query_id, a, max(z) AS z FROM s, (SELECT unnest(range(26)) AS z) WHERE a >> (2 * (25 - z)) = b >> (2 * (25 - z)) GROUP BY 1, 2)
SELECT query_id::BIGINT AS query_id, z::INTEGER AS z, a >> (2 * (25 - z)) AS quadrant FROM p""")
def parent_quadrants(spark, sf_dir):
    """The smallest quadrant that holds both corners."""
    return spark.createDataFrame([(k, r.box.parent.z, r.box.parent.code) for k, r in BOXES], "query_id long, z int, quadrant long")


#: A client's windows: north, west, south, east, zoom.
WINDOWS = [(60.0, -100.0, 15.0, -55.0, 3), (89.0, -190.0, -89.0, 179.5, 1), (12.25, 33.25, 12.0, 34.0, 9), (50.0, -10.0, 38.75, 1.25, 30)]


@query("WITH w(k, north, west, south, east, zoom) AS (VALUES " + ", ".join(f"({k}, {', '.join(map(str, w))})" for k, w in enumerate(WINDOWS)) + """),
h AS (SELECT k, least(zoom, 24) AS z, greatest(-85.0, least(85.0, north))::DOUBLE AS n, greatest(-85.0, least(85.0, south))::DOUBLE AS s,
 CASE WHEN west > 179 THEN 179.9 ELSE greatest(west, -180.0) END::DOUBLE AS w, CASE WHEN east > 179 THEN 179.9 ELSE greatest(east, -180.0) END::DOUBLE AS e FROM w)
SELECT k::BIGINT AS k, z::INTEGER AS z, floor((w + 180.0) / 360.0 * pow(2, z))::BIGINT AS x0, floor((1.0 - ln(tan(radians(n)) + 1.0 / cos(radians(n))) / pi()) / 2.0 * pow(2, z))::BIGINT AS y0,
 floor((e + 180.0) / 360.0 * pow(2, z))::BIGINT AS x1, floor((1.0 - ln(tan(radians(s)) + 1.0 / cos(radians(s))) / pi()) / 2.0 * pow(2, z))::BIGINT AS y1 FROM h""")
def viewports(spark, sf_dir):
    """a client's windows as tiles."""
    return spark.createDataFrame([(k, *viewport(*w)) for k, w in enumerate(WINDOWS)], "k long, z int, x0 long, y0 long, x1 long, y1 long")


@query("""WITH b AS (SELECT k, i, 180.0 / pow(2.0, k) AS width FROM (SELECT unnest(range(1, 9)) AS k), (SELECT unnest(range(10)) AS i)),
h AS (SELECT *, least(width / 2, 85.0) AS hl, least(width / 2, 180.0) AS ho FROM b),
c AS (SELECT *, -85.0 + hl + (i + 0.5) / 10 * (170.0 - 2 * hl) AS y, -180.0 + ho + ((i * 7 + k) % 10 + 0.5) / 10 * (360.0 - 2 * ho) AS x FROM h)
SELECT ((k - 1) * 10 + i)::BIGINT AS query_id, k::BIGINT AS level, round(y + hl, 6) AS lat0, round(x - ho, 6) AS lon0, round(y - hl, 6) AS lat1, round(x + ho, 6) AS lon1 FROM c""")
def workload_latin(spark, sf_dir):
    """A generated workload of eight width classes, ten boxes each."""
    return analysis.latin_boxes(spark).select("query_id", "level", *[F.round(c, 6).alias(c) for c in ("lat0", "lon0", "lat1", "lon1")])


@query(f"""WITH {POINTS}, f AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS q, lat::DOUBLE AS lat, lon::DOUBLE AS lon FROM p ORDER BY event_id LIMIT 80), h AS (SELECT *, 90.0 / pow(2.0, q // 10 + 1) AS half FROM f)
SELECT q::BIGINT AS query_id, round(lat + half, 6) AS lat0, round(lon - half, 6) AS lon0, round(lat - half, 6) AS lat1, round(lon + half, 6) AS lon1 FROM h""")
def workload_centred(spark, sf_dir):
    """A generated workload centred on data."""
    return analysis.centred_boxes(points(spark, sf_dir), "event_id").select("query_id", *[F.round(c, 6).alias(c) for c in ("lat0", "lon0", "lat1", "lon1")])


# -- other forms of counts -----------------------------------------------------------------------------


@query(f"{KEYED}, {BOX}, {_cover(0)}, i AS (SELECT code FROM k WHERE {_inside(0)}) SELECT z::INTEGER AS z, quadrant, count(code) AS n FROM q LEFT JOIN i ON code BETWEEN lo AND hi GROUP BY ALL")
def quadrant_counts_all(spark, sf_dir):
    """Counts by quadrant, zeros too."""
    return regions.count_by_quadrant(store(spark, sf_dir).points, MAIN, include_empty=True)


@query(f"{_tiles_sql(0, ZOOM + 5)} SELECT z, tile, n FROM g")
def tile_grid_resolution(spark, sf_dir):
    """Q7: tiles of another resolution."""
    return regions.tile_grid(keyed(spark, sf_dir), MAIN, ZOOM, 5)


@query(f"{KEYED}, {BOX} SELECT event_type, count(*) AS n FROM k WHERE {_inside(0)} GROUP BY 1")
def applied_to_region(spark, sf_dir):
    """The callback surface: any transformation of a box's rows."""
    return store(spark, sf_dir).apply(MAIN, lambda rows: rows.groupBy("event_type").agg(F.count("*").alias("n")))


@query(f"{KEYED} SELECT event_id FROM k WHERE time >= 5")
def lazy_survivors(spark, sf_dir):
    """A store above its limit loses what has expired."""
    return store(spark, sf_dir).survivors(5, 100).select("event_id")


@query(f"{KEYED} SELECT event_id FROM k")
def lazy_untouched(spark, sf_dir):
    """A store below its limit keeps all."""
    return store(spark, sf_dir).survivors(5, 10**15).select("event_id")


@query(f"{KEYED}, {BOX} SELECT event_id, code FROM k WHERE {_inside(1)}")
def inserted_rows(spark, sf_dir):
    """A store built from half of the rows, the rest inserted."""
    rows = points(spark, sf_dir)
    made = PointStore.create(rows.where("event_id % 2 = 0"), layout.scratch(spark, "halves"))
    made.insert(rows.where("event_id % 2 = 1"))
    return made.scan(BOXES[1][1]).select("event_id", "code")


# -- messages, logs and streams -------------------------------------------------------------------------


@query(f"""WITH {POINTS} SELECT event_id AS id, (1219842525 + event_id % 30)::BIGINT AS time, round(lat::DOUBLE, 4) AS lat, round(lon::DOUBLE, 4) AS lon, 'note ' || event_type AS text FROM p WHERE event_id % 4 <> 0""")
def message_points(spark, sf_dir):
    """Messages written as JSON lines, read again and made points; those without coordinates are none."""
    rows = points(spark, sf_dir)
    where = F.when(F.col("event_id") % 4 != 0, F.struct(F.array(F.col("lon").cast("double"), F.col("lat").cast("double")).alias("coordinates")))
    at = F.concat(F.lit("Wed Aug 27 13:08:"), F.lpad((F.col("event_id") % 30 + 45 - F.when(F.col("event_id") % 30 >= 15, 60).otherwise(0)).cast("string"), 2, "0"), F.lit(" +0000 2008"))
    at = F.when(F.col("event_id") % 30 >= 15, F.regexp_replace(at, "13:08:", "13:09:")).otherwise(at)
    lines = rows.select(F.to_json(F.struct(where.alias("coordinates"), at.alias("created_at"), F.col("event_id").alias("id"), F.concat(F.lit("note "), F.col("event_type")).alias("text"))).alias("value"))
    path = layout.scratch(spark, "messages")
    lines.write.text(path)
    messages = text.read_messages(spark, path)
    found = text.to_points(messages, keep=["id"])
    return found.select(F.col("id").cast("long").alias("id"), "time", F.round(F.col("lat").cast("double"), 4).alias("lat"), F.round(F.col("lon").cast("double"), 4).alias("lon"), "text")


@query(f"{LOG} SELECT algo, t, round(ms, 6) AS ms, query_id FROM g")
def benchmark_log(spark, sf_dir):
    """A log written as ;-separated rows and read again."""
    path = layout.scratch(spark, "log")
    text.write_benchmark_log(_log(spark, sf_dir).select("algo", "t", "ms", "query_id"), path)
    return spark.read.option("sep", ";").option("header", True).schema("algo string, t long, ms double, query_id long").csv(path).select("algo", "t", F.round("ms", 6).alias("ms"), "query_id")


@query("SELECT event_id FROM events WHERE contains(lower(event_type), 'click') OR contains(lower(event_type), 'view')")
def keyword_rows(spark, sf_dir):
    """Rows with one of some words."""
    return ingest.with_keyword(points(spark, sf_dir), ["Click", "VIEW"], "event_type").select("event_id")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    found = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(f"{sf_dir}/events.parque[t]")
    return generators.points_of_events(found)


@query(f"{KEYED} SELECT event_id, code FROM k")
def ingested_rows(spark, sf_dir):
    """Rows that a stream has written, keyed."""
    path = layout.scratch(spark, "ingested")
    ingest.ingest(_stream(spark, sf_dir), path, layout.scratch(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(path).select("event_id", "code")


@query(f"WITH {POINTS}, m AS (SELECT max(time) AS newest FROM p) SELECT event_id, time FROM p, m WHERE time > newest - 20")
def windowed_rows(spark, sf_dir):
    """The last twenty ticks of a stream's windowed store."""
    path = layout.scratch(spark, "windowed")
    ingest.windowed_store(_stream(spark, sf_dir), path, layout.scratch(spark, "checkpoint"), 20).awaitTermination()
    rows = spark.read.parquet(path)
    newest = rows.agg(F.max("time").alias("newest"))
    return rows.join(F.broadcast(newest), F.col("time") > F.col("newest") - 20).select("event_id", "time")


@query("SELECT date_trunc('hour', ts) - to_hours(h) AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS h) GROUP BY 1")
def hopping_windows(spark, sf_dir):
    """Windows of two hours that start every hour."""
    return windows.hopping_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "2 hours", "1 hour").select("start", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    """Sessions of users that a pause of six hours ends."""
    return windows.session_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "ts", "6 hours")
