"""The path form of queries and its JSON answers.

A path is ``/rest/query/`` and then keywords in any order, each with its
numbers: ``tile|region|data/z/x0/y0/x1/y1`` and ``resolution/n``.  The last
keyword decides the kind.  Whatever cannot be read answers ``[]``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotiles.operators import regions
from geotiles.plans.region import TileBox

#: Deepest tiles below a zoom that an answer holds: at most 4**MOST_RESOLUTION tiles a map tile.
MOST_RESOLUTION = 10
#: Shortest path, in parts.
LEAST_PARTS = 5
FIELDS = ("time", "language", "device", "app", "text")


@dataclass(frozen=True)
class Query:
    kind: str
    z: int
    box: TileBox
    resolution: int = regions.GRID_STEP


def parse(path: str, edge: str = "inclusive") -> Query | None:
    parts = [p for p in path.split("/") if p]
    if parts[:2] != ["rest", "query"] or len(parts) + 1 < LEAST_PARTS:
        return None
    kind, z, box, resolution = None, 0, None, regions.GRID_STEP
    rest = iter(parts[2:])
    try:
        for word in rest:
            if word in ("tile", "region", "data"):
                kind = word
                z, *corners = (int(next(rest)) for _ in range(5))
                if not 0 <= z <= 25:
                    return None
                box = TileBox.of_tiles(z, *corners, edge=edge)
            elif word == "resolution":
                kind, resolution = "tile", int(next(rest))
                if not 0 <= resolution <= MOST_RESOLUTION:
                    return None
    except (ValueError, StopIteration, RuntimeError):
        return None
    return Query(kind, z, box, resolution) if kind and box else None


def answer(keyed: DataFrame, path: str, edge: str = "inclusive") -> str:
    """The JSON answer; only bounded results (tiles of a map, a page, a number) reach the driver."""
    query = parse(path, edge)
    if query is None:
        return "[]"
    if query.kind == "region":
        return json.dumps([regions.count(keyed, query.box).collect()[0]["n"]])
    if query.kind == "tile":
        rows = regions.tile_response(regions.tile_grid(keyed, query.box, query.z, query.resolution)).collect()
        counts = [r["n"] for r in rows]
        return json.dumps([{"data": [[r["lat"], r["lon"], r["n"]] for r in rows], "min": min(counts, default=None), "max": max(counts, default=0)}])
    rows = regions.page(keyed, query.box, tie=[c for c in ("time", *keyed.columns) if c not in ("code", "extra")]).select(*[c for c in FIELDS if c in keyed.columns]).collect()
    return json.dumps({"draw": 1, "data": [list(r) for r in rows], "recordsTotal": len(rows), "recordsFiltered": len(rows)})


def as_json(grid: DataFrame) -> DataFrame:
    """The same tile rows as JSON strings, for a sink."""
    return regions.tile_response(grid).select(F.to_json(F.struct("lat", "lon", "n")).alias("value"))
