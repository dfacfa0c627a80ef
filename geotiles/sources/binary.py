"""Fixed-width binary point files as Spark data sources.

``dat``: a 764-byte header, then 19-byte little-endian records.  ``dmp``: no
header, 156-byte records with 140 bytes of text; option ``endian`` (little or
big) and ``coord_order`` (lat_lon or lon_lat) say who wrote it.  Partitions are
ranges of records, so a file of any size is read in parallel; executors must see
the path.  A cut last record is left out.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from geotiles.plans.layout import MESSAGE, METADATA

# The files' layout.
HEADER = {"dat": 764, "dmp": 0}
TEXT_BYTES = 140
#: Records of a partition, and of a batch.
PARTITION_RECORDS, BATCH_RECORDS = 4_000_000, 100_000


def record(kind: str, endian: str = "little", coord_order: str = "lat_lon") -> np.dtype:
    e = {"little": "<", "big": ">"}[endian]
    names = {"lat_lon": ("lat", "lon"), "lon_lat": ("lon", "lat")}[coord_order]
    tail = [("language", "u1"), ("device", "u1"), ("app", "u1")] if kind == "dat" else [("text", f"S{TEXT_BYTES}")]
    return np.dtype([(names[0], f"{e}f4"), (names[1], f"{e}f4"), ("time", f"{e}u8"), *tail])


class Slice(InputPartition):
    def __init__(self, path: str, first: int, count: int) -> None:
        super().__init__((path, first, count))
        self.path, self.first, self.count = path, first, count


class PointReader(DataSourceReader):
    def __init__(self, kind: str, options: dict) -> None:
        self.kind, self.path = kind, options["path"]
        self.header = HEADER[kind]
        self.type = record(kind, options.get("endian", "little"), options.get("coord_order", options.get("coordorder", "lat_lon")))
        self.limit = int(options.get("limit", -1))

    def files(self) -> list[str]:
        if os.path.isdir(self.path):
            return sorted(os.path.join(self.path, f) for f in os.listdir(self.path) if f.endswith("." + self.kind))
        return [self.path]

    def partitions(self) -> list[Slice]:
        out, left = [], self.limit if self.limit >= 0 else float("inf")
        for path in self.files():
            n = int(min(left, max(0, os.path.getsize(path) - self.header) // self.type.itemsize))
            left -= n
            out += [Slice(path, a, min(PARTITION_RECORDS, n - a)) for a in range(0, n, PARTITION_RECORDS)]
        return out or [Slice("", 0, 0)]

    def read(self, part: Slice):
        for a in range(0, part.count, BATCH_RECORDS):
            n = min(BATCH_RECORDS, part.count - a)
            rows = np.fromfile(part.path, self.type, n, offset=self.header + (part.first + a) * self.type.itemsize)
            columns = {"lat": pa.array(rows["lat"].astype("<f4")), "lon": pa.array(rows["lon"].astype("<f4")), "time": pa.array(rows["time"].astype(np.int64))}
            if self.kind == "dat":
                columns |= {c: pa.array(rows[c].astype(np.int16)) for c in ("language", "device", "app")}
            else:
                columns["text"] = pa.array([t.split(b"\0")[0].decode("utf-8", "replace") for t in rows["text"].tolist()])
            yield pa.RecordBatch.from_pydict(columns)


class DatSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiles_dat"

    def schema(self) -> str:
        return METADATA

    def reader(self, schema) -> PointReader:
        return PointReader("dat", self.options)


class DmpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiles_dmp"

    def schema(self) -> str:
        return MESSAGE

    def reader(self, schema) -> PointReader:
        return PointReader("dmp", self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DatSource)
    spark.dataSource.register(DmpSource)
