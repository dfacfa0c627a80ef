"""Structured Streaming forms: ingest, windows, hot cells and change notices."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geotiles.operators import windows
from geotiles.plans.layout import append, with_keys
from geotiles.plans.region import Region


def read_points(spark: SparkSession, path: str, schema: str, files_a_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, a bounded number of files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def in_region(points: DataFrame, region: Region) -> DataFrame:
    return with_keys(points).where(region.box.contains())


def with_keyword(points: DataFrame, words: list[str], column: str = "text") -> DataFrame:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(F.lower(column), F.lit(w.lower()))
    return points.where(found)


def ingest(points: DataFrame, path: str, checkpoint: str, on_batch: Callable[[str], None] | None = None, available_now: bool = True, interval: str = "10 milliseconds") -> StreamingQuery:
    """Append each batch, keyed and sorted, to a Z-ordered folder; tell ``on_batch`` the notice.

    A batch that is repeated after a failure is written to its own folder again,
    which replaces it: the sink is exactly-once.
    """

    def write(batch: DataFrame, number: int) -> None:
        with_keys(batch).sortWithinPartitions("code").write.mode("overwrite").parquet(f"{path}/batch={number}")
        if on_batch:
            on_batch(renewed())

    writer = points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def windowed_store(points: DataFrame, path: str, checkpoint: str, ticks: int) -> StreamingQuery:
    """Keep the last ``ticks`` ticks: each batch moves the window on and drops folders wholly before it.

    Readers use ``live`` for the exact bound; what has expired inside a kept
    folder is dropped with it later, so the store holds at least the window.
    """

    def write(batch: DataFrame, number: int) -> None:
        keyed = with_keys(batch).withColumn("tick", F.floor(F.col("time") / ticks)).withColumn("batch", F.lit(number).cast("long"))
        # a repeated batch replaces its own folders and no others
        writer = keyed.sortWithinPartitions("code").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("tick", "batch").parquet(path)
        newest = batch.agg(F.max("time")).collect()[0][0]
        if newest is not None:
            _drop_before(batch.sparkSession, path, (newest - ticks + 1) // ticks)

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _drop_before(spark: SparkSession, path: str, first: int) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.listStatus(at):
        name = found.getPath().getName()
        if name.startswith("tick=") and int(name[5:]) < first:
            fs.delete(found.getPath(), True)


def hot_cells(points: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], batch_rows: int, alert: float = windows.ALERT) -> StreamingQuery:
    """Hand each batch's hot cells to ``sink``."""

    def look(batch: DataFrame, number: int) -> None:
        sink(windows.hot_cells(batch.withColumn("batch", F.lit(number).cast("long")), "batch", batch_rows, alert), number)

    return points.writeStream.foreachBatch(look).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cell_counts(points: DataFrame, event_time: str, length: str, late: str) -> DataFrame:
    """Counts of cells by tumbling event-time windows; what is later than ``late`` is dropped."""
    timed = points.withWatermark(event_time, late)
    return timed.groupBy(F.window(event_time, length), windows.cell().alias("cell")).agg(F.count("*").alias("n"))


def push(points: DataFrame, checkpoint: str, send: Callable[[str], None], batch_rows: int, alert: float = windows.ALERT) -> StreamingQuery:
    """Tell ``send`` of every batch: that there is new data, its latest time, and its hot cells if it has any.

    A batch has at most 100 / ``alert`` hot cells of the configured size, so the cells sent are few.
    """

    def look(batch: DataFrame, number: int) -> None:
        newest = batch.agg(F.max("time")).collect()[0][0]
        if newest is None:
            return
        send(renewed())
        send(informed(newest))
        cells = windows.hot_cells(batch.withColumn("batch", F.lit(number).cast("long")), "batch", batch_rows, alert).orderBy("lat0", "lon0").limit(1000).collect()
        if cells:
            send(triggered([(c["lat0"], c["lon0"], c["lat1"], c["lon1"]) for c in cells]))

    return points.writeStream.foreachBatch(look).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def renewed() -> str:
    return json.dumps({"renew": True})


def informed(now: int) -> str:
    return json.dumps({"renew": False, "info": [now]})


def triggered(cells: list[tuple[float, float, float, float]]) -> str:
    return json.dumps({"renew": False, "triggers": [list(c) for c in cells]})


__all__ = ["append", "cell_counts", "hot_cells", "in_region", "informed", "ingest", "push", "read_points", "renewed", "triggered", "windowed_store", "with_keyword"]
