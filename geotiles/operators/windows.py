"""Sliding windows over ticks, hot cells and the latest time, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of a batch, in per cent, that makes a cell hot.
ALERT = 2.0


def live(points: DataFrame, oldest: int) -> DataFrame:
    """Rows that have not expired: only what is strictly older goes."""
    return points.where(F.col("time") >= oldest)


def remove(points: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate does not hold; a null verdict removes nothing."""
    return points.where(~F.coalesce(predicate, F.lit(False)))


def strict_window(points: DataFrame, ticks: int, step: Column | None = None) -> DataFrame:
    """The window after every tick: (tick, oldest, rows) with the ``ticks`` most recent ticks eligible.

    One count per tick is enough, and each counts for the ``ticks`` ticks it is eligible in, so
    sums are by tick and no task sees all ticks.
    """
    per = points.groupBy(F.col("time").alias("tick")).agg(F.count("*").alias("n"))
    counts = per.select(F.explode(F.sequence(F.col("tick"), F.col("tick") + (ticks - 1))).alias("tick"), "n", F.col("tick").alias("own"))
    sums = counts.groupBy("tick").agg(F.sum("n").alias("rows"), F.max("own").alias("own"))
    return sums.where("own = tick").select("tick", (F.col("tick") - (ticks - 1)).alias("oldest"), "rows")


def lazy_state(counts: list[tuple[int, int]], ticks: int, most: int) -> list[tuple[int, int, int, bool]]:
    """(tick, inserted, rows, purged) when expired rows go only once the store exceeds ``most`` rows.

    counts: rows by tick, a bounded list of ticks.  Every tick inserts first;
    if the store is then too large, all expired rows go at once.
    """
    held: dict[int, int] = {}
    out = []
    for tick, n in counts:
        held[tick] = held.get(tick, 0) + n
        purge = sum(held.values()) > most
        if purge:
            held = {t: k for t, k in held.items() if t >= tick - (ticks - 1)}
        out.append((tick, n, sum(held.values()), purge))
    return out


def cell() -> Column:
    """The one-degree cell of a point; a whole coordinate gives a cell without extent."""
    lat, lon = F.col("lat").cast("double"), F.col("lon").cast("double")
    return F.struct(F.floor(lat).cast("double").alias("lat0"), F.floor(lon).cast("double").alias("lon0"), F.ceil(lat).cast("double").alias("lat1"), F.ceil(lon).cast("double").alias("lon1"))


def hot_cells(points: DataFrame, batch: str, batch_rows: int, alert: float = ALERT) -> DataFrame:
    """Cells of a batch with more rows than ``alert`` per cent of the configured batch size."""
    counted = points.groupBy(F.col(batch).alias("batch"), cell().alias("cell")).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > batch_rows * alert / 100.0).select("batch", "cell.*", "n")


def hopping_counts(points: DataFrame, event_time: str, length: str, step: str) -> DataFrame:
    """Rows of hopping event-time windows: (start, end, n)."""
    return points.groupBy(F.window(event_time, length, step).alias("w")).agg(F.count("*").alias("n")).select("w.start", "w.end", "n")


def session_counts(points: DataFrame, by: str, event_time: str, gap: str) -> DataFrame:
    """Rows of sessions that a pause of ``gap`` ends: (by, start, end, n)."""
    return points.groupBy(by, F.session_window(event_time, gap).alias("w")).agg(F.count("*").alias("n")).select(by, "w.start", "w.end", "n")
