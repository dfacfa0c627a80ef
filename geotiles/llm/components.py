"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotiles.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the least node that links reach.

    Alternates two star operations (Kiveris et al., 2014): every node links its
    larger neighbours, then its smaller ones and itself, to the least node it
    knows.  The number of rounds grows with the logarithm of the longest chain.
    Each round is written to the shared folder.  Sums over the edges tell when
    nothing moves any more.

    Defined cases: loops and repeated edges count for nothing, a null end is ignored,
    and no edges give no rows.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, before = materialize(both), None
    while True:
        # large star: larger neighbours of u go to the least of u and its neighbours
        out = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # (what is grouped is written, so that a join with a hot node reads both sides anew and can be split)
        least = materialize(out.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = materialize(out.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: smaller neighbours of u and u itself go to the least of them
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = materialize(small.where("u <> v").distinct())
        discard(links, least, large, low)
        links = now
        state = links.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.col("v").cast("decimal(38,0)"))).collect()[0]
        if state == before:
            break
        before = state
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
