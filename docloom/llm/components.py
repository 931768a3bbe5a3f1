"""Connected components of an edge table by alternating large-star and small-star steps.

Cases: an edge to itself and repeated edges change nothing; an edge with a null
end is no edge; an empty table gives no rows; ids are of any type with an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (its smallest id) of every id in the edges (a, b).

    Every step groups by node with map-side minima, so a node with very many
    neighbours is pre-aggregated; no link ever goes to the driver.  Each step's
    result is a table in the shared folder.  Steps keep what is connected, and
    they end once the table is a forest of stars.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _stars(now):
        both = now.union(now.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").filter("v <> m").select("v", "m").toDF("u", "v").union(least.select("u", "m").toDF("u", "v"))
        before, now = now, written(small.filter("u <> v").distinct(), "stars")
        dropped(before)
    heads = now.select("v").distinct()
    return now.toDF("id", "component").union(heads.select("v", "v").toDF("id", "component"))


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one edge and is no v."""
    several = edges.groupBy("u").count().filter("count > 1").select("u")
    inner = edges.select(F.col("v").alias("x")).join(edges.select("u"), F.col("x") == F.col("u"), "left_semi")
    return several.union(inner).isEmpty()
