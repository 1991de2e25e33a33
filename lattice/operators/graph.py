"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(id, component: the smallest id reachable) of every node of (u, v), by alternating large and small stars."""
    now = materialise(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    sign = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    before, after = None, sign(now)
    while after != before:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Grouped by another key than the join's, so that the join deals both sides anew and can split a hot key.
        low = both.groupBy(F.bitwise_not("u").alias("g")).agg(F.min("v").alias("m")).select(F.bitwise_not("g").alias("u"), F.least(F.bitwise_not("g"), "m").alias("m"))
        large = both.join(low, "u").where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy(F.bitwise_not("u").alias("g")).agg(F.min("v").alias("m")).select(F.bitwise_not("g").alias("u"), "m")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        now = materialise(small)
        before, after = after, sign(now)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
