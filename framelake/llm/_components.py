"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm._scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): component is the least node reachable.

    ``edges`` has long columns a and b. Nodes without an edge to another are
    left out. Every round writes its edges to the shared folder; only two
    numbers of a round come to the driver.
    """
    kept = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        e = kept.df
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = scratch.keep(large)
        lower = large.df.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.df.join(lower, "u")
            .select(
                F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")
            )
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        after = scratch.keep(small)
        kept.drop()
        large.drop()
        kept = after
        now = kept.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return (
        kept.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionByName(kept.df.select(F.col("v").alias("node"), F.col("v").alias("component")))
        .distinct()
    )
