"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.session import drop, written


def _least(pairs: DataFrame) -> DataFrame:
    """For rows (u, v): v with the least of u and all its v. The least is aggregated before the exchange; rows of a hot u
    are joined to its one aggregate, which adaptive execution splits."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, comp): every node that has an edge to another, with the smallest node it is linked to by a chain.

    Rounds follow the logarithm of the longest chain. Each round's edges are written to the shared folder. Edges to
    itself, repeated edges and edges with a NULL end don't matter; no edges give no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    e = written(e, "edges")
    mark = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = _least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        last, e = e, written(small.where("u != v").distinct(), "edges")
        drop(last)
        row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
            )
        mark = tuple(row)
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
