"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.shared import forget, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: every node links its larger neighbours to the smallest around it; small: its smaller ones and itself."""
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = around.join(least, F.col("u") == F.col("w"))
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def labels(links: DataFrame, tag: str = "components") -> DataFrame:
    """node, label: the smallest node that can be reached, for every node in links (a, b).

    Each round is a table in the shared folder; the rounds grow with the
    logarithm of a component's diameter.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag)
    seen = None
    while True:
        following = materialize(_star(_star(edges, True), False), tag)
        now = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v") / 2.0**20), F.bit_xor(F.xxhash64("u", "v"))).first()
        forget(edges)
        edges = following
        if now[0] == 0 or (seen is not None and (now[0], now[2]) == (seen[0], seen[2])):
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
