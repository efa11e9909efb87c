"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from punctual.llm.storage import stored


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """(node, component) for every node with a link to a smaller one; component is the smallest node reachable.

    Nodes that are the smallest of their component, or have no link, have no row. Every round is two
    grouped minima joined back on the node (a third of the links may share one node: minima combine
    before the shuffle and skewed joins are split), and is written, so that lineage stays short.
    Links to itself and NULL ends are ignored; repeated links count once; no links give no rows.
    """
    pairs = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    edges = stored(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = _signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        larger = stored(larger, name)
        smallest = larger.groupBy("u").agg(F.min("v").alias("m"))
        moved = larger.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(moved.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct(), name)
        after = _signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
