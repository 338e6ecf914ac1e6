"""Connected components of a graph given by its links, in alternating star rounds.

Large stars hand each neighbour above a node to the smallest node around it; small stars do the same
below.  Rounds end when the links no longer change, each being a star around the smallest node of its
component.  Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _mark(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node and component (its smallest node) of every node that has a link to another one.

    Nodes are integers; null ends, loops and repeated links are ignored; no links give no rows.
    """
    high, low = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    links = written(links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(high, low).distinct(), "components")
    mark = _mark(links)
    while mark[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(around, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            around.where("m < u").select("u", F.col("m").alias("v"))
        ).where("u <> v").distinct()
        large = written(large, "components")
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(below.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        links = written(small, "components")
        new = _mark(links)
        if new == mark:
            break
        mark = new
    return links.select(F.col("u").alias("node"), F.col("v").alias("component"))


def forest_roots(links: DataFrame, child: str, parent: str) -> DataFrame:
    """node and component (the root above it) where each node has one parent at most and no cycles.

    Pointers jump to the parent's parent, so rounds grow as the logarithm of the depth."""
    tree = written(links.select(F.col(child).alias("node"), F.col(parent).alias("component")), "forest")
    while True:
        above = tree.select(F.col("node").alias("p"), F.col("component").alias("top"))
        jumped = tree.join(above, F.col("component") == F.col("p"), "left")
        jumped = written(jumped.select("node", F.coalesce("top", "component").alias("component"), F.col("top").isNotNull().alias("moved")), "forest")
        tree = jumped.select("node", "component")
        if jumped.where("moved").isEmpty():
            return tree
