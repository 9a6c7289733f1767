"""Connected components of a link table, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.session import materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`(node, root)` for every linked node; the root is the component's smallest node.

    Alternates two star contractions: each node's larger neighbours move to its smallest one, then
    its smaller neighbours do. Minima are combined before the shuffle and the joins are plain
    equi-joins on the node, which adaptive execution splits for a node with very many links. Every
    round is written to the shared folder. Ends when a round changes nothing.

    Cases: self-links and repeated links are harmless; a node without another node is not returned;
    null ends are ignored; an empty table gives an empty one.
    """
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    links = materialise(links.where(F.col("u") > F.col("v")).distinct())
    state = _state(links)
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Stored, so that the join is not tied to the grouping's partitions and a hub can be split.
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u > v").distinct())
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(least, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            moved.select("u", F.col("m").alias("v"))
        )
        links = materialise(small.where("u > v").distinct())
        before, state = state, _state(links)
        if state == before:
            break
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return roots.union(links.select(F.col("u").alias("node"), F.col("v").alias("root")))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
