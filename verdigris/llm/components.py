"""Connected components of a table of links, by alternating large-star and small-star contraction.

Each round moves links towards the smallest id of their component; hubs are handled by a partial aggregation and
a join, never by gathering a node's neighbours in one place. Rounds are cut by reliable checkpoints. The driver
sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.where("b > a").join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` has ``a > b`` in every row."""
    least = links.groupBy("a").agg(F.min("b").alias("low"))
    moved = links.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(least.select("a", F.col("low").alias("b"))).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``node, root``: for each node in a link the smallest node of its component; roots themselves are left out.

    Links to itself and repeats change nothing; rows with a null end are ignored; no links give no rows.
    """
    now = links.where(f"`{a}` is not null and `{b}` is not null and `{a}` <> `{b}`").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    now = cut(now)
    state = None
    for _ in range(most_rounds):
        now = cut(_small_star(_large_star(now)))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(seen)
    raise RuntimeError("links did not settle")
