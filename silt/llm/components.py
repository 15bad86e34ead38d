"""Connected components by alternating large-star and small-star rounds.

Each round rewires every node to the smallest node it can see. Links are only ever
held in DataFrames; each round's links are a table in the shared folder, so lost
executors never replay earlier rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "cc-least")
    out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    out = materialize(out, "cc-large")
    discard(least)
    return out


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialize(down.groupBy("a").agg(F.min("b").alias("m")), "cc-least")
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    out = materialize(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "cc-small")
    discard(least)
    return out


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node of the node's component.

    ``links`` has two long columns a and b, in any order, repeats and self links
    allowed; null ends are ignored. Nodes without a link to another node are not
    returned. An empty table gives an empty result. The result is a written table.
    """
    now = materialize(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "cc-links",
    )
    seen = None
    for _ in range(max_rounds):
        wide = _large_star(now)
        narrow = _small_star(wide)
        discard(now, wide)
        now = narrow
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out._silt_path = now._silt_path
            return out
        seen = mark
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
