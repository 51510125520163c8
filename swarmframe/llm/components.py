"""Connected components of an edge table, without collecting it anywhere.

Large-star and small-star alternate until nothing changes: each node's
neighbours are linked to the smallest node of its neighbourhood. Minima are
partial aggregates, and the links of one hub are spread by the other end's key
before they are made distinct, so a hub of any degree is no task's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rekeyed, stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: a > b. Relink every node's larger (or smaller) neighbours to the least of its neighbourhood."""
    if large:
        around = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = around.filter("v > u").join(rekeyed(least, "u"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        both = links.join(rekeyed(least, "a"), "a")
        out = both.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root of every node of ``edges`` (two columns of ids): root is the least id of its component. Loops and repeats do no harm."""
    x, y = edges.columns
    links = stored(edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).filter("a <> b").distinct())
    loops = edges.filter(F.col(x) == F.col(y)).select(F.col(x).alias("node"))
    state = None
    for _ in range(max_rounds):
        links = stored(_star(_star(links, True), False))
        # both sums are the same again only when no link moved
        new = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return ends.union(ends.select(F.col("root").alias("node"), "root")).union(loops.select("node", F.col("node").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
