"""Networks as link tables (src, dst), generated without a driver loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from ..plans.lineage import stored


def chain(spark: SparkSession, n: int) -> DataFrame:
    """0 - 1 - ... - (n-1)"""
    return spark.range(max(n - 1, 0)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


def ring(spark: SparkSession, n: int, k: int) -> DataFrame:
    """Each agent linked to the next k // 2 around a ring."""
    out = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(max(k // 2, 1)))).alias("d"))
    return out.select("src", ((F.col("src") + F.col("d")) % n).alias("dst")).filter("src <> dst")


def small_world(spark: SparkSession, n: int, k: int, p: float, seed: int = 0, rounds: int = 60) -> DataFrame:
    """Ring lattice whose links move their far end to a random agent with probability p; every link stays one of its own, so there are as many as in the lattice.

    In each round the links that have to move draw an agent; draws that are no other agent, a link that exists, or another link's draw (the least link has it) are
    drawn anew in the next. Draws are keyed by link and round. Where no free place turns up in ``rounds`` rounds (networks that are all but complete) that is an error.
    """
    link = F.col("src") * (n + 1) + F.col("dst")
    lattice = ring(spark, n, k).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct().withColumn("link", link)
    moves = rng.uniform(seed, 0, F.col("link"), 1) < p
    taken, left = stored(lattice.filter(~moves).select("src", "dst")), stored(lattice.filter(moves).select(F.col("src").alias("near"), "link"))
    for r in range(rounds):
        if left.head() is None:
            return taken
        far = F.floor(rng.uniform(seed, r, F.col("link"), 2) * n).cast("long")
        drawn = left.withColumn("far", far).filter("far <> near").select("near", "link", F.least("near", "far").alias("src"), F.greatest("near", "far").alias("dst"))
        free = drawn.join(taken, ["src", "dst"], "left_anti").groupBy("src", "dst").agg(F.min("link").alias("link"))
        placed = stored(free)
        taken = taken.union(placed.select("src", "dst"))
        taken = stored(taken) if r % 8 == 7 else taken
        left = stored(left.join(placed.select("link"), "link", "left_anti"))
    raise RuntimeError("no room for all links")


def hierarchy(spark: SparkSession, fan_out: int = 10, levels: int = 3) -> DataFrame:
    """A tree of levels of 1, fan_out, fan_out^2 ... agents, numbered level by level."""
    size = sum(fan_out**i for i in range(levels))
    return spark.range(1, size).select(F.floor((F.col("id") - 1) / fan_out).alias("src"), F.col("id").alias("dst"))


def one_of_each_stratum(total: int, parts: int, x, u):
    """The x-th of ``parts`` distinct numbers under ``total``: one from each stratum, by a uniform number."""
    low, high = F.floor(x * total / parts), F.floor((x + 1) * total / parts)
    return (low + F.floor(u * (high - low))).cast("long")


def clustered_ring(spark: SparkSession, clusters: int, per_cluster: int, degree: int, cross: int, reach: int = 1, seed: int = 0) -> DataFrame:
    """Clusters of agents that draw ``degree`` others of their cluster each (a link to a higher id is kept), and exactly ``cross`` random links to each of the next ``reach`` clusters.

    Draws are one from each stratum of the possible targets or pairs, so none comes twice.
    """
    n = min(degree, per_cluster - 1)
    agents = spark.range(clusters * per_cluster).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("d"))
    offset = 1 + one_of_each_stratum(per_cluster - 1, max(n, 1), F.col("d"), rng.uniform(seed, 0, F.col("src") * max(n, 1) + F.col("d"), 5))
    first = F.floor(F.col("src") / per_cluster) * per_cluster
    inside = agents.select("src", (first + (F.col("src") - first + offset) % per_cluster).cast("long").alias("dst")).filter("src < dst")
    if n < 1:
        inside = inside.limit(0)
    cross = min(cross, per_cluster * per_cluster)
    if cross < 1 or clusters < 2 or reach < 1:
        return inside
    wide = spark.range(clusters).select(F.col("id").alias("c"), F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("r")).select("c", "r", F.explode(F.sequence(F.lit(0), F.lit(cross - 1))).alias("x"))
    key = (F.col("c") * reach + F.col("r") - 1) * cross + F.col("x")
    pair = one_of_each_stratum(per_cluster * per_cluster, cross, F.col("x"), rng.uniform(seed, 0, key, 3))
    between = wide.withColumn("p", pair).select((F.col("c") * per_cluster + F.floor(F.col("p") / per_cluster)).alias("src"), (((F.col("c") + F.col("r")) % clusters) * per_cluster + F.col("p") % per_cluster).alias("dst"))
    return inside.union(between.filter("src <> dst"))


def sample(agents: DataFrame, k: int, seed: int, salt: int = 9) -> DataFrame:
    """k agents without replacement: those with the least random number."""
    return agents.select("agent_id").orderBy(rng.uniform(seed, 0, F.col("agent_id"), salt), "agent_id").limit(k)
