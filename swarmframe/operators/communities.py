"""Communities of greatest modularity: moves to neighbouring communities, contraction, again.

The graph is two tables, as in the multilevel partitioner: nodes (node, k: weight of its links' ends, loops included) and arcs (u, v, w), both directions of
each link. In a round every node of one half (by a hash of node and round) looks at what it gains by joining a neighbour's community; the halves move in turn, and of two
communities of one node only the one of greater name joins the other, so that nodes do not swap places. A round that lowers modularity is taken back. What is left are the communities as
nodes of a smaller graph, until modularity rises no more. Volumes are sums over communities, ties are joins: nothing is collected but a few numbers a round, and
tables of more than ``BROADCAST`` nodes are merged, as a broadcast in every round of every level would bring them all to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import stored

#: What a round has to gain, and in how many rounds of no gain a level ends (each half has its turn).
GAIN, IDLE = 1e-6, 2
#: Nodes of a graph whose tables may be broadcast.
BROADCAST = 10_000


def side(df: DataFrame, n: int) -> DataFrame:
    """A side of a join in a graph of ``n`` nodes."""
    return df.hint("merge") if n > BROADCAST else df


def modularity(edges: DataFrame, found: DataFrame) -> float:
    """Share of edges inside communities less what it would be if ends met by chance. found: agent_id, community, of all agents; edges count as they are, in both directions."""
    ends = edges.select("src", "dst").join(found.select(F.col("agent_id").alias("src"), F.col("community").alias("a")).hint("merge"), "src").join(found.select(F.col("agent_id").alias("dst"), F.col("community").alias("b")).hint("merge"), "dst")
    both = ends.select("a", "b").union(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
    per = both.groupBy("a").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("a") == F.col("b")).alias("inside"))
    total, inside, squares = per.agg(F.sum("k"), F.sum("inside"), F.sum(F.col("k").cast("double") * F.col("k"))).first()
    return inside / total - squares / total / total if total else 0.0


def _half(r: int):
    return F.pmod(F.xxhash64(F.col("node"), F.lit(r // 2)) + r, F.lit(2)) == 0


def moved(nodes: DataFrame, arcs: DataFrame, total: float, rounds: int) -> tuple[DataFrame, float]:
    """node, community, k after rounds of moves, and the modularity."""
    state = stored(nodes.select("node", F.col("node").alias("community"), "k", "loops"))
    best, quality, idle, n = state, None, 0, state.count()
    for r in range(rounds + 1):
        near = stored(arcs.join(side(state.select(F.col("node").alias("v"), F.col("community").alias("to")), n), "v").groupBy(F.col("u").alias("node"), "to").agg(F.sum("w").alias("s")))
        volumes = stored(state.groupBy("community").agg(F.sum("k").alias("volume"), F.count(F.lit(1)).alias("n"), F.sum("loops").alias("loops")))
        inside = near.join(side(state, n), "node").filter(F.col("to") == F.col("community")).agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0]
        loops, squares = volumes.agg(F.sum("loops"), F.sum(F.col("volume").cast("double") * F.col("volume"))).first()
        now = (inside + loops) / total - squares / total / total
        if quality is not None and now < quality + GAIN:
            idle += 1
            if now < quality:
                state = best
                if idle < IDLE and r < rounds:
                    continue
        else:
            idle = 0
        if quality is None or now >= quality:
            best, quality = state, now
        if idle >= IDLE or r == rounds:
            break
        here = volumes.select("community", F.col("volume").alias("own_volume"), F.col("n").alias("own_n"))
        there = volumes.select(F.col("community").alias("to"), "volume", F.col("n").alias("to_n"))
        ways = near.join(side(state.filter(_half(r)), n), "node").join(side(here, n), "community").join(side(there, n), "to")
        alone = (F.col("own_n") == 1) & (F.col("to_n") == 1)
        value = F.col("s") - F.col("k") * F.col("volume") / total
        stay = F.max(F.when(F.col("to") == F.col("community"), F.col("s")))
        go = F.max(F.when((F.col("to") != F.col("community")) & (~alone | (F.col("to") < F.col("community"))), F.struct(value.alias("value"), (-F.col("to")).alias("name"))))
        chosen = ways.groupBy("node", "k", "own_volume").agg(stay.alias("stay"), go.alias("go"))
        gains = F.col("go.value") > F.coalesce("stay", F.lit(0)) - F.col("k") * (F.col("own_volume") - F.col("k")) / total + 1e-12
        going = chosen.filter(gains).select("node", (-F.col("go.name")).alias("new"))
        state = stored(state.join(side(going, n), "node", "left").select("node", F.coalesce("new", "community").alias("community"), "k", "loops"))
    return best, quality


def louvain(agents: DataFrame, edges: DataFrame, rounds: int = 8, levels: int = 12) -> DataFrame:
    """agent_id, community (its least agent_id). Edges count in both directions; loops and edges of unknown agents do not; an agent without links is alone."""
    known = agents.select(F.col("agent_id").alias("node"))
    n = known.count()
    links = edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.count(F.lit(1)).alias("w"))
    links = links.join(side(known.select(F.col("node").alias("u")), n), "u").join(side(known.select(F.col("node").alias("v")), n), "v")
    arcs = stored(links.select("u", "v", "w").union(links.select("v", "u", "w")))
    ends = arcs.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k"))
    nodes = stored(known.join(side(ends, n), "node", "left").select("node", F.coalesce("k", F.lit(0)).alias("k"), F.lit(0).cast("long").alias("loops")))
    member = stored(known.select(F.col("node").alias("agent_id"), "node"))
    total = arcs.agg(F.sum("w")).first()[0]
    quality = None
    for _ in range(levels if total else 0):
        state, now = moved(nodes, arcs, float(total), rounds)
        if quality is not None and now < quality + GAIN:
            break
        quality = now
        of, n = side(state.select("node", "community"), n), state.select("community").distinct().count()
        member = stored(member.join(of, "node").select("agent_id", F.col("community").alias("node")))
        small = arcs.join(of.withColumnRenamed("node", "u").withColumnRenamed("community", "a"), "u").join(of.withColumnRenamed("node", "v").withColumnRenamed("community", "b"), "v")
        small = stored(small.groupBy("a", "b").agg(F.sum("w").alias("w")))
        inner = small.filter("a = b").select(F.col("a").alias("node"), F.col("w").alias("inner"))
        sums = state.groupBy(F.col("community").alias("node")).agg(F.sum("k").alias("k"), F.sum("loops").alias("loops"))
        nodes = stored(sums.join(side(inner, n), "node", "left").select("node", "k", (F.col("loops") + F.coalesce("inner", F.lit(0))).alias("loops")))
        arcs = stored(small.filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"), "w"))
    names = member.groupBy("node").agg(F.min("agent_id").alias("community"))
    return member.join(side(names, n), "node").select("agent_id", "community")
