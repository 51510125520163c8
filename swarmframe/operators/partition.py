"""Partitioning a network: in turn, at random, by communities, and in levels (``multilevel``)."""

from __future__ import annotations

import heapq
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..plans.lineage import cut
from .communities import louvain
from .multilevel import multilevel
from .order import numbered, running_sums

#: So many of the largest communities are placed one by one, on the driver; the others fill the room that is left, end to end.
PLACED = 10_000


def round_robin(agents: DataFrame, workers: int) -> DataFrame:
    """agent_id, rank: ids in order, dealt in turn."""
    _checked(workers)
    return numbered(agents.select("agent_id"), [F.col("agent_id")], "place").select("agent_id", (F.col("place") % workers).cast("int").alias("rank"))


def random(agents: DataFrame, workers: int, seed: int = 42) -> DataFrame:
    _checked(workers)
    return agents.select("agent_id", F.floor(rng.uniform(seed, 0, F.col("agent_id"), 7) * workers).cast("int").alias("rank"))


def label_propagation(agents: DataFrame, edges: DataFrame, rounds: int = 8, max_size: int | None = None) -> DataFrame:
    """agent_id, community. Each round, agents of one random half take their neighbours' most frequent label (the least of ties), unless that community is full."""
    state = cut(agents.select("agent_id", F.col("agent_id").alias("community")))
    for r in range(rounds):
        near = edges.join(state.select(F.col("agent_id").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.count(F.lit(1)).alias("n"))
        best = near.groupBy("src").agg(F.min_by("community", F.struct((-F.col("n")).alias("n"), "community")).alias("new"))
        moved = state.join(best, F.col("agent_id") == F.col("src"), "left")
        if max_size:
            full = state.groupBy("community").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= max_size).select(F.col("community").alias("new"), F.lit(True).alias("full"))
            moved = moved.join(full, "new", "left")
        else:
            moved = moved.withColumn("full", F.lit(None).cast("boolean"))
        turn = rng.uniform(11, r, F.col("agent_id"), 5) < 0.5
        state = cut(moved.select("agent_id", F.when(turn & F.col("new").isNotNull() & F.col("full").isNull(), F.col("new")).otherwise(F.col("community")).alias("community")))
    return state


def pack(communities: DataFrame, workers: int) -> DataFrame:
    """agent_id, rank: the largest communities by size, each to the least loaded rank (the lowest of ties); then the rest, laid end to end
    in the order of their labels, up to one common level. Ranks differ by less than two of the rest's largest, or as placing the largest leaves them."""
    sizes = cut(communities.groupBy("community").agg(F.count(F.lit(1)).alias("n")))
    loads, rows = [(0, w) for w in range(workers)], []
    for community, n in sizes.orderBy(F.desc("n"), "community").limit(PLACED).collect():
        load, w = heapq.heappop(loads)
        rows.append((community, w))
        heapq.heappush(loads, (load + n, w))
    placed = communities.sparkSession.createDataFrame(rows, "community bigint, rank int")
    rest = sizes.join(F.broadcast(placed), "community", "left_anti")
    left = rest.agg(F.sum("n")).head()[0]
    if left:
        upto = [0, *itertools.accumulate(room_up_to_a_level([load for load, _ in sorted(loads, key=lambda x: x[1])], left))]
        spread = running_sums(rest, [F.col("community")], "n", "before")
        middle = F.col("before") + F.col("n") / 2
        placed = placed.union(spread.select("community", (F.size(F.filter(F.array(*[F.lit(float(x)) for x in upto[1:-1]]), lambda x: x <= middle)) if workers > 1 else F.lit(0)).cast("int")))
    return communities.join(placed, "community").select("agent_id", "rank")


def room_up_to_a_level(loads: list[int], extra: int) -> list[float]:
    """What each rank takes of ``extra`` so that those that take any end at one level."""
    for k in range(len(loads), 0, -1):
        lowest = sorted(loads)[:k]
        level = (sum(lowest) + extra) / k
        if level >= lowest[-1]:
            break
    return [max(0.0, level - x) for x in loads]


def by_communities(agents: DataFrame, edges: DataFrame, workers: int, rounds: int = 8) -> DataFrame:
    """agent_id, rank: communities of greatest modularity, packed."""
    _checked(workers)
    return pack(louvain(agents, edges, rounds), workers)


def balanced(agents: DataFrame, edges: DataFrame, workers: int, slack: float = 1.05, rounds: int = 8) -> DataFrame:
    """agent_id, rank with few cut edges and ranks of equal size: communities are laid end to end, by label, and cut into equal lengths.

    Balance is exact to one agent, the cut is that of the communities; ``multilevel`` cuts less.
    """
    _checked(workers)
    total = agents.count()
    if not total:
        raise ValueError("the network is empty")
    found = label_propagation(agents, edges, rounds, max_size=max(1, int(slack * total / workers)))
    placed = numbered(found, [F.col("community"), F.col("agent_id")], "place")
    return placed.select("agent_id", F.floor(F.col("place") * workers / total).cast("int").alias("rank"))


def _checked(workers: int) -> None:
    if workers < 1:
        raise ValueError("at least one worker is needed")


METHODS = {"round_robin": lambda a, e, w, s: round_robin(a, w), "random": lambda a, e, w, s: random(a, w, s), "communities": lambda a, e, w, s: by_communities(a, e, w), "balanced": lambda a, e, w, s: balanced(a, e, w), "multilevel": multilevel}
METHODS |= {"roundrobin": METHODS["round_robin"], "community": METHODS["communities"], "metis": METHODS["multilevel"]}
