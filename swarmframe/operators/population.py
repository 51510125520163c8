"""Operators on agent tables: counts, histograms, breed ranges, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts(agents: DataFrame, *by: str) -> DataFrame:
    """Agents per rank, breed, state or any columns."""
    return agents.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def breed_ranges(agents: DataFrame) -> DataFrame:
    """breed, start, n: where each breed lies when agents are sorted by breed. One row per breed in the only window."""
    n = counts(agents, "breed")
    return n.select("breed", (F.sum("n").over(Window.orderBy("breed")) - F.col("n")).cast("long").alias("start"), "n")


def priority_ranges(agents: DataFrame, priorities: dict[int, list[int]]) -> dict[int, tuple[int, int]]:
    """Per priority, from the first to after the last agent (sorted by breed) of the breeds that have a step there."""
    at = {r.breed: (r.start, r.start + r.n) for r in breed_ranges(agents).collect()}
    return {p: (min(at[b][0] for b in breeds if b in at), max(at[b][1] for b in breeds if b in at)) for p, breeds in priorities.items() if any(b in at for b in breeds)}


def sorted_by_breed(agents: DataFrame, partitions: int | None = None) -> DataFrame:
    """Agents laid out by breed, then id; a physical order only."""
    dealt = agents.repartitionByRange(partitions, "breed", "agent_id") if partitions else agents.repartitionByRange("breed", "agent_id")
    return dealt.sortWithinPartitions("breed", "agent_id")


def widest(agents: DataFrame, *arrays: str) -> DataFrame:
    """One row: the greatest size of each array property."""
    return agents.agg(*[F.coalesce(F.max(F.size(a)), F.lit(0)).cast("long").alias(a) for a in arrays])
