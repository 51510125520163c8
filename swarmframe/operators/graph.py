"""Operators on edge tables (src, dst, pos): building, changing, degrees, layout, cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered, running_sums


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Each (src, dst) once, with its first position."""
    return edges.groupBy("src", "dst").agg(F.min("pos").alias("pos"))


def connect(links: DataFrame, directed: bool = False) -> DataFrame:
    """Links to edges; undirected links become both directions. Repeats are ignored."""
    pos = F.col("pos").cast("long") if "pos" in links.columns else F.lit(0).cast("long")
    one = links.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), pos.alias("pos"))
    if directed:
        return distinct_edges(one)
    # both directions of a link are one row until repeats are gone
    turn = F.coalesce(F.col("src") > F.col("dst"), F.col("src").isNotNull() & F.col("dst").isNull())
    a, b = F.when(turn, F.col("dst")).otherwise(F.col("src")), F.when(turn, F.col("src")).otherwise(F.col("dst"))
    there, back = F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ways = F.when(F.col("src").eqNullSafe(F.col("dst")), F.array(there)).otherwise(F.array(there, back))
    return distinct_edges(one.select(a.alias("src"), b.alias("dst"), "pos")).select(F.explode(ways).alias("way"), "pos").select("way.src", "way.dst", "pos")


def disconnect(edges: DataFrame, links: DataFrame, directed: bool = False) -> DataFrame:
    """Edges without the given links; links that are not there do no harm."""
    gone = links.select("src", "dst")
    if not directed:
        gone = gone.union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.join(gone.distinct(), ["src", "dst"], "left_anti")


def degree(agents: DataFrame, edges: DataFrame) -> DataFrame:
    """agent_id, degree; agents without neighbours have 0."""
    count = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    return agents.select("agent_id").join(count, F.col("agent_id") == F.col("src"), "left").select("agent_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def nth_neighbor(edges: DataFrame, n: int) -> DataFrame:
    """src, dst of each agent's n-th neighbour (from 0) by position, then id."""
    rows = numbered(edges, [F.col("src"), F.col("pos"), F.col("dst")], "number")
    wanted = rows.groupBy("src").agg((F.min("number") + n).alias("number"))
    return rows.select("src", "dst", "number").join(wanted, ["number", "src"]).select("src", "dst")


def csr(agents: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compressed rows: (agent_id, offset, degree) and (slot, src, dst).

    Offsets are running sums in sampled ranges of ids, slots are places in the order of agent and position: no window holds all rows, or all of a hub's.
    """
    offsets = running_sums(degree(agents, edges), [F.col("agent_id")], "degree", "offset")
    slots = numbered(edges.join(agents.select(F.col("agent_id").alias("src")), "src", "left_semi"), [F.col("src"), F.col("pos"), F.col("dst")], "slot")
    return offsets, slots.select("slot", "src", "dst")


def with_ranks(edges: DataFrame, partition: DataFrame, default: int | None = None) -> DataFrame:
    """Edges with src_rank and dst_rank of a partition (agent_id, rank); without ``default``, edges of unknown agents go."""
    p = partition.select(F.col("agent_id"), F.col("rank"))
    how = "inner" if default is None else "left"
    out = edges.join(p.select(F.col("agent_id").alias("src"), F.col("rank").alias("src_rank")), "src", how).join(p.select(F.col("agent_id").alias("dst"), F.col("rank").alias("dst_rank")), "dst", how)
    return out if default is None else out.fillna({"src_rank": default, "dst_rank": default})


def ghosts(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """rank, agent_id, owner: the foreign neighbours that each rank reads."""
    r = with_ranks(edges, partition).filter("src_rank <> dst_rank")
    return r.select(F.col("src_rank").alias("rank"), F.col("dst").alias("agent_id"), F.col("dst_rank").alias("owner")).distinct()


def communication_volume(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """rank, owner, n_agents: how many agents each rank reads from each other."""
    return ghosts(edges, partition).groupBy("rank", "owner").agg(F.count(F.lit(1)).alias("n_agents"))


def balance(partition: DataFrame, workers: int | None = None) -> DataFrame:
    """One row: n_ranks, least and most agents of a rank that occurs, mean agents of all ``workers`` (of those that occur, if not given), imbalance = (most - least) / mean."""
    n = partition.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    one = n.agg(F.count(F.lit(1)).alias("n_ranks"), F.min("n").alias("least"), F.max("n").alias("most"), (F.avg("n") if workers is None else F.sum("n") / F.lit(workers)).alias("mean"))
    return one.withColumn("imbalance", (F.col("most") - F.col("least")) / F.col("mean"))


def cut_quality(ratio: Column) -> Column:
    return F.when(ratio < 0.10, "excellent").when(ratio < 0.20, "good").when(ratio < 0.40, "fair").otherwise("poor")


def edge_cut(edges: DataFrame, partition: DataFrame, default: int | None = -1) -> DataFrame:
    """One row: n_edges, n_cut, cut_ratio, quality. Unknown agents count as rank ``default``, or their edges are left out (None)."""
    r = with_ranks(edges, partition, default)
    cut = F.sum((F.col("src_rank") != F.col("dst_rank")).cast("long"))
    one = r.agg(F.count(F.lit(1)).alias("n_edges"), F.coalesce(cut, F.lit(0)).cast("long").alias("n_cut"))
    return one.withColumn("cut_ratio", F.when(F.col("n_edges") > 0, F.col("n_cut") / F.col("n_edges")).otherwise(F.lit(0.0))).withColumn("quality", cut_quality(F.col("cut_ratio")))


def analyze(edges: DataFrame, partition: DataFrame, default: int | None = -1, workers: int | None = None) -> DataFrame:
    """Balance and cut of a partition, and the mean number of neighbours, as one row."""
    n = partition.agg(F.count(F.lit(1)).alias("n_agents"))
    both = balance(partition, workers).withColumn("__k", F.lit(1)).join(edge_cut(edges, partition, default).withColumn("__k", F.lit(1)), "__k").join(n.withColumn("__k", F.lit(1)), "__k").drop("__k")
    return both.withColumn("mean_neighbors", F.col("n_edges") / F.col("n_agents"))
