"""Histories of a simulation: circular buffers, pivots to wide tables, snapshot and event sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import set_at


def record(ctx, buffer: str, name: str):
    """The write of a circular history buffer: slot tick modulo its size gets the value at the tick's start."""
    return set_at(ctx.self(buffer), ctx.tick.cast("int"), ctx.self(name).cast("double"))


def wide(history: DataFrame, name: str, ticks: int) -> DataFrame:
    """agent_id, tick_0 ... tick_{ticks-1} as integers. The columns are given, so one aggregate makes them."""
    return history.groupBy("agent_id").agg(*[F.max(F.when(F.col("tick") == t, F.col(name))).cast("int").alias(f"tick_{t}") for t in range(ticks)])


def last_values(history: DataFrame, name: str, n: int) -> DataFrame:
    """The last n values up to each tick, oldest first."""
    w = Window.partitionBy("agent_id").orderBy("tick").rowsBetween(-(n - 1), 0)
    return history.withColumn(f"last_{name}", F.collect_list(name).over(w))


def previous(history: DataFrame, name: str) -> DataFrame:
    """The value one tick before, beside each value; null at the first."""
    return history.withColumn(f"previous_{name}", F.lag(name).over(Window.partitionBy("agent_id").orderBy("tick")))


def write_csv(history: DataFrame, name: str, ticks: int, path: str) -> None:
    wide(history, name, ticks).orderBy("agent_id").write.mode("overwrite").csv(path, header=True)


def parquet_sink(path: str, *columns: str) -> Callable[[int, DataFrame], None]:
    """A snapshot sink: each batch's state is one tick= folder."""

    def write(tick: int, agents: DataFrame) -> None:
        (agents.select("agent_id", *columns) if columns else agents).write.mode("overwrite").parquet(f"{path}/tick={tick}")

    return write


class Fired:
    """A ``post_step`` hook that records the agents for which a condition holds. It is part of the tick's plan: nothing is computed twice, and nothing is checkpointed but the events."""

    def __init__(self, condition: Column, columns: tuple[str, ...]):
        self.condition, self.columns = condition, ("tick", "agent_id", *columns)

    def __call__(self, breed, priority: int, agents: DataFrame) -> DataFrame:
        return agents.filter(self.condition).select(*self.columns)


def fired(condition: Column, *columns: str) -> Fired:
    """A ``post_step`` hook that records the agents for which a condition holds, with the tick."""
    return Fired(condition, columns)
