"""Feeding a simulation from a stream: each micro-batch sets globals and agents' properties, then ticks follow.

With a ledger every batch counts once, whatever fails: the state after a batch is saved under the batch's number, its metadata last, before the stream's own
checkpoint moves on. A batch that comes again finds its state there; a query that is started anew begins with the last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.model import Model

#: States that a ledger keeps: the last one, and the one before in case its successor is being written.
KEPT = 2


class Ledger:
    """States by batch number below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm = path, spark.sparkContext._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def of(self, number: int) -> str:
        return f"{self.path}/batch={number}"

    def numbers(self) -> list[int]:
        """Batches whose states are whole, in order. Spark marks what it has written, and the metadata come last."""
        if not self._fs.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        found = [int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")]
        return sorted(n for n in found if self._fs.exists(self._jvm.org.apache.hadoop.fs.Path(f"{self.of(n)}/meta/_SUCCESS")))

    def keep(self, model: Model, number: int) -> None:
        model.save(self.of(number))
        for n in self.numbers():
            if n <= number - KEPT:
                self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(self.of(n)), True)


def apply(model: Model, batch: DataFrame, name_col: str, value_col: str, order_col: str | None, agent_col: str | None) -> None:
    """Set what a batch says: the latest value of each registered global, and of each property of each agent that it names."""
    order = F.struct(*[c for c in (order_col, value_col) if c])
    agent = F.col(agent_col).cast("long") if agent_col else F.lit(None).cast("long")
    rows = batch.select(agent.alias("agent_id"), F.col(name_col).alias("name"), F.col(value_col).alias("value"), order.alias("at"))
    latest = rows.groupBy("agent_id", "name").agg(F.max_by("value", "at").alias("value"), F.count(F.lit(1)).alias("n")).persist()
    try:
        if order_col is None and (twice := latest.filter("n > 1").head()):
            raise ValueError(f"{twice['n']} values of {twice['name']} in a batch, and no column that orders them")
        if model.globals:
            for r in latest.filter(F.col("agent_id").isNull() & F.col("name").isin(*model.globals)).collect():
                model.set_global_property_value(r["name"], r["value"])
        if agent_col:
            for name in model.properties:
                model.set_property_values(latest.filter(F.col("agent_id").isNotNull() & (F.col("name") == name)).select("agent_id", "value"), name)
    finally:
        latest.unpersist()


def drive(
    model: Model, events: DataFrame, checkpoint: str, ticks_per_batch: int = 1, name_col: str = "name", value_col: str = "value", order_col: str | None = None, agent_col: str | None = None, ledger: str | None = None
) -> StreamingQuery:
    """Run ``ticks_per_batch`` ticks after each micro-batch of (name, value), which sets the latest value of each registered global.

    With ``agent_col``, rows that have an agent there set that agent's property of the name (agents and names that do not exist are passed over). The latest is that of the greatest ``order_col``
    (of ties, the greatest value); without that column a batch must have one value per global, and per agent and property. A batch brings one row per global at most to the driver.

    With ``ledger``, a folder, each batch ticks once even if it is replayed or the driver is started anew: then the model, with its breeds, goes on from the last state there. Without it, ``model.tick`` tells whether
    a batch's ticks were run.
    """
    book = Ledger(events.sparkSession, ledger) if ledger else None
    if book and (known := book.numbers()):
        model.load(book.of(known[-1]))

    def each(batch: DataFrame, number: int) -> None:
        if book and number in (done := book.numbers()):
            if number == done[-1]:
                model.load(book.of(number))
            return
        apply(model, batch, name_col, value_col, order_col, agent_col)
        model.simulate(ticks_per_batch)
        if book:
            book.keep(model, number)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
