"""Cutting lineage through reliable storage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a shuffle (compressed; about a million links) that a task of ``cut_by_size`` reads, and partitions that are dealt before they are put together to that.
TASK_BYTES, DEALT = 8 << 20, 200
#: Rows of tables that are few enough for plans made beforehand (one task can hold them all), and rows of such a plan's task.
FEW, SHARE = 1_000_000, 100_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's folder for checkpoints, below the one named by ``spark.checkpoint.dir``; a local session without one (tests) gets a folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ticks"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession) -> str:
    """A new path there."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same cut by a table, which goes with the session's end: for loops, where what the planner has inferred about a checkpoint's rows would double from round to round."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    target = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_by_size(df: DataFrame) -> DataFrame:
    """The same in tasks of a bounded size, however large the table is and whatever ``spark.sql.shuffle.partitions``."""
    dealt = max(DEALT, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    with _with(df.sparkSession, {"adaptive.advisoryPartitionSizeInBytes": str(TASK_BYTES), "adaptive.coalescePartitions.initialPartitionNum": str(dealt)}):
        return cut(df)


def cut_in_place(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Checkpoint rows where they are, so that the planner knows their partitioning later. (An adaptive plan does not tell its own.) Shuffles have ``parts`` partitions, if given."""
    with _with(df.sparkSession, {"adaptive.enabled": "false"} | ({} if parts is None else {"shuffle.partitions": str(parts)})):
        return cut(df)


@contextlib.contextmanager
def fixed_plans(spark: SparkSession, rows: int) -> Iterator[None]:
    """Where tables have few rows, what runs inside is planned beforehand: one job instead of one for each shuffle and broadcast. Larger ones stay adaptive."""
    few = {"adaptive.enabled": "false", "autoBroadcastJoinThreshold": "-1", "shuffle.partitions": str(-(-rows // SHARE) or 1)}
    with _with(spark, few if rows <= FEW else {}):
        yield


@contextlib.contextmanager
def _with(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(f"spark.sql.{k}", None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(f"spark.sql.{k}", v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(f"spark.sql.{k}") if v is None else spark.conf.set(f"spark.sql.{k}", v)
