"""What the training-data operators share: table access, lineage cuts, words."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII blanks. The same class is what ``bytes.split()`` takes.
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def integer_ids(docs: DataFrame, column: str = "doc_id") -> None:
    """Refuse a table whose ids are not whole numbers, before anything runs."""
    kind = docs.schema[column].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint", "void"):
        raise TypeError(f"{column} is {kind}; this operator orders documents by an integer id")


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's folder for checkpoints: below the one that the cluster names in ``spark.checkpoint.dir``."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same cut by a table in the checkpoint folder: later plans know its size and read only the columns they use, and what was
    inferred about the rows does not pile up in them, as it does in loops over checkpoints. The table goes with the session's end, or by ``discard``."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` has written and that nothing reads any more."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            target = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a session on one machine may make its own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")
    return named or tempfile.mkdtemp(prefix="ckpt")


def word_count(text: Column) -> Column:
    """Words of a text as a long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def rekeyed(df: DataFrame, key: str) -> DataFrame:
    """The same rows, with a key whose partitioning the planner does not know.

    A join with an aggregate on its own key would reuse the aggregate's partitions, and then adaptive
    execution cannot split the other side's hot keys. One more exchange of the aggregate lets it.
    """
    kind = df.schema[key].dataType.simpleString()
    same = F.col(key).bitwiseXOR(F.lit(0).cast(kind)) if kind in ("bigint", "int") else F.unhex(F.hex(key)).cast(kind)
    return df.withColumn(key, same)
