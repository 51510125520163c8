"""Agents and links from relational tables; generated networks kept as files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPLIER_BASE = 1_000_000_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("agent_id"))
    return n, n.filter("agent_id > 0").select((F.col("agent_id") - 1).alias("src"), F.col("agent_id").alias("dst"))


def trade_network(spark: SparkSession, sf_dir: str, base: int = SUPPLIER_BASE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(customers, suppliers, links): who has ordered from whom."""
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("agent_id"), F.col("c_acctbal").alias("balance"))
    suppliers = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + base).alias("agent_id"), F.col("s_acctbal").alias("balance"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    links = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + base).alias("dst")).distinct()
    return customers, suppliers, links


def cached(spark: SparkSession, folder: str, make, **parameters) -> DataFrame:
    """A generated network, made once per set of parameters and read from parquet afterwards."""
    name = "-".join(f"{k}={json.dumps(v)}" for k, v in sorted(parameters.items())).replace("/", "_")
    path = f"{folder}/{make.__name__}-{name}"
    try:
        return spark.read.parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    make(spark, **parameters).write.parquet(path)
    return spark.read.parquet(path)
