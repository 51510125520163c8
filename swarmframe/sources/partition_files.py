"""Partitions (agent_id to rank) in files: pickle, JSON, npy, text; and parquet for large ones."""

from __future__ import annotations

import json
import pickle
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = {".pkl": "pickle", ".pickle": "pickle", ".json": "json", ".npy": "numpy", ".txt": "text", ".dat": "text"}


def kind_of(path: str, format: str, otherwise: str | None = None) -> str:
    found = SUFFIXES.get(Path(path).suffix.lower(), otherwise) if format == "auto" else {"npy": "numpy"}.get(format, format)
    if found not in set(SUFFIXES.values()):
        raise ValueError(f"unknown partition format of {path}: {format}")
    return found


def load(path: str, format: str = "auto") -> dict[int, int]:
    """A partition file as a dict. In text, ``#`` begins a comment and empty lines are skipped."""
    file = Path(path)
    if not file.exists():
        raise FileNotFoundError(path)
    kind = kind_of(path, format)
    if kind == "pickle":
        found = pickle.loads(file.read_bytes())
    elif kind == "json":
        found = json.loads(file.read_text())
    elif kind == "numpy":
        found = dict(enumerate(np.load(file).tolist()))
    else:
        found = {}
        for number, line in enumerate(file.read_text().splitlines(), 1):
            parts = line.partition("#")[0].split()
            if not parts:
                continue
            if len(parts) != 2:
                raise ValueError(f"{path}, line {number}: two numbers are expected")
            found[parts[0]] = parts[1]
    return {int(k): int(v) for k, v in found.items()}


def read(spark: SparkSession, path: str, format: str = "auto") -> dict[int, int] | DataFrame:
    """A partition of any size: text and parquet by Spark's readers, wherever they lie; the formats of one machine as a dict."""
    kind = "parquet" if format == "parquet" or (format == "auto" and str(path).rstrip("/").endswith(".parquet")) else kind_of(path, format)
    if kind == "parquet":
        return spark.read.parquet(str(path)).select(F.col("agent_id").cast("long").alias("agent_id"), F.col("rank").cast("int").alias("rank"))
    if kind == "text":
        p = F.split(F.trim(F.split("value", "#")[0]), r"\s+")
        lines = spark.read.text(str(path)).select(p.alias("p")).filter(F.array_join("p", "") != "")
        bad = lines.filter(F.size("p") != 2).head()
        if bad:
            raise ValueError(f"{path}: two numbers are expected, not {' '.join(bad[0])}")
        return lines.select(F.col("p")[0].cast("long").alias("agent_id"), F.col("p")[1].cast("int").alias("rank"))
    return load(path, format)


def validate(partition: dict[int, int] | DataFrame, workers: int) -> None:
    """Raise if the partition is empty or has a rank outside 0 .. workers - 1."""
    if isinstance(partition, DataFrame):
        n, low, high = partition.agg(F.count(F.lit(1)), F.min("rank"), F.max("rank")).first()
    else:
        ranks = partition.values()
        n, low, high = len(ranks), min(ranks, default=0), max(ranks, default=0)
    if not n:
        raise ValueError("the partition is empty")
    if low < 0 or high >= workers:
        raise ValueError(f"ranks {low} to {high} do not lie in 0 to {workers - 1}")


def save(partition: dict[int, int] | DataFrame, path: str, format: str = "auto", missing: int = -1) -> None:
    """Write a partition to one file (it is collected; use parquet for large ones). npy has ``missing`` for ids without a rank."""
    if isinstance(partition, DataFrame):
        partition = {r[0]: r[1] for r in partition.select("agent_id", "rank").collect()}
    partition = dict(sorted(partition.items()))
    kind, file = kind_of(path, format, "pickle"), Path(path)
    if kind == "pickle":
        file.write_bytes(pickle.dumps(partition))
    elif kind == "json":
        file.write_text(json.dumps(partition))
    elif kind == "numpy":
        ranks = np.full(max(partition, default=-1) + 1, missing, np.int64)
        for k, v in partition.items():
            ranks[k] = v
        np.save(file, ranks)
    else:
        file.write_text("".join(f"{k} {v}\n" for k, v in partition.items()))


def frame(spark: SparkSession, partition: dict[int, int]) -> DataFrame:
    return spark.createDataFrame(list(partition.items()), "agent_id bigint, rank int")
