"""Partition a graph file: python -m swarmframe.cli --input g.edgelist --output p.json --method balanced --workers 4"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import graph, partition
from .plans.lineage import cut
from .sources import graph_files, partition_files


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-m", "--method", choices=sorted(partition.METHODS), default="balanced")
    p.add_argument("-w", "--workers", type=int, required=True)
    p.add_argument("-f", "--format", choices=["auto", "pickle", "json", "numpy", "npy", "text"], default="auto")
    p.add_argument("--seed", type=int, default=42)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    agents, links = graph_files.read_graph(spark, a.input)
    agents, edges = cut(agents.select("agent_id")), cut(graph.connect(links))
    found = cut(partition.METHODS[a.method](agents, edges, a.workers, a.seed))
    graph.analyze(edges, found, default=None, workers=a.workers).show(truncate=False)
    partition_files.save(found, a.output, a.format, missing=0)


if __name__ == "__main__":
    main()
