"""Graph files as tables of nodes and links: edge lists by Spark's reader, GraphML and GML by small parsers.

Nodes whose labels are all whole numbers (in GraphML perhaps after an n), and different ones, keep them as ids. If any label is not a
number, or two are the same number (1 and 01), all nodes are numbered from 0, by label.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import numbered

LABELS = "src string, dst string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """src, dst."""
    return read_graph(spark, path)[1]


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(agent_id and label of all nodes, src and dst of all links)."""
    suffix = Path(path).suffix.lower()
    if suffix in (".edgelist", ".edges", ".txt"):
        nodes, links = edge_list(spark, path)
    elif suffix in (".graphml", ".gml"):
        found, pairs = (graphml if suffix == ".graphml" else gml)(path)
        nodes, links = spark.createDataFrame([(x,) for x in found], "label string"), spark.createDataFrame(pairs, LABELS)
    else:
        raise ValueError(f"unknown graph format: {suffix}")
    nodes = nodes.union(links.select("src")).union(links.select("dst")).distinct()
    number = F.regexp_extract("label", r"^n?(\d+)$" if suffix == ".graphml" else r"^(\d+)$", 1)
    ids = nodes.select(number.try_cast("long").alias("agent_id"), "label")
    # a label that is no number, or two that are the same one
    if ids.groupBy("agent_id").agg(F.count(F.lit(1)).alias("n")).filter("agent_id is null or n > 1").head() is not None:
        ids = by_label(nodes)
    out = links.join(ids.select(F.col("label").alias("src"), F.col("agent_id").alias("a")), "src").join(ids.select(F.col("label").alias("dst"), F.col("agent_id").alias("b")), "dst")
    return ids, out.select(F.col("a").alias("src"), F.col("b").alias("dst"))


def by_label(nodes: DataFrame) -> DataFrame:
    """agent_id, label: places in the order of labels."""
    return numbered(nodes, [F.col("label")], "agent_id").select("agent_id", "label")


def edge_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Two labels a line, and what follows is not read; a line of one label is a node; ``#`` begins a comment. Distributed."""
    p = F.split(F.trim(F.regexp_replace("value", "#.*", "")), r"[\s,]+")
    lines = spark.read.text(path).select(p.alias("p")).filter(F.col("p")[0] != "")
    return lines.select(F.col("p")[0].alias("label")), lines.filter(F.size("p") >= 2).select(F.col("p")[0].alias("src"), F.col("p")[1].alias("dst"))


def graphml(path: str) -> tuple[list[str], list[tuple[str, str]]]:
    nodes, links = [], []
    for e in ET.parse(path).iter():
        kind = e.tag.rpartition("}")[2]
        if kind == "node":
            nodes.append(e.attrib["id"])
        elif kind == "edge":
            links.append((e.attrib["source"], e.attrib["target"]))
    return nodes, links


#: A bracket, a quoted text, or a run of anything else.
TOKEN = re.compile(r"[\[\]]|\"([^\"]*)\"|[^\s\[\]\"]+")


def gml(path: str) -> tuple[list[str], list[tuple[str, str]]]:
    """Nodes go by their label where they have one, as in most readers. Blocks inside nodes and edges (``graphics`` and the like) are passed over. The file is read on the driver."""
    names: dict[str, str] = {}
    links, open_blocks, key = [], [], None
    for line in Path(path).read_text().splitlines():
        if line.lstrip().startswith("#"):
            continue
        for t in TOKEN.finditer(line):
            word = t[0]
            if word == "[":
                open_blocks.append((key, {}))
                key = None
            elif word == "]":
                kind, values = open_blocks.pop()
                if kind == "node":
                    names[values["id"]] = values.get("label", values["id"])
                elif kind == "edge":
                    links.append((values["source"], values["target"]))
            elif key is None:
                key = word.lower()
            else:
                if open_blocks:
                    open_blocks[-1][1].setdefault(key, t[1] if t[1] is not None else word)
                key = None
    return list(names.values()), [(names.get(a, a), names.get(b, b)) for a, b in links]
