"""Spaces: who is whose neighbour. ``src`` reads ``dst``."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from ..operators import graph
from .lineage import cut

EDGES = "src bigint, dst bigint, pos bigint"
#: Single changes that the driver holds.
LOGGED = 100_000


class Space(Protocol):
    def edges(self, spark: SparkSession) -> DataFrame: ...


class NetworkSpace:
    """A graph: a table of links, and a log of single changes since then, of which the last of each link counts (links made, and links of the table that have gone).

    The log is applied in one join, and becomes part of the table when whole tables of links come or go, or when it has grown to ``LOGGED`` changes.
    """

    def __init__(self, ordered: bool = False):
        self.ordered = ordered
        self.version = 0
        self._base: DataFrame | None = None
        self._made: dict[int, dict[int, int]] = {}
        self._gone: set[tuple[int, int]] = set()
        self._logged = self._next = 0
        self._spark: SparkSession | None = None

    def add_agent(self, agent_id: int) -> None:
        """An agent without links has no row."""

    def bulk_add_agents(self, total: int) -> None:
        """Agents 0 to ``total`` - 1 exist. Nothing is allocated for them: an agent without links has no row."""

    def connect_agents(self, a: int, b: int, directed: bool = False) -> None:
        for x, y in ((a, b),) if directed else ((a, b), (b, a)):
            self._made.setdefault(x, {}).setdefault(y, self._next)
            self._next += 1
        self._changed(1)

    def disconnect_agents(self, a: int, b: int, directed: bool = False) -> None:
        for x, y in ((a, b),) if directed else ((a, b), (b, a)):
            self._made.get(x, {}).pop(y, None)
            self._gone.add((x, y))
        self._changed(1)

    def _changed(self, n: int) -> None:
        self.version += 1
        self._logged += n
        spark = SparkSession.getActiveSession() if self._spark is None else self._spark
        if self._logged >= LOGGED and spark is not None:
            self._base = cut(self.edges(spark))
            self._made, self._gone, self._logged = {}, set(), 0

    def _settle(self, spark: SparkSession) -> None:
        """The table with the log applied."""
        self._spark = spark
        if self._logged:
            self._base = self.edges(spark)
        self._made, self._gone, self._logged = {}, set(), 0

    def connect_frame(self, links: DataFrame, directed: bool = False) -> None:
        """Add a table of links (src, dst, and pos if order matters); any size, lazily."""
        self._settle(links.sparkSession)
        edges = graph.connect(links, directed)
        self._base = edges if self._base is None else graph.distinct_edges(self._base.unionByName(edges))
        self.version += 1

    def disconnect_frame(self, links: DataFrame, directed: bool = False) -> None:
        self._settle(links.sparkSession)
        if self._base is not None:
            self._base = graph.disconnect(self._base, links, directed)
        self.version += 1

    def neighbors(self, agent_id: int) -> list[int] | set[int]:
        """Neighbours of one agent: a list in order of connection if ordered, else a set."""
        out = []
        if self._base is not None:
            out = [r[0] for r in self._base.filter(self._base.src == agent_id).orderBy("pos", "dst").select("dst").collect() if (agent_id, r[0]) not in self._gone]
        out = list(dict.fromkeys(out + list(self._made.get(agent_id, ()))))
        return out if self.ordered else set(out)

    get_location = get_neighbors = neighbors

    def edges(self, spark: SparkSession) -> DataFrame:
        """src, dst, pos of all links: the table without those that have gone, and those made since; a link that was there already keeps its place."""
        made = [(s, d, p) for s, n in self._made.items() for d, p in n.items()]
        new = spark.createDataFrame(made, EDGES) if made or self._base is None else None
        if self._base is None:
            return new
        left = graph.disconnect(self._base, spark.createDataFrame(sorted(self._gone), "src bigint, dst bigint"), directed=True) if self._gone else self._base
        return left if new is None else graph.distinct_edges(left.unionByName(new))
