"""The model: catalog of breeds, globals and agents, and the tick loop.

A tick is one plan. All steps read the state at the tick's start; their writes are
merged by priority (the later one wins where it writes, null is no write) and
appear together in the next state. Properties written in place are visible to later
priorities of the same tick. Steps share one join with their neighbours' columns and one
aggregate, unless a later step reads of its neighbours what an earlier one wrote in place.
"""

from __future__ import annotations

import copy
import itertools
import json
import random
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.folds import folded
from ..operators.order import numbered, places_within
from ..streaming.history import Fired
from .breed import Breed
from .context import NEIGHBOR, OWN, Context
from .lineage import cut, cut_by_size, cut_in_place
from .space import NetworkSpace, Space

BASE = ["agent_id", "logical_id", "breed", "rank"]
WRITE, ARRAY, GHOST, EVENT, STREAMED = "write__", "array__", "ghost__", "event__", "streamed__"
#: Edges that a partition may have of one agent beyond twice its share, and edges of a partition where there are more than ``spark.sql.shuffle.partitions`` times as many.
HUB, EDGES = 1000, 1_000_000


class Model:
    def __init__(self, spark: SparkSession, space: Space | None = None, *, verbose_timing: bool = False, checkpoint_every: int = 1, num_partitions: int | None = None, workers: int = 1):
        self.spark, self.space = spark, space or NetworkSpace()
        self.verbose_timing, self.checkpoint_every, self.num_partitions, self.workers = verbose_timing, max(1, checkpoint_every), num_partitions, workers
        self.breeds: list[Breed] = []
        self.seed = random.randrange(1 << 31)
        self.tick = 0
        self.tick_timings: list[float] = []
        self.is_setup = False
        self._globals: dict[str, float | list[float]] = {}
        self._arrays: dict[str, tuple[Breed, tuple[int, ...], bool]] = {}
        self._rows: list[dict] = []
        self._frames: list[DataFrame] = []
        self._sizes: list[int | None] = []
        self._built, self._turns = (0, 0), 0
        self._loaded = self._next = 0
        self._base: DataFrame | None = None
        self._partition: DataFrame | None = None
        self._pending: dict[int, dict[str, object]] = {}
        self._agents: DataFrame | None = None
        self._edges: DataFrame | None = None
        self._layouts: dict[str, tuple[DataFrame, DataFrame | None, DataFrame | None]] = {}
        self._edges_version = None
        self._parts: int | None = None
        self._places = False
        self._settled = False
        self._history: list[tuple[int, DataFrame]] = []
        self._tracked: list[str] = []
        self._events: list[tuple[int, DataFrame]] = []
        self.post_step: Callable[[Breed, int, DataFrame], DataFrame | None] | None = None

    # catalog

    def register_breed(self, breed: Breed) -> None:
        if self.num_agents:
            raise RuntimeError("breeds are registered before agents exist")
        breed.index = len(self.breeds)
        self.breeds.append(breed)

    @property
    def num_agents(self) -> int:
        """Counts tables of agents the first time."""
        self._sizes = [f.count() if n is None else n for n, f in zip(self._sizes, self._frames, strict=True)]
        return self._loaded + len(self._rows) + sum(self._sizes)

    @property
    def properties(self) -> dict[str, object]:
        """Union of the breeds' properties: the last registration's default and type, visible if any breed's is."""
        out: dict[str, object] = {}
        for b in self.breeds:
            for name, p in b.properties.items():
                p = copy.copy(p)
                if name in out:
                    p.neighbor_visible |= out[name].neighbor_visible
                out[name] = p
        return out

    @property
    def in_place(self) -> set[str]:
        return set().union(*(b.no_double_buffer for b in self.breeds))

    def set_property_neighbor_visible(self, name: str, visible: bool) -> None:
        for b in self.breeds:
            if name in b.properties:
                b.properties[name].neighbor_visible = visible

    def register_global_property(self, name: str, value) -> None:
        self._globals[name] = _plain(value)

    def set_global_property_value(self, name: str, value) -> None:
        """Same shape as before, or a number for all elements of a list."""
        old, new = self._globals[name], _plain(value)
        if isinstance(old, list):
            new = new if isinstance(new, list) else [new] * len(old)
            if len(new) != len(old):
                raise ValueError(f"{name} has {len(old)} elements")
        elif isinstance(new, list):
            raise ValueError(f"{name} is a number")
        self._globals[name] = new

    def get_global_property_value(self, name: str):
        return self._globals[name]

    @property
    def globals(self) -> dict:
        return dict(self._globals)

    def register_breed_local_array(self, name: str, breed: Breed, shape: int | tuple[int, ...], neighbor_visible: bool = False) -> int:
        """An array of zeros of this shape for each agent of one breed, other agents have none."""
        self._arrays[name] = (breed, (shape,) if isinstance(shape, int) else tuple(shape), neighbor_visible)
        self._agents, self._base = (None if x is None else self._with_arrays(x) for x in (self._agents, self._base))
        return len(self._arrays) - 1

    def set_seed(self, seed: int) -> None:
        self.seed = int(seed)

    def _known(self, name: str) -> None:
        if name not in self.properties and name not in BASE and name not in self._arrays:
            raise ValueError(f"no property {name}")

    def _array_column(self, name: str) -> str:
        if name not in self._arrays:
            raise ValueError(f"no breed-local array {name}")
        return ARRAY + name

    # population

    def create_agent_of_breed(self, breed: Breed, add_to_space: bool = True, rank: int | None = None, **values) -> int:
        """One agent; properties that are not given are copies of the defaults, unknown names are ignored. Its rank is the given one, that of the partition, or the next in turn."""
        if self._frames:
            raise RuntimeError("single agents without an id come before tables of agents; see create_agent_at_index")
        return self.create_agent_at_index(self._next, breed, add_to_space, rank, **values)

    def create_agent_at_index(self, agent_id: int, breed: Breed, add_to_space: bool = True, rank: int | None = None, **values) -> int:
        """One agent of a given id."""
        if breed not in self.breeds:
            raise ValueError(f"breed {breed.name} is not registered")
        row = {name: copy.copy(values.get(name, breed.properties[name].default if name in breed.properties else p.default)) for name, p in self.properties.items()}
        self._rows.append({"agent_id": agent_id, "logical_id": agent_id, "breed": breed.index, "rank": rank} | row)
        self._next = max(self._next, agent_id + 1)
        if add_to_space and hasattr(self.space, "add_agent"):
            self.space.add_agent(agent_id)
        return agent_id

    create_agent = create_agent_of_breed

    def add_agents(self, df: DataFrame, breed: Breed, id_col: str = "agent_id", rank: Column | None = None, **values: Column) -> None:
        """A table of agents of one breed: ids from a column, properties from columns of the same name or ``values``, defaults for the rest.

        Ranks are those given (null: not given), then those of the partition, then the next in turn by id.
        """
        if breed not in self.breeds:
            raise ValueError(f"breed {breed.name} is not registered")
        ident = F.col(id_col).cast("long")
        rank = F.lit(None) if rank is None else rank
        logical = F.col("logical_id").cast("long") if "logical_id" in df.columns else ident
        columns = [ident.alias("agent_id"), logical.alias("logical_id"), F.lit(breed.index).alias("breed"), rank.cast("int").alias("rank")]
        for name, p in self.properties.items():
            default = breed.properties[name].default if name in breed.properties else p.default
            value = values[name] if name in values else F.col(name) if name in df.columns else _literal(default)
            columns.append(value.cast(p.type).alias(name))
        self._frames.append(df.select(*columns))
        self._sizes.append(None)

    bulk_register_agents = add_agents

    def connect_agents(self, a: int, b: int, directed: bool = False) -> None:
        self.space.connect_agents(a, b, directed)

    def load_partition(self, source, format: str = "auto") -> None:
        """agent_id to rank from a dict, a table (agent_id, rank) or a file; before agents exist."""
        from ..sources import partition_files

        if self._loaded or self._rows or self._frames:
            raise RuntimeError("a partition is loaded before agents exist")
        loaded = source if isinstance(source, (dict, DataFrame)) else partition_files.read(self.spark, source, format)
        partition_files.validate(loaded, self.workers)
        self._partition = partition_files.frame(self.spark, loaded) if isinstance(loaded, dict) else loaded

    def set_agent_logical_id(self, agent_id: int, logical_id: int) -> None:
        self._pending.setdefault(agent_id, {})["logical_id"] = int(logical_id)

    # reading and point writes

    @property
    def agents(self) -> DataFrame:
        """The current state of all agents. Agents that were added since it was last looked at join it; the others keep theirs."""
        if self._agents is None or self._built != (len(self._rows), len(self._frames)):
            self._agents = self._build(self._agents)
        if self._pending:
            self._agents = self._apply_pending(self._agents)
        return self._agents

    @property
    def edges(self) -> DataFrame:
        """src, dst, pos of all links."""
        return self._links().select("src", "dst", "pos") if not self._places else self.space.edges(self.spark).select("src", "dst", "pos")

    def _links(self) -> DataFrame:
        """Edges with what never changes (rank and breed of ``src``, and each neighbour's place, where a tick asks for them), so that no tick has to look it up."""
        version = (getattr(self.space, "version", 0), self._built, self._places)
        if self._edges is None or self._edges_version != version:
            edges = self.space.edges(self.spark).select("src", "dst", "pos")
            if self.workers > 1 or len(self.breeds) > 1:
                fixed = self.agents.select(F.col("agent_id").alias("src"), F.col("rank").alias("src_rank"), F.col("breed").alias("src_breed"))
                edges = edges.join(fixed, "src", "left")
            if self._places:
                there = self.agents.select(F.col("agent_id").alias("dst"))
                edges = edges.join(there, "dst", "left_semi")
                edges = cut_by_size(edges)
                edges = places_within(edges, "src", [F.col("pos"), F.col("dst")], "place", edges.count())
            self._edges, self._edges_version, self._layouts = cut_by_size(edges), version, {}
            self._settled = self._edges.head() is not None
        return self._edges

    def _layout(self, end: str) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """Edges kept where one end hashes to, in order, as agents are by their id, so that a tick's join with that end moves no edge; apart from them those of hubs, and the hubs.

        A hub has more than twice a partition's share of all edges at that end, so there are fewer hubs than half the partitions. Their edges stay as they lie and meet the hubs' broadcast state.
        """
        links = self._links()
        if end not in self._layouts:
            degrees = cut_by_size(links.groupBy(end).agg(F.count(F.lit(1)).alias("n")))
            total = degrees.agg(F.sum("n")).first()[0] or 0
            n = self._parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-total // EDGES))
            hubs = cut(degrees.filter(F.col("n") > 2 * total / n + HUB).select(end))
            if hubs.head() is None:
                self._layouts[end] = (cut_in_place(links.repartition(n, end).sortWithinPartitions(end), n), None, None)
            else:
                light = links.join(F.broadcast(hubs), end, "left_anti")
                self._layouts[end] = (cut_in_place(light.repartition(n, end).sortWithinPartitions(end), n), cut(links.join(F.broadcast(hubs), end, "left_semi")), hubs)
        return self._layouts[end]

    def _meet(self, end: str, side: DataFrame) -> DataFrame:
        """All edges with the columns of ``side`` for one of their ends."""
        light, heavy, hubs = self._layout(end)
        out = light.join(side, end)
        return out if heavy is None else out.unionByName(heavy.join(self._of_hubs(side, hubs, end), end))

    def _meet_also(self, edges: DataFrame, end: str, side: DataFrame) -> DataFrame:
        """The same for edges that lie by their other end: those of hubs stay, the others move."""
        _, _, hubs = self._layout(end)
        if hubs is None:
            return edges.join(side, end)
        few = F.broadcast(hubs)
        return edges.join(few, end, "left_anti").join(side, end).unionByName(edges.join(self._of_hubs(side, hubs, end), end))

    @staticmethod
    def _of_hubs(side: DataFrame, hubs: DataFrame, end: str) -> DataFrame:
        return F.broadcast(side.join(F.broadcast(hubs), end, "left_semi"))

    def _schema(self) -> T.StructType:
        fields = "agent_id bigint, logical_id bigint, breed int, rank int"
        schema = T.StructType.fromDDL(fields)
        for name, p in self.properties.items():
            schema = schema.add(name, T._parse_datatype_string(p.type))
        return schema

    def _build(self, state: DataFrame | None) -> DataFrame:
        """``state`` and the agents that were added to it; all agents if there is none, those that were loaded first."""
        schema, state = self._schema(), self._base if state is None else state
        rows, frames = self._rows[self._built[0] :], self._frames[self._built[1] :]
        if not (rows or frames) and state is not None:
            return state
        if rows or not frames:
            frames = [self.spark.createDataFrame([tuple(_typed(r[f.name], f.dataType) for f in schema) for r in rows], schema), *frames]
        new = frames[0]
        for f in frames[1:]:
            new = new.unionByName(f)
        new = self._ranked(new).select(*[f.name for f in schema])
        new = self._with_arrays(new)
        out = new if state is None else state.unionByName(new.select(*state.columns))
        out = cut(out.repartition(self.num_partitions, "agent_id") if self.num_partitions else out)
        twice = out.groupBy("agent_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("agent_id").head()
        if twice:
            raise ValueError(f"agent {twice[0]} exists twice")
        self._built = (len(self._rows), len(self._frames))
        return out

    def _with_arrays(self, agents: DataFrame) -> DataFrame:
        """Agents with the breed-local arrays that they do not have yet, as zeros."""
        for name, (breed, shape, _) in self._arrays.items():
            if ARRAY + name not in agents.columns:
                zeros, kind = F.lit(0.0), "double"
                for n in reversed(shape):
                    zeros, kind = F.array_repeat(zeros, n), f"array<{kind}>"
                agents = agents.withColumn(ARRAY + name, F.when(F.col("breed") == breed.index, zeros.cast(kind)))
        return agents

    def _ranked(self, agents: DataFrame) -> DataFrame:
        """Ranks as given, else of the partition, else in turn among those that have none, by id."""
        if self._partition is not None:
            given = self._partition.select("agent_id", F.col("rank").cast("int").alias("__rank"))
            agents = agents.join(given, "agent_id", "left").withColumn("rank", F.coalesce("rank", "__rank")).drop("__rank")
        if self.workers == 1:
            return agents.withColumn("rank", F.coalesce("rank", F.lit(0)))
        agents = cut(agents)
        free = agents.filter("rank is null")
        n = free.count()
        if n:
            turn = numbered(free.select("agent_id"), [F.col("agent_id")], "__n")
            turn = turn.select("agent_id", F.pmod(F.col("__n") + self._turns, F.lit(self.workers)).cast("int").alias("__turn"))
            agents = agents.join(turn, "agent_id", "left").withColumn("rank", F.coalesce("rank", "__turn")).drop("__turn")
            self._turns = (self._turns + n) % self.workers
        return agents

    def _apply_pending(self, agents: DataFrame) -> DataFrame:
        pending, self._pending = self._pending, {}
        for name in {n for p in pending.values() for n in p}:
            kind = agents.schema[name].dataType
            rows = [(i, _typed(p[name], kind)) for i, p in pending.items() if name in p]
            new = self.spark.createDataFrame(rows, T.StructType().add("agent_id", T.LongType()).add("__new", kind))
            hit = new.withColumn("__set", F.lit(True))
            agents = agents.join(F.broadcast(hit) if len(rows) <= 100_000 else hit, "agent_id", "left").withColumn(name, F.when(F.col("__set"), F.col("__new")).otherwise(F.col(name))).drop("__new", "__set")
        return cut(agents)

    def get_agent_property_value(self, agent_id: int, name: str):
        if name in ("locations", "neighbors"):
            return self.space.neighbors(agent_id)
        self._known(name)
        row = self.agents.filter(F.col("agent_id") == agent_id).select(name).head()
        return None if row is None else row[0]

    def set_agent_property_value(self, agent_id: int, name: str, value) -> None:
        """Collected, and applied together before the next read or tick."""
        if name not in self.properties:
            raise ValueError(f"no property {name}")
        self._pending.setdefault(agent_id, {})[name] = value

    def set_property_values(self, values: DataFrame, name: str) -> None:
        """Values of one property for many agents: a table of agent_id, value with a row for each. Agents that are not there are passed over, null is no write."""
        if name not in self.properties:
            raise ValueError(f"no property {name}")
        new = values.select(F.col("agent_id").cast("long").alias("agent_id"), F.col("value").cast(self.properties[name].type).alias("__new"))
        if new.head() is not None:
            self._agents = cut(self.agents.join(new, "agent_id", "left").withColumn(name, F.coalesce("__new", name)).drop("__new"))

    def get_agents_with(self, predicate: Column | Callable[[dict], bool]) -> DataFrame:
        """Agents that fit a column, or a Python predicate on a dict of an agent's columns."""
        if isinstance(predicate, Column):
            return self.agents.filter(predicate)

        def run(frames):
            for f in frames:
                yield f[[bool(predicate(r)) for r in f.to_dict("records")]]

        return self.agents.mapInPandas(run, self.agents.schema)

    def get_breed_data(self, breed: Breed, name: str, rank: int | None = None) -> DataFrame:
        self._known(name)
        rows = self.agents.filter(F.col("breed") == breed.index)
        return (rows if rank is None else rows.filter(F.col("rank") == rank)).select("agent_id", name)

    def get_breed_agent_ids(self, breed: Breed, rank: int | None = None) -> DataFrame:
        rows = self.agents.filter(F.col("breed") == breed.index)
        return (rows if rank is None else rows.filter(F.col("rank") == rank)).select("agent_id")

    def get_breed_local_array(self, name: str) -> DataFrame:
        column = self._array_column(name)
        return self.agents.filter(F.col("breed") == self._arrays[name][0].index).select("agent_id", F.col(column).alias("v"))

    # simulation

    def setup(self, skip_priority_barriers: bool | set[int] = False) -> None:
        """Check the steps and build the tables. Barriers between priorities cost nothing here, so skipping them changes nothing."""
        if skip_priority_barriers not in (True, False) and not set(skip_priority_barriers) <= {p for b in self.breeds for p in b.steps}:
            raise ValueError("unknown priorities in skip_priority_barriers")
        self.tick, self.is_setup = 0, True
        _ = self.agents, self.edges

    @staticmethod
    def _append(kept: list[tuple[int, DataFrame]], new: DataFrame) -> None:
        """Tables of a growing series, merged where two hold as many ticks: their number stays logarithmic."""
        n = 1
        while kept and kept[-1][0] == n:
            new, n = cut(kept.pop()[1].unionByName(new)), 2 * n
        kept.append((n, new))

    def track_history(self, *names: str) -> None:
        """Keep these properties as of each tick's start."""
        for n in names:
            self._known(n)
        self._tracked = list(names)

    @property
    def history(self) -> DataFrame:
        """tick, agent_id and the tracked properties."""
        out = self.agents.select(F.lit(0).alias("tick"), "agent_id", *self._tracked).limit(0) if not self._history else self._history[0][1]
        for _, h in self._history[1:]:
            out = out.unionByName(h)
        return out

    @property
    def events(self) -> DataFrame | None:
        """What ``post_step`` has returned in all ticks."""
        out = None
        for _, e in self._events:
            out = e if out is None else out.unionByName(e)
        return out

    def simulate(self, ticks: int, sync_workers_every_n_ticks: int = 1) -> None:
        """Advance. With several workers, agents of other ranks are seen as of the last synchronisation."""
        if not self.is_setup:
            self.setup()
        every = ticks if self.workers == 1 else max(1, sync_workers_every_n_ticks)
        done = 0
        while done < ticks:
            ghosts = self.agents if self.workers > 1 else None
            for _ in range(min(every, ticks - done)):
                began = time.perf_counter()
                self._one_tick(ghosts)
                self.tick_timings.append(time.perf_counter() - began)
                if self.verbose_timing:
                    print(f"tick {self.tick - 1}: {self.tick_timings[-1]:.3f} s")
                done += 1
        self._agents = self._cut(self._agents) if self.checkpoint_every > 1 else self._agents

    def run(self, ticks: int, snapshot_every: int, sink: Callable[[int, DataFrame], None], sync_workers_every_n_ticks: int = 1) -> None:
        """Simulate in batches and hand each batch's last state to ``sink(tick, agents)``."""
        for at in range(0, ticks, snapshot_every):
            self.simulate(min(snapshot_every, ticks - at), sync_workers_every_n_ticks)
            sink(self.tick, self.agents)

    def timing_stats(self) -> dict[str, float]:
        """Least, most, mean and standard deviation of the ticks' seconds, agent-ticks a second, and the load imbalance of the ranks in percent.

        This joins agents with their degrees, so it reads the whole network. Ranks are not processes of their own here, so their load is the agents and edges that a tick reads for them: (most - least) / most.
        """
        t = self.tick_timings
        if not t:
            return {}
        mean = sum(t) / len(t)
        return {"min": min(t), "max": max(t), "mean": mean, "std": (sum((x - mean) ** 2 for x in t) / len(t)) ** 0.5, "agent_ticks_per_s": self.num_agents / mean, "load_imbalance": self._load_imbalance()}

    def _load_imbalance(self) -> float:
        degree = self.edges.groupBy(F.col("src").alias("agent_id")).agg(F.count(F.lit(1)).alias("n"))
        load = self.agents.select("agent_id", "rank").join(degree, "agent_id", "left").groupBy("rank").agg(F.sum(1 + F.coalesce("n", F.lit(0))).alias("load"))
        ranks, least, most = load.agg(F.count(F.lit(1)), F.min("load"), F.max("load")).head()
        return 100.0 * (most - (least if ranks >= self.workers else 0)) / most if most else 0.0

    def reset(self, to_initial: bool = False) -> None:
        """The clock restarts; values stay, or are built anew."""
        self.tick = 0
        if to_initial:
            self._agents, self._history, self._events, self._built, self._turns = None, [], [], (0, 0), 0

    def _plan(self) -> list[list[tuple[Breed, int, Context, dict, list]]]:
        """Steps in order of priority, in stages that share one join with the neighbours."""
        in_place, folds, stages, written = self.in_place, [], [[]], set()
        tick = F.lit(self.tick).cast("long")
        for priority in sorted({p for b in self.breeds for p in b.steps}):
            group = []
            for b in self.breeds:
                if priority not in b.steps:
                    continue
                step, mine = b.steps[priority], []
                ctx = Context(self, (priority, b.index), tick, folds)
                at = len(folds)
                if step.pandas and step.pandas.streamed:
                    ctx.read_of_neighbors |= set(step.pandas.neighbor_reads)
                    ctx.read_of_own |= set(step.pandas.reads)
                    writes = dict.fromkeys(step.pandas.writes)
                elif step.pandas:
                    ctx.read_of_neighbors |= set(step.pandas.neighbor_reads)
                    if step.pandas.neighbor_reads:
                        rows = F.collect_list(F.struct(F.col("dst").alias("agent_id"), *[F.col(NEIGHBOR + n).alias(n) for n in step.pandas.neighbor_reads]))
                        ctx._add_fold(rows)
                    writes = dict.fromkeys(step.pandas.writes)
                else:
                    writes = step.function(ctx) or {}
                for n in writes:
                    if n not in self.properties and n not in self._arrays:
                        raise ValueError(f"no property {n}")
                mine = folds[at:]
                group.append((b, priority, ctx, writes, mine))
            if any((c.read_of_neighbors | c.read_of_own) & written for _, _, c, _, _ in group):
                stages.append([])
                written = set()
            stages[-1] += group
            written |= in_place & {n for _, _, c, w, _ in group for n in [*w, *c.messages]}
        return [s for s in stages if s]

    def _one_tick(self, ghosts: DataFrame | None) -> None:
        state = self.agents
        if self._tracked:
            self._append(self._history, state.select(F.lit(self.tick).alias("tick"), "agent_id", *self._tracked))
        columns, in_place = state.columns, self.in_place
        frame = state
        for stage in self._plan():
            frame = self._gather(frame, stage, ghosts)
            for priority in dict.fromkeys(p for _, p, _, _, _ in stage):
                frame = self._apply([s for s in stage if s[1] == priority], frame, in_place)
            frame = frame.select(*[c for c in frame.columns if not c.startswith(("fold__", "message__", STREAMED))])
        events = [c for c in frame.columns if c.startswith(EVENT)]
        out = frame.select(*[F.coalesce(F.col(WRITE + c), F.col(c)).alias(c) if WRITE + c in frame.columns else F.col(c) for c in columns], *events)
        self.tick += 1
        if events:
            done = self._cut(out)
            fired = done.select(F.explode(F.filter(F.array(*events), lambda e: e.isNotNull())).alias("e")).select("e.*")
            self._append(self._events, cut(fired))
            out = done.select(*columns)
        self._agents = self._cut(out) if self.tick % self.checkpoint_every == 0 and not events else out

    def _cut(self, agents: DataFrame) -> DataFrame:
        """With edges laid out, a fixed plan: the state stays where agent ids hash to, and the only shuffle of a tick is of partial aggregates."""
        return cut_in_place(agents, self._parts) if self._settled else cut(agents)

    def _gather(self, frame: DataFrame, stage: list, ghosts: DataFrame | None) -> DataFrame:
        """Add the stage's folds over neighbours, and messages, to each agent's row: one join and one aggregate."""
        folds = [f for s in stage for f in s[4]]
        wanted = sorted(set().union(*(s[2].read_of_neighbors for s in stage)))
        own = sorted(set().union(*(s[2].read_of_own for s in stage if s[4])))
        if folds:
            edges = self._near(frame, ghosts, wanted, own, {s[0].index for s in stage if s[4]})
            built_in, custom = [f for f in folds if isinstance(f[2], Column)], [f for f in folds if not isinstance(f[2], Column)]
            if built_in:
                found = edges.groupBy("src").agg(*[a.alias(name) for _, name, a in built_in]).withColumnRenamed("src", "agent_id")
                frame = frame.join(found, "agent_id", "left")
            if custom:
                values = [F.struct(*[v.alias(f"v{k}") for k, v in enumerate(columns)]).alias(name) for _, name, (_, columns) in custom]
                found = folded(edges.select("src", *values), [(name, fold) for _, name, (fold, _) in custom])
                frame = frame.join(found.withColumnRenamed("src", "agent_id"), "agent_id", "left")
        for b, priority, _, _, _ in stage:
            if (spec := b.steps[priority].pandas) and spec.streamed:
                frame = frame.join(self._streamed(frame, ghosts, b, priority), "agent_id", "left")
        sends = {priority: [s for s in stage if s[1] == priority and s[2].messages] for priority in dict.fromkeys(s[1] for s in stage)}
        if any(sends.values()):
            frame = frame.join(self._sent(frame, sends), "agent_id", "left")
        return frame

    def _near(self, frame: DataFrame, ghosts: DataFrame | None, wanted: list[str], own: list[str], breeds: set[int]) -> DataFrame:
        """The edges of agents of these breeds with the columns wanted of their neighbours, as their ranks see them, and own ones."""
        needs_rank = ghosts is not None and wanted
        seen = frame.select(F.col("agent_id").alias("dst"), F.col("rank").alias("dst_rank"), *[F.col(self._column(c)).alias(NEIGHBOR + c) for c in wanted])
        if needs_rank:
            old = ghosts.select(F.col("agent_id").alias("dst"), *[F.col(self._column(c)).alias(GHOST + c) for c in wanted])
            seen = seen.join(old, "dst", "left")
        # an agent's own columns meet its edges where these are kept by src; without them the edges stay where their dst is
        if own:
            edges = self._meet_also(self._meet("src", frame.select(F.col("agent_id").alias("src"), *[F.col(self._column(c)).alias(OWN + c) for c in own])), "dst", seen)
        else:
            edges = self._meet("dst", seen)
        if len(breeds) < len(self.breeds):
            edges = edges.filter(F.col("src_breed").isin(*breeds))
        if needs_rank:
            for c in wanted:
                kind = edges.schema[GHOST + c].dataType
                far = F.col(GHOST + c) if self._visible(c) else F.when(F.col(NEIGHBOR + c).isNotNull(), _zero(kind))
                edges = edges.withColumn(NEIGHBOR + c, F.when(F.col("src_rank") == F.col("dst_rank"), F.col(NEIGHBOR + c)).otherwise(far))
        return edges

    def _streamed(self, frame: DataFrame, ghosts: DataFrame | None, b: Breed, priority: int) -> DataFrame:
        """agent_id and what a streamed step writes: each agent's row and then its neighbours', in order, go past its function."""
        step, tick, name = b.steps[priority], self.tick, f"{STREAMED}{priority}__{b.index}__"
        spec, function = step.pandas, step.function
        edges = self._near(frame, ghosts, sorted(spec.neighbor_reads), [], {b.index})
        own = frame.filter(F.col("breed") == b.index).select(F.col("agent_id").alias("src"), F.lit(None).cast("bigint").alias("pos"), F.lit(None).cast("bigint").alias("dst"), *[F.col(self._column(c)).alias(OWN + c) for c in spec.reads])
        rows = own.unionByName(edges.select("src", "pos", "dst", *[NEIGHBOR + c for c in spec.neighbor_reads]), allowMissingColumns=True)
        schema = T.StructType().add("agent_id", T.LongType())
        for n in spec.writes:
            schema = schema.add(name + n, frame.schema[self._column(n)].dataType)

        def run(batches):
            def parts():
                for f in batches:
                    src = f["src"].to_numpy()
                    cuts = [0, *((src[1:] != src[:-1]).nonzero()[0] + 1).tolist(), len(src)] if len(src) else []
                    for lo, hi in itertools.pairwise(cuts):
                        yield int(src[lo]), f.iloc[lo:hi]

            for ident, mine in itertools.groupby(parts(), lambda p: p[0]):
                first = next(mine)[1]
                if not first["dst"].isna().iloc[0]:
                    continue  # edges of no agent of this breed

                def chunks(first=first, mine=mine):
                    for p in itertools.chain([first.iloc[1:]], (p for _, p in mine)):
                        if len(p):
                            yield p[["dst", *[NEIGHBOR + c for c in spec.neighbor_reads]]].rename(columns={"dst": "agent_id"} | {NEIGHBOR + c: c for c in spec.neighbor_reads}).astype({"agent_id": "int64"})

                out = function({"agent_id": ident} | {c: first[OWN + c].iloc[0] for c in spec.reads}, chunks(), tick)
                yield pd.DataFrame({"agent_id": [ident]} | {name + n: [out[n]] for n in spec.writes})

        ordered = rows.repartition("src").sortWithinPartitions("src", F.col("dst").isNotNull(), "pos", "dst")
        return ordered.mapInPandas(run, schema)

    def _sent(self, frame: DataFrame, sends: dict[int, list]) -> DataFrame:
        """agent_id and what is sent to it: one column for each priority and property, over the senders of all breeds. One join and one aggregate."""
        own = sorted(set().union(*(c.read_of_own for group in sends.values() for _, _, c, _, _ in group)))
        breeds = {b.index for group in sends.values() for b, _, _, _, _ in group}
        senders = frame.filter(F.col("breed").isin(*breeds)).select(F.col("agent_id").alias("src"), F.col("breed").alias("sender__"), *[F.col(self._column(c)).alias(OWN + c) for c in own])
        columns = []
        for priority, group in sends.items():
            values: dict[str, list] = {}
            for b, _, ctx, _, _ in group:
                for n, (value, combine) in ctx.messages.items():
                    values.setdefault(n, []).append((b, value, combine))
            for n, parts in values.items():
                if any(c is not parts[0][2] for _, _, c in parts):
                    raise ValueError(f"messages to {n} at priority {priority} are combined in several ways")
                kinds = F.coalesce(*[F.when(F.col("sender__") == b.index, v) for b, v, _ in parts])
                columns.append(parts[0][2](kinds).alias(f"message__{priority}__{n}"))
        return self._meet("src", senders).groupBy("dst").agg(*columns).withColumnRenamed("dst", "agent_id")

    def _apply(self, group: list, frame: DataFrame, in_place: set[str]) -> DataFrame:
        """Writes of one priority: in place, or into the write buffer over earlier priorities' writes."""
        new: dict[str, list[Column]] = {}
        for b, _, ctx, writes, folds in group:
            if (spec := b.steps[ctx._key[0]].pandas):
                frame = frame if spec.streamed else self._apply_pandas(b, ctx, frame, folds)
                writes = {n: F.col((f"{STREAMED}{ctx._key[0]}__" if spec.streamed else "pandas__") + f"{b.index}__{n}") for n in writes}
            for n, value in writes.items():
                value = value if isinstance(value, Column) else _literal(value)
                new.setdefault(n, []).append(F.when(F.col("breed") == b.index, value))
        for n in dict.fromkeys(n for _, _, ctx, _, _ in group for n in ctx.messages):
            new.setdefault(n, []).append(F.col(f"message__{group[0][1]}__{n}"))
        types = {f.name: f.dataType for f in frame.schema}
        changed = {}
        for n, values in new.items():
            column = self._column(n)
            value = F.coalesce(*[v.cast(types[column]) for v in values])
            if n in in_place:
                changed[column] = F.coalesce(value, F.col(column))
            else:
                changed[WRITE + column] = F.coalesce(value, F.col(WRITE + column)) if WRITE + column in frame.columns else value
        out = frame.withColumns(changed) if changed else frame
        if isinstance(self.post_step, Fired):
            # goes through the tick's own checkpoint, as a column
            now = F.struct(*[(F.lit(self.tick) if c == "tick" else F.col(c)).alias(c) for c in self.post_step.columns])
            out = out.withColumns({f"{EVENT}{p}__{b.index}": F.when((F.col("breed") == b.index) & self.post_step.condition, now) for b, p, _, _, _ in group})
        elif self.post_step:
            # the hook and the rest of the tick read what is computed here once
            out = self._cut(out)
            for b, p, _, _, _ in group:
                events = self.post_step(b, p, out.filter(F.col("breed") == b.index).withColumn("tick", F.lit(self.tick)))
                if events is not None:
                    self._append(self._events, cut(events))
        return out.select(*[c for c in out.columns if not c.startswith("pandas__")])

    def _apply_pandas(self, b: Breed, ctx: Context, frame: DataFrame, folds: list) -> DataFrame:
        step = b.steps[ctx._key[0]]
        spec, tick, function = step.pandas, self.tick, step.function
        given = frame.filter(F.col("breed") == b.index).select("agent_id", "logical_id", *spec.reads, *([F.coalesce(folds[0][1], F.array().cast(frame.schema[folds[0][1]].dataType)).alias("neighbors")] if folds else []))
        schema = T.StructType().add("agent_id", T.LongType())
        for n in spec.writes:
            schema = schema.add(f"pandas__{b.index}__{n}", frame.schema[self._column(n)].dataType)

        def run(frames):
            for f in frames:
                out = function(f, tick)
                yield out.rename(columns={n: f"pandas__{b.index}__{n}" for n in spec.writes})[schema.names]

        return frame.join(given.mapInPandas(run, schema), "agent_id", "left")

    def _column(self, name: str) -> str:
        return ARRAY + name if name in self._arrays else name

    def _visible(self, name: str) -> bool:
        if name in BASE:
            return True
        return self._arrays[name][2] if name in self._arrays else self.properties[name].neighbor_visible

    # storage

    def save(self, path: str) -> None:
        """State, edges, history, events, partition and metadata; step functions and hooks are code and are registered again before loading."""
        self.agents.write.mode("overwrite").parquet(f"{path}/agents")
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")
        kept = {"history": self.history if self._history else None, "events": self.events, "partition": self._partition}
        for name, df in kept.items():
            if df is not None:
                df.write.mode("overwrite").parquet(f"{path}/{name}")
        arrays = {n: [b.index, list(shape), visible] for n, (b, shape, visible) in self._arrays.items()}
        meta = {"seed": self.seed, "tick": self.tick, "globals": self._globals, "workers": self.workers, "breeds": [b.name for b in self.breeds]}
        meta |= {"arrays": arrays, "tracked": self._tracked, "turns": self._turns, "timings": self.tick_timings, "tables": [n for n, df in kept.items() if df is not None]}
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    def load(self, path: str) -> None:
        """Put a saved state into a model whose breeds are registered in the same order. It is the initial state from now on; agents that are added later join it."""
        meta = json.loads(self.spark.read.text(f"{path}/meta").head()[0])
        if meta["breeds"] != [b.name for b in self.breeds]:
            raise ValueError(f"saved breeds are {meta['breeds']}")
        self.seed, self.tick, self.workers, self._globals = meta["seed"], meta["tick"], meta["workers"], meta["globals"]
        self._arrays |= {n: (self.breeds[k], tuple(shape), visible) for n, (k, shape, visible) in meta["arrays"].items()}
        self._tracked, self._turns, self.tick_timings = meta["tracked"], meta["turns"], meta["timings"]
        found = {n: cut(self.spark.read.parquet(f"{path}/{n}")) for n in meta["tables"]}
        self._history = [(self.tick, found["history"])] if "history" in found else []
        self._events = [(self.tick, found["events"])] if "events" in found else []
        self._partition = found.get("partition")
        self._agents = self._base = self._with_arrays(cut(self.spark.read.parquet(f"{path}/agents")))
        self._loaded, self._rows, self._frames, self._sizes, self._built, self._pending = self._agents.count(), [], [], [], (0, 0), {}
        last = self._agents.agg(F.max("agent_id")).head()[0]
        self._next = 0 if last is None else last + 1
        space = NetworkSpace()
        space.connect_frame(self.spark.read.parquet(f"{path}/edges"), directed=True)
        self.space, self._edges, self._layouts, self.is_setup = space, None, {}, True


def _plain(value) -> float | list[float]:
    if hasattr(value, "tolist"):
        value = value.tolist()
    return [float(v) for v in value] if isinstance(value, (list, tuple)) else float(value)


def _literal(value) -> Column:
    if isinstance(value, (list, tuple)):
        return F.array(*[_literal(v) for v in value])
    return F.lit(float(value) if isinstance(value, (int, float)) else value)


def _zero(kind: T.DataType) -> Column:
    return F.array().cast(kind) if isinstance(kind, T.ArrayType) else F.lit(0).cast(kind)


def _typed(value, kind: T.DataType):
    if isinstance(kind, T.ArrayType):
        return [_typed(v, kind.elementType) for v in value]
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return None if value is None else int(value)
    return float(value) if isinstance(kind, T.DoubleType) else value

