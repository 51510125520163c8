"""Breeds: kinds of agents with typed properties and step functions."""

from __future__ import annotations

import copy
import math
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Property:
    default: object = math.nan
    neighbor_visible: bool = True
    sql_type: str | None = None

    @property
    def type(self) -> str:
        """Declared, or the type of the default: numbers are double unless declared otherwise."""
        if self.sql_type:
            return self.sql_type
        kind, value = "double", self.default
        while isinstance(value, (list, tuple)):
            kind, value = f"array<{kind}>", value[0] if value else 0.0
        return kind


@dataclass
class Step:
    function: Callable
    priority: int
    pandas: PandasStep | None = None


@dataclass
class PandasStep:
    """An imperative step on Arrow batches: what it reads of an agent and its neighbours, and what it writes."""

    reads: list[str]
    neighbor_reads: list[str]
    writes: list[str]
    streamed: bool = False


@dataclass
class Breed:
    name: str
    properties: dict[str, Property] = field(default_factory=dict)
    steps: dict[int, Step] = field(default_factory=dict)
    no_double_buffer: set[str] = field(default_factory=set)
    index: int = -1

    def register_property(self, name: str, default=math.nan, neighbor_visible: bool = True, sql_type: str | None = None) -> None:
        self.properties[name] = Property(copy.copy(default), neighbor_visible, sql_type)

    def set_property_neighbor_visible(self, name: str, visible: bool) -> None:
        self.properties[name].neighbor_visible = visible

    def register_step_func(self, function: Callable, priority: int = 0, no_double_buffer: list[str] | None = None) -> None:
        """One step per priority; lower priorities run first. ``no_double_buffer`` properties are written in place."""
        self.steps[priority] = Step(function, priority)
        self.no_double_buffer |= set(no_double_buffer or ())

    def register_pandas_step(self, function: Callable, reads: list[str], writes: list[str], neighbor_reads: list[str] | None = None, priority: int = 0) -> None:
        """``function(frame, tick)``: a pandas frame with agent_id, the columns read and ``neighbors`` (a list of dicts) to a frame of agent_id and the columns written.

        All neighbours of an agent are in one row, so this is for networks whose largest neighbourhoods fit in a worker's memory; folds and streamed steps have no such bound.
        """
        self.steps[priority] = Step(function, priority, PandasStep(list(reads), list(neighbor_reads or ()), list(writes)))

    def register_streamed_step(self, function: Callable, reads: list[str], writes: list[str], neighbor_reads: list[str], priority: int = 0) -> None:
        """``function(agent, chunks, tick)``: a dict of agent_id and the columns read, an iterator over pandas frames of neighbours (agent_id and the columns read of them, by position, then id), to a dict of the columns written.

        Neighbours are streamed, so a neighbourhood of any size takes a chunk's memory (and one task's time; folds are dealt to many). No neighbours, no chunks.
        """
        self.steps[priority] = Step(function, priority, PandasStep(list(reads), list(neighbor_reads), list(writes), True))
