"""What a step sees: columns of its agent, folds over its neighbours, globals, random numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.folds import Fold

NEIGHBOR, OWN = "nbr__", "own__"


class Neighbors:
    """Folds over the neighbours of an agent. An expression uses ``ctx.nbr`` (and ``ctx.own`` for the agent's own columns)."""

    def __init__(self, ctx: Context):
        self._ctx = ctx

    def fold(self, aggregate: Column | tuple, default=None) -> Column:
        """Any aggregate expression; ``default`` where an agent has no neighbours."""
        name = self._ctx._add_fold(aggregate)
        return F.col(name) if default is None else F.coalesce(F.col(name), default if isinstance(default, Column) else F.lit(default))

    def custom(self, fold: Fold, *values: Column, default=None) -> Column:
        """A fold of the user's own over the neighbours' values; ``default`` where an agent has no neighbours."""
        return self.fold((fold, values), default)

    def any(self, predicate: Column) -> Column:
        return self.fold(F.max(F.coalesce(predicate, F.lit(False))), False)

    def all(self, predicate: Column) -> Column:
        return self.fold(F.min(F.coalesce(predicate, F.lit(False))), True)

    def count(self, predicate: Column | None = None) -> Column:
        return self.fold(F.count(F.lit(1)) if predicate is None else F.count_if(predicate), 0)

    def sum(self, value: Column) -> Column:
        return self.fold(F.sum(value), 0)

    def max(self, value: Column) -> Column:
        return self.fold(F.max(value))

    def min(self, value: Column) -> Column:
        return self.fold(F.min(value))

    def avg(self, value: Column) -> Column:
        return self.fold(F.avg(value))

    def first(self, value: Column, where: Column | None = None) -> Column:
        """Value of the first neighbour by position (then id), of those that fit ``where``."""
        at = F.struct(F.col("pos"), F.col("dst"))
        return self.fold(F.min_by(value, at if where is None else F.when(where, at)))

    def nth(self, value: Column, n: int) -> Column:
        """Value of the n-th neighbour that exists (from 0), by position, then id. Places are numbered once, so a fold keeps one value however many neighbours there are."""
        self._ctx._model._places = True
        return self.fold(F.max(F.when(F.col("place") == n, value)))


class Context:
    def __init__(self, model, step_key: tuple[int, int], tick: Column, folds: list):
        self._model, self._key, self._folds = model, step_key, folds
        self.tick = tick
        self.neighbors = Neighbors(self)
        self.read_of_neighbors: set[str] = set()
        self.read_of_own: set[str] = set()
        self.messages: dict[str, tuple[Column, Callable[[Column], Column]]] = {}

    def self(self, name: str) -> Column:
        """The agent's own value: of the tick's start, or the current one if the property is written in place."""
        self._model._known(name)
        return F.col(self._model._column(name))

    def nbr(self, name: str) -> Column:
        """A neighbour's value, inside a fold."""
        self._model._known(name)
        self.read_of_neighbors.add(name)
        return F.col(NEIGHBOR + name)

    def own(self, name: str) -> Column:
        """The agent's own value inside a fold or a message, where it meets neighbours' values."""
        self._model._known(name)
        self.read_of_own.add(name)
        return F.col(OWN + name)

    def glob(self, name: str):
        """A global: a double column, or an array of doubles."""
        value = self._model.get_global_property_value(name)
        return F.array(*[F.lit(float(v)) for v in value]) if isinstance(value, list) else F.lit(float(value))

    def bla(self, name: str) -> Column:
        return F.col(self._model._array_column(name))

    @property
    def agent_id(self) -> Column:
        return F.col("agent_id")

    @property
    def breed(self) -> Column:
        return F.col("breed")

    @property
    def num_neighbors(self) -> Column:
        return self.neighbors.count()

    def rand_uniform(self, salt: int = 0) -> Column:
        return rng.uniform(self._model.seed, self.tick, F.col("logical_id"), salt)

    def rand_xorshift(self, salt: int = 0) -> Column:
        return rng.uniform_xorshift(self._model.seed, self.tick, F.col("logical_id"), salt)

    def rand_normal(self, salt: int = 0, mean=0.0, std=1.0) -> Column:
        return rng.normal(self._model.seed, self.tick, F.col("logical_id"), salt, mean, std)

    def rand_normal_bounded(self, low, high, salt: int = 0, mean=0.0, std=1.0) -> Column:
        return rng.normal_bounded(self._model.seed, self.tick, F.col("logical_id"), salt, low, high, mean, std)

    def send(self, name: str, value: Column, combine: Callable[[Column], Column] = F.sum) -> None:
        """Write ``combine`` of the values sent to each neighbour into its property ``name``. ``value`` uses ``ctx.own``; null sends nothing."""
        self._model._known(name)
        self.messages[name] = (value, combine)

    def _add_fold(self, aggregate: Column | tuple) -> str:
        name = f"fold__{len(self._folds)}"
        self._folds.append((self._key, name, aggregate))
        return name


def get_num_neighbors(ctx: Context) -> Column:
    return ctx.neighbors.count()


def get_neighbor(ctx: Context, k: int, name: str = "agent_id") -> Column:
    """A property (the id, unless named) of the k-th neighbour by order of connection; null if there are fewer."""
    return ctx.neighbors.nth(F.col("dst") if name == "agent_id" else ctx.nbr(name), k)
