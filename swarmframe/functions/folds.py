"""Folds over neighbours that users write: a zero, an update with some neighbours' values, a merge and a finish.

Each task folds what it holds of a neighbourhood into a partial state; partial states of an agent meet after one shuffle. So no task holds
a neighbourhood, and states should be small whatever the number of neighbours.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Agents whose partial states a task holds before it sends them on.
HELD = 50_000


@dataclass(frozen=True)
class Fold:
    """``update(state, *arrays)`` takes NumPy arrays of the values of some neighbours; ``merge`` takes two states; ``finish`` gives a value of the SQL type ``kind``."""

    zero: Callable[[], object]
    update: Callable[..., object]
    merge: Callable[[object, object], object]
    finish: Callable[[object], object]
    kind: str = "double"


def geometric_mean() -> Fold:
    """Of positive values."""
    return Fold(lambda: (0.0, 0), lambda s, v: (s[0] + float(np.log(v).sum()), s[1] + len(v)), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: float(np.exp(s[0] / s[1])) if s[1] else None)


def distinct_sketch(k: int = 256) -> Fold:
    """About how many different whole numbers there are, from the k least hashes; exact below k."""
    mask = (1 << 64) - 1

    def least(hashes: np.ndarray) -> np.ndarray:
        return np.unique(hashes)[:k]

    def hashed(v: np.ndarray) -> np.ndarray:
        x = v.astype(np.int64).view(np.uint64).copy()
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))

    return Fold(
        lambda: np.zeros(0, np.uint64), lambda s, v: least(np.concatenate([s, hashed(v)])), lambda a, b: least(np.concatenate([a, b])),
        lambda s: int(len(s) if len(s) < k else (k - 1) * mask // int(s[-1])), "bigint",
    )


def folded(edges: DataFrame, folds: list[tuple[str, Fold]]) -> DataFrame:
    """src and the folds' results by name. edges: src, and for each fold a struct of its values under its name."""
    widths = [len(edges.schema[n].dataType.fields) for n, _ in folds]
    flat = edges.select("src", *[F.col(n)[f.name].alias(f"{n}__{f.name}") for n, _ in folds for f in edges.schema[n].dataType.fields])
    plain = [f for _, f in folds]

    def partial(batches):
        held: dict[int, list] = {}

        def sent():
            rows = [pa.array(list(held), pa.int64()), pa.array([pickle.dumps(s) for s in held.values()], pa.binary())]
            held.clear()
            return pa.RecordBatch.from_arrays(rows, names=["src", "state"])

        for b in batches:
            src = np.asarray(b.column(0))
            order = np.argsort(src, kind="stable")
            src = src[order]
            columns = [c.to_numpy(zero_copy_only=False)[order] for c in b.columns[1:]]
            cuts = np.flatnonzero(np.append(True, src[1:] != src[:-1])) if len(src) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(src)], strict=True):
                states, at = held.setdefault(int(src[lo]), [f.zero() for f in plain]), 0
                for i, (f, w) in enumerate(zip(plain, widths, strict=True)):
                    states[i] = f.update(states[i], *[c[lo:hi] for c in columns[at : at + w]])
                    at += w
            if len(held) >= HELD:
                yield sent()
        yield sent()

    schema = T.StructType().add("src", T.LongType())
    for n, f in folds:
        schema = schema.add(n, T._parse_datatype_string(f.kind))
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def merged(batches):
        src, states, out = None, None, []

        def batch():
            done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * len(kinds), kinds, strict=True)], names=schema.names)
            out.clear()
            return done

        for b in batches:
            for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                new = pickle.loads(x)
                if s == src:
                    states = [f.merge(a, c) for f, a, c in zip(plain, states, new, strict=True)]
                else:
                    if states is not None:
                        out.append((src, *(f.finish(a) for f, a in zip(plain, states, strict=True))))
                    src, states = s, new
            yield batch()
        if states is not None:
            out.append((src, *(f.finish(a) for f, a in zip(plain, states, strict=True))))
        yield batch()

    return flat.mapInArrow(partial, "src bigint, state binary").repartition("src").sortWithinPartitions("src").mapInArrow(merged, schema)
