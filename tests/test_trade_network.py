"""Epidemics on the trade network: every link counts, against a plain simulator."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from swarmframe import queries
from swarmframe.functions import rng
from swarmframe.sources import tables


def plain_sir(spark, sf, ticks):
    """id: (breed, state) after so many ticks on all links; random numbers are the generator's own."""
    lines = {(r.l_orderkey, r.l_suppkey) for r in tables.read(spark, sf, "lineitem").collect()}
    buyer = {r.o_orderkey: r.o_custkey for r in tables.read(spark, sf, "orders").collect()}
    near = {}
    for order, seller in lines:
        a, b = buyer[order], seller + tables.SUPPLIER_BASE
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    state = {r.c_custkey: 2 if r.c_custkey % 100 == 0 else 1 for r in tables.read(spark, sf, "customer").collect()}
    state |= {r.s_suppkey + tables.SUPPLIER_BASE: 1 for r in tables.read(spark, sf, "supplier").collect()}
    ids = spark.createDataFrame([(i,) for i in state], "id bigint")
    for t in range(ticks):
        u = {r.id: r.u for r in ids.select("id", rng.uniform(queries.SEED, t, F.col("id"), 1).alias("u")).collect()}
        old = dict(state)
        for i, s in old.items():
            hit = any(old[j] == 2 for j in near.get(i, ()))
            state[i] = 3 if s == 2 and u[i] < 0.2 else 2 if s == 1 and hit and u[i] < 0.3 else s
    return {i: (int(i >= tables.SUPPLIER_BASE), s) for i, s in state.items()}


def counted(states):
    out = {}
    for x in states:
        out[x] = out.get(x, 0) + 1
    return out


def test_every_trade_link_counts(spark, sf):
    got = {r.agent_id: (r.breed, r.state) for r in queries.QUERIES["sir_trade_network"](spark, sf).collect()}
    assert got == plain_sir(spark, sf, 3)
    got = {r.agent_id: (1, r.state) for r in queries.QUERIES["trade_breed_data"](spark, sf).collect()}
    assert got == {i: x for i, x in plain_sir(spark, sf, 1).items() if x[0]}


def test_entry_counts_every_trade_link(spark, sf):
    assert {(r.breed, r.state): r.n for r in entry.entry(spark).collect()} == counted(plain_sir(spark, sf, 2).values())
