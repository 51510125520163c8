"""Queries over the engine's operators, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays, folds, math, rng
from .operators import graph, partition, population
from .operators.communities import louvain, modularity
from .operators.multilevel import multilevel
from .plans.breed import Breed
from .plans.context import get_neighbor, get_num_neighbors
from .plans.lineage import cut, scratch
from .plans.model import Model
from .plans.space import NetworkSpace
from .sources import generators, tables
from .streaming import history

SEED = 42


def sir(ctx):
    """Infected neighbours infect with p_infection; the infected recover with p_recovery."""
    u = ctx.rand_uniform(salt=1)
    hit = ctx.neighbors.any(ctx.nbr("state") == 2)
    s = ctx.self("state")
    return {"state": F.when((s == 2) & (u < ctx.glob("p_recovery")), 3).when((s == 1) & hit & (u < ctx.glob("p_infection")), 2)}


def model_of(spark: SparkSession, agents: DataFrame, links: DataFrame | None = None, steps=(), properties=None, seed: int = SEED, workers: int = 1, rank=None, directed: bool = False, **values) -> Model:
    """A model of one breed over a table of agents. steps: (function, priority, properties written in place)."""
    space = NetworkSpace()
    model = Model(spark, space, workers=workers)
    breed = Breed("agent")
    for name, (default, kind) in (properties or {"state": (1, "bigint")}).items():
        breed.register_property(name, default, sql_type=kind)
    for function, priority, in_place in steps:
        breed.register_step_func(function, priority, in_place)
    model.register_breed(breed)
    model.set_seed(seed)
    model.add_agents(agents, breed, rank=rank, **values)
    if links is not None:
        space.connect_frame(links, directed)
    else:
        space.connect_frame(spark.createDataFrame([], "src bigint, dst bigint"))
    return model


def customers(spark, sf_dir):
    return tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("agent_id"), "c_acctbal", "c_nationkey", "c_mktsegment")


def cents(c):
    return F.round(F.col(c) * 100).cast("bigint")


def customer_ring(spark, sf_dir, k=4):
    """Customers linked to the next k // 2 by id."""
    c = customers(spark, sf_dir).select("agent_id")
    n = c.count()
    return c.select(F.col("agent_id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(k // 2))).alias("d")).select("src", ((F.col("src") + F.col("d")) % n).alias("dst"))


# simulations


def sir_chain(spark, sf_dir, p_infection, p_recovery, seed, ticks, workers=1, every=1):
    agents, links = tables.nation_chain(spark, sf_dir)
    m = model_of(spark, agents, links, [(sir, 0, None)], seed=seed, workers=workers, state=F.when(F.col("agent_id") == 0, 2).otherwise(1), rank=F.floor(F.col("agent_id") / 7) if workers > 1 else None)
    m.register_global_property("p_infection", p_infection)
    m.register_global_property("p_recovery", p_recovery)
    m.simulate(ticks, every)
    return m.agents.select("agent_id", "state")


def sir_chain_wave(spark, sf_dir):
    return sir_chain(spark, sf_dir, 1.0, 1.0, SEED, 5)


def sir_chain_philox(spark, sf_dir):
    return sir_chain(spark, sf_dir, 0.8, 0.3, 999, 5)


def stale_ghost_sync2(spark, sf_dir):
    return sir_chain(spark, sf_dir, 1.0, 1.0, SEED, 4, workers=4, every=2)


def trade_model(spark, sf_dir, p_infection=0.3, ticks=3, network=None):
    buyers, sellers, links = network or tables.trade_network(spark, sf_dir)
    space = NetworkSpace()
    m = Model(spark, space)
    breeds = [Breed("customer"), Breed("supplier")]
    for b in breeds:
        b.register_property("state", 1, sql_type="bigint")
        b.register_step_func(sir)
        m.register_breed(b)
    m.set_seed(SEED)
    m.register_global_property("p_infection", p_infection)
    m.register_global_property("p_recovery", 0.2)
    m.add_agents(buyers, breeds[0], state=F.when(F.col("agent_id") % 100 == 0, 2).otherwise(1))
    m.add_agents(sellers, breeds[1], state=F.lit(1))
    space.connect_frame(links)
    m.simulate(ticks)
    return m, breeds


def sir_trade_network(spark, sf_dir):
    """SIR on all trade links; the three queries after the next two run a slower epidemic on them."""
    m, _ = trade_model(spark, sf_dir)
    return m.agents.select("agent_id", "breed", "state")


def trade_histogram(spark, sf_dir):
    m, _ = trade_model(spark, sf_dir, ticks=2)
    return m.agents.groupBy("breed", "state").agg(F.count(F.lit(1)).alias("n"))


def trade_breed_data(spark, sf_dir):
    m, breeds = trade_model(spark, sf_dir, ticks=1)
    return m.get_breed_data(breeds[1], "state")


SLOW = 0.05


def sir_two_breed_bipartite(spark, sf_dir):
    m, _ = trade_model(spark, sf_dir, SLOW)
    return m.agents.select("agent_id", "breed", "state")


def state_histogram(spark, sf_dir):
    m, _ = trade_model(spark, sf_dir, SLOW, ticks=2)
    return m.agents.groupBy("breed", "state").agg(F.count(F.lit(1)).alias("n"))


def breed_data(spark, sf_dir):
    m, breeds = trade_model(spark, sf_dir, SLOW, ticks=1)
    return m.get_breed_data(breeds[1], "state")


def sir_vector_safety(spark, sf_dir):
    """Infection scaled by the mean product of two agents' vectors (the double sum separates into totals)."""
    v = tables.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("agent_id"), F.transform("embedding", lambda x: F.round(F.abs(x.cast("double")) * 1000)).alias("measures"))
    size = F.size("measures").cast("double")
    agents = v.select("agent_id", arrays.total(F.col("measures")).alias("total"), size.alias("size"))
    n = agents.count()
    links = agents.select(F.col("agent_id").alias("src"), ((F.col("agent_id") + 1) % n).alias("dst"))

    def step(ctx):
        product = arrays.mean_of_products(ctx.own("total"), ctx.nbr("total"), ctx.own("size"))
        return {"safety": ctx.neighbors.max(product)}

    m = model_of(spark, agents, links, [(step, 0, None)], {"total": (0.0, "double"), "size": (0.0, "double"), "safety": (0.0, "double")})
    m.simulate(1)
    return m.agents.select("agent_id", F.round("safety", 3).alias("safety"))


def hierarchy_links(spark, sf_dir):
    """Region over nation over customer: ids 0.., 100.., 1000.."""
    n = tables.read(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey").cast("long") + 100).alias("dst"))
    c = customers(spark, sf_dir).select((F.col("c_nationkey").cast("long") + 100).alias("src"), (F.col("agent_id") + 1000).alias("dst"))
    return n.union(c)


def hierarchy_run(spark, sf_dir, steps, ticks):
    links = hierarchy_links(spark, sf_dir)
    agents = links.select(F.col("src").alias("agent_id")).union(links.select("dst")).distinct()
    m = model_of(spark, agents, links, steps, {"state": (1, "bigint"), "dummy": (0, "bigint")}, state=F.when(F.col("agent_id") == 0, 2).otherwise(1))
    m.simulate(ticks)
    return m.agents.select("agent_id", "state", "dummy")


def infect(ctx):
    return {"state": F.when((ctx.self("state") == 1) & ctx.neighbors.any(ctx.nbr("state") == 2), 2)}


def recover(ctx):
    return {"state": F.when(ctx.self("state") == 2, 3), "dummy": ctx.self("dummy") + 1}


def hierarchy_si_one_hop(spark, sf_dir):
    return hierarchy_run(spark, sf_dir, [(infect, 0, None)], 1)


def hierarchy_sir_two_hop(spark, sf_dir):
    return hierarchy_run(spark, sf_dir, [(infect, 0, None), (recover, 1, None)], 2)


def buffers(spark, sf_dir, steps, ticks=1):
    agents = customers(spark, sf_dir).select("agent_id")
    m = model_of(spark, agents, None, steps, {"counter": (0, "bigint"), "result": (0, "bigint")})
    m.simulate(ticks)
    return m.agents.select("agent_id", "counter", "result")


def writer(ctx):
    return {"counter": F.lit(10)}


def reader(ctx):
    return {"result": ctx.self("counter") * 2}


def priority_buffered(spark, sf_dir):
    return buffers(spark, sf_dir, [(writer, 0, None), (reader, 1, None)])


def priority_in_place(spark, sf_dir):
    return buffers(spark, sf_dir, [(writer, 0, ["counter"]), (reader, 1, None)])


def priority_last_writer(spark, sf_dir):
    some = lambda ctx: {"counter": F.when(ctx.agent_id % 3 == 0, 20)}
    return buffers(spark, sf_dir, [(writer, 0, None), (some, 1, None)])


def augassign_snapshot(spark, sf_dir):
    """Two priorities each add to the tick-start value: only the later one's sum stays."""
    return buffers(spark, sf_dir, [(lambda ctx: {"counter": ctx.self("counter") + 1}, 0, None), (lambda ctx: {"counter": ctx.self("counter") + 5}, 1, None)], 3)


def in_place_neighbor_read(spark, sf_dir):
    """A later priority folds over what its neighbours wrote in place in the same tick."""
    agents = customers(spark, sf_dir).select("agent_id")
    write = lambda ctx: {"counter": ctx.agent_id % 7}
    read = lambda ctx: {"result": ctx.neighbors.sum(ctx.nbr("counter"))}
    m = model_of(spark, agents, customer_ring(spark, sf_dir), [(write, 0, ["counter"]), (read, 1, None)], {"counter": (0, "bigint"), "result": (0, "bigint")})
    m.simulate(1)
    return m.agents.select("agent_id", "counter", "result")


def wave_with_history(spark, sf_dir, ticks):
    agents, links = tables.nation_chain(spark, sf_dir)

    def step(ctx):
        hit = ctx.neighbors.any(ctx.nbr("state") == 2)
        return {"state": F.when(ctx.self("state") == 2, 3).when((ctx.self("state") == 1) & hit, 2), "buffer": history.record(ctx, "buffer", "state")}

    m = model_of(spark, agents, links, [(step, 0, None)], {"state": (1, "bigint"), "buffer": ([0.0] * 3, "array<double>")}, state=F.when(F.col("agent_id") == 0, 2).otherwise(1))
    m.track_history("state")
    m.simulate(ticks)
    return m


def history_circular_buffer(spark, sf_dir):
    m = wave_with_history(spark, sf_dir, 4)
    return m.agents.select("agent_id", "state", *[F.col("buffer")[i].cast("bigint").alias(f"slot_{i}") for i in range(3)])


def history_pivot(spark, sf_dir):
    return history.wide(wave_with_history(spark, sf_dir, 4).history, "state", 4)


def event_recording(spark, sf_dir):
    """tick and agent of each infection, recorded where it happens."""
    agents, links = tables.nation_chain(spark, sf_dir)
    step = lambda ctx: {"state": F.when((ctx.self("state") == 1) & ctx.neighbors.any(ctx.nbr("state") == 2), 2)}
    m = model_of(spark, agents, links, [(step, 0, None)], state=F.when(F.col("agent_id") == 0, 2).otherwise(1))
    m.post_step = history.fired(F.col("write__state") == 2)
    m.simulate(4)
    return m.events.select(F.col("tick").cast("bigint").alias("tick"), "agent_id")


def set_property(spark, sf_dir):
    agents, links = tables.nation_chain(spark, sf_dir)
    m = model_of(spark, agents, links, [(infect, 0, None)])
    m.set_agent_property_value(3, "state", 2)
    m.set_agent_property_value(20, "state", 2)
    m.simulate(2)
    return m.agents.select("agent_id", "state")


def agents_with(spark, sf_dir):
    m = model_of(spark, customers(spark, sf_dir).withColumn("state", F.col("agent_id") % 5), None)
    return m.get_agents_with(F.col("state") == 3).select("agent_id", "state")


def breed_local_array(spark, sf_dir):
    """Each agent counts infected neighbours per tick in an array of its own."""
    m = model_of(spark, *tables.nation_chain(spark, sf_dir), state=F.when(F.col("agent_id") == 0, 2).otherwise(1))
    breed = m.breeds[0]
    m.register_breed_local_array("seen", breed, 3)

    def step(ctx):
        n = ctx.neighbors.count(ctx.nbr("state") == 2)
        return {"state": F.when((ctx.self("state") == 1) & (n > 0), 2), "seen": arrays.set_at(ctx.bla("seen"), ctx.tick.cast("int"), n.cast("double"))}

    breed.register_step_func(step)
    m.simulate(3)
    return m.get_breed_local_array("seen").select("agent_id", *[F.col("v")[i].cast("bigint").alias(f"v_{i}") for i in range(3)])


def invisible_property_zero(spark, sf_dir):
    """A property that is not visible across ranks reads as 0 there."""
    agents = customers(spark, sf_dir).select("agent_id")
    step = lambda ctx: {"result": ctx.neighbors.sum(ctx.nbr("secret"))}
    m = model_of(spark, agents, customer_ring(spark, sf_dir), [(step, 0, None)], {"secret": (0, "bigint"), "result": (0, "bigint")}, workers=4, rank=F.pmod(F.col("agent_id"), F.lit(4)), secret=F.col("agent_id") % 10 + 1)
    m.set_property_neighbor_visible("secret", False)
    m.simulate(1)
    return m.agents.select("agent_id", "result")


def visible_in_one_breed(spark, sf_dir):
    """A property that one breed hides and another shows is seen across ranks."""
    m = Model(spark, NetworkSpace(), workers=4)
    breeds = [Breed("even"), Breed("odd")]
    for k, b in enumerate(breeds):
        b.register_property("secret", 0, neighbor_visible=bool(k), sql_type="bigint")
        b.register_property("result", 0, sql_type="bigint")
        b.register_step_func(lambda ctx: {"result": ctx.neighbors.sum(ctx.nbr("secret"))})
        m.register_breed(b)
    for k, b in enumerate(breeds):
        m.add_agents(customers(spark, sf_dir).select("agent_id").filter(F.col("agent_id") % 2 == k), b, rank=F.pmod(F.col("agent_id"), F.lit(4)), secret=F.col("agent_id") % 10 + 1)
    m.space.connect_frame(customer_ring(spark, sf_dir))
    m.simulate(1)
    return m.agents.select("agent_id", "result")


def periodic_snapshots(spark, sf_dir):
    """States written after every second tick of four."""
    path = scratch(spark)
    agents, links = tables.nation_chain(spark, sf_dir)
    m = model_of(spark, agents, links, [(infect, 0, None)], state=F.when(F.col("agent_id") == 0, 2).otherwise(1))
    m.run(4, 2, history.parquet_sink(path, "state"))
    return spark.read.parquet(path).select(F.col("tick").cast("int").alias("tick"), "agent_id", "state")


def single_links(spark, sf_dir):
    """A table of links, then single ones that come and go, the last change of each counting: customers with every third nation's number leave the ring, and are linked with the first customer."""
    few = [r[0] for r in tables.nation_chain(spark, sf_dir)[0].filter("agent_id % 3 = 0").collect()]
    n, space = customers(spark, sf_dir).count(), NetworkSpace()
    space.connect_frame(customer_ring(spark, sf_dir))
    for i in few:
        for d in (-2, -1, 1, 2):
            space.disconnect_agents(i, (i + d) % n)
        if i:
            space.connect_agents(i, 0)
    return space.edges(spark).select("src", "dst")


def message_send_sum(spark, sf_dir):
    """Agents send a third of their points to each neighbour, which adds up what it gets."""
    agents = customers(spark, sf_dir).select("agent_id")

    def step(ctx):
        ctx.send("inbox", ctx.own("points"), F.sum)
        return {}

    m = model_of(spark, agents, customer_ring(spark, sf_dir), [(step, 0, None)], {"points": (0, "bigint"), "inbox": (0, "bigint")}, points=F.col("agent_id") % 11)
    m.simulate(1)
    return m.agents.select("agent_id", "inbox")


def parity_model(spark, sf_dir, links, priorities):
    """Customers of even and of odd id as two breeds, whose agents send their points and ten times these to whom they are linked with."""
    m = Model(spark, NetworkSpace())
    breeds = [Breed("even"), Breed("odd")]
    for k, (b, priority) in enumerate(zip(breeds, priorities, strict=True)):
        b.register_property("points", 0, sql_type="bigint")
        b.register_property("inbox", 0, sql_type="bigint")
        b.register_step_func(lambda ctx, k=k: ctx.send("inbox", ctx.own("points") * (10 if k else 1), F.sum), priority)
        m.register_breed(b)
    for k, b in enumerate(breeds):
        m.add_agents(customers(spark, sf_dir).select("agent_id").filter(F.col("agent_id") % 2 == k), b, points=F.col("agent_id") % 11)
    m.space.connect_frame(links, directed=True)
    m.simulate(1)
    return m.agents.select("agent_id", "inbox")


def messages_two_breeds(spark, sf_dir):
    """Two breeds send to one property at one priority: what comes from both adds up."""
    return parity_model(spark, sf_dir, graph.connect(customer_ring(spark, sf_dir)), (0, 0))


def messages_by_priority(spark, sf_dir):
    """The odd ones send later: their sum replaces that of the even ones where any of them sends."""
    c = customers(spark, sf_dir).select("agent_id")
    n = c.count()
    far = lambda a, b: c.select(F.col("agent_id").alias("src"), ((F.col("agent_id") * a + b) % n).alias("dst"))
    return parity_model(spark, sf_dir, far(7, 3).union(far(5, 1)), (0, 1))


def pandas_step_without_neighbors(spark, sf_dir):
    """An imperative step that counts its neighbours: none is an empty list."""
    links = customer_ring(spark, sf_dir).filter("src % 3 = 0 and dst % 2 = 0")
    m = model_of(spark, customers(spark, sf_dir).select("agent_id"), links, [], {"points": (0, "bigint"), "n": (-1, "bigint")}, directed=True)
    m.breeds[0].register_pandas_step(lambda frame, tick: frame.assign(n=[len(x) for x in frame["neighbors"]])[["agent_id", "n"]], ["points"], ["n"], ["points"])
    m.simulate(1)
    return m.agents.select("agent_id", "n")


def pandas_step(spark, sf_dir):
    """An imperative step: the median of the neighbours' points."""
    agents = customers(spark, sf_dir).select("agent_id")
    m = model_of(spark, agents, customer_ring(spark, sf_dir), [], {"points": (0, "bigint"), "middle": (0.0, "double")}, points=F.col("agent_id") % 11)

    def median(frame, tick):
        frame["middle"] = [float(sorted(x["points"] for x in n)[len(n) // 2]) for n in frame["neighbors"]]
        return frame[["agent_id", "middle"]]

    m.breeds[0].register_pandas_step(median, ["points"], ["middle"], ["points"])
    m.simulate(1)
    return m.agents.select("agent_id", F.col("middle").cast("bigint").alias("middle"))


def custom_folds(spark, sf_dir):
    """Folds that a user writes: the geometric mean of the neighbours' points, and a sketch of how many kinds there are (exact for a few)."""
    def step(ctx):
        return {"middle": ctx.neighbors.custom(folds.geometric_mean(), ctx.nbr("points") + 1), "kinds": ctx.neighbors.custom(folds.distinct_sketch(), ctx.nbr("points") % 3, default=0)}

    agents = customers(spark, sf_dir).select("agent_id")
    m = model_of(spark, agents, customer_ring(spark, sf_dir), [(step, 0, None)], {"points": (0, "bigint"), "middle": (0.0, "double"), "kinds": (0, "bigint")}, points=F.col("agent_id") % 11)
    m.simulate(1)
    return m.agents.select("agent_id", F.round("middle", 6).alias("middle"), "kinds")


def neighbor_folds(spark, sf_dir):
    """All folds over the suppliers of each customer, in one aggregate."""
    buyers, sellers, links = tables.trade_network(spark, sf_dir)
    names = ["n", "total", "most", "least", "rich", "first_one", "second_one", "poor"]

    def step(ctx):
        b, nb = ctx.nbr("points"), ctx.neighbors
        return {"n": nb.count(), "total": nb.sum(b), "most": nb.max(b), "least": nb.min(b), "rich": nb.any(b > 500000).cast("bigint"), "first_one": nb.first(b), "second_one": nb.nth(b, 1), "poor": nb.count(b < 0)}

    space = NetworkSpace()
    m = Model(spark, space)
    customer, supplier = Breed("customer"), Breed("supplier")
    for b in (customer, supplier):
        for n in ["points", *names]:
            b.register_property(n, 0, sql_type="bigint")
        m.register_breed(b)
    customer.register_step_func(step)
    m.add_agents(buyers, customer, points=cents("balance"))
    m.add_agents(sellers, supplier, points=cents("balance"))
    space.connect_frame(links)
    m.simulate(1)
    return m.agents.filter("breed = 0").select("agent_id", *names)


def third_neighbor(spark, sf_dir):
    """The id of each agent's third neighbour and the number of its neighbours, read inside a step."""
    agents = customers(spark, sf_dir).select("agent_id")
    step = lambda ctx: {"third": get_neighbor(ctx, 2), "n": get_num_neighbors(ctx)}
    m = model_of(spark, agents, customer_ring(spark, sf_dir), [(step, 0, None)], {"third": (0, "bigint"), "n": (0, "bigint")})
    m.simulate(1)
    return m.agents.select("agent_id", "third", "n")


def history_last_values(spark, sf_dir):
    h = history.last_values(wave_with_history(spark, sf_dir, 4).history, "state", 2)
    return history.previous(h, "state").select("tick", "agent_id", F.array_join("last_state", ",").alias("last_two"), "previous_state")


def breed_ranges(spark, sf_dir):
    a = customers(spark, sf_dir).select("agent_id", F.col("c_nationkey").alias("breed"))
    return population.breed_ranges(population.sorted_by_breed(a))


def rank_counts(spark, sf_dir):
    a = customers(spark, sf_dir).select(F.col("c_nationkey").alias("breed"), F.pmod(F.col("agent_id"), F.lit(4)).cast("int").alias("rank"))
    return population.counts(a, "rank", "breed")


def widest_arrays(spark, sf_dir):
    return population.widest(tables.read(spark, sf_dir, "embeddings"), "embedding")


def community_packing(spark, sf_dir):
    """Nations as communities, packed by size onto three ranks: agents of each."""
    packed = partition.pack(customers(spark, sf_dir).select("agent_id", F.col("c_nationkey").cast("long").alias("community")), 3)
    return packed.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


def partition_precedence(spark, sf_dir):
    """Ranks of a table of agents: given for some, of a partition for some, in turn for the rest."""
    agents = customers(spark, sf_dir).select("agent_id")
    m, breed = Model(spark, workers=4), Breed("agent")
    breed.register_property("state", 0, sql_type="bigint")
    m.register_breed(breed)
    m.load_partition(agents.filter("agent_id % 5 = 1").select("agent_id", F.lit(2).alias("rank")))
    m.create_agent_of_breed(breed)
    m.create_agent_of_breed(breed, rank=3)
    m.add_agents(agents.filter("agent_id > 1"), breed, rank=F.when(F.col("agent_id") % 3 == 0, F.col("agent_id") % 2))
    return m.agents.select("agent_id", "rank")


def partition_from_dict(spark, sf_dir):
    """Ranks of nations given as a dict; nations without one take turns."""
    agents, _ = tables.nation_chain(spark, sf_dir)
    m, breed = Model(spark, workers=3), Breed("agent")
    m.register_breed(breed)
    m.load_partition({r[0]: r[0] // 2 % 3 for r in agents.filter("agent_id % 4 < 2").collect()})
    m.add_agents(agents, breed)
    return m.agents.select("agent_id", "rank")


def partition_from_file(spark, sf_dir):
    """Ranks of a partition kept as text, read in a distributed way."""
    agents, path = customers(spark, sf_dir).select("agent_id"), scratch(spark)
    agents.select(F.concat_ws(" ", "agent_id", F.floor(F.col("agent_id") / 7) % 4).alias("value")).write.text(path)
    m, breed = Model(spark, workers=4), Breed("agent")
    m.register_breed(breed)
    m.load_partition(path, "text")
    m.add_agents(agents, breed)
    return m.agents.select("agent_id", "rank")


def count_up(ctx):
    return {"counter": ctx.self("counter") + 1, "result": ctx.tick}


def agents_added_later(spark, sf_dir):
    """Customers count two ticks, then suppliers join, and all count one more."""
    m = model_of(spark, customers(spark, sf_dir).select("agent_id"), None, [(count_up, 0, None)], {"counter": (0, "bigint"), "result": (0, "bigint")})
    m.simulate(2)
    m.add_agents(tables.read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + tables.SUPPLIER_BASE).alias("agent_id")), m.breeds[0])
    m.simulate(1)
    return m.agents.select("agent_id", "counter", "result")


def clock_reset(spark, sf_dir):
    """Three ticks, the clock restarts, two more: values stay, ticks count from 0."""
    m = model_of(spark, customers(spark, sf_dir).select("agent_id"), None, [(count_up, 0, None)], {"counter": (0, "bigint"), "result": (0, "bigint")})
    m.simulate(3)
    m.reset()
    m.simulate(2)
    return m.agents.select("agent_id", "counter", "result")


def saved_and_loaded(spark, sf_dir):
    """One tick, saved, loaded into another model, one more tick."""
    path = scratch(spark)
    agents, links = tables.nation_chain(spark, sf_dir)
    m = model_of(spark, agents, links, [(infect, 0, None)], state=F.when(F.col("agent_id") == 0, 2).otherwise(1))
    m.simulate(1)
    m.save(path)
    other = Model(spark)
    other.register_breed(m.breeds[0])
    other.load(path)
    other.simulate(1)
    return other.agents.select("agent_id", "state")


def reset_after_load(spark, sf_dir):
    """A loaded model that ticks and is reset has the state that was loaded, and what has been added since."""
    path = scratch(spark)
    agents, links = tables.nation_chain(spark, sf_dir)
    m = model_of(spark, agents, links, [(infect, 0, None)], state=F.when(F.col("agent_id") == 0, 2).otherwise(1))
    m.simulate(1)
    m.save(path)
    other = Model(spark)
    other.register_breed(m.breeds[0])
    other.load(path)
    other.simulate(2)
    other.create_agent_of_breed(m.breeds[0], state=5)
    other.reset(to_initial=True)
    return other.agents.select("agent_id", "state")


def skipped_barriers(spark, sf_dir):
    """Skipping barriers between priorities changes nothing."""
    links = hierarchy_links(spark, sf_dir)
    agents = links.select(F.col("src").alias("agent_id")).union(links.select("dst")).distinct()
    m = model_of(spark, agents, links, [(infect, 0, None), (recover, 1, None)], {"state": (1, "bigint"), "dummy": (0, "bigint")}, state=F.when(F.col("agent_id") == 0, 2).otherwise(1))
    m.setup(skip_priority_barriers={0})
    m.simulate(2)
    return m.agents.select("agent_id", "state", "dummy")


def dangling_neighbors(spark, sf_dir):
    """Links to agents that do not exist are skipped: half of each customer's two."""
    agents = customers(spark, sf_dir).select("agent_id")
    links = agents.select(F.col("agent_id").alias("src"), F.explode(F.array(F.col("agent_id") + 1, -1 - F.col("agent_id"))).alias("dst"))
    step = lambda ctx: {"n": ctx.neighbors.count(), "most": ctx.neighbors.max(ctx.nbr("points")), "mean": ctx.neighbors.avg(ctx.nbr("points")), "even": ctx.neighbors.all(ctx.nbr("points") % 2 == 0).cast("bigint")}
    m = model_of(spark, agents, links, [(step, 0, None)], {"points": (0, "bigint"), "n": (9, "bigint"), "most": (-1, "bigint"), "mean": (-1.0, "double"), "even": (9, "bigint")}, directed=True, points=F.col("agent_id") % 11)
    m.simulate(1)
    return m.agents.select("agent_id", "n", "most", "mean", "even")


def own_array_in_folds(spark, sf_dir):
    """A fold that compares neighbours with an agent's own breed-local array."""
    m = model_of(spark, customers(spark, sf_dir).select("agent_id"), customer_ring(spark, sf_dir), [], {"points": (0, "bigint"), "n": (0, "bigint")}, points=F.col("agent_id") % 11)
    m.register_breed_local_array("limits", m.breeds[0], 2)
    m.breeds[0].register_step_func(lambda ctx: {"limits": arrays.set_at(ctx.self("limits"), 1, ctx.self("points").cast("double"))}, 0, ["limits"])
    m.breeds[0].register_step_func(lambda ctx: {"n": ctx.neighbors.count(ctx.nbr("points") > ctx.own("limits")[1])}, 1)
    m.simulate(1)
    return m.agents.select("agent_id", "n")


def breed_agent_ids(spark, sf_dir):
    m, breeds = trade_model(spark, sf_dir, ticks=0)
    return m.get_breed_agent_ids(breeds[1])


def property_read(spark, sf_dir):
    """One property of three agents, read one by one; null for one that does not exist."""
    m = model_of(spark, customers(spark, sf_dir).select("agent_id"), None, properties={"state": (0, "bigint")}, state=F.col("agent_id") * 3)
    ids = (2, 17, -4)
    return spark.createDataFrame([(i, m.get_agent_property_value(i, "state")) for i in ids], "agent_id bigint, state bigint")


def agents_with_python_predicate(spark, sf_dir):
    m = model_of(spark, customers(spark, sf_dir).withColumn("state", F.col("agent_id") % 5), None)
    return m.get_agents_with(lambda agent: agent["state"] == 3 and agent["agent_id"] > 10).select("agent_id", "state")


def breed_order(spark, sf_dir):
    """Places of agents laid out by breed, then id."""
    a = customers(spark, sf_dir).select("agent_id", F.col("c_nationkey").alias("breed"))
    return population.sorted_by_breed(a, 1).select("agent_id", "breed", F.monotonically_increasing_id().alias("place"))


def padded_arrays(spark, sf_dir):
    """Rows of one width with NaN behind, and what is left without it."""
    a = customers(spark, sf_dir).select("agent_id", F.sequence(F.lit(0), F.col("agent_id") % 4).cast("array<double>").alias("v"))
    p = arrays.pad(F.col("v"), 6)
    return a.select("agent_id", F.size(p).cast("long").alias("width"), F.size(F.filter(p, F.isnan)).cast("long").alias("padded"), F.aggregate(arrays.unpad(p), F.lit(0.0), lambda s, x: s + x).alias("total"))


# graph operators


def nation_links(spark, sf_dir):
    n = tables.read(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).cast("long").alias("dst"), F.col("n_nationkey").cast("long").alias("pos"))


def edges_directed(spark, sf_dir):
    return graph.connect(nation_links(spark, sf_dir), directed=True)


def edges_undirected(spark, sf_dir):
    return graph.connect(nation_links(spark, sf_dir))


def edges_disconnect(spark, sf_dir):
    links = nation_links(spark, sf_dir)
    return graph.disconnect(graph.connect(links), links.filter("src % 5 = 0"))


def degree(spark, sf_dir):
    buyers, _, links = tables.trade_network(spark, sf_dir)
    return graph.degree(buyers, graph.connect(links, directed=True))


def nth_neighbor(spark, sf_dir):
    _, _, links = tables.trade_network(spark, sf_dir)
    return graph.nth_neighbor(graph.connect(links, directed=True), 2)


def csr_offsets(spark, sf_dir):
    buyers, _, links = tables.trade_network(spark, sf_dir)
    return graph.csr(buyers, graph.connect(links, directed=True))[0].select("agent_id", "degree", "offset")


def csr_values(spark, sf_dir):
    buyers, _, links = tables.trade_network(spark, sf_dir)
    return graph.csr(buyers, graph.connect(links, directed=True))[1]


# functions


def draws(spark, sf_dir, **columns):
    return customers(spark, sf_dir).select("agent_id", *[c.alias(n) for n, c in columns.items()])


def philox_uniform(spark, sf_dir):
    return draws(spark, sf_dir, u=rng.uniform(SEED, 5, F.col("agent_id"), 1), v=rng.uniform(SEED, 99, F.col("agent_id"), 2))


def xorshift_uniform(spark, sf_dir):
    return draws(spark, sf_dir, u=rng.uniform_xorshift(SEED, 5, F.col("agent_id"), 1))


def rand_normal(spark, sf_dir):
    return draws(spark, sf_dir, z=F.round(rng.normal(SEED, 5, F.col("agent_id"), 1), 6))


def rand_normal_bounded(spark, sf_dir):
    return draws(spark, sf_dir, z=F.round(rng.normal_bounded(SEED, 5, F.col("agent_id"), 1, -0.5, 0.5), 6))


def scalar_functions(spark, sf_dir):
    b = F.col("c_acctbal")
    return customers(spark, sf_dir).select("agent_id", math.clamp(b, 0, 5000).alias("clamped"), math.safe_divide(b, F.col("c_nationkey"), -1).alias("ratio"), math.lerp(b, 100, 0.25).alias("mixed"), math.heaviside(b).alias("step"))


def scalar_functions_nan(spark, sf_dir):
    """The same where every seventh value is no number; NaN is shown as null."""
    b = F.when(F.col("agent_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    shown = lambda x: F.when(~F.isnan(x), x)
    return customers(spark, sf_dir).select("agent_id", shown(math.clamp(b, 0, 5000)).alias("clamped"), shown(math.safe_divide(F.lit(1.0), b, -1)).alias("ratio"), shown(math.lerp(b, 100, 0.25)).alias("mixed"), math.heaviside(b).alias("step"))


def initial_sample(spark, sf_dir):
    return generators.sample(customers(spark, sf_dir), 20, SEED)


# partitions


def rank_by_mod(spark, sf_dir):
    return customers(spark, sf_dir).select("agent_id", (F.col("agent_id") % 4).cast("int").alias("rank"))


def partition_round_robin(spark, sf_dir):
    return partition.round_robin(customers(spark, sf_dir), 4)


def partition_random(spark, sf_dir):
    return partition.random(customers(spark, sf_dir), 4)


def partition_balance(spark, sf_dir):
    return graph.balance(customers(spark, sf_dir).select("agent_id", F.col("c_nationkey").alias("rank")))


def partition_edge_cut(spark, sf_dir):
    return graph.edge_cut(graph.connect(customer_ring(spark, sf_dir)), rank_by_mod(spark, sf_dir))


def ghost_topology(spark, sf_dir):
    return graph.ghosts(graph.connect(customer_ring(spark, sf_dir)), rank_by_mod(spark, sf_dir))


def comm_volume(spark, sf_dir):
    return graph.communication_volume(graph.connect(customer_ring(spark, sf_dir)), rank_by_mod(spark, sf_dir))


def partition_quality(spark, sf_dir):
    """Balance and cut of the ranks 0 to 3 among five workers."""
    return graph.analyze(graph.connect(customer_ring(spark, sf_dir)), rank_by_mod(spark, sf_dir), workers=5)


def partition_balanced(spark, sf_dir):
    """Agents of each rank of a balanced partition: they differ by one at most."""
    agents, edges = customers(spark, sf_dir), graph.connect(customer_ring(spark, sf_dir))
    return partition.balanced(agents, edges, 4, rounds=4).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


def partition_communities(spark, sf_dir):
    agents, edges = customers(spark, sf_dir), graph.connect(customer_ring(spark, sf_dir))
    return partition.by_communities(agents, edges, 4, rounds=2).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


def partition_multilevel(spark, sf_dir):
    """Four ranks of a ring by the multilevel partitioner, against a bound: 1.3 times the cut of four arcs, which is the least one."""
    agents, edges = customers(spark, sf_dir), cut(graph.connect(customer_ring(spark, sf_dir)))
    n = agents.count()
    arcs = agents.select("agent_id", F.floor(F.col("agent_id") * 4 / n).cast("int").alias("rank"))
    bound = int(1.3 * graph.edge_cut(edges, arcs).first().n_cut)
    found = cut(multilevel(agents, edges, 4))
    one = graph.analyze(edges, found)
    return one.select("n_agents", "n_ranks", F.lit(bound).cast("bigint").alias("bound"), (F.col("n_cut") <= bound).alias("within_bound"), ((F.col("least") >= 0.95 * F.col("mean")) & (F.col("most") <= 1.05 * F.col("mean"))).alias("balanced"))


def crowds(spark, sf_dir):
    """Customers linked to the next three by id within crowds of 25, and every tenth to one anywhere."""
    c = customers(spark, sf_dir).select("agent_id")
    n = c.count()
    crowd = lambda x: F.floor(F.col(x) / 25)
    near = c.select(F.col("agent_id").alias("src"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("d")).select("src", (F.col("src") + F.col("d")).alias("dst"))
    far = c.filter("agent_id % 10 = 0").select(F.col("agent_id").alias("src"), ((F.col("agent_id") * 7 + 1) % n).alias("dst"))
    links = near.filter((crowd("src") == crowd("dst")) & (F.col("dst") < n)).union(far.filter(crowd("src") != crowd("dst")))
    return c, graph.connect(links), c.select("agent_id", crowd("agent_id").alias("community"))


def modularity_communities(spark, sf_dir):
    """Modularity of the crowds, and whether the communities found reach 99 % of it."""
    agents, edges, truth = crowds(spark, sf_dir)
    planted = modularity(edges, truth)
    found = modularity(edges, louvain(agents, edges))
    return agents.agg(F.count(F.lit(1)).alias("n_agents")).select("n_agents", F.round(F.lit(planted), 9).alias("planted"), F.lit(found >= 0.99 * planted).alias("reached"))


def small_world(spark, sf_dir):
    """All links of a small world, in both directions."""
    return graph.connect(generators.small_world(spark, customers(spark, sf_dir).count(), 4, 0.1, SEED))


def clustered_ring(spark, sf_dir):
    return graph.connect(generators.clustered_ring(spark, 10, customers(spark, sf_dir).count() // 10, 6, 20, 2, SEED))


QUERIES = {
    f.__name__: f
    for f in (
        sir_chain_wave, sir_chain_philox, stale_ghost_sync2, sir_trade_network, trade_histogram, trade_breed_data, sir_two_breed_bipartite, state_histogram, breed_data, sir_vector_safety,
        hierarchy_si_one_hop, hierarchy_sir_two_hop, priority_buffered, priority_in_place, priority_last_writer, augassign_snapshot, in_place_neighbor_read,
        history_circular_buffer, history_pivot, event_recording, set_property, agents_with, breed_local_array, invisible_property_zero, message_send_sum, messages_two_breeds, messages_by_priority, pandas_step, pandas_step_without_neighbors, reset_after_load,
        third_neighbor, history_last_values, breed_ranges, rank_counts, widest_arrays, community_packing,
        neighbor_folds, custom_folds, edges_directed, edges_undirected, edges_disconnect, degree, nth_neighbor, csr_offsets, csr_values,
        philox_uniform, xorshift_uniform, rand_normal, rand_normal_bounded, scalar_functions, initial_sample,
        partition_round_robin, partition_random, partition_balance, partition_edge_cut, ghost_topology, comm_volume, partition_quality, partition_communities, partition_balanced, partition_multilevel, modularity_communities,
        partition_precedence, partition_from_file, partition_from_dict, periodic_snapshots, visible_in_one_breed, single_links, agents_added_later, clock_reset, saved_and_loaded, skipped_barriers, dangling_neighbors, own_array_in_folds,
        breed_agent_ids, property_read, agents_with_python_predicate, breed_order, padded_arrays, scalar_functions_nan,
        small_world, clustered_ring,
    )
}
