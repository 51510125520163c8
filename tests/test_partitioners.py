"""Multilevel partitions and communities against known optima."""

import random

import pytest
from pyspark.sql import functions as F

from swarmframe.operators import communities, graph, multilevel, partition

#: The friendships of Zachary's karate club, each once.
KARATE = {
    0: [1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 17, 19, 21, 31], 1: [2, 3, 7, 13, 17, 19, 21, 30], 2: [3, 7, 8, 9, 13, 27, 28, 32], 3: [7, 12, 13], 4: [6, 10], 5: [6, 10, 16], 6: [16],
    8: [30, 32, 33], 9: [33], 13: [33], 14: [32, 33], 15: [32, 33], 18: [32, 33], 19: [33], 20: [32, 33], 22: [32, 33], 23: [25, 27, 29, 32, 33], 24: [25, 27, 31], 25: [31], 26: [29, 33],
    27: [33], 28: [31, 33], 29: [32, 33], 30: [32, 33], 31: [32, 33], 32: [33],
}


def network(spark, pairs, n):
    agents = spark.range(n).withColumnRenamed("id", "agent_id")
    return agents, graph.connect(spark.createDataFrame(pairs, "src bigint, dst bigint"))


def grid(n):
    return [(i, i + 1) for i in range(n * n) if i % n < n - 1] + [(i, i + n) for i in range(n * (n - 1))]


def planted(rng, groups, size, inside, between):
    pairs = set()
    for g in range(groups):
        while len(pairs) < (g + 1) * inside:
            a, b = rng.sample(range(g * size, (g + 1) * size), 2)
            pairs.add((min(a, b), max(a, b)))
    total = len(pairs) + between
    while len(pairs) < total:
        a, b = rng.sample(range(groups * size), 2)
        if a // size != b // size:
            pairs.add((min(a, b), max(a, b)))
    return sorted(pairs)


def greedy(pairs, n):
    """Modularity of greedy merging, the plain way."""
    m, members = len(pairs), {i: {i} for i in range(n)}
    k = [sum(i in p for p in pairs) for i in range(n)]

    def quality(groups):
        return sum(sum(a in g and b in g for a, b in pairs) / m - (sum(k[i] for i in g) / 2 / m) ** 2 for g in groups)

    best = quality(members.values())
    while True:
        tried = []
        for a in members:
            for b in members:
                if a < b:
                    links = sum((x in members[a] and y in members[b]) or (x in members[b] and y in members[a]) for x, y in pairs)
                    if links:
                        tried.append((links / m - sum(k[i] for i in members[a]) * sum(k[i] for i in members[b]) / 2 / m / m, -a, -b))
        if not tried or max(tried)[0] <= 0:
            return best
        gain, a, b = max(tried)
        members[-a] |= members.pop(-b)
        best += gain


@pytest.mark.parametrize("name, coarse", [("grid", 100), ("planted", 80)])
def test_multilevel_cut(spark, monkeypatch, name, coarse):
    monkeypatch.setattr(multilevel, "COARSE", coarse)
    pairs, n, best = (grid(20), 400, 40) if name == "grid" else (planted(random.Random(3), 4, 100, 600, 60), 400, 60)
    agents, edges = network(spark, pairs, n)
    found = multilevel.multilevel(agents, edges, 4).cache()
    assert found.count() == found.select("agent_id").distinct().count() == n
    cut = graph.edge_cut(edges, found).first()
    assert cut.n_cut / 2 <= 1.3 * best
    balance = graph.balance(found).first()
    assert balance.n_ranks == 4 and balance.least >= 0.95 * n / 4 and balance.most <= 1.05 * n / 4


def test_multilevel_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(multilevel, "COARSE", 30)
    star = [(0, i) for i in range(1, 200)] + [(3, 3), (5, 900)]  # a hub, a loop, an unknown agent
    agents, edges = network(spark, star, 230)  # and agents without links
    sizes = [r["count"] for r in multilevel.multilevel(agents, edges, 3).groupBy("rank").count().collect()]
    assert len(sizes) == 3 and sum(sizes) == 230 and max(sizes) <= 1.05 * 230 / 3 + 1
    assert {r.rank for r in multilevel.multilevel(agents, edges, 1).collect()} == {0}
    few = spark.createDataFrame([(7,), (9,)], "agent_id bigint")
    assert multilevel.multilevel(few, edges.limit(0), 4).count() == 2
    with pytest.raises(ValueError):
        multilevel.multilevel(agents.limit(0), edges, 2)
    with pytest.raises(ValueError):
        multilevel.multilevel(agents, edges, 0)
    assert partition.METHODS["metis"] is multilevel.multilevel


def test_levels_take_few_jobs(spark, monkeypatch):
    """Small graphs are planned beforehand, and what nodes want is looked for again only after moves. Ranks are those of adaptive plans, settings are as before."""
    monkeypatch.setattr(multilevel, "COARSE", 100)
    agents, edges = network(spark, grid(20), 400)
    settings = [f"spark.sql.{x}" for x in ("adaptive.enabled", "autoBroadcastJoinThreshold", "shuffle.partitions")]
    before = [spark.conf.get(x) for x in settings]

    def run(group):
        spark.sparkContext.setJobGroup(group, group)
        try:
            return sorted(map(tuple, multilevel.multilevel(agents, edges, 4).collect())), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext._jsc.clearJobGroup()

    got, jobs = run("as it is")
    assert [spark.conf.get(x) for x in settings] == before
    monkeypatch.setattr("swarmframe.plans.lineage.FEW", 0, raising=False)
    assert got == run("adaptive")[0] and jobs <= 120


def test_halving_a_small_graph():
    near = [{} for _ in range(64)]
    for a, b in grid(8):
        near[a][b] = near[b][a] = 1
    ranks = multilevel.parted(near, [1] * 64, 4, 0.01, random.Random(1))
    assert sorted(ranks.count(r) for r in range(4)) == [16] * 4
    assert sum(ranks[a] != ranks[b] for a, b in grid(8)) <= 1.3 * 16


def test_modularity_of_karate_club(spark):
    pairs = [(a, b) for a, others in KARATE.items() for b in others]
    agents, edges = network(spark, pairs, 34)
    one = agents.withColumn("community", F.lit(0))
    assert len(pairs) == 78 and abs(communities.modularity(edges, one)) < 1e-12
    found = communities.louvain(agents, edges).cache()
    value = communities.modularity(edges, found)
    of = {r.agent_id: r.community for r in found.collect()}
    plain = sum(of[a] == of[b] for a, b in pairs) / 78 - sum((sum((of[a] == c) + (of[b] == c) for a, b in pairs) / 156) ** 2 for c in set(of.values()))
    assert abs(value - plain) < 1e-12 and value >= greedy(pairs, 34) - 1e-9
    assert all(min(i for i in of if of[i] == c) == c for c in of.values())


def test_communities_of_planted_groups(spark):
    pairs = planted(random.Random(5), 6, 30, 150, 40)
    agents, edges = network(spark, pairs, 190)  # ten without links
    found = communities.louvain(agents, edges).cache()
    assert found.filter("agent_id >= 180 and community = agent_id").count() == 10
    truth = agents.filter("agent_id < 180").select("agent_id", F.floor(F.col("agent_id") / 30).alias("community"))
    assert communities.modularity(edges, found) >= communities.modularity(edges, truth) - 1e-9
    assert communities.louvain(agents, edges.limit(0)).filter("agent_id = community").count() == 190


def test_large_graphs_are_not_broadcast(spark, monkeypatch):
    """Tables of a graph that is too large reach no driver; communities are the same."""
    links = [(c * 6 + a, c * 6 + b) for c in range(5) for a in range(6) for b in range(a)] + [(c * 6, (c + 1) % 5 * 6) for c in range(5)]
    edges = graph.connect(spark.createDataFrame(links, "src bigint, dst bigint"))
    agents = spark.range(30).withColumnRenamed("id", "agent_id")
    want = sorted(map(tuple, communities.louvain(agents, edges).collect()))
    plans, stored = [], communities.stored
    monkeypatch.setattr(communities, "stored", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), stored(df))[1])
    monkeypatch.setattr(communities, "BROADCAST", 1, raising=False)
    assert sorted(map(tuple, communities.louvain(agents, edges).collect())) == want
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
