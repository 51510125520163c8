"""Edge-table operators: compressed rows, cuts, partitions and their files, graph files, generators."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from swarmframe import cli, queries
from swarmframe.functions import arrays
from swarmframe.operators import graph, partition, population
from swarmframe.sources import generators, graph_files, partition_files, tables


def agents_of(spark, n):
    return spark.range(n).withColumnRenamed("id", "agent_id")


def edges_of(spark, rows):
    links = [(i, d, k) for i, row in enumerate(rows) for k, d in enumerate(row)]
    return spark.createDataFrame(links, "src bigint, dst bigint, pos bigint")


@pytest.mark.parametrize(
    ("rows", "offsets"),
    [
        ([[5, 2], [8, 3, 1], [], [7, 4, 9, 6]], [0, 2, 5, 5]),
        ([[1], [], [2, 3]], [0, 1, 1]),
        ([], []),
        ([[4, 5]], [0]),
    ],
)
def test_compressed_rows(spark, rows, offsets):
    off, slots = graph.csr(agents_of(spark, len(rows)), edges_of(spark, rows))
    got = sorted(map(tuple, off.select("agent_id", "offset", "degree").collect()))
    assert got == [(i, o, len(rows[i])) for i, o in enumerate(offsets)]
    assert [r.dst for r in slots.orderBy("slot").collect()] == [d for r in rows for d in r]


def test_degree_and_nth(spark):
    e = edges_of(spark, [[3, 1], [0]])
    assert sorted(map(tuple, graph.degree(agents_of(spark, 3), e).collect())) == [(0, 2), (1, 1), (2, 0)]
    assert sorted(map(tuple, graph.nth_neighbor(e, 1).collect())) == [(0, 1)]


def test_cut_counts_unknown_agents_or_leaves_them_out(spark):
    e = edges_of(spark, [[1, 2], [0]])
    p = spark.createDataFrame([(0, 0), (1, 0)], "agent_id bigint, rank int")
    assert tuple(graph.edge_cut(e, p).select("n_edges", "n_cut", "quality").head()) == (3, 1, "fair")
    assert tuple(graph.edge_cut(e, p, default=None).select("n_edges", "n_cut", "quality").head()) == (2, 0, "excellent")


def test_partitions_of_two_cliques(spark):
    links = [(a, b) for base in (0, 10) for a in range(base, base + 10) for b in range(a + 1, base + 10)] + [(9, 10)]
    e = graph.connect(spark.createDataFrame(links, "src bigint, dst bigint"))
    a = agents_of(spark, 20)
    row = graph.analyze(e, partition.balanced(a, e, 2)).head()
    assert (row.least, row.most) == (10, 10)
    assert row.n_cut < graph.edge_cut(e, partition.round_robin(a, 2)).head().n_cut
    assert partition.by_communities(a, e, 2).count() == 20
    assert {r.rank for r in partition.random(a, 3).collect()} <= {0, 1, 2}
    with pytest.raises(ValueError, match="worker"):
        partition.round_robin(a, 0)
    with pytest.raises(ValueError, match="empty"):
        partition.balanced(agents_of(spark, 0), e, 2)


@pytest.mark.parametrize("name", ["p.pkl", "p.json", "p.npy", "p.txt", "p.dat"])
def test_partition_files_round_trip(tmp_path, name):
    p = {0: 1, 1: 0, 2: 1}
    partition_files.save(p, tmp_path / name)
    assert partition_files.load(tmp_path / name) == p


def test_partition_files_errors_and_comments(tmp_path):
    (tmp_path / "a.txt").write_text("# ranks\n0 1\n\n1 0 # last\n")
    assert partition_files.load(tmp_path / "a.txt") == {0: 1, 1: 0}
    (tmp_path / "b.txt").write_text("0\n")
    with pytest.raises(ValueError, match="line 1"):
        partition_files.load(tmp_path / "b.txt")
    with pytest.raises(FileNotFoundError):
        partition_files.load(tmp_path / "none.json")
    with pytest.raises(ValueError, match="empty"):
        partition_files.validate({}, 2)
    with pytest.raises(ValueError, match="ranks"):
        partition_files.validate({0: 2}, 2)
    partition_files.save({0: 1, 2: 1}, tmp_path / "gap.npy")
    assert np.load(tmp_path / "gap.npy").tolist() == [1, -1, 1]
    with pytest.raises(ValueError, match="ranks"):
        partition_files.validate(partition_files.load(tmp_path / "gap.npy"), 2)


def test_graph_files(spark, tmp_path):
    (tmp_path / "g.edgelist").write_text("# a graph\n0 1\n1 2 {'w': 1}\n")
    (tmp_path / "g.gml").write_text("graph [ node [ id 0 ] node [ id 1 ] edge [ source 0 target 1 ] ]")
    (tmp_path / "g.graphml").write_text('<graphml xmlns="x"><graph><node id="n0"/><edge source="n0" target="n4"/></graph></graphml>')
    (tmp_path / "named.edgelist").write_text("a 0\nz 1\nlonely\n")
    (tmp_path / "named.gml").write_text('graph [ node [ id 0 label "x y" ] node [ id 1 label "b" ] node [ id 7 label "c" ] edge [ source 0 target 1 ] ]')
    (tmp_path / "named.graphml").write_text('<graphml><graph><node id="u"/><node id="n1"/><node id="w"/><edge source="n1" target="u"/></graph></graphml>')
    read = lambda n: sorted(map(tuple, graph_files.read(spark, str(tmp_path / n)).collect()))
    names = lambda n: {r.label: r.agent_id for r in graph_files.read_graph(spark, str(tmp_path / n))[0].collect()}
    assert names("named.edgelist") == {"0": 0, "1": 1, "a": 2, "lonely": 3, "z": 4}
    assert read("named.edgelist") == [(2, 0), (4, 1)]
    assert (names("named.gml"), read("named.gml")) == ({"b": 0, "c": 1, "x y": 2}, [(2, 0)])
    assert (names("named.graphml"), read("named.graphml")) == ({"n1": 0, "u": 1, "w": 2}, [(0, 1)])
    assert names("g.graphml") == {"n0": 0, "n4": 4}
    assert read("g.edgelist") == [(0, 1), (1, 2)]
    assert read("g.gml") == [(0, 1)]
    assert read("g.graphml") == [(0, 4)]
    with pytest.raises(ValueError, match="unknown"):
        graph_files.read(spark, "g.dot")


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "g.edgelist").write_text("".join(f"{i} {i + 1}\n" for i in range(9)))
    cli.main(["--input", str(tmp_path / "g.edgelist"), "--output", str(tmp_path / "p.json"), "--workers", "2", "--method", "round_robin"])
    assert json.loads((tmp_path / "p.json").read_text()) == {str(i): i % 2 for i in range(10)}
    assert "imbalance" in capsys.readouterr().out
    (tmp_path / "g.gml").write_text("graph [ node [ id 0 ] node [ id 1 ] node [ id 2 ] edge [ source 0 target 1 ] ]")
    for method in ("metis", "community", "roundrobin", "random"):
        cli.main(["-i", str(tmp_path / "g.gml"), "-o", str(tmp_path / "p"), "-w", "2", "-m", method, "-f", "numpy"])
        assert len(np.load(tmp_path / "p.npy" if (tmp_path / "p.npy").exists() else tmp_path / "p")) == 3


def test_balance_counts_workers_without_agents(spark):
    p = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "agent_id bigint, rank int")
    assert (graph.balance(p).head().mean, graph.balance(p, 4).head().mean) == (1.5, 0.75)


def test_many_communities_are_packed_by_one_rule(spark, monkeypatch):
    rows = [(c * 1000 + i, c) for c, n in enumerate([60, 50, 40, 7, 6, 5, 5, 4, 3, 3, 2, 2, 1, 1, 1]) for i in range(n)]
    df = spark.createDataFrame(rows, "agent_id bigint, community bigint")
    for placed in (10_000, 3, 0):
        monkeypatch.setattr(partition, "PLACED", placed)
        out = partition.pack(df, 4).collect()
        n = [sum(r.rank == w for r in out) for w in range(4)]
        assert sum(n) == len(rows) == len({r.agent_id for r in out})
        assert len({(r.agent_id // 1000, r.rank) for r in out}) == 15
        if placed == 3:
            assert n[:3] == [60, 50, 40] or max(n) - min(n) <= 60 - 40
    assert partition.room_up_to_a_level([60, 50, 40, 0], 40) == [0, 0, 0, 40]
    assert partition.room_up_to_a_level([10, 0, 0], 20) == [0, 10, 10]
    assert sum(partition.room_up_to_a_level([10, 4, 0], 31)) == pytest.approx(31)


def test_partitions_of_any_size(spark, tmp_path):
    df = spark.createDataFrame([(0, 1), (7, 0)], "agent_id bigint, rank int")
    df.write.parquet(str(tmp_path / "p.parquet"))
    (tmp_path / "p.txt").write_text("# ranks\n0 1\n\n7 0 # last\n")
    for name in ("p.parquet", "p.txt"):
        assert sorted(map(tuple, partition_files.read(spark, str(tmp_path / name)).collect())) == [(0, 1), (7, 0)]
    (tmp_path / "bad.txt").write_text("0\n")
    with pytest.raises(ValueError, match="two numbers"):
        partition_files.read(spark, str(tmp_path / "bad.txt"))


def test_small_world_query_gives_every_link(spark, sf):
    n = spark.read.parquet(f"{sf}/customer.parquet").count()
    links = {(r.src, r.dst) for r in queries.QUERIES["small_world"](spark, sf).collect()}
    assert len(links) == 4 * n and all(a != b and (b, a) in links for a, b in links)


def test_generators(spark, tmp_path):
    assert generators.chain(spark, 5).count() == 4
    assert generators.hierarchy(spark).count() == 110
    ring = generators.ring(spark, 10, 4)
    assert ring.count() == 20
    moved = generators.small_world(spark, 200, 4, 0.2, 1)
    kept = moved.join(generators.ring(spark, 200, 4), ["src", "dst"]).count()
    assert 0.7 < kept / 400 < 0.9
    c = generators.clustered_ring(spark, 4, 20, 4, 7, 1, 3).withColumn("same", F.floor(F.col("src") / 20) == F.floor(F.col("dst") / 20))
    inside = c.filter("same").groupBy("src").count().collect()
    assert c.filter("same and src >= dst").count() == 0 and max(r["count"] for r in inside) <= 4
    assert 4 * 20 < c.filter("same").count() < 4 * 20 * 3
    assert c.filter("not same").count() == c.filter("not same").distinct().count() == 4 * 7
    assert generators.sample(agents_of(spark, 50), 7, 1).count() == 7
    make = lambda s, n: generators.chain(s, n)
    make.__name__ = "chain"
    for _ in range(2):
        assert tables.cached(spark, str(tmp_path), make, n=4).count() == 3


def test_padding(spark):
    row = spark.createDataFrame([([1.0, 2.0],)], "a array<double>").select(arrays.pad(F.col("a"), 4).alias("p"))
    assert len(row.head().p) == 4
    assert row.select(arrays.unpad(F.col("p"))).head()[0] == [1.0, 2.0]


def test_population(spark):
    a = spark.createDataFrame([(i, b) for i, b in enumerate([1, 0, 1, 2])], "agent_id bigint, breed int")
    assert sorted(map(tuple, population.breed_ranges(a).collect())) == [(0, 0, 1), (1, 1, 2), (2, 3, 1)]
    assert population.priority_ranges(a, {0: [1, 2], 1: [0], 2: [9]}) == {0: (1, 4), 1: (0, 1)}
    assert [r.agent_id for r in population.sorted_by_breed(a, 1).collect()] == [1, 0, 2, 3]
    assert population.counts(a, "breed").count() == 3


def test_gml_with_blocks_inside(spark, tmp_path):
    path = tmp_path / "g.gml"
    path.write_text('''# made by hand
Creator "x [ y"
graph [ directed 0
  node [ id 1 graphics [ x 1 y [ z 2 ] ] label "A b" ]
  node [ id 2 label "C]" graphics [ id 9 ] ]
  node [ id 3 ]
  edge [ graphics [ width 2 source 7 ] source 1 target 2 ]
  edge [ source 2
    target 3 label "e" ]
]''')
    nodes, links = graph_files.gml(str(path))
    assert nodes == ["A b", "C]", "3"] and links == [("A b", "C]"), ("C]", "3")]


def test_labels_that_are_the_same_number(spark, tmp_path):
    path = tmp_path / "g.edgelist"
    path.write_text("1 01\n01 2\n" + "".join(f"user_{k} user_{k + 1}\n" for k in range(50)))
    ids, links = graph_files.read_graph(spark, str(path))
    found = {r.label: r.agent_id for r in ids.collect()}
    assert sorted(found.values()) == list(range(54)) and sorted(found, key=found.get) == sorted(found)
    path.write_text("1 01\n01 2\n")
    ids, links = graph_files.read_graph(spark, str(path))
    assert {r.label: r.agent_id for r in ids.collect()} == {"01": 0, "1": 1, "2": 2} and links.count() == 2


@pytest.mark.parametrize("n, k, p", [(200, 4, 0.2), (60, 10, 1.0), (40, 6, 0.0), (12, 8, 0.9)])
def test_small_world_keeps_all_links(spark, n, k, p):
    links = [tuple(r) for r in generators.small_world(spark, n, k, p, 3).collect()]
    assert len(links) == len(set(links)) == n * k // 2 and all(a < b for a, b in links)
    ring = {(min(i, (i + d) % n), max(i, (i + d) % n)) for i in range(n) for d in range(1, k // 2 + 1)}
    assert (p == 0.0) == (set(links) == ring)
    with pytest.raises(RuntimeError):
        generators.small_world(spark, 5, 4, 1.0, 3, rounds=2)


def test_connect_takes_any_ends(spark):
    """Loops, repeats, both directions and ends that are not there give each edge once, with its first position."""
    rows = [(1, 2, 5), (2, 1, 3), (1, 2, 4), (4, 4, 7), (4, 4, 6), (None, 5, 2), (5, None, 1), (None, None, 0)]
    got = graph.connect(spark.createDataFrame(rows, "src bigint, dst bigint, pos bigint")).collect()
    want = {}
    for a, b, p in rows:
        for e in ((a, b), (b, a)):
            want[e] = min(want.get(e, p), p)
    assert len(got) == len(want) and {(r.src, r.dst): r.pos for r in got} == want
