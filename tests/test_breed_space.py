"""Registration of breeds, and graphs as sets or lists of neighbours."""

import random

import pytest

from swarmframe import Breed, Model, NetworkSpace


def test_scalar_and_list_defaults_and_types():
    b = Breed("person")
    b.register_property("health", 100)
    b.register_property("history", [0.0] * 10)
    b.register_property("grid", [[1.0]])
    b.register_property("state", 1, sql_type="bigint")
    assert b.properties["health"].default == 100
    assert b.properties["history"].default == [0.0] * 10
    assert [b.properties[n].type for n in ("health", "history", "grid", "state")] == ["double", "array<double>", "array<array<double>>", "bigint"]


def test_default_is_a_copy():
    shared = [1.0]
    b = Breed("x")
    b.register_property("p", shared)
    shared.append(2.0)
    assert b.properties["p"].default == [1.0]


def test_steps_by_priority_and_in_place_names():
    b = Breed("x")
    f, g = (lambda ctx: {}), (lambda ctx: {})
    b.register_step_func(f, priority=5, no_double_buffer=["counter"])
    b.register_step_func(g, priority=5)
    assert b.steps[5].function is g
    assert b.no_double_buffer == {"counter"}


def test_visibility_flags():
    b = Breed("x")
    b.register_property("seen")
    b.register_property("hidden", neighbor_visible=False)
    assert (b.properties["seen"].neighbor_visible, b.properties["hidden"].neighbor_visible) == (True, False)


def test_union_schema_takes_last_default_and_any_visibility(spark):
    m = Model(spark)
    a, b = Breed("a"), Breed("b")
    a.register_property("p", 1, neighbor_visible=True)
    b.register_property("p", 2, neighbor_visible=False)
    m.register_breed(a)
    m.register_breed(b)
    assert m.properties["p"].default == 2
    assert m.properties["p"].neighbor_visible


def test_agents_have_no_neighbors_at_first():
    s = NetworkSpace()
    for i in range(3):
        s.add_agent(i)
    assert [s.get_neighbors(i) for i in range(3)] == [set(), set(), set()]


@pytest.mark.parametrize(("directed", "back"), [(False, {0}), (True, set())])
def test_connect(directed, back):
    s = NetworkSpace()
    s.connect_agents(0, 1, directed)
    assert s.get_location(0) == {1}
    assert s.get_location(1) == back


@pytest.mark.parametrize(("directed", "left"), [(False, set()), (True, {0})])
def test_disconnect(directed, left):
    s = NetworkSpace()
    s.connect_agents(0, 1)
    s.disconnect_agents(0, 1, directed)
    s.disconnect_agents(5, 6)
    assert s.get_neighbors(0) == set()
    assert s.get_neighbors(1) == left


def test_ordered_space_keeps_order_and_ignores_repeats():
    s = NetworkSpace(ordered=True)
    for x in (7, 3, 9, 3):
        s.connect_agents(0, x, directed=True)
    assert s.get_neighbors(0) == [7, 3, 9]


def test_tables_and_single_links_together(spark):
    s = NetworkSpace()
    s.connect_frame(spark.createDataFrame([(0, 1), (1, 2), (1, 0)], "src bigint, dst bigint"))
    s.connect_agents(2, 3)
    s.disconnect_agents(0, 1, directed=True)
    assert {(r.src, r.dst) for r in s.edges(spark).collect()} == {(1, 0), (1, 2), (2, 1), (2, 3), (3, 2)}
    assert s.get_neighbors(1) == {0, 2}


def test_single_changes_are_one_join(spark, monkeypatch):
    rng = random.Random(2)
    base = {(i, (i + d) % 300) for i in range(300) for d in (1, 2)}
    for logged in (100_000, 900):
        monkeypatch.setattr("swarmframe.plans.space.LOGGED", logged)
        space = NetworkSpace()
        space.connect_frame(spark.createDataFrame(sorted(base), "src bigint, dst bigint"), directed=True)
        links = set(base)
        for _ in range(5000):
            a, b, one = rng.randrange(300), rng.randrange(300), rng.random() < 0.5
            if rng.random() < 0.5:
                space.connect_agents(a, b, directed=one)
                links |= {(a, b)} if one else {(a, b), (b, a)}
            else:
                space.disconnect_agents(a, b, directed=one)
                links -= {(a, b)} if one else {(a, b), (b, a)}
        edges = space.edges(spark)
        assert edges._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
        assert {(r.src, r.dst) for r in edges.collect()} == links and edges.count() == len(links)
        assert space.neighbors(5) == {b for a, b in links if a == 5}
        space.disconnect_frame(spark.createDataFrame([(5, x) for x in range(300)], "src bigint, dst bigint"), directed=True)
        space.connect_agents(5, 6, directed=True)
        assert space.neighbors(5) == {6} and space.edges(spark).count() == len([x for x in links if x[0] != 5]) + 1


def test_a_link_made_again_is_the_last(spark):
    space = NetworkSpace(ordered=True)
    space.connect_frame(spark.createDataFrame([(0, 1, 0), (0, 2, 1)], "src bigint, dst bigint, pos bigint"), directed=True)
    space._next = 10
    space.disconnect_agents(0, 1, directed=True)
    space.connect_agents(0, 1, directed=True)
    space.connect_agents(0, 2, directed=True)
    assert space.neighbors(0) == [2, 1]
    assert [r.dst for r in space.edges(spark).orderBy("pos").collect()] == [2, 1]
