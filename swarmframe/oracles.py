"""SQL that must give the rows of ``queries``; built without the engine's own expressions."""

from __future__ import annotations

from .functions.rng import PHILOX_KEY_STEP, PHILOX_MULTIPLIER, SECOND_NORMAL_SALT, TICK_STRIDE, XORSHIFT_ID, XORSHIFT_MIX, XORSHIFT_SALT, XORSHIFT_SEED, XORSHIFT_TICK
from .sources.tables import SUPPLIER_BASE

WORD = 1 << 32


def philox(seed: int, tick: int | str, ident: str, salt: int) -> str:
    keys = ", ".join(str((seed + r * PHILOX_KEY_STEP) % WORD) for r in range(10))
    product = f"((acc // {WORD}) * {PHILOX_MULTIPLIER})"
    step = f"xor(xor({product} // {WORD}, k), acc % {WORD}) * {WORD} + {product} % {WORD}"
    counter = (tick * TICK_STRIDE + salt) % WORD if isinstance(tick, int) else f"(({tick})::HUGEINT * {TICK_STRIDE} + {salt}) % {WORD}"
    start = f"(({counter})::HUGEINT * {WORD} + ({ident})::HUGEINT % {WORD})"
    return f"((list_reduce([{keys}]::HUGEINT[], lambda acc, k: {step}, {start}) // {WORD} % 8388608)::DOUBLE / 8388608.0::DOUBLE)"


def xorshift(seed: int, tick: int, ident: str, salt: int) -> str:
    h = f"({seed}::HUGEINT * {XORSHIFT_SEED} + {tick}::HUGEINT * {XORSHIFT_TICK} + ({ident})::HUGEINT * {XORSHIFT_ID} + {salt}::HUGEINT * {XORSHIFT_SALT})"
    ops = "[0, 1, 0, 1, 0]::HUGEINT[]"
    return f"((list_reduce({ops}, lambda h, o: CASE WHEN o = 0 THEN xor(h, (h // 65536) % 65536) % 2147483648 ELSE (h * {XORSHIFT_MIX}) % 2147483648 END, {h}) % 1000000)::DOUBLE / 1000000.0::DOUBLE)"


def normal(seed: int, tick: int, ident: str, salt: int) -> str:
    u, v = philox(seed, tick, ident, salt), philox(seed, tick, ident, salt + SECOND_NORMAL_SALT)
    return f"(sqrt(-2.0::DOUBLE * ln({u} + 1e-10::DOUBLE)) * cos(6.283185307179586::DOUBLE * {v}))"


CHAIN = "edges AS (SELECT n_nationkey::BIGINT AS src, n_nationkey::BIGINT + 1 AS dst FROM nation WHERE n_nationkey < 24 UNION ALL SELECT n_nationkey::BIGINT + 1, n_nationkey::BIGINT FROM nation WHERE n_nationkey < 24)"
NATIONS = "t0 AS (SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey = 0 THEN 2 ELSE 1 END::BIGINT AS state FROM nation)"
RING = "ring AS (SELECT c_custkey AS src, (c_custkey + d) % (SELECT count(*) FROM customer) AS dst FROM customer, (VALUES (1), (2)) v(d)), edges AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM ring UNION ALL SELECT dst, src FROM ring))"
TRADE = f"links AS (SELECT DISTINCT o_custkey AS src, l_suppkey + {SUPPLIER_BASE} AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
TRADE_BOTH = TRADE + ", edges AS (SELECT src, dst FROM links UNION ALL SELECT dst, src FROM links)"


def sir_ticks(ticks: int, p_infection: float, p_recovery: float, seed: int, extra: str = "") -> str:
    """CTEs t1 .. of SIR on t0 (id, state, extra columns) and edges."""
    out = []
    for k in range(ticks):
        u = philox(seed, k, "a.id", 1)
        out.append(
            f"h{k} AS (SELECT src, max(CASE WHEN n.state = 2 THEN 1 ELSE 0 END) AS hit FROM edges JOIN t{k} n ON dst = n.id GROUP BY src), "
            f"u{k} AS (SELECT a.*, coalesce(hit, 0) AS hit, {u} AS u FROM t{k} a LEFT JOIN h{k} ON src = a.id), "
            f"t{k + 1} AS (SELECT id{extra}, CASE WHEN state = 2 AND u < {p_recovery}::DOUBLE THEN 3 WHEN state = 1 AND hit = 1 AND u < {p_infection}::DOUBLE THEN 2 ELSE state END::BIGINT AS state FROM u{k})"
        )
    return ", ".join(out)


def stale_sir() -> str:
    """Four ticks in chunks of two on ranks id // 7: other ranks are seen as of the chunk's start."""
    out = []
    for k in range(4):
        old = f"t{k - k % 2}"
        out.append(
            f"h{k} AS (SELECT src, max(CASE WHEN (CASE WHEN src // 7 = dst // 7 THEN n.state ELSE g.state END) = 2 THEN 1 ELSE 0 END) AS hit FROM edges JOIN t{k} n ON dst = n.id JOIN {old} g ON dst = g.id GROUP BY src), "
            f"t{k + 1} AS (SELECT id, CASE WHEN state = 2 THEN 3 WHEN state = 1 AND hit = 1 THEN 2 ELSE state END::BIGINT AS state FROM t{k} LEFT JOIN h{k} ON src = id)"
        )
    return f"WITH {CHAIN}, {NATIONS}, {', '.join(out)} SELECT id AS agent_id, state FROM t4"


def wave(ticks: int, recover: bool = True) -> str:
    out = []
    for k in range(ticks):
        done = "WHEN state = 2 THEN 3 " if recover else ""
        out.append(
            f"h{k} AS (SELECT src, sum(CASE WHEN n.state = 2 THEN 1 ELSE 0 END) AS hit FROM edges JOIN t{k} n ON dst = n.id GROUP BY src), "
            f"t{k + 1} AS (SELECT id, CASE {done}WHEN state = 1 AND hit > 0 THEN 2 ELSE state END::BIGINT AS state FROM t{k} LEFT JOIN h{k} ON src = id)"
        )
    return f"WITH {CHAIN}, {NATIONS}, {', '.join(out)}"


HIERARCHY = (
    "one AS (SELECT n_regionkey::BIGINT AS src, n_nationkey::BIGINT + 100 AS dst FROM nation UNION SELECT c_nationkey::BIGINT + 100, c_custkey + 1000 FROM customer), "
    "edges AS (SELECT src, dst FROM one UNION SELECT dst, src FROM one), t0 AS (SELECT DISTINCT src AS id, CASE WHEN src = 0 THEN 2 ELSE 1 END::BIGINT AS state FROM edges)"
)
FOLDED = f"WITH {TRADE}, s AS (SELECT s_suppkey + {SUPPLIER_BASE} AS id, round(s_acctbal * 100)::BIGINT AS p FROM supplier), j AS (SELECT src, dst, p, row_number() OVER (PARTITION BY src ORDER BY dst) AS rn FROM links JOIN s ON dst = id)"
LINKS = "one AS (SELECT n_nationkey::BIGINT AS src, ((n_nationkey * 7 + 3) % 25)::BIGINT AS dst, n_nationkey::BIGINT AS pos FROM nation)"
BOTH = f"{LINKS}, edges AS (SELECT src, dst, min(pos) AS pos FROM (SELECT * FROM one UNION ALL SELECT dst, src, pos FROM one) GROUP BY src, dst)"
RANKS = "r AS (SELECT src, dst, (src % 4)::INTEGER AS sr, (dst % 4)::INTEGER AS dr FROM edges)"
CUSTOMER_COUNTERS = "SELECT c_custkey AS agent_id, {counter}::BIGINT AS counter, {result}::BIGINT AS result FROM customer"
SPREAD = "seen AS (SELECT t.id, t.k, coalesce(sum(CASE WHEN n.state = 2 THEN 1 ELSE 0 END), 0) AS n FROM all_t t LEFT JOIN edges ON src = t.id LEFT JOIN all_t n ON n.id = dst AND n.k = t.k GROUP BY t.id, t.k)"


def oracle_sql() -> dict[str, str]:
    return {
        "sir_chain_wave": f"{wave(5)} SELECT id AS agent_id, state FROM t5",
        "sir_chain_philox": f"WITH {CHAIN}, {NATIONS}, {sir_ticks(5, 0.8, 0.3, 999)} SELECT id AS agent_id, state FROM t5",
        "stale_ghost_sync2": stale_sir(),
        **{
            name: f"WITH {TRADE_BOTH}, t0 AS (SELECT c_custkey AS id, 0 AS breed, CASE WHEN c_custkey % 100 = 0 THEN 2 ELSE 1 END::BIGINT AS state FROM customer UNION ALL SELECT s_suppkey + {SUPPLIER_BASE}, 1, 1 FROM supplier), {sir_ticks(n, p, 0.2, 42, ', breed')} {select}"
            for names, n, select in (
                (("sir_two_breed_bipartite", "sir_trade_network"), 3, "SELECT id AS agent_id, breed, state FROM t3"),
                (("state_histogram", "trade_histogram"), 2, "SELECT breed, state, count(*) AS n FROM t2 GROUP BY breed, state"),
                (("breed_data", "trade_breed_data"), 1, "SELECT id AS agent_id, state FROM t1 WHERE breed = 1"),
            )
            for name, p in zip(names, (0.05, 0.3), strict=True)
        },
        "sir_vector_safety": "WITH v AS (SELECT vec_id AS id, list_sum(list_transform(embedding, lambda x: round(abs(x::DOUBLE) * 1000)))::DOUBLE AS total, len(embedding)::DOUBLE AS n FROM embeddings), c AS (SELECT count(*) AS m FROM v), one AS (SELECT id AS src, (id + 1) % m AS dst FROM v, c), e AS (SELECT src, dst FROM one UNION SELECT dst, src FROM one) SELECT a.id AS agent_id, round(max(a.total * b.total / (a.n * a.n)), 3) AS safety FROM v a JOIN e ON a.id = src JOIN v b ON b.id = dst GROUP BY a.id",
        "hierarchy_si_one_hop": f"WITH {HIERARCHY}, h AS (SELECT src, max(CASE WHEN state = 2 THEN 1 ELSE 0 END) AS hit FROM edges JOIN t0 ON dst = id GROUP BY src) SELECT id AS agent_id, CASE WHEN state = 1 AND hit = 1 THEN 2 ELSE state END::BIGINT AS state, 0::BIGINT AS dummy FROM t0 LEFT JOIN h ON src = id",
        "hierarchy_sir_two_hop": f"WITH {HIERARCHY}, "
        + ", ".join(
            f"h{k} AS (SELECT src, max(CASE WHEN state = 2 THEN 1 ELSE 0 END) AS hit FROM edges JOIN t{k} ON dst = id GROUP BY src), t{k + 1} AS (SELECT id, CASE WHEN state = 2 THEN 3 WHEN state = 1 AND hit = 1 THEN 2 ELSE state END::BIGINT AS state FROM t{k} LEFT JOIN h{k} ON src = id)"
            for k in range(2)
        )
        + " SELECT id AS agent_id, state, 2::BIGINT AS dummy FROM t2",
        "skipped_barriers": f"WITH {HIERARCHY}, "
        + ", ".join(
            f"h{k} AS (SELECT src, max(CASE WHEN state = 2 THEN 1 ELSE 0 END) AS hit FROM edges JOIN t{k} ON dst = id GROUP BY src), t{k + 1} AS (SELECT id, CASE WHEN state = 2 THEN 3 WHEN state = 1 AND hit = 1 THEN 2 ELSE state END::BIGINT AS state FROM t{k} LEFT JOIN h{k} ON src = id)"
            for k in range(2)
        )
        + " SELECT id AS agent_id, state, 2::BIGINT AS dummy FROM t2",
        "priority_buffered": CUSTOMER_COUNTERS.format(counter=10, result=0),
        "priority_in_place": CUSTOMER_COUNTERS.format(counter=10, result=20),
        "priority_last_writer": CUSTOMER_COUNTERS.format(counter="(CASE WHEN c_custkey % 3 = 0 THEN 20 ELSE 10 END)", result=0),
        "augassign_snapshot": CUSTOMER_COUNTERS.format(counter=15, result=0),
        "in_place_neighbor_read": f"WITH {RING} SELECT src AS agent_id, src % 7 AS counter, sum(dst % 7)::BIGINT AS result FROM edges GROUP BY src",
        "history_circular_buffer": f"{wave(4)} SELECT t4.id AS agent_id, t4.state, t3.state AS slot_0, t1.state AS slot_1, t2.state AS slot_2 FROM t4 JOIN t3 USING (id) JOIN t2 USING (id) JOIN t1 USING (id)",
        "history_pivot": f"{wave(3)} SELECT t0.id AS agent_id, t0.state::INTEGER AS tick_0, t1.state::INTEGER AS tick_1, t2.state::INTEGER AS tick_2, t3.state::INTEGER AS tick_3 FROM t0 JOIN t1 USING (id) JOIN t2 USING (id) JOIN t3 USING (id)",
        "event_recording": f"{wave(4, False)} SELECT k AS tick, id AS agent_id FROM (" + " UNION ALL ".join(f"SELECT {k}::BIGINT AS k, b.id FROM t{k} a JOIN t{k + 1} b USING (id) WHERE a.state = 1 AND b.state = 2" for k in range(4)) + ")",
        "set_property": "SELECT n_nationkey::BIGINT AS agent_id, CASE WHEN least(abs(n_nationkey - 3), abs(n_nationkey - 20)) <= 2 THEN 2 ELSE 1 END::BIGINT AS state FROM nation",
        "agents_with": "SELECT c_custkey AS agent_id, c_custkey % 5 AS state FROM customer WHERE c_custkey % 5 = 3",
        "breed_local_array": f"{wave(2, False)}, all_t AS (SELECT *, 0 AS k FROM t0 UNION ALL SELECT *, 1 FROM t1 UNION ALL SELECT *, 2 FROM t2), {SPREAD} SELECT id AS agent_id, sum(n) FILTER (k = 0)::BIGINT AS v_0, sum(n) FILTER (k = 1)::BIGINT AS v_1, sum(n) FILTER (k = 2)::BIGINT AS v_2 FROM seen GROUP BY id",
        "invisible_property_zero": f"WITH {RING} SELECT src AS agent_id, sum(CASE WHEN src % 4 = dst % 4 THEN dst % 10 + 1 ELSE 0 END)::BIGINT AS result FROM edges GROUP BY src",
        "message_send_sum": f"WITH {RING} SELECT dst AS agent_id, sum(src % 11)::BIGINT AS inbox FROM edges GROUP BY dst",
        "visible_in_one_breed": f"WITH {RING} SELECT src AS agent_id, sum(dst % 10 + 1)::BIGINT AS result FROM edges GROUP BY src",
        "periodic_snapshots": f"{wave(4, False)} SELECT 2::INTEGER AS tick, id AS agent_id, state FROM t2 UNION ALL SELECT 4::INTEGER, id, state FROM t4",
        "partition_from_dict": "WITH g AS (SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 4 < 2 THEN n_nationkey // 2 % 3 END AS r FROM nation), t AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) % 3 AS turn FROM g WHERE r IS NULL) "
        "SELECT id AS agent_id, coalesce(r, turn)::INTEGER AS rank FROM g LEFT JOIN t USING (id)",
        "single_links": f"WITH {RING}, few AS (SELECT n_nationkey::BIGINT AS id FROM nation WHERE n_nationkey % 3 = 0), k AS (SELECT src, dst FROM edges WHERE src NOT IN (SELECT id FROM few) AND dst NOT IN (SELECT id FROM few)) "
        "SELECT src, dst FROM k UNION SELECT id, 0 FROM few WHERE id <> 0 UNION SELECT 0, id FROM few WHERE id <> 0",
        "messages_two_breeds": f"WITH {RING} SELECT dst AS agent_id, sum(CASE WHEN src % 2 = 0 THEN src % 11 ELSE 10 * (src % 11) END)::BIGINT AS inbox FROM edges GROUP BY dst",
        "messages_by_priority": "WITH n AS (SELECT count(*) AS n FROM customer), e AS (SELECT DISTINCT c_custkey AS src, (c_custkey * a + b) % (SELECT n FROM n) AS dst FROM customer, (VALUES (7, 3), (5, 1)) v(a, b)) "
        "SELECT c_custkey AS agent_id, coalesce(sum(10 * (src % 11)) FILTER (src % 2 = 1), sum(src % 11) FILTER (src % 2 = 0), 0)::BIGINT AS inbox FROM customer LEFT JOIN e ON dst = c_custkey GROUP BY 1",
        "pandas_step_without_neighbors": f"WITH {RING} SELECT c_custkey AS agent_id, count(src) AS n FROM customer LEFT JOIN (SELECT DISTINCT src, dst FROM ring WHERE src % 3 = 0 AND dst % 2 = 0) r ON src = c_custkey GROUP BY 1",
        "reset_after_load": f"{wave(1, False)} SELECT id AS agent_id, state FROM t1 UNION ALL SELECT max(id) + 1, 5 FROM t1",
        "partition_multilevel": f"WITH {RING}, n AS (SELECT count(*) AS n FROM customer), c AS (SELECT count(*) FILTER (src * 4 // (SELECT n FROM n) <> dst * 4 // (SELECT n FROM n)) AS cut FROM edges) "
        "SELECT (SELECT n FROM n) AS n_agents, 4::BIGINT AS n_ranks, floor(1.3 * cut)::BIGINT AS bound, true AS within_bound, true AS balanced FROM c",
        "modularity_communities": "WITH n AS (SELECT count(*) AS n FROM customer), l AS (SELECT c_custkey AS a, c_custkey + d AS b FROM customer, (VALUES (1), (2), (3)) v(d) WHERE c_custkey // 25 = (c_custkey + d) // 25 AND c_custkey + d < (SELECT n FROM n) "
        "UNION ALL SELECT c_custkey, (c_custkey * 7 + 1) % (SELECT n FROM n) FROM customer WHERE c_custkey % 10 = 0 AND c_custkey // 25 <> (c_custkey * 7 + 1) % (SELECT n FROM n) // 25), "
        "p AS (SELECT DISTINCT least(a, b) // 25 AS x, greatest(a, b) // 25 AS y, least(a, b) AS a, greatest(a, b) AS b FROM l), ends AS (SELECT x AS c FROM p UNION ALL SELECT y FROM p), m AS (SELECT count(*)::DOUBLE AS m FROM p), "
        "v AS (SELECT c, count(*) AS k FROM ends GROUP BY c) SELECT (SELECT n FROM n) AS n_agents, round((SELECT count(*) FILTER (x = y) FROM p) / (SELECT m FROM m) - (SELECT sum(k::DOUBLE * k) FROM v) / (4 * (SELECT m * m FROM m)), 9) AS planted, true AS reached",
        "pandas_step": f"WITH {RING} SELECT src AS agent_id, list_sort(list(dst % 11))[len(list(dst % 11)) // 2 + 1]::BIGINT AS middle FROM edges GROUP BY src",
        "neighbor_folds": f"{FOLDED}, f AS (SELECT src, count(*) AS n, sum(p)::BIGINT AS total, max(p) AS most, min(p) AS least, max(CASE WHEN p > 500000 THEN 1 ELSE 0 END) AS rich, max(p) FILTER (rn = 1) AS first_one, max(p) FILTER (rn = 2) AS second_one, count(*) FILTER (p < 0) AS poor FROM j GROUP BY src) "
        "SELECT c_custkey AS agent_id, " + ", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("n", "total", "most", "least", "rich", "first_one", "second_one", "poor")) + " FROM customer LEFT JOIN f ON src = c_custkey",
        "third_neighbor": f"WITH {RING}, o AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS rn FROM edges) SELECT src AS agent_id, coalesce(max(dst) FILTER (rn = 3), 0)::BIGINT AS third, count(*) AS n FROM o GROUP BY src",
        "history_last_values": f"{wave(3)}, h AS ("
        + " UNION ALL ".join(f"SELECT {k}::INTEGER AS tick, id AS agent_id, state FROM t{k}" for k in range(4))
        + "), p AS (SELECT *, lag(state) OVER (PARTITION BY agent_id ORDER BY tick) AS previous_state FROM h) SELECT tick, agent_id, CASE WHEN previous_state IS NULL THEN state::VARCHAR ELSE previous_state || ',' || state END AS last_two, previous_state FROM p",
        "breed_ranges": "WITH n AS (SELECT c_nationkey AS breed, count(*) AS n FROM customer GROUP BY 1) SELECT breed, (sum(n) OVER (ORDER BY breed) - n)::BIGINT AS start, n FROM n",
        "rank_counts": "SELECT (c_custkey % 4)::INTEGER AS rank, c_nationkey AS breed, count(*) AS n FROM customer GROUP BY 1, 2",
        "widest_arrays": "SELECT max(len(embedding))::BIGINT AS embedding FROM embeddings",
        "community_packing": "WITH RECURSIVE n AS (SELECT c_nationkey AS g, count(*) AS n FROM customer GROUP BY 1), o AS (SELECT n, row_number() OVER (ORDER BY n DESC, g) AS k FROM n), "
        "p AS (SELECT 0::BIGINT AS k, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c UNION ALL SELECT o.k, CASE WHEN a <= b AND a <= c THEN a + n ELSE a END, CASE WHEN NOT (a <= b AND a <= c) AND b <= c THEN b + n ELSE b END, CASE WHEN NOT (a <= b AND a <= c) AND NOT b <= c THEN c + n ELSE c END FROM p JOIN o ON o.k = p.k + 1), "
        "l AS (SELECT * FROM p ORDER BY k DESC LIMIT 1) SELECT 0 AS rank, a AS n FROM l UNION ALL SELECT 1, b FROM l UNION ALL SELECT 2, c FROM l",
        "partition_precedence": "WITH g AS (SELECT c_custkey AS id, CASE WHEN c_custkey = 1 THEN 3 WHEN c_custkey > 1 AND c_custkey % 3 = 0 THEN c_custkey % 2 WHEN c_custkey % 5 = 1 THEN 2 END AS r FROM customer), "
        "t AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) % 4 AS r FROM g WHERE r IS NULL) SELECT g.id AS agent_id, coalesce(g.r, t.r)::INTEGER AS rank FROM g LEFT JOIN t USING (id)",
        "partition_from_file": "SELECT c_custkey AS agent_id, (c_custkey // 7 % 4)::INTEGER AS rank FROM customer",
        "agents_added_later": f"SELECT c_custkey AS agent_id, 3::BIGINT AS counter, 2::BIGINT AS result FROM customer UNION ALL SELECT s_suppkey + {SUPPLIER_BASE}, 1, 2 FROM supplier",
        "clock_reset": CUSTOMER_COUNTERS.format(counter=5, result=1),
        "saved_and_loaded": f"{wave(2, False)} SELECT id AS agent_id, state FROM t2",
        "dangling_neighbors": "WITH p AS (SELECT c_custkey AS id, c_custkey % 11 AS points FROM customer) SELECT a.id AS agent_id, count(b.id) AS n, coalesce(max(b.points), -1)::BIGINT AS most, coalesce(avg(b.points), -1)::DOUBLE AS mean, coalesce(min(CASE WHEN b.points % 2 = 0 THEN 1 WHEN b.id IS NOT NULL THEN 0 END), 1)::BIGINT AS even FROM p a LEFT JOIN p b ON b.id = a.id + 1 GROUP BY a.id",
        "own_array_in_folds": f"WITH {RING} SELECT src AS agent_id, sum(CASE WHEN dst % 11 > src % 11 THEN 1 ELSE 0 END)::BIGINT AS n FROM edges GROUP BY src",
        "breed_agent_ids": f"SELECT s_suppkey + {SUPPLIER_BASE} AS agent_id FROM supplier",
        "property_read": "SELECT v.id::BIGINT AS agent_id, (c_custkey * 3)::BIGINT AS state FROM (VALUES (2), (17), (-4)) v(id) LEFT JOIN customer ON c_custkey = v.id",
        "agents_with_python_predicate": "SELECT c_custkey AS agent_id, c_custkey % 5 AS state FROM customer WHERE c_custkey % 5 = 3 AND c_custkey > 10",
        "breed_order": "SELECT c_custkey AS agent_id, c_nationkey AS breed, row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS place FROM customer",
        "padded_arrays": "SELECT c_custkey AS agent_id, 6::BIGINT AS width, (5 - c_custkey % 4)::BIGINT AS padded, ((c_custkey % 4) * (c_custkey % 4 + 1) / 2)::DOUBLE AS total FROM customer",
        "scalar_functions_nan": "WITH b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS b FROM customer) SELECT id AS agent_id, CASE WHEN b IS NOT NULL THEN greatest(0.0::DOUBLE, least(5000.0::DOUBLE, b)) END AS clamped, CASE WHEN abs(b) > 1e-30 THEN 1.0::DOUBLE / b ELSE -1.0::DOUBLE END AS ratio, b + 0.25::DOUBLE * (100.0::DOUBLE - b) AS mixed, CASE WHEN b >= 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS step FROM b",
        "partition_balanced": "WITH t AS (SELECT count(*) AS n FROM customer), p AS (SELECT unnest(range(0, (SELECT n FROM t))) AS place) SELECT (place * 4 // (SELECT n FROM t))::INTEGER AS rank, count(*) AS n FROM p GROUP BY 1",
        # s: links after so many rounds; those that still have to move have their number in ``link``
        "small_world": f"WITH RECURSIVE c AS (SELECT count(*) AS n FROM customer), l AS (SELECT DISTINCT least(src, (src + d) % n) AS a, greatest(src, (src + d) % n) AS b, n FROM c, (SELECT unnest(range(0, (SELECT n FROM c))) AS src), (VALUES (1), (2)) v(d)), "
        f"m AS (SELECT a, b, a * (n + 1) + b AS link, {philox(42, 0, '(a * (n + 1) + b)', 1)} < 0.1 AS moves FROM l WHERE a <> b), "
        "s AS (SELECT 0::BIGINT AS r, a AS src, CASE WHEN NOT moves THEN b END AS dst, CASE WHEN moves THEN link END AS link FROM m UNION ALL SELECT r + 1, CASE WHEN won THEN p ELSE src END, CASE WHEN won THEN q ELSE dst END, CASE WHEN NOT won THEN link END FROM ("
        "SELECT *, coalesce(link IS NOT NULL AND p <> q AND NOT bool_or(link IS NULL) OVER w AND link = min(link) OVER w, false) AS won FROM (SELECT *, least(src, coalesce(far, dst)) AS p, greatest(src, coalesce(far, dst)) AS q, count(link) OVER () AS waiting FROM ("
        f"SELECT s.*, CASE WHEN link IS NOT NULL THEN floor({philox(42, 'r', 'coalesce(link, 0)', 2)} * n)::BIGINT END AS far FROM s, c)) WHERE waiting > 0 WINDOW w AS (PARTITION BY p, q))), "
        "k AS (SELECT src, dst FROM s WHERE r = (SELECT max(r) FROM s)) SELECT src, dst, 0::BIGINT AS pos FROM k UNION ALL SELECT dst, src, 0::BIGINT FROM k",
        "custom_folds": f"WITH {RING} SELECT src AS agent_id, round(exp(avg(ln(dst % 11 + 1))), 6) AS middle, count(DISTINCT dst % 11 % 3) AS kinds FROM edges GROUP BY src",
        "clustered_ring": f"WITH k AS (SELECT count(*) // 10 AS per FROM customer), a AS (SELECT src, d, per, 6 AS n, src // per * per AS base, {philox(42, 0, '(src * 6 + d)', 5)} AS u FROM k, (SELECT unnest(range(0, (SELECT per * 10 FROM k))) AS src), (SELECT unnest(range(0, 6)) AS d)), "
        "i AS (SELECT src, base + (src - base + 1 + floor(d * (per - 1) / 6) + floor(u * (floor((d + 1) * (per - 1) / 6) - floor(d * (per - 1) / 6))))::BIGINT % per AS dst FROM a), "
        f"w AS (SELECT c, r, x, per, {philox(42, 0, '((c * 2 + r - 1) * 20 + x)', 3)} AS u FROM k, (SELECT unnest(range(0, 10)) AS c), (SELECT unnest(range(1, 3)) AS r), (SELECT unnest(range(0, 20)) AS x)), "
        "p AS (SELECT c, r, per, (floor(x * per * per / 20) + floor(u * (floor((x + 1) * per * per / 20) - floor(x * per * per / 20))))::BIGINT AS p FROM w), "
        "o AS (SELECT src, dst FROM i WHERE src < dst UNION SELECT c * per + p // per, (c + r) % 10 * per + p % per FROM p) SELECT src, dst, 0::BIGINT AS pos FROM (SELECT src, dst FROM o UNION SELECT dst, src FROM o)",
        "edges_directed": f"WITH {LINKS} SELECT src, dst, pos FROM one",
        "edges_undirected": f"WITH {BOTH} SELECT src, dst, pos FROM edges",
        "edges_disconnect": f"WITH {BOTH} SELECT src, dst, pos FROM edges e WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.src % 5 = 0 AND ((o.src = e.src AND o.dst = e.dst) OR (o.dst = e.src AND o.src = e.dst)))",
        "degree": f"WITH {TRADE} SELECT c_custkey AS agent_id, count(dst) AS degree FROM customer LEFT JOIN links ON src = c_custkey GROUP BY c_custkey",
        "nth_neighbor": f"WITH {TRADE} SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS rn FROM links) WHERE rn = 3",
        "csr_offsets": f"WITH {TRADE}, d AS (SELECT c_custkey AS agent_id, count(dst) AS degree FROM customer LEFT JOIN links ON src = c_custkey GROUP BY c_custkey) SELECT agent_id, degree, (sum(degree) OVER (ORDER BY agent_id) - degree)::BIGINT AS \"offset\" FROM d",
        "csr_values": f"WITH {TRADE} SELECT row_number() OVER (ORDER BY src, dst) - 1 AS slot, src, dst FROM links",
        "philox_uniform": f"SELECT c_custkey AS agent_id, {philox(42, 5, 'c_custkey', 1)} AS u, {philox(42, 99, 'c_custkey', 2)} AS v FROM customer",
        "xorshift_uniform": f"SELECT c_custkey AS agent_id, {xorshift(42, 5, 'c_custkey', 1)} AS u FROM customer",
        "rand_normal": f"SELECT c_custkey AS agent_id, round({normal(42, 5, 'c_custkey', 1)}, 6) AS z FROM customer",
        "rand_normal_bounded": f"SELECT c_custkey AS agent_id, round(greatest(-0.5::DOUBLE, least(0.5::DOUBLE, {normal(42, 5, 'c_custkey', 1)})), 6) AS z FROM customer",
        "scalar_functions": "SELECT c_custkey AS agent_id, greatest(0.0::DOUBLE, least(5000.0::DOUBLE, c_acctbal)) AS clamped, CASE WHEN c_nationkey <> 0 THEN c_acctbal / c_nationkey ELSE -1.0::DOUBLE END AS ratio, c_acctbal + 0.25::DOUBLE * (100.0::DOUBLE - c_acctbal) AS mixed, CASE WHEN c_acctbal >= 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS step FROM customer",
        "initial_sample": f"SELECT c_custkey AS agent_id FROM customer ORDER BY {philox(42, 0, 'c_custkey', 9)}, c_custkey LIMIT 20",
        "partition_round_robin": "SELECT c_custkey AS agent_id, ((row_number() OVER (ORDER BY c_custkey) - 1) % 4)::INTEGER AS rank FROM customer",
        "partition_random": f"SELECT c_custkey AS agent_id, floor({philox(42, 0, 'c_custkey', 7)} * 4)::INTEGER AS rank FROM customer",
        "partition_balance": "WITH n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) SELECT count(*) AS n_ranks, min(n) AS least, max(n) AS most, avg(n) AS mean, (max(n) - min(n)) / avg(n) AS imbalance FROM n",
        "partition_edge_cut": f"WITH {RING}, {RANKS} SELECT count(*) AS n_edges, sum(CASE WHEN sr <> dr THEN 1 ELSE 0 END)::BIGINT AS n_cut, sum(CASE WHEN sr <> dr THEN 1 ELSE 0 END)::DOUBLE / count(*) AS cut_ratio, CASE WHEN avg(CASE WHEN sr <> dr THEN 1 ELSE 0 END) < 0.1 THEN 'excellent' WHEN avg(CASE WHEN sr <> dr THEN 1 ELSE 0 END) < 0.2 THEN 'good' WHEN avg(CASE WHEN sr <> dr THEN 1 ELSE 0 END) < 0.4 THEN 'fair' ELSE 'poor' END AS quality FROM r",
        "ghost_topology": f"WITH {RING}, {RANKS} SELECT DISTINCT sr AS rank, dst AS agent_id, dr AS owner FROM r WHERE sr <> dr",
        "comm_volume": f"WITH {RING}, {RANKS} SELECT sr AS rank, dr AS owner, count(DISTINCT dst) AS n_agents FROM r WHERE sr <> dr GROUP BY sr, dr",
        "partition_quality": f"WITH {RING}, {RANKS}, n AS (SELECT c_custkey % 4 AS rank, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT count(*) AS n_ranks, min(n) AS least, max(n) AS most, sum(n)::DOUBLE / 5 AS mean, sum(n)::BIGINT AS n_agents FROM n), c AS (SELECT count(*) AS n_edges, count(*) FILTER (sr <> dr) AS n_cut FROM r) "
        "SELECT n_ranks, least, most, mean, (most - least) / mean AS imbalance, n_edges, n_cut, n_cut::DOUBLE / n_edges AS cut_ratio, CASE WHEN n_cut < 0.1 * n_edges THEN 'excellent' WHEN n_cut < 0.2 * n_edges THEN 'good' WHEN n_cut < 0.4 * n_edges THEN 'fair' ELSE 'poor' END AS quality, n_agents, n_edges::DOUBLE / n_agents AS mean_neighbors FROM b, c",
    }
