"""The network queries over a part table with more than 400 rows and keys past the lattice, against brute force."""

import heapq

import pytest

from lodestrata import queries as Q

KEYS = [*range(1, 421), *range(10000, 10031)]
EDGES = {k * 10 + s: (k, k + s, 1.0 + k * 31 % 97) for k in KEYS for s in (1, 7) if k + s in set(KEYS)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("network"))
    spark.createDataFrame([(k,) for k in KEYS], "p_partkey long").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(k,) for k in range(1, 8)], "s_suppkey long").write.parquet(f"{d}/supplier.parquet")
    return d


def costs(start):
    best, todo = {}, [(0.0, start)]
    arcs = {}
    for u, v, w in EDGES.values():
        arcs.setdefault(u, []).append((v, w))
        arcs.setdefault(v, []).append((u, w))
    while todo:
        c, n = heapq.heappop(todo)
        if n not in best:
            best[n] = c
            for m, w in arcs.get(n, []):
                heapq.heappush(todo, (c + w, m))
    return best


def rows(spark, d, name):
    return sorted(tuple(r) for r in Q.QUERIES[name](spark, d).collect())


def test_network_is_of_all_parts(spark, folder):
    got = Q.network(spark, folder).select(Q.ROW, "p_partkey", "other", "w").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == EDGES
    assert rows(spark, folder, "connectivity_check") == [(False, 2, len(KEYS), len(EDGES))]


def test_costs(spark, folder):
    assert rows(spark, folder, "network_costs") == sorted((n, c) for n, c in costs(1).items() if c <= 150)
    assert sorted((a, b, c) for a, b, c in rows(spark, folder, "od_matrix")) == sorted((a, b, costs(a)[b]) for a in (1, 5, 9) for b in (1, 5, 9) if a != b)
    path = rows(spark, folder, "shortest_path")
    assert max(r[3] for r in path) == costs(1)[2]


def test_isochrone(spark, folder):
    c = costs(1)
    want = [(e, min(c.get(u, 1e9), c.get(v, 1e9)), b) for e, (u, v, _) in EDGES.items() for b in (50.0, 100.0)]
    assert rows(spark, folder, "isochrone") == sorted(x for x in want if x[1] <= x[2])


def test_allocation_is_of_all_parts(spark, folder):
    want = []
    for k in KEYS:
        c, hub = min((costs(h).get(k, 1e9), h) for h in (1, 100, 200))
        want.append((k, hub, c, True) if c <= 200 else (k, None, None, False))
    assert sorted(map(tuple, Q.QUERIES["network_allocation"](spark, folder).collect()), key=lambda r: r[0]) == want


def test_points_meet_all_lines(spark, folder):
    """Suppliers that lie on parts past 400."""
    at = {k: (k * 7919 % 10007, k * 104729 % 10007 + k // 10007 * 10007) for k in KEYS}

    def off(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
        return ((p[0] - a[0] - t * dx) ** 2 + (p[1] - a[1] - t * dy) ** 2) ** 0.5

    far = str(folder) + "_far"
    spark.createDataFrame([(k,) for k in KEYS if k <= 30 or k > 400], "p_partkey long").write.mode("overwrite").parquet(f"{far}/part.parquet")
    spark.createDataFrame([(k,) for k in range(401, 415)], "s_suppkey long").write.mode("overwrite").parquet(f"{far}/supplier.parquet")
    kept = {e: x for e, x in EDGES.items() if not 30 < x[0] <= 400 and not 30 < x[1] <= 400}
    for s, m, e in rows(spark, far, "line_locate_point"):
        p = at[s]
        assert off(p, at[kept[e][0]], at[kept[e][1]]) == pytest.approx(min(off(p, at[u], at[v]) for u, v, _ in kept.values()), abs=1e-6)


@pytest.mark.parametrize("end", [60])
def test_shortest_path_edge_by_edge(spark, folder, end):
    """Consecutive edges from the start to the end, with the costs so far, which end at the least one."""
    x, y = end * 7919 % 10007, end * 104729 % 10007
    path = Q.apply("shortest_path", Q.network(spark, folder), start_x=7919.0, start_y=4659.0, end_x=float(x), end_y=float(y), weight_col="w").select("p_partkey", "step", "path_order", "path_cost").collect()
    at, cost = 1, 0.0
    assert [r.path_order for r in path] == list(range(len(path)))
    for r in path:
        u, v, w = EDGES[r.p_partkey * 10 + r.step]
        at, cost = (v if at == u else u), cost + w
        assert r.path_cost == cost
    assert at == end and cost == costs(1)[end]


def test_no_path(spark, folder):
    """From part 10005 to part 1, which is in another component."""
    x, y = 10005 * 7919 % 10007, 10005 * 104729 % 10007
    assert Q.apply("shortest_path", Q.network(spark, folder), start_x=float(x), start_y=float(y), end_x=7919.0, end_y=4659.0, weight_col="w").count() == 0
