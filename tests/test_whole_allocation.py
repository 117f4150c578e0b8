"""Allocation over whole networks: all nodes with a way to a hub."""

import heapq
import random

import pytest

from lodestrata import queries as Q
from lodestrata.functions import geometry as G
from lodestrata.operators import apply
from lodestrata.operators import costs as C
from lodestrata.operators import network as N
from lodestrata.operators.layer import GEOM, ROW, with_srid


def nearest(links, starts):
    """node: least (cost, label)."""
    arcs, best, todo = {}, {}, [(c, k, n) for n, k, c in starts]
    for u, v, w in links:
        arcs.setdefault(u, []).append((v, w))
        arcs.setdefault(v, []).append((u, w))
    heapq.heapify(todo)
    while todo:
        c, k, n = heapq.heappop(todo)
        if n not in best:
            best[n] = (c, k)
            for m, w in arcs.get(n, []):
                heapq.heappush(todo, (c + w, k, m))
    return best


@pytest.mark.parametrize("together", [True, False])
def test_least_costs(spark, monkeypatch, together):
    """In one task and in rounds of joins, with ties, starts away from all links and links without a cost."""
    if not together:
        monkeypatch.setattr(C, "MOST_LINKS", 0)
    rng = random.Random(5)
    links = [(k, k + s, float(rng.randint(0, 9))) for k in range(40) for s in (1, 3) if k + s < 40 and k != 20]
    starts = [(0, 7, 0.0), (38, 3, 0.0), (39, 2, 5.0), (5000, 6, 0.0)]
    got = C.least_costs(spark.createDataFrame([*links, (5, 9, None)], "u long, v long, w double"), spark.createDataFrame(starts, "node long, label long, cost double"), 25.0).collect()
    want = {n: x for n, x in nearest(links, starts).items() if x[0] <= 25}
    assert {r.node: (r.cost, r.label) for r in got} == want and len(got) == len(want)


def test_ways_are_not_followed_link_by_link(spark, monkeypatch):
    """600 lines in a row took 600 rounds of joins (F1)."""
    monkeypatch.setattr(N, "relax", lambda *a: 1 / 0)
    lines = with_srid(spark.createDataFrame([(k, 1.0 + k % 3, bytearray(G.to_wkb(G.line([(k, 0), (k + 1, 0)])))) for k in range(600)], f"{ROW} long, w double, {GEOM} binary"), 3857)
    at = lambda rows: with_srid(spark.createDataFrame([(k, n, bytearray(G.to_wkb(G.point(x, y)))) for k, n, x, y in rows], f"{ROW} long, id string, {GEOM} binary"), 3857)
    places = at([(0, "on", 600.0, 0.0), (1, "off", 12.2, 3.0), (2, "hub", 0.0, 0.0)])
    got = apply("network_allocation", places, network_gdf=lines, hubs_gdf=at([(8, "a", 0.0, 0.0), (9, "b", 20.0, 0.1)]), weight_col="w").collect()
    cost = lambda a, b: sum(1.0 + k % 3 for k in range(a, b))
    assert {r.id: (r.allocated_hub_id, r.allocation_cost) for r in got} == {"on": ("b", cost(20, 600)), "off": ("b", cost(12, 20)), "hub": ("a", 0.0)}


def test_query_has_no_limit_of_cost(spark, tmp_path):
    """All parts linked to a hub are allocated (F4)."""
    spark.range(700).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    links = [(k, k + s, 1.0 + k * 31 % 97) for k in range(700) for s in (1, 7) if k + s < 700]
    want = nearest(links, [(h, h, 0.0) for h in (1, 100, 200)])
    got = Q.QUERIES["network_allocation"](spark, str(tmp_path)).collect()
    assert {r.p_partkey: (r.allocation_cost, r.allocated_hub_id) for r in got} == want and max(x[0] for x in want.values()) > 200
