"""What large tables showed: small cases of the same kind."""

import time

import numpy as np
import pandas as pd

from lodestrata.functions import geometry as G
from lodestrata.operators import apply
from lodestrata.operators import layer as L
from lodestrata.operators import network as N
from lodestrata.operators import spatial as S
from lodestrata.operators.geometry import _longest_out
from lodestrata.operators.stats import hdbscan
from lodestrata.operators.layer import GEOM, ROW, make_line, make_point, with_srid


def points(spark, xy):
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)]
    return with_srid(spark.createDataFrame(rows, f"{ROW} long, x double, y double").withColumn(GEOM, make_point("x", "y")), 3857)


def test_cells_of_a_narrow_extent(spark):
    """A cell of such points held their whole width, so each met all those within it (F14)."""
    p = points(spark, [(i % 10, i) for i in range(2000)]).withColumn("box", L.bbox(GEOM))
    assert L.cell_size(p) < 10


def test_two_point_lines(spark):
    t = pd.DataFrame({"a": [0.0, 3.5], "b": [1.0, -2.0], "c": [5.0, 1.0], "d": [-1.0, 8.0]})
    out = spark.createDataFrame(t).withColumn(GEOM, make_line("a", "b", "c", "d")).collect()
    for r in out:
        assert bytes(r[GEOM]) == G.to_wkb(G.line([(r.a, r.b), (r.c, r.d)]))
    assert np.array_equal(L.two_point(pd.Series([bytes(r[GEOM]) for r in out])), [[r.a, r.b, r.c, r.d] for r in out])
    assert L.two_point(pd.Series([G.to_wkb(G.line([(0, 0), (1, 1), (2, 0)]))])) is None


def test_hulls_of_many_points():
    """Quadratic before: 1500 points took far over ten seconds in either hull (F2, F4)."""
    p = np.random.default_rng(1).uniform(0, 1000, (1500, 2))
    t = time.perf_counter()
    tri = G.delaunay(p)
    for limit, sides in ((60.0, False), (0.05, True)):
        g = _longest_out(p, limit, sides)
        assert 0 < G.area(g) < G.area(G.hull(p))
    assert time.perf_counter() - t < 10
    assert sum(abs((p[b] - p[a])[0] * (p[c] - p[a])[1] - (p[b] - p[a])[1] * (p[c] - p[a])[0]) / 2 for a, b, c in tri) > 0.99 * G.area(G.hull(p))
    some = G.delaunay(p[:60])
    assert abs(G.area(G.area_of_triangles(p, some)) - G.area(G.union([G.polygon(p[list(x)]) for x in some]))) < 1e-6


def lines(spark, coords):
    rows = [(i, bytearray(G.to_wkb(G.line(c)))) for i, c in enumerate(coords)]
    return with_srid(spark.createDataFrame(rows, f"{ROW} long, {GEOM} binary"), 3857)


def shapes_of(out):
    return sorted(sorted([tuple(map(float, p)) for p in G.from_wkb(bytes(r[GEOM])).coords]) for r in out.select(GEOM).collect())


def no_pairs(monkeypatch, *modules):
    """Pairs of all lines whose boxes meet, exactly tested: what took the time."""

    def refuse(left, right, predicate="intersects", *rest):
        assert left.columns == right.columns and False, "every pair of lines is tested"

    for m in modules:
        monkeypatch.setattr(m, "pairs", refuse)


def test_duplicates_without_pairs_of_all_lines(spark, monkeypatch):
    """(F9)"""
    no_pairs(monkeypatch, N)
    df = lines(spark, [[(0, 0), (5, 5)], [(0, 0), (5, 5)], [(0, 0.005), (5, 5)], [(0, 0.013), (5, 5)], [(0, 0), (5, 5)], [(0, 5), (5, 0)], [(5, 5), (0, 0)]])
    assert sorted(r[ROW] for r in apply("network_remove_duplicates", df, tolerance=0.01).collect()) == [0, 3, 5]


def test_dangles_look_from_their_ends(spark, monkeypatch):
    """Crossings far from the ends and copies bring no pairs (F10)."""
    seen = []
    real = L.pairs
    monkeypatch.setattr(N, "pairs", lambda *a: seen.append(real(*a)) or seen[-1])
    fan = [[(0, i), (1000, 1000 - i)] for i in range(0, 1000, 50)]
    df = lines(spark, [*fan, [(300, -3), (300, -500)], [(-5, 0), (900, 0)], [(7, 7), (8, -90)], [(7, 7), (8, -90)]])
    got = {r[ROW]: G.from_wkb(bytes(r[GEOM])).coords.tolist() for r in apply("network_extend_dangles", df, tolerance=5.0).collect()}
    assert got[20] == [[300, 0], [300, -500]] and got[22] == got[23] == [[7, 7], [8, -90]] and got[3] == [[0, 150], [1000, 850]]
    assert seen[0].count() < 60  # the ends and their own lines; lines meet lines more than 400 times


def test_chains_without_pairs_of_all_lines(spark, monkeypatch):
    """Chains through nodes of two ends, not through those that other chains' lines make three (F11)."""
    no_pairs(monkeypatch, N)
    df = lines(spark, [[(0, 0), (1, 0)], [(2, 0), (1, 0)], [(2, 0), (3, 0)], [(2, 0), (2, 5)], [(3, 0), (4, 1)], [(9, 9), (8, 8), (9, 8), (9, 9)], [(0.5, -1), (0.5, 1)]])
    assert shapes_of(apply("network_remove_pseudo_nodes", df)) == sorted(map(sorted, [[(0, 0), (1, 0), (2, 0)], [(2, 0), (3, 0), (4, 1)], [(2, 0), (2, 5)], [(9, 9), (8, 8), (9, 8), (9, 9)], [(0.5, -1), (0.5, 1)]]))


def test_rings_once(spark, monkeypatch):
    """Copies of places and of rings bring no pairs of their own (F5)."""
    seen = []
    real = L.pairs
    monkeypatch.setattr(S, "pairs", lambda *a: seen.append(real(*a)) or seen[-1])
    p = points(spark, [(i % 3 * 10, 0) for i in range(30)])
    rings = spark.createDataFrame([(float(v), bytearray(G.to_wkb(G.box(-1, -1, w, 1)))) for v, w in [(2, 25), (1, 5), (3, 5), (4, 25)] * 5], f"cost_budget double, {GEOM} binary")
    out = apply("classify_by_ring", p, ref_gdfs=[with_srid(rings, 3857)]).collect()
    assert sorted((r[ROW], r.ring_value, r.ring_class) for r in out) == [(i, 1.0, 1) if i % 3 == 0 else (i, 2.0, 2) for i in range(30)]
    assert seen[0].count() == 4


def test_moran_keeps_its_links_in_tasks(spark, monkeypatch):
    """The p-value by the same seeded shuffles over all links; only the values reach the driver (F1)."""
    from pyspark.sql.classic.dataframe import DataFrame

    real = DataFrame.toPandas
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: real(self) if set(self.columns) == {"r", "z"} else 1 / 0)
    xy = np.array([(i * 37 % 101, i * 53 % 97) for i in range(60)], float)
    v = xy[:, 0] + np.arange(60) % 7
    p = points(spark, xy).join(spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], f"{ROW} long, v double"), ROW)
    got = apply("morans_i", with_srid(p, 3857), field="v", method="distance_band", threshold=25.0, permutations=99).first()
    near = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1)) <= 25
    np.fill_diagonal(near, False)
    w = near / np.maximum(near.sum(1, keepdims=True), 1)
    z = v - v.mean()
    moran = lambda y: 60 / w.sum() * (y @ w @ y) / (z @ z)
    rng = np.random.default_rng(42)
    sims = np.array([moran(rng.permutation(z)) for _ in range(99)])
    more = int((sims >= moran(z)).sum())
    assert np.isclose(got.morans_i, moran(z)) and got.n_links == near.sum() and np.isclose(got.p_value, (min(more, 99 - more) + 1) / 100)
    assert np.isclose(got.z_score, (moran(z) - sims.mean()) / sims.std())


def test_hdbscan_of_many_rows_at_few_places():
    """21 000 rows, which were refused: three places' groups, each place with copies (F12)."""
    rng = np.random.default_rng(3)
    u = np.concatenate([rng.normal(c, 1, (100, 2)) for c in ((0, 0), (100, 0), (0, 100))])
    label, prob = hdbscan(np.tile(u, (70, 1)), 2000, 100)
    assert set(label[:100]) - {-1} != set() and all(len(set(label[i::300])) == 1 for i in range(300))
    assert len({max(set(label[k : k + 100].tolist()), key=label[k : k + 100].tolist().count) for k in (0, 100, 200)}) == 3 and prob.max() == 1


def test_hdbscan_row_limit(spark):
    df = points(spark, [(i % 5 * 10 + i % 5 % 2, i % 5) for i in range(20_001)])
    assert apply("cluster_hdbscan", df, min_cluster_size=5).count() == 20_001


def test_noding_of_copies():
    """Copies of an edge met each other and all that the edge meets: the square of their number (F8, F13)."""
    s = np.array([(0, 5, 10, 5), (5, 0, 5, 10), (0, 0, 10, 10)], float)
    t = time.perf_counter()
    assert np.array_equal(G.node_edges(np.tile(s, (1000, 1)), 1e-9), G.node_edges(s, 1e-9))
    assert time.perf_counter() - t < 2
