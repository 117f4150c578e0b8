"""The nearest of many long lines, whose boxes all meet, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import geometry as G
from lodestrata.operators import apply
from lodestrata.operators import layer as L
from lodestrata.operators.layer import GEOM, ROW, with_srid

RNG = np.random.default_rng(5)
POINTS = [G.point(*p) for p in [*RNG.uniform(0, 1000, (150, 2)), (400, 400), (400, 400), (-5000, 7000), (20000, 3), *RNG.normal(700, 0.01, (60, 2))]]
LINES = [G.line(p) for p in RNG.uniform(0, 1000, (120, 2, 2))]
LINES += [G.line(RNG.uniform(0, 1000, (5, 2))), G.collect([G.line(RNG.uniform(0, 1000, (3, 2))) for _ in range(2)]), G.point(699.999, 700), G.line([(30000, 0), (30000, 9000)])]
LINES += LINES[:40] + [G.line([(0, 1.5 * i), (1000, 1000 - 1.5 * i)]) for i in range(60)]


def layer(spark, shapes):
    rows = [(i, None if g is None else bytearray(G.to_wkb(g))) for i, g in enumerate(shapes)]
    return with_srid(spark.createDataFrame(rows, f"{ROW} long, {GEOM} binary").repartition(3), 3857)


@pytest.fixture
def no_pairs(monkeypatch):
    """Points and lines may not be paired by the cells of their boxes; small parts, so that there are many."""
    monkeypatch.setattr(L, "pairs", lambda *a: 1 / 0)
    monkeypatch.setattr(L, "PART", 3, raising=False)


def want(points=POINTS, lines=LINES):
    """The nearest line, the first of equals, and its distance."""
    d = np.array([[G.distance(p, g) for g in lines] for p in points])
    return [(int(r.argmin()), r.min()) for r in d]


def test_nearest_place_on_long_lines(spark, no_pairs):
    """(F6)"""
    got = {r[ROW]: r for r in apply("ftth_nearest_node", layer(spark, [*POINTS, None, G.from_wkt("POINT EMPTY")]), road_network=layer(spark, LINES), max_distance_m=3).collect()}
    assert len(got) == len(POINTS) + 2
    for i, (line, d) in enumerate(want()):
        r = got[i]
        assert r.snap_distance == pytest.approx(d, abs=1e-9) and r.snap_status == ("snapped" if d <= 3 else "too_far")
        place = G.nearest_point(LINES[line], POINTS[i].coords[0, :2]) if d <= 3 else POINTS[i].coords[0]
        assert np.allclose(G.from_wkb(bytes(r[GEOM])).coords[0], place)
    assert {got[len(POINTS) + k].snap_status for k in (0, 1)} == {"no_network"}
    assert {r.snap_status for r in got.values()} == {"snapped", "too_far", "no_network"}


def test_nearest_line_of_copies(spark, no_pairs):
    """Of equal lines the smaller row, and only those near enough."""
    got = {(r[ROW], r.other, r.nn_distance) for r in apply("nearest_neighbor", layer(spark, POINTS), ref_gdf=layer(spark, LINES).selectExpr("*", f"{ROW} as other"), max_distance=2.5).collect()}
    assert {x[:2] for x in got} == {(i, j) for i, (j, d) in enumerate(want()) if d <= 2.5}
    none = apply("nearest_neighbor", layer(spark, POINTS), ref_gdf=layer(spark, [G.from_wkt("LINESTRING EMPTY"), None]).selectExpr("*", f"{ROW} as other")).collect()
    assert len(none) == len(POINTS) and {r.other for r in none} == {None}


def test_measure_on_long_lines(spark, no_pairs):
    """(F7)"""
    lines = [g for g in LINES if g.dim == 1]
    got = {r[ROW]: r for r in apply("line_locate_point", layer(spark, POINTS), ref_gdf=layer(spark, lines)).collect()}
    assert len(got) == len(POINTS)
    for i, (line, _) in enumerate(want(lines=lines)):
        p, done, best = POINTS[i].coords[0, :2], 0.0, (np.inf, 0.0)
        for c in lines[line].arrays():
            d, m = G.measure(c, p)
            best, done = min(best, (d, done + m)), done + G._length(c)
        assert got[i].ref_index == line and got[i].measure == pytest.approx(best[1], abs=1e-9)


def test_lines_are_computed_once(spark, no_pairs):
    """What makes the lines may be dear."""
    lines, made = [g for g in LINES if g.dim == 1], spark.sparkContext.accumulator(0)

    @F.udf("binary")
    def told(g):
        made.add(1)
        return g

    ref = with_srid(layer(spark, lines).withColumn(GEOM, told(GEOM)), 3857)
    assert len(apply("line_locate_point", layer(spark, POINTS), ref_gdf=ref).collect()) == len(POINTS)
    assert made.value == len(lines)
