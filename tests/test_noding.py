"""Noding and faces of whole layers, against the kernel and against what faces must add up to."""

import random

import numpy as np
import pytest

from lodestrata.functions import geometry as G
from lodestrata.operators import apply
from lodestrata.operators import geometry as O
from lodestrata.operators import noding as D
from lodestrata.operators.layer import GEOM, ROW, with_srid


def layer(spark, coords):
    rows = [(i, bytearray(G.to_wkb(G.line(c)))) for i, c in enumerate(coords)]
    return with_srid(spark.createDataFrame(rows, f"{ROW} long, {GEOM} binary"), 3857)


def bends(n, size=100):
    rng = random.Random(3)
    at = [(rng.randrange(size), rng.randrange(size)) for _ in range(n)]
    return [[(x, y), (x + 30, y), (x + 30, y + 40), (x + 31, y + 41)] for x, y in at]


def test_meetings_as_by_the_kernel():
    s = np.concatenate([np.concatenate([np.array(a[:-1], float), np.array(a[1:], float)], 1) for a in bends(60)])
    s = np.unique(np.concatenate([s, [(0, 0, 50, 0), (20, 0, 90, 0), (0, 5, 10, 5), (10, 5, 10, 90)]]), axis=0)
    swap = (s[:, 0] > s[:, 2]) | ((s[:, 0] == s[:, 2]) & (s[:, 1] > s[:, 3]))
    s[swap] = s[swap][:, [2, 3, 0, 1]]
    cuts = {i: [(0.0, tuple(a[:2])), (1.0, tuple(a[2:]))] for i, a in enumerate(s.tolist())}
    for i, t, p in D.meetings(s, 1e-9):
        for k, x, q in zip(i.tolist(), t.tolist(), p.tolist(), strict=True):
            cuts[k].append((x, tuple(q)))
    got = set()
    for c in cuts.values():
        p = [tuple(np.round(q, 6)) for _, q in sorted(c)]
        got |= {(min(a, b), max(a, b)) for a, b in zip(p, p[1:]) if a != b}
    assert got == {(tuple(a[:2]), tuple(a[2:])) for a in np.round(G.node_edges(s, 1e-9), 6).tolist()}


def test_node_lines_without_a_task_for_all(spark, monkeypatch):
    """Lines that touch were one group, noded in one task (F2)."""
    lines = bends(40)
    want = G.merge_lines([x.reshape(2, 2) for x in G.node_edges(G.segments(G.Shape("MultiLineString", parts=[G.line(a) for a in lines])), 1e-9)])
    monkeypatch.setattr(G, "node_edges", lambda *a: 1 / 0)
    got = [G.from_wkb(bytes(r[GEOM])) for r in apply("network_node_lines", layer(spark, lines * 3)).select(GEOM).collect()]
    assert sorted(round(G.length(g), 6) for g in got) == pytest.approx(sorted(round(G.length(G.line(a)), 6) for a in want), abs=1e-6)


@pytest.mark.parametrize("together", [True, False])
def test_faces_without_bound(spark, monkeypatch, together):
    """Layers beyond MOST_TOGETHER shapes were refused (F3); a slanted piece could be followed by itself, which lost area."""
    monkeypatch.setattr(O, "MOST_TOGETHER", 10)
    if not together:
        monkeypatch.setattr(D, "MOST_HALVES", 0)
    island = [[(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)], [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(0, 2), (3, 2)], [(6, 5), (8, 5)], [(20, 20), (21, 21)]]
    got = [G.from_wkb(bytes(r[GEOM])) for r in apply("polygonize", layer(spark, island * 4)).collect()]
    assert sorted((G.area(g), len(g.rings)) for g in got) == [(4.0, 1), (96.0, 2)]
    if together:
        lines = bends(40, 60)
        e = G.node_edges(G.segments(G.Shape("MultiLineString", parts=[G.line(a) for a in lines])), 1e-9)
        got = [G.from_wkb(bytes(r[GEOM])) for r in apply("polygonize", layer(spark, lines)).collect()]
        nodes = {n: n for n in map(tuple, e.reshape(-1, 2).tolist())}

        def root(n):
            while nodes[n] != n:
                n = nodes[n]
            return n

        for x in e.tolist():
            nodes[root(tuple(x[:2]))] = root(tuple(x[2:]))
        assert len(got) == len(e) - len(nodes) + sum(nodes[n] == n for n in nodes)  # Euler: edges, nodes, components
