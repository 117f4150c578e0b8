"""Queries over the lines of parts give every part, vertex by vertex."""

import math

import pytest

from lodestrata import queries as Q

N = 350


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("lines"))
    spark.range(N).withColumnRenamed("id", "p_partkey").write.parquet(f"{d}/part.parquet")
    return d


def bend(k):
    x, y = k * 7919 % 10007, k * 104729 % 10007
    return [(x, y), (x + 300, y), (x + 300, y + 400), (x + 310, y + 405)]


def swapped(p):
    return [(y, x) for x, y in p]


def middle_half(p):
    n = sum(math.dist(a, b) for a, b in zip(p, p[1:], strict=False)) / 4
    return [(p[0][0] + n, p[0][1]), p[1], (p[1][0], p[1][1] + 3 * n - 300)]


def cut_corners(p):
    mid = [(a[0] * s + b[0] * (1 - s), a[1] * s + b[1] * (1 - s)) for a, b in zip(p, p[1:], strict=False) for s in (0.75, 0.25)]
    return [p[0], *mid, p[-1]]


@pytest.mark.parametrize(("name", "f"), [("swap_xy", swapped), ("reverse_lines", lambda p: p[::-1]), ("line_substring", middle_half), ("chaikin_smooth", cut_corners), ("simplify", lambda p: [p[0], p[1], p[3]])])
def test_every_part(spark, folder, name, f):
    got = {r.p_partkey: r for r in Q.QUERIES[name](spark, folder).collect()}
    assert set(got) == set(range(N))
    for k, r in got.items():
        p = f(bend(k))
        want = [len(p), *p[0], *p[-1], sum(x for x, _ in p), sum(y for _, y in p), 0, 0, 0]
        assert list(r)[1:] == pytest.approx(want, abs=1e-5)
