"""Lines of a whole layer split where they meet, and the faces between them, without a task that holds them all.

Segments meet in the cells of a grid that they pass through; a piece is a row (x0, y0, x1, y1) from its smaller end. Faces are the
rings that half-edges form when each is followed by the next one to the left, found as connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .graph import components, cut
from .layer import GEOM, ROW, pairs, shapes, with_srid

_SEGMENT = "x0 double, y0 double, x1 double, y1 double"
_AT = ["x0", "y0", "x1", "y1"]
#: Pairs of segments that are compared at once, and half-edges whose rings one task tells.
AT_ONCE, MOST_HALVES = 500_000, 4_000_000


def segments(df: DataFrame) -> DataFrame:
    """The segments of lines and rings, each once, from the smaller end; those without length go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            s = [G.segments(G.from_wkb(w)) for w in t[GEOM]]
            e = np.concatenate([np.zeros((0, 4)), *s]) + 0.0
            e = e[(e[:, :2] != e[:, 2:]).any(1) & np.isfinite(e).all(1)]
            swap = (e[:, 0] > e[:, 2]) | ((e[:, 0] == e[:, 2]) & (e[:, 1] > e[:, 3]))
            e[swap] = e[swap][:, [2, 3, 0, 1]]
            yield pd.DataFrame(e, columns=_AT)

    one = df.where(F.col(GEOM).isNotNull()).select(GEOM).distinct()  # copies of a line bring nothing
    return cut(one.mapInPandas(run, _SEGMENT).distinct().withColumn("s", F.monotonically_increasing_id()))


def _cells(e: np.ndarray, size: float, tol: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, and the cells that they pass through: column by column, the rows of cells there."""
    low, high = np.floor((e[:, 0] - tol) / size).astype(np.int64), np.floor((e[:, 2] + tol) / size).astype(np.int64)
    n = high - low + 1
    i = np.repeat(np.arange(len(e)), n)
    cx = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[i]
    d = e[i, 2:] - e[i, :2]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = [np.where(d[:, 0] > 0, np.clip(((cx + k) * size + (2 * k - 1) * 2 * tol - e[i, 0]) / d[:, 0], 0, 1), k) for k in (0, 1)]
    y = np.sort([e[i, 1] + x * d[:, 1] for x in t], axis=0)
    bottom, top = np.floor((y[0] - 2 * tol) / size).astype(np.int64), np.floor((y[1] + 2 * tol) / size).astype(np.int64)
    m = top - bottom + 1
    j = np.repeat(np.arange(len(i)), m)
    return i[j], cx[j], np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + bottom[j]


def meetings(e: np.ndarray, tol: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of e that another one cuts, the share of their length at which, and the place: where both cross, or where the other ends on it."""
    e_order = np.lexsort(e.T[::-1])
    s = e[e_order]  # by x0: of a pair the same one comes first in each cell
    d = s[:, 2:] - s[:, :2]
    size = np.hypot(*d.T)
    low, high = np.minimum(s[:, 1], s[:, 3]) - tol, np.maximum(s[:, 1], s[:, 3]) + tol
    n = np.searchsorted(s[:, 0], s[:, 2] + 2 * tol, side="right") - np.arange(len(s)) - 1
    done = 0
    while done < len(s):
        upto = max(done + 1, int(np.searchsorted(np.cumsum(n[done:]), AT_ONCE, side="right")) + done)
        k = n[done:upto]
        a = np.repeat(np.arange(done, upto), k)
        b = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + a + 1
        done = upto
        near = (low[a] <= high[b]) & (low[b] <= high[a])
        a, b = a[near], b[near]
        r = s[b, :2] - s[a, :2]
        cross = d[a, 0] * d[b, 1] - d[a, 1] * d[b, 0]
        skew = np.abs(cross) > 1e-12 * size[a] * size[b]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (r[:, 0] * d[b, 1] - r[:, 1] * d[b, 0]) / cross, (r[:, 0] * d[a, 1] - r[:, 1] * d[a, 0]) / cross
            ta, tb = tol / np.maximum(size[a], tol), tol / np.maximum(size[b], tol)
            hit = skew & (t >= -ta) & (t <= 1 + ta) & (u >= -tb) & (u <= 1 + tb)
        i, j, t, u, ta, tb = a[hit], b[hit], np.clip(t[hit], 0, 1), np.clip(u[hit], 0, 1), ta[hit], tb[hit]
        p = s[i, :2] + t[:, None] * d[i]
        for c in (0, 1):  # lines along an axis have the coordinate itself
            p[:, c] = np.where(d[i, c] == 0, s[i, c], np.where(d[j, c] == 0, s[j, c], p[:, c]))
        for w, x, near_end in ((j, u, tb), (i, t, ta)):
            p = np.where((x <= near_end)[:, None], s[w, :2], np.where((x >= 1 - near_end)[:, None], s[w, 2:], p))
        yield e_order[i], t, p
        yield e_order[j], u, p
        for i, j in ((a, b), (b, a)):
            for q in (s[j, :2], s[j, 2:]):
                rel = q - s[i, :2]
                x = (rel * d[i]).sum(1) / size[i] ** 2
                on = (np.hypot(*(rel - x[:, None] * d[i]).T) <= tol) & (x > 0) & (x < 1)
                yield e_order[i[on]], x[on], q[on]


def noded(segs: DataFrame, tol: float) -> DataFrame:
    """Pieces of segments (s, x0, y0, x1, y1) between the places where they meet, each once. Places nearer than four tolerances are one."""
    side = segs.agg(F.avg(F.greatest(F.col("x1") - F.col("x0"), F.abs(F.col("y1") - F.col("y0")))), F.max("x1") - F.min("x0"), F.max(F.greatest("y0", "y1")) - F.min(F.least("y0", "y1"))).first()
    size = max(2 * (side[0] or 0.0), max(side[1] or 0.0, side[2] or 0.0) * 1e-6, 100 * tol)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            i, cx, cy = _cells(t[_AT].to_numpy(float), size, tol)
            yield t.iloc[i].assign(cx=cx, cy=cy)

    def meet(t: pd.DataFrame) -> pd.DataFrame:
        got = list(meetings(t[_AT].to_numpy(float), tol))
        i, x, p = (np.concatenate(k) for k in zip(*got, strict=True)) if got else (np.zeros(0, int), np.zeros(0), np.zeros((0, 2)))
        return pd.DataFrame({"s": t["s"].to_numpy()[i], "t": x, "x": p[:, 0] + 0.0, "y": p[:, 1] + 0.0}).drop_duplicates(["s", "x", "y"])

    cuts = segs.mapInPandas(spread, f"{_SEGMENT}, s long, cx long, cy long").groupBy("cx", "cy").applyInPandas(meet, "s long, t double, x double, y double")
    ends = segs.select("s", F.lit(0.0).alias("t"), F.col("x0").alias("x"), F.col("y0").alias("y")).unionByName(segs.select("s", F.lit(1.0).alias("t"), F.col("x1").alias("x"), F.col("y1").alias("y")))
    marks = cut(ends.unionByName(cuts).groupBy("s", "x", "y").agg(F.min("t").alias("t")))
    moved = _moves(marks.select("x", "y").distinct(), 4 * tol)
    if moved is not None:
        marks = marks.join(moved, ["x", "y"], "left").select("s", "t", F.coalesce("nx", "x").alias("x"), F.coalesce("ny", "y").alias("y")).groupBy("s", "x", "y").agg(F.min("t").alias("t"))
    along = Window.partitionBy("s").orderBy("t", "x", "y")
    p = marks.select(F.struct("x", "y").alias("a"), F.lead(F.struct("x", "y")).over(along).alias("b")).where("b is not null and a <> b")
    p = p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return cut(p.select(F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1")))


def _moves(places: DataFrame, eps: float) -> DataFrame | None:
    """x, y, nx, ny: places that are near others, directly or by way of others, and the smallest of them. None if there are none."""
    from .stats import near_points

    places = cut(places.withColumn(ROW, F.xxhash64("x", "y")))
    close = cut(near_points(places, eps).select("a", "b"))
    if close.isEmpty():
        return None
    group = cut(components(close).join(places, F.col("node") == F.col(ROW)).select("root", "x", "y"))
    to = group.groupBy(F.col("root").alias("_r")).agg(F.min(F.struct("x", "y")).alias("m"))
    return group.join(to, F.col("root") == F.col("_r")).select("x", "y", F.col("m.x").alias("nx"), F.col("m.y").alias("ny"))


def _next(half: DataFrame) -> DataFrame:
    """Half-edges (h, twin, a, b, angle: a struct of the ends and the direction) with the one that follows each on the ring to its left."""
    round_ = Window.partitionBy("a").orderBy("angle")
    before = F.coalesce(F.lag("h").over(round_), F.last("h").over(round_.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return half.select(F.col("twin").alias("_t"), before.alias("next")).join(half.hint("merge"), F.col("_t") == F.col("h")).drop("_t")


def _roots(links: DataFrame) -> DataFrame:
    """node, root: of half-edges h, next the smallest one on their ring."""
    if links.count() > MOST_HALVES:
        return components(links.select(F.col("h").alias("a"), F.col("next").alias("b")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = pd.concat([pd.DataFrame({"h": np.zeros(0, np.int64), "next": np.zeros(0, np.int64)}), *batches]).sort_values("h")
        h = t["h"].to_numpy()
        low, jump = np.arange(len(h)), np.searchsorted(h, t["next"].to_numpy())
        while True:  # each time the smallest of twice as many that follow
            new = np.minimum(low, low[jump])
            if (new == low).all():
                break
            low, jump = new, jump[jump]
        for i in range(0, len(h), 100_000):
            yield pd.DataFrame({"node": h[i : i + 100_000], "root": h[low[i : i + 100_000]]})

    return cut(links.select("h", "next").repartition(1).mapInPandas(run, "node long, root long"))


def _rings(half: DataFrame) -> DataFrame:
    n = cut(_next(half))
    roots = _roots(n)
    return cut(n.join(roots.hint("merge"), F.col("h") == F.col("node"), "left").withColumn("ring", F.coalesce("root", "h")).drop("node", "root"))


def faces(pieces: DataFrame, srid: int) -> DataFrame:
    """The areas that noded pieces bound, as polygons. Pieces with the same area on both sides bound none."""
    a, b = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    both = pieces.select(a.alias("a"), b.alias("b")).unionByName(pieces.select(b.alias("a"), a.alias("b")))
    angle = F.atan2(F.col("b.y") - F.col("a.y"), F.col("b.x") - F.col("a.x"))
    half = cut(both.select(F.xxhash64("a", "b").alias("h"), F.xxhash64("b", "a").alias("twin"), "a", "b", angle.alias("angle")))
    r = _rings(half)
    same = cut(r.join(r.select(F.col("h").alias("twin"), F.col("ring").alias("_ring")).hint("merge"), "twin").where("ring = _ring").select("h", "ring"))
    if not same.isEmpty():
        # what is left of the rings that have such pieces is put together anew: the others don't change
        old = same.select("ring").distinct()
        left = half.join(same.select("h").hint("merge"), "h", "left_anti")
        n = cut(_next(left).join(r.select(F.col("h").alias("_h"), "ring").hint("merge"), F.col("h") == F.col("_h")).drop("_h"))
        anew = cut(n.join(old.hint("merge"), "ring", "left_semi"))
        roots = _roots(anew)
        anew = anew.join(roots.hint("merge"), F.col("h") == F.col("node"), "left").withColumn("ring", F.coalesce("root", "h")).drop("node", "root")
        r = cut(n.join(old.hint("merge"), "ring", "left_anti").unionByName(anew.select(n.columns)))

    def trace(t: pd.DataFrame) -> pd.DataFrame:
        """Each ring of a portion of rings: a shell with its area, or a hole with a place on it."""
        out = []
        for ring, k in t.groupby("ring", sort=False).indices.items():
            x, y = t["x"].to_numpy()[k], t["y"].to_numpy()[k]
            at = {h: i for i, h in enumerate(t["h"].to_numpy()[k].tolist())}
            after = [at[h] for h in t["next"].to_numpy()[k].tolist()]
            order = [0]
            while (i := after[order[-1]]) != 0:
                order.append(i)
            c = np.stack([x[order], y[order]], 1)
            c = np.concatenate([c, c[:1]])
            area = G.ring_area(c) if len(c) > 3 else 0.0
            if abs(area) > 1e-12:
                out.append((ring, float(area), G.to_wkb(G.Shape("Polygon", rings=[G.tidy(c)])), G.to_wkb(G.point(*(c[0] + c[1]) / 2))))
        return pd.DataFrame(out, columns=["ring", "area", GEOM, "on"])

    rows = r.select("ring", "h", "next", F.col("a.x").alias("x"), F.col("a.y").alias("y"), F.pmod(F.xxhash64("ring"), F.lit(512)).alias("_p"))
    told = cut(rows.groupBy("_p").applyInPandas(trace, f"ring long, area double, {GEOM} binary, on binary"))
    shells = with_srid(told.where("area > 0").select(F.col("ring").alias(ROW), "area", GEOM), srid)
    holes = with_srid(told.where("area < 0").select(F.col("ring").alias(ROW), (-F.col("area")).alias("area"), F.col(GEOM).alias("hole"), F.col("on").alias(GEOM)), srid)
    within = pairs(holes, shells, "within").where(F.col("r_area") > F.col("l_area") * (1 + 1e-9))
    inner = within.groupBy(F.col(f"l_{ROW}").alias("_h")).agg(F.min_by(F.struct(F.col(f"r_{ROW}").alias("shell"), F.col("l_hole").alias("hole")), F.struct("r_area", f"r_{ROW}")).alias("m"))
    by_shell = cut(inner.groupBy(F.col("m.shell").alias("_s")).agg(F.collect_list("m.hole").alias("_holes")))
    whole = shells.join(by_shell.hint("merge"), F.col(ROW) == F.col("_s"), "left")

    def with_holes(shell: G.Shape, holes_: list) -> G.Shape:
        return G.Shape("Polygon", rings=[*shell.rings, *[G.from_wkb(bytes(w)).rings[0] for w in holes_]])

    plain = whole.where("_holes is null").select(GEOM)
    return with_srid(plain.unionByName(whole.where("_holes is not null").select(shapes(with_holes, "binary")(GEOM, "_holes").alias(GEOM))), srid)
