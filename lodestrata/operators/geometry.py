"""Operators on single geometries, and those that make rows of geometries."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import crs as C
from ..functions import geometry as G
from .attribute import _names
from .layer import GEOM, ROW, attributes, bbox, identified, in_meters, make_box, many_shapes, metric, shape_lists, shapes, srid_of, st_centroid, st_dim, st_empty, st_union, transformed, with_geometry, with_srid, udf
from .registry import operator


def _scalar(df: DataFrame, f, crs_meters=None, *rest) -> DataFrame:
    """Each geometry through f, measured in crs_meters where the layer is in degrees."""
    own, to = srid_of(df), metric(df, crs_meters)
    return with_geometry(df, shapes(in_meters(f, own, to), "binary")(F.col(GEOM), *rest))


def _grouped(df: DataFrame, f, by_group=None, dissolve: bool = False) -> DataFrame:
    """f of all points of a row, of a group, or of the layer. Points are first taken together within 64 parts of a group."""
    if not by_group and not dissolve:
        return _scalar(df, lambda g: f(g.all_coords()) if not g.empty else g)
    by = _names(by_group)
    parts = identified(df).withColumn("_part", F.pmod(F.xxhash64(ROW), F.lit(64))).groupBy(*by, "_part").agg(F.collect_list(GEOM).alias("_g"))
    together = many_shapes(lambda s: G.Shape("MultiPoint", parts=[G.point(*p) for p in np.unique(np.concatenate([x.all_coords()[:, :2] for x in s if not x.empty] or [np.zeros((0, 2))]), axis=0)]))
    parts = parts.withColumn("_g", together("_g"))
    # a task for few groups: their points are small, which would put many groups together, but their work isn't
    out = (parts.repartition(4 * max(df.sparkSession.sparkContext.defaultParallelism, 2), *by) if by else parts).groupBy(*by).agg(F.collect_list("_g").alias("_g"))
    return with_srid(out.select(*by, many_shapes(lambda s: f(np.concatenate([x.all_coords() for x in s] or [np.zeros((0, 2))])))("_g").alias(GEOM)), srid_of(df))


@operator("buffer", "scalar")
def buffer(df: DataFrame, distance: float = 0.0, distance_col=None, crs_meters="EPSG:3857", quad_segs: int = 8, cap_style: str = "round", join_style: str = "round", mitre_limit: float = 5.0, single_sided: bool = False) -> DataFrame:
    d = F.col(distance_col).cast("double") if distance_col else F.lit(float(distance))
    return _scalar(df, lambda g, r: G.buffer(g, r or 0.0, quad_segs, cap_style, join_style, mitre_limit, single_sided), crs_meters, d)


@operator("centroid", "scalar")
def centroid(df: DataFrame) -> DataFrame:
    return with_geometry(df, st_centroid(GEOM))


@operator("area_length", "scalar")
def area_length(df: DataFrame, crs_meters="EPSG:3857", area_col: str = "area_m2", length_col: str = "length_m", compute_area: bool = True, compute_length: bool = True) -> DataFrame:
    g = transformed(F.col(GEOM), srid_of(df), metric(df, crs_meters))
    new = ({area_col: shapes(G.area, "double")(g)} if compute_area else {}) | ({length_col: shapes(G.length, "double")(g)} if compute_length else {})
    return df.withColumns(new) if new else df


@operator("reproject", "scalar")
def reproject(df: DataFrame, target_crs="EPSG:4326") -> DataFrame:
    to = C.srid(target_crs)
    return with_geometry(df, transformed(F.col(GEOM), srid_of(df), to), to)


@operator("assign_projection", "scalar")
def assign_projection(df: DataFrame, crs: str = "", allow_override: bool = True) -> DataFrame:
    known = next((f.metadata.get("srid") for f in df.schema.fields if f.name == GEOM), None)
    if known and known != C.srid(crs) and not allow_override:
        raise ValueError(f"the layer is EPSG:{known} already")
    return with_srid(df, C.srid(crs))


@operator("simplify", "scalar")
def simplify(df: DataFrame, tolerance: float = 1.0, preserve_topology: bool = True, algorithm: str = "dp", crs_meters="EPSG:3857") -> DataFrame:
    """dp, vw, or coverage: vertices where edges of three areas meet stay, and shared borders are cut alike, so no gaps open."""
    if algorithm == "coverage":
        own, to = srid_of(df), metric(df, crs_meters)

        def cover(s: list[G.Shape]) -> list[G.Shape]:
            return [x.map(lambda a: C.transform(a, to, own)) for x in simplify_coverage([g.map(lambda a: C.transform(a, own, to)) for g in s], tolerance)]

        return _whole_layer(df, cover)
    if algorithm not in ("dp", "vw"):
        raise ValueError("algorithm is dp, vw or coverage")
    return _scalar(df, lambda g: G.simplify(g, tolerance, algorithm, preserve_topology), crs_meters)


def simplify_coverage(s: list[G.Shape], tol: float) -> list[G.Shape]:
    """Rings cut at nodes (vertices with other than two neighbours in the coverage) and each arc simplified the same way for both sides."""
    near: dict[tuple, set] = {}
    for g in s:
        for r in g.arrays():
            for a, b in zip(map(tuple, r[:-1, :2]), map(tuple, r[1:, :2]), strict=True):
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)

    def ring(r: np.ndarray) -> np.ndarray:
        p = r[:-1, :2]
        stops = [i for i, v in enumerate(map(tuple, p)) if len(near[v]) != 2] or [int(np.lexsort((p[:, 1], p[:, 0]))[0])]
        out = []
        for i, j in zip(stops, stops[1:] + [stops[0] + len(p)], strict=True):
            arc = p[np.arange(i, j + 1) % len(p)]
            back = tuple(arc[0]) > tuple(arc[-1]) or (tuple(arc[0]) == tuple(arc[-1]) and tuple(arc[1]) > tuple(arc[-2]))
            cut = G.simplify_line(arc[::-1] if back else arc, tol)
            out.append((cut[::-1] if back else cut)[:-1])
        q = np.concatenate(out)
        return np.concatenate([q, q[:1]]) if len(q) >= 3 else r

    return [g.map(ring) if g.dim == 2 else g for g in s]


def _whole_layer(df: DataFrame, f) -> DataFrame:
    """f(list of shapes) -> list of as many shapes, over groups of rows that touch each other, one group a task.

    What lies apart can't bear on each other, so groups are the connected components of the rows' touching.
    """
    from .graph import components
    from .layer import pairs

    had = ROW in df.columns
    df = identified(df)
    g = df.select(ROW, GEOM)
    edges = pairs(g, g, "intersects").where(f"l_{ROW} < r_{ROW}").select(F.col(f"l_{ROW}").alias("a"), F.col(f"r_{ROW}").alias("b"))
    group = components(edges)
    rows = g.join(group, F.col(ROW) == F.col("node"), "left").select(ROW, GEOM, F.coalesce("root", ROW).alias("_group"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(ROW)
        t = t[t[GEOM].notna()]
        out = f([G.from_wkb(x) for x in t[GEOM]])
        return pd.DataFrame({ROW: t[ROW].to_numpy(), "_new": [None if x is None else G.to_wkb(x) for x in out]})

    new = rows.groupBy("_group").applyInPandas(run, f"{ROW} long, _new binary").withColumnRenamed(ROW, "_r")
    out = df.join(new, F.col(ROW) == F.col("_r")).withColumn(GEOM, F.col("_new")).drop("_r", "_new").where(F.col(GEOM).isNotNull() & ~st_empty(GEOM))
    return with_srid(out if had else out.drop(ROW), srid_of(df))


@operator("chaikin_smooth", "scalar")
def chaikin_smooth(df: DataFrame, iterations: int = 2) -> DataFrame:
    def f(g: G.Shape) -> G.Shape:
        if g.kind == "LineString":
            return G.Shape(g.kind, G.chaikin(g.coords, iterations, False), z=g.z, m=g.m)
        if g.kind == "Polygon":
            return G.Shape(g.kind, rings=[G.chaikin(r, iterations, True) for r in g.rings], z=g.z, m=g.m)
        return g if g.kind == "Point" else G.Shape(g.kind, parts=[f(p) for p in g.parts], z=g.z, m=g.m)

    return _scalar(df, f)


@operator("convex_hull", "scalar")
def convex_hull(df: DataFrame, by_group=None, dissolve: bool = False) -> DataFrame:
    return _grouped(df, G.hull, by_group, dissolve)


def _longest_out(p: np.ndarray, limit, edges: bool) -> G.Shape:
    """Delaunay triangles worn away from outside while a border edge is longer than limit (edges), or all with a small circle kept."""
    p = np.unique(p[:, :2], axis=0)
    tri = G.delaunay(p)
    if not tri:
        return G.hull(p)
    if not edges:
        def circum(t):
            a, b, c = (p[i] for i in t)
            la, lb, lc = np.hypot(*(b - c)), np.hypot(*(a - c)), np.hypot(*(a - b))
            s = abs((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])) / 2
            return la * lb * lc / (4 * s) if s else math.inf

        keep = [t for t in tri if circum(t) < limit]
        return G.area_of_triangles(p, keep) if keep else G.Shape("Polygon")
    long = lambda a, b: float(np.hypot(*(p[a] - p[b])))
    sides = [long(a, b) for t in tri for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))]
    most = min(sides) + limit * (max(sides) - min(sides))
    live = {tuple(t) for t in tri}
    own: dict[tuple, list] = {}
    for t in live:
        for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
            own.setdefault((min(a, b), max(a, b)), []).append(t)
    # the longest border side first; the rim only grows, so a side that is passed over once is so for good
    border = [(-long(*e), (-e[0], -e[1])) for e, ts in own.items() if len(ts) == 1]
    rim = {-v for _, e in border for v in e}
    heapq.heapify(border)
    while border:
        d, e = heapq.heappop(border)
        e = (-e[0], -e[1])
        if -d <= most or len(live) == 1:
            break
        t = own[e][0]
        tip = next(v for v in t if v not in e)
        if tip in rim:
            continue
        live.remove(t)
        rim.add(tip)
        for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
            k = (min(a, b), max(a, b))
            own[k].remove(t)
            if not own[k]:
                del own[k]
            else:
                heapq.heappush(border, (-long(*k), (-k[0], -k[1])))
    return G.area_of_triangles(p, [t for t in tri if tuple(t) in live])


@operator("concave_hull", "scalar")
def concave_hull(df: DataFrame, ratio: float = 0.3, allow_holes: bool = False, by_group=None, dissolve: bool = False) -> DataFrame:
    """The Delaunay triangulation worn away from outside down to edges of min + ratio * (max - min); it never gets holes."""
    return _grouped(df, lambda p: _longest_out(p, ratio, True), by_group, dissolve)


@operator("alpha_shape", "scalar")
def alpha_shape(df: DataFrame, alpha: float = 0.05, by_group=None) -> DataFrame:
    """Union of the Delaunay triangles whose circumcircle has a radius under 1/alpha, of all points of a group."""
    return _grouped(df, lambda p: _longest_out(p, 1 / alpha, False), by_group, True)


@operator("envelope", "scalar")
def envelope(df: DataFrame, by_group=None, dissolve: bool = False) -> DataFrame:
    b = df.withColumn("_b", bbox(GEOM))
    if not by_group and not dissolve:
        return with_geometry(b, F.when(~F.isnan("_b.xmin"), make_box("_b.xmin", "_b.ymin", "_b.xmax", "_b.ymax")), srid_of(df)).drop("_b")
    by = _names(by_group)
    out = b.where(~F.isnan("_b.xmin")).groupBy(*by).agg(F.min("_b.xmin").alias("a"), F.min("_b.ymin").alias("b"), F.max("_b.xmax").alias("c"), F.max("_b.ymax").alias("d"))
    return with_srid(out.select(*by, make_box("a", "b", "c", "d").alias(GEOM)), srid_of(df))


@operator("oriented_bbox", "scalar")
def oriented_bbox(df: DataFrame, dissolve: bool = False) -> DataFrame:
    return _grouped(df, lambda p: G.min_rectangle(G.Shape("LineString", p)), None, dissolve)


@operator("min_bounding_circle", "scalar")
def min_bounding_circle(df: DataFrame, dissolve: bool = False) -> DataFrame:
    return _grouped(df, lambda p: G.circle(*G.min_circle(p), quad=8), None, dissolve)


@operator("boundary", "scalar")
def boundary(df: DataFrame, drop_empty: bool = True) -> DataFrame:
    out = _scalar(df, G.boundary)
    return out.where(F.col(GEOM).isNotNull() & ~st_empty(GEOM)) if drop_empty else out


@operator("make_valid", "scalar")
def make_valid(df: DataFrame, drop_empty: bool = True, keep_geom_type: bool = False) -> DataFrame:
    out = _scalar(df.withColumn("_d", st_dim(GEOM)), G.make_valid)
    if keep_geom_type:
        out = out.where(st_dim(GEOM) == F.col("_d"))
    return (out.where(F.col(GEOM).isNotNull() & ~st_empty(GEOM)) if drop_empty else out).drop("_d")


@operator("snap_to_grid", "scalar")
def snap_to_grid(df: DataFrame, grid_size: float = 0.001, crs_meters=None) -> DataFrame:
    return _scalar(df, lambda g: G.snap_grid(g, grid_size), crs_meters)


def _each_line(f):
    def run(g: G.Shape, *rest) -> G.Shape:
        if g.kind == "LineString" and not g.empty:
            return G.line(f(g.coords, *rest))
        return G.Shape(g.kind, parts=[run(p, *rest) for p in g.parts], z=g.z, m=g.m) if g.kind == "MultiLineString" else g

    return run


@operator("offset_curve", "scalar")
def offset_curve(df: DataFrame, distance: float = 1.0, quad_segs: int = 8, join_style: str = "round", mitre_limit: float = 5.0, crs_meters="EPSG:3857") -> DataFrame:
    return _scalar(df, _each_line(lambda a: G.offset(a, distance, quad_segs, join_style, mitre_limit)), crs_meters)


@operator("line_merge", "scalar")
def line_merge(df: DataFrame, directed: bool = False) -> DataFrame:
    return _scalar(df, lambda g: G.collect([G.line(a) for a in G.merge_lines([p.coords for p in g.simple()], directed)]) if g.kind == "MultiLineString" else g)


@operator("line_substring", "scalar")
def line_substring(df: DataFrame, start_measure: float = 0.0, end_measure: float = 1.0, normalized: bool = True) -> DataFrame:
    def f(g: G.Shape) -> G.Shape:
        if g.kind != "LineString":
            return g
        n = G._length(g.coords) if normalized else 1.0
        out = G.substring(g.coords, start_measure * n, end_measure * n)
        return G.line(out) if len(out) > 1 else G.point(*out[0])

    return _scalar(df, f)


@operator("densify_vertices", "scalar")
def densify_vertices(df: DataFrame, max_distance=None, n_vertices_per_segment=None, crs_meters="EPSG:3857") -> DataFrame:
    if (max_distance is None) == (n_vertices_per_segment is None):
        raise ValueError("give max_distance or n_vertices_per_segment")
    return _scalar(df, lambda g: g.map(lambda a: G.densify(a, max_distance, n_vertices_per_segment) if len(a) > 1 else a), crs_meters)


@operator("affine_transform", "scalar")
def affine_transform(df: DataFrame, translate=None, rotate=None, scale=None, skew=None, origin="center") -> DataFrame:
    """Translate, rotate, scale, skew, in this order; angles in degrees about the origin: center (of the box), centroid or (x, y)."""

    def pair(v, keys=("x", "y"), default=0.0):
        return (v.get(keys[0], default), v.get(keys[1], default)) if isinstance(v, dict) else (v, v) if isinstance(v, (int, float)) else tuple(v[:2])

    def f(g: G.Shape) -> G.Shape:
        def about(g: G.Shape) -> np.ndarray:
            if origin == "center":
                b = g.bounds()
                return np.array([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2])
            return G.centroid(g).coords[0, :2] if origin == "centroid" else np.array(pair(origin))

        def through(g: G.Shape, m: np.ndarray) -> G.Shape:
            o = about(g)

            def one(a: np.ndarray) -> np.ndarray:
                a = a.copy()
                a[:, :2] = (a[:, :2] - o) @ m.T + o
                return a

            return g.map(one)

        if g.empty:
            return g
        if translate is not None:
            d = np.array(pair(translate))
            g = g.map(lambda a: np.concatenate([a[:, :2] + d, a[:, 2:]], 1))
        if rotate is not None:
            t = math.radians(rotate["angle"] if isinstance(rotate, dict) else rotate)
            g = through(g, np.array([[math.cos(t), -math.sin(t)], [math.sin(t), math.cos(t)]]))
        if scale is not None:
            g = through(g, np.diag(pair(scale, default=1.0)))
        if skew is not None:
            x, y = (math.tan(math.radians(v)) for v in (pair(skew) if not isinstance(skew, (int, float)) else (skew, 0.0)))
            g = through(g, np.array([[1, x], [y, 1]]))
        return g

    return _scalar(df, f)


@operator("swap_xy", "scalar")
def swap_xy(df: DataFrame) -> DataFrame:
    return _scalar(df, lambda g: g.map(lambda a: np.concatenate([a[:, 1::-1], a[:, 2:]], 1)))


@operator("reverse_lines", "scalar")
def reverse_lines(df: DataFrame, ignore_non_lines: bool = True) -> DataFrame:
    def f(g: G.Shape) -> G.Shape:
        if g.kind in ("LineString", "MultiLineString"):
            return g.map(lambda a: a[::-1])
        if not ignore_non_lines:
            raise TypeError(f"{g.kind} is no line")
        return g

    return _scalar(df, f)


@operator("add_z", "scalar")
def add_z(df: DataFrame, z=None, from_column=None) -> DataFrame:
    if (z is None) == (from_column is None):
        raise ValueError("give z or from_column")
    return _scalar(df, lambda g, v: _dimension(g, "z", 0.0 if v is None or v != v else v), None, F.lit(float(z)) if z is not None else F.col(from_column).cast("double"))


def _dimension(g: G.Shape, which: str, value: float | None) -> G.Shape:
    """The shape with (value) or without (None) Z or M."""
    if which == "m" and (g.kind not in ("Point", "LineString", "MultiPoint", "MultiLineString")) and (value is not None or g.m):
        raise TypeError(f"M is for points and lines, not {g.kind}")

    def one(a: np.ndarray) -> np.ndarray:
        xy, z, m = a[:, :2], a[:, 2:3] if g.z else None, a[:, 2 + g.z : 3 + g.z] if g.m else None
        new = None if value is None else np.full((len(a), 1), value)
        z, m = (new, m) if which == "z" else (z, new)
        return np.concatenate([x for x in (xy, z, m) if x is not None], 1)

    def flag(s: G.Shape) -> G.Shape:
        s.z, s.m = (value is not None, s.m) if which == "z" else (s.z, value is not None)
        for p in s.parts:
            flag(p)
        return s

    return flag(g.map(one))


@operator("drop_z", "scalar")
def drop_z(df: DataFrame) -> DataFrame:
    def f(g: G.Shape) -> G.Shape:
        g = _dimension(g, "z", None)
        return _dimension(g, "m", None) if g.m else g

    return _scalar(df, f)


@operator("add_m", "scalar")
def add_m(df: DataFrame, m=None, from_column=None) -> DataFrame:
    if (m is None) == (from_column is None):
        raise ValueError("give m or from_column")
    return _scalar(df, lambda g, v: _dimension(g, "m", 0.0 if v is None or v != v else v), None, F.lit(float(m)) if m is not None else F.col(from_column).cast("double"))


@operator("drop_m", "scalar")
def drop_m(df: DataFrame) -> DataFrame:
    return _scalar(df, lambda g: _dimension(g, "m", None))


# ---------------------------------------------------------------- rows of geometries


def _split(df: DataFrame, f, index: str, base: int = 0) -> DataFrame:
    """A row for each shape that f gives, with its number in the feature."""
    out = df.select(*[c for c in df.columns if c != GEOM], F.posexplode(shape_lists(f)(F.col(GEOM))).alias(index, GEOM))
    return with_srid(out.withColumn(index, F.col(index) + base), srid_of(df))


@operator("extract_vertices", "table")
def extract_vertices(df: DataFrame, keep_attrs: bool = True) -> DataFrame:
    """vertex_index counts in the feature; global_index orders all, and needs _rowid order."""
    df = identified(df)
    src = df if keep_attrs else df.select(ROW, GEOM)
    out = _split(src, lambda g: [G.Shape("Point", p[None], z=g.z, m=g.m) for p in g.all_coords()], "vertex_index")
    sizes = df.select(ROW, shapes(lambda g: len(g.all_coords()), "int")(GEOM).alias("_n"))
    return _numbered(out, sizes, "vertex_index", "global_index").drop(ROW)


def _numbered(out: DataFrame, sizes: DataFrame, index: str, name: str) -> DataFrame:
    """A running number over all rows in _rowid order: per part sums first, so no task orders the whole."""
    part = F.shiftright(F.col(ROW), 33)
    within = Window.partitionBy("_p", "_q").orderBy(ROW).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_p": part, "_q": F.shiftright(F.col(ROW), 12)})
    groups = sizes.groupBy("_p", "_q").agg(F.sum("_n").alias("_s"))
    groups = groups.select("_p", "_q", F.coalesce(F.sum("_s").over(Window.orderBy("_p", "_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    start = sizes.withColumn("_own", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(groups, ["_p", "_q"]).select(F.col(ROW).alias("_r"), (F.col("_own") + F.col("_before")).alias("_start"))
    return out.join(start, F.col(ROW) == F.col("_r")).withColumn(name, F.col("_start") + F.col(index)).drop("_r", "_start")


@operator("extract_segments", "table")
def extract_segments(df: DataFrame, crs_meters="EPSG:3857", keep_attrs: bool = True, strict_parts: bool = False) -> DataFrame:
    """Lines between consecutive vertices with their length; between the last of a ring or part and the next one's first too, unless strict_parts."""
    own, to = srid_of(df), metric(df, crs_meters)

    def f(g: G.Shape) -> list[G.Shape]:
        runs = g.arrays() if strict_parts else [g.all_coords()]
        return [G.line(a[i : i + 2, :2]) for a in runs for i in range(len(a) - 1)]

    out = _split(df if keep_attrs else df.select(GEOM), f, "segment_index")
    return out.withColumn("length_m", shapes(G.length, "double")(transformed(F.col(GEOM), own, to)))


@operator("extract_holes", "table")
def extract_holes(df: DataFrame, parent_id_col=None, hole_index_col: str = "hole_index") -> DataFrame:
    df = identified(df) if parent_id_col else df
    out = _split(df, lambda g: [G.Shape("Polygon", rings=[r], z=g.z) for s in g.simple() if s.kind == "Polygon" for r in s.rings[1:]], hole_index_col)
    return out.withColumnRenamed(ROW, parent_id_col) if parent_id_col else out


@operator("multipart_to_singleparts", "table")
def multipart_to_singleparts(df: DataFrame, reset_index: bool = True, drop_empty: bool = True) -> DataFrame:
    out = _split(df, lambda g: g.simple() if drop_empty else g.simple() or [g], "_part").drop("_part")
    return out.where(~st_empty(GEOM)) if drop_empty else out


@operator("force_geometry_type", "table")
def force_geometry_type(df: DataFrame, target: str = "", on_multi: str = "explode", on_invalid: str = "raise") -> DataFrame:
    """To a Multi or a collection by wrapping; to a single kind by its parts (on_multi explode) or the first (first)."""
    if target not in G.KINDS[1:]:
        raise ValueError(f"unknown kind {target}")
    if on_multi not in ("explode", "first") or on_invalid not in ("raise", "drop", "skip"):
        raise ValueError("on_multi is explode or first, on_invalid raise, drop or skip")
    plural = target in G.SINGLE or target == "GeometryCollection"

    def f(g: G.Shape) -> list[G.Shape]:
        if g.kind == target:
            return [g]
        parts = [p for p in g.simple() if not p.empty]
        if target == "GeometryCollection":
            return [G.Shape(target, parts=parts, z=g.z, m=g.m)]
        want = G.SINGLE.get(target, target)
        if all(p.kind == want for p in parts) and (plural or parts):
            return [G.Shape(target, parts=parts, z=g.z, m=g.m)] if plural else parts[: None if on_multi == "explode" else 1]
        if on_invalid == "raise":
            raise ValueError(f"{g.kind} can't become {target}")
        return [] if on_invalid == "drop" else [g]

    empty = bytearray(G.to_wkb(G.Shape(target)))
    src = with_geometry(df, F.coalesce(GEOM, F.lit(empty))) if plural else df
    return _split(src, f, "_part").drop("_part")


#: Shapes of a layer that one task is given at once.
MOST_TOGETHER = 500_000


def _layer_shapes(df: DataFrame, f, name: str = "_g") -> DataFrame:
    """f(all shapes) -> shapes, as rows: for results that depend on the whole layer, which one task holds; larger layers are refused."""
    if df.limit(MOST_TOGETHER + 1).count() > MOST_TOGETHER:
        raise ValueError(f"the result depends on the whole layer, which must not have more than {MOST_TOGETHER} shapes")
    all_ = df.where(F.col(GEOM).isNotNull()).agg(F.collect_list(GEOM).alias(name))
    out = all_.select(F.explode(many_list(f)(name)).alias(GEOM))
    return with_srid(out, srid_of(df))


def many_list(f):
    @udf("array<binary>")
    def run(arrays: pd.Series) -> pd.Series:
        return pd.Series([[G.to_wkb(x) for x in f([G.from_wkb(b) for b in a])] for a in arrays])

    return run


@operator("polygonize", "table")
def polygonize(df: DataFrame, keep_attrs: bool = False) -> DataFrame:
    """Faces of the noded lines. keep_attrs: each face takes the attributes of the first line on its border."""
    from . import noding as D

    segs = D.segments(df)
    far = segs.agg(F.max(F.greatest(*[F.abs(c) for c in ("x0", "y0", "x1", "y1")]))).first()[0] or 0.0
    faces = D.faces(D.noded(segs, 1e-11 * max(1.0, far)), srid_of(df))
    if not keep_attrs:
        return faces
    from .layer import pairs

    src = identified(df)
    p = pairs(identified(faces), src, "touches").unionByName(pairs(identified(faces), src, "intersects")).groupBy(f"l_{ROW}").agg(F.first(f"l_{GEOM}").alias(GEOM), *[F.min_by(f"r_{c}", f"r_{ROW}").alias(c) for c in attributes(df)])
    return with_srid(p.drop(f"l_{ROW}"), srid_of(df))


def voronoi(p: np.ndarray, frame: tuple[float, float, float, float]) -> list[G.Shape]:
    """Cells of distinct points within the frame: each the frame cut by the middles to its Delaunay neighbours."""
    near: dict[int, set[int]] = {i: set() for i in range(len(p))}
    tri = G.delaunay(p)
    for t in tri:
        for a in t:
            near[a].update(t)
    x0, y0, x1, y1 = frame
    out = []
    for i in range(len(p)):
        cell = [np.array(c) for c in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
        for j in near[i] - {i} if tri and near[i] else set(range(len(p))) - {i}:
            n, mid = p[j] - p[i], (p[i] + p[j]) / 2
            side = [float((c - mid) @ n) for c in cell]
            cut = []
            for k, c in enumerate(cell):
                d, e, sd, se = c, cell[(k + 1) % len(cell)], side[k], side[(k + 1) % len(cell)]
                if sd <= 0:
                    cut.append(d)
                if sd * se < 0:
                    cut.append(d + (e - d) * sd / (sd - se))
            cell = cut
            if not cell:
                break
        if len(cell) >= 3:
            out.append(G.polygon(np.array(cell)))
    return out


@operator("voronoi_polygons", "table")
def voronoi_polygons(df: DataFrame, tolerance: float = 0.0, extend_to_wkt=None, only_edges: bool = False) -> DataFrame:
    def f(s: list[G.Shape]) -> list[G.Shape]:
        p = np.concatenate([g.all_coords()[:, :2] for g in s] or [np.zeros((0, 2))])
        p = np.unique(np.round(p / tolerance) * tolerance if tolerance else p, axis=0)
        if len(p) < 2:
            return []
        lo, hi = p.min(0), p.max(0)
        pad = float((hi - lo).max()) or 1.0
        frame = [lo[0] - pad, lo[1] - pad, hi[0] + pad, hi[1] + pad]
        if extend_to_wkt:
            b = G.from_wkt(extend_to_wkt).bounds()
            frame = [min(frame[0], b[0]), min(frame[1], b[1]), max(frame[2], b[2]), max(frame[3], b[3])]
        cells = voronoi(p, tuple(frame))
        if only_edges:
            e = G.node_edges(G.segments(G.Shape("MultiPolygon", parts=cells)), pad * 1e-9)
            return [G.line(x.reshape(2, 2)) for x in e]
        return cells

    return _layer_shapes(df, f)


@operator("delaunay_triangulation", "table")
def delaunay_triangulation(df: DataFrame, tolerance: float = 0.0, only_edges: bool = False) -> DataFrame:
    def f(s: list[G.Shape]) -> list[G.Shape]:
        p = np.concatenate([g.all_coords()[:, :2] for g in s] or [np.zeros((0, 2))])
        p = np.unique(np.round(p / tolerance) * tolerance if tolerance else p, axis=0)
        tri = G.delaunay(p)
        if only_edges:
            return [G.line(p[list(e)]) for e in sorted({tuple(sorted(e)) for t in tri for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))})]
        return [G.polygon(p[list(t)]) for t in tri]

    return _layer_shapes(df, f)


def _extent(df: DataFrame, bounds, to: int) -> tuple[float, float, float, float]:
    if bounds is not None:
        return tuple(map(float, bounds))
    b = df.select(bbox(transformed(F.col(GEOM), srid_of(df), to)).alias("b")).where(~F.isnan("b.xmin")).agg(F.min("b.xmin"), F.min("b.ymin"), F.max("b.xmax"), F.max("b.ymax")).first()
    if b[0] is None:
        raise ValueError("no extent: give bounds or a layer with geometries")
    return tuple(b)


def _lattice(df: DataFrame, rows: int, cols: int) -> DataFrame:
    """row and col of a grid, made in parallel."""
    return df.sparkSession.range(rows * cols).select((F.col("id") / cols).cast("long").alias("row"), (F.col("id") % cols).alias("col"))


def _clipped(out: DataFrame, ref, own: int, to: int, clip: bool) -> DataFrame:
    out = with_srid(out, to)
    if clip and ref is not None:
        from .spatial import filter_

        mask = with_geometry(ref.select(GEOM), transformed(F.col(GEOM), srid_of(ref), to), to)
        out = filter_(out, spatial_predicate="intersects", ref_gdf=mask)
    return with_geometry(out, transformed(F.col(GEOM), to, own), own)


@operator("grid_create", "table")
def grid_create(df: DataFrame, ref_gdf=None, bounds=None, cell_size: float = 100.0, crs_meters="EPSG:3857", clip_to_extent: bool = True) -> DataFrame:
    """Squares from the lower left of the extent, with row and col."""
    src = ref_gdf if ref_gdf is not None else df
    own, to = srid_of(src), metric(src, crs_meters)
    x0, y0, x1, y1 = _extent(src, bounds, to)
    cols, rows = max(1, math.ceil((x1 - x0) / cell_size)), max(1, math.ceil((y1 - y0) / cell_size))
    x, y = F.lit(x0) + F.col("col") * cell_size, F.lit(y0) + F.col("row") * cell_size
    out = _lattice(df, rows, cols).withColumn(GEOM, make_box(x, y, x + cell_size, y + cell_size))
    return _clipped(out, src if bounds is None else None, own, to, clip_to_extent)


@operator("hexgrid_create", "table")
def hexgrid_create(df: DataFrame, ref_gdf=None, bounds=None, cell_size: float = 100.0, crs_meters="EPSG:3857", clip_to_extent: bool = True, tiling: str = "offset") -> DataFrame:
    """Flat-topped hexagons of circumradius cell_size. Columns are 1.5 apart and rows sqrt(3); tiling "offset" moves odd rows by
    0.75 in x and half a row in y (cells overlap there), "exact" moves odd columns by half a row instead (no gaps, no overlaps)."""
    src = ref_gdf if ref_gdf is not None else df
    own, to = srid_of(src), metric(src, crs_meters)
    x0, y0, x1, y1 = _extent(src, bounds, to)
    dx, dy = 1.5 * cell_size, math.sqrt(3) * cell_size
    cols, rows = math.ceil((x1 - x0) / dx) + 2, math.ceil((y1 - y0) / dy) + 2

    @udf("binary")
    def hexagon(row: pd.Series, col: pd.Series) -> pd.Series:
        t = np.arange(6) * math.pi / 3
        ring = cell_size * np.stack([np.cos(t), np.sin(t)], 1)
        out = []
        for r, c in zip(row, col, strict=True):
            odd = r % 2 if tiling == "offset" else c % 2
            x, y = x0 + c * dx + (0.75 * cell_size * odd if tiling == "offset" else 0), y0 + r * dy + odd * dy / 2
            out.append(G.to_wkb(G.polygon(ring + (x, y))))
        return pd.Series(out)

    out = _lattice(df, rows, cols).withColumn(GEOM, hexagon("row", "col"))
    return _clipped(out, src if bounds is None else None, own, to, clip_to_extent)


KERNELS = {
    "gaussian": lambda d, h: F.exp(-d * d / (2 * h * h)) / (2 * math.pi * h * h),
    "tophat": lambda d, h: F.when(d < h, 1.0).otherwise(0.0) / (math.pi * h * h),
    "epanechnikov": lambda d, h: F.when(d < h, 1 - d * d / (h * h)).otherwise(0.0) * 2 / (math.pi * h * h),
}
MOST_CELLS = 1_000_000


@operator("kde_heatmap", "table")
def kde_heatmap(df: DataFrame, bandwidth: float = 100.0, cell_size: float = 50.0, kernel: str = "gaussian", weight_field=None, crs_meters="EPSG:3857") -> DataFrame:
    """Kernel density at the middles of a grid over the points' box and a bandwidth round it: row, col, density, geometry.

    Each point goes to the cells within the kernel's reach (for the gaussian 6 bandwidths, where it is under 1e-7 of its top) and
    densities are summed by cell, so nothing is crossed. Densities integrate to 1.
    """
    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel {kernel}")
    own, to = srid_of(df), metric(df, crs_meters)
    c = st_centroid(transformed(F.col(GEOM), own, to))
    from .layer import st_x, st_y

    w = F.col(weight_field).cast("double") if weight_field else F.lit(1.0)
    pts = df.where(F.col(GEOM).isNotNull()).select(c.alias("_c"), w.alias("w")).select(st_x("_c").alias("x"), st_y("_c").alias("y"), "w")
    s = pts.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.sum("w"), F.count_if(F.col("w").isNull() | F.isnan("w"))).first()
    if s[0] is None:
        return with_srid(df.sparkSession.createDataFrame([], "row long, col long, density double, geometry binary"), own)
    if s[5]:
        raise ValueError("weights are missing")
    x0, y0 = s[0] - bandwidth, s[1] - bandwidth
    cols, rows = math.ceil((s[2] + bandwidth - x0) / cell_size), math.ceil((s[3] + bandwidth - y0) / cell_size)
    if rows * cols > MOST_CELLS:
        raise ValueError(f"{rows * cols} cells; the most is {MOST_CELLS}")
    reach = bandwidth * (6 if kernel == "gaussian" else 1)
    span = lambda v, o, n: F.sequence(F.greatest(F.floor((F.col(v) - o - reach) / cell_size), F.lit(0)), F.least(F.floor((F.col(v) - o + reach) / cell_size), F.lit(n - 1)))
    at = pts.withColumn("col", F.explode(span("x", x0, cols))).withColumn("row", F.explode(span("y", y0, rows)))
    mx, my = F.lit(x0) + (F.col("col") + 0.5) * cell_size, F.lit(y0) + (F.col("row") + 0.5) * cell_size
    d = F.sqrt((mx - F.col("x")) ** 2 + (my - F.col("y")) ** 2)
    dens = at.groupBy("row", "col").agg((F.sum(F.col("w") * KERNELS[kernel](d, bandwidth)) / float(s[4])).alias("density"))
    out = _lattice(df, rows, cols).join(dens, ["row", "col"], "left").withColumn("density", F.coalesce("density", F.lit(0.0)))
    x, y = F.lit(x0) + F.col("col") * cell_size, F.lit(y0) + F.col("row") * cell_size
    return _clipped(out.withColumn(GEOM, make_box(x, y, x + cell_size, y + cell_size)), None, own, to, False)


__all__ = ["st_union"]
