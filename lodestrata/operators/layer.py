"""Layers: a DataFrame with a WKB column `geometry` whose metadata hold the coordinate system, and optionally `_rowid`."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crs as C
from ..functions import geometry as G
from .graph import cut

GEOM, ROW = "geometry", "_rowid"
BOX = "xmin double, ymin double, xmax double, ymax double"


def srid_of(df: DataFrame, default: int = 4326) -> int:
    field = next((f for f in df.schema.fields if f.name == GEOM), None)
    return int((field.metadata or {}).get("srid", default)) if field else default


def with_srid(df: DataFrame, srid: int) -> DataFrame:
    return df.withMetadata(GEOM, {"srid": int(srid)}) if GEOM in df.columns else df


def with_geometry(df: DataFrame, column: Column, srid: int | None = None) -> DataFrame:
    """The geometry replaced, its coordinate system kept unless another is given."""
    return with_srid(df.withColumn(GEOM, column), srid_of(df) if srid is None else srid)


def has_geometry(df: DataFrame) -> bool:
    return GEOM in df.columns


def attributes(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (GEOM, ROW)]


def identified(df: DataFrame) -> DataFrame:
    """With `_rowid`. Sources assign it from a key; without one the position in the scan is taken."""
    return df if ROW in df.columns else df.withColumn(ROW, F.monotonically_increasing_id())


def assign_rowid(df: DataFrame, *keys: str) -> DataFrame:
    """`_rowid` by the order of keys: unique and increasing, the same for the same rows; one range shuffle."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(ROW, F.monotonically_increasing_id())


def udf(kind: str) -> Callable:
    """An Arrow-batched function of columns, made when it is called: modules can be imported without a session."""

    def wrap(f: Callable) -> Callable:
        return lambda *cols: F.pandas_udf(f, kind)(*cols)

    return wrap


def shapes(f: Callable, kind: str) -> Callable:
    """A column function from f(Shape, *other values); nulls in give null out. Whole Arrow batches go to Python."""
    pack = G.to_wkb if kind == "binary" else (lambda x: x)

    @udf(kind)
    def run(geometry: pd.Series, *rest: pd.Series) -> pd.Series:
        out = []
        for values in zip(geometry, *rest, strict=True):
            out.append(None if values[0] is None else pack(f(G.from_wkb(values[0]), *values[1:])))
        return pd.Series(out, dtype=object if kind not in ("double", "boolean", "int", "long") or any(v is None for v in out) else None)

    return run


def shape_lists(f: Callable, kind: str = "array<binary>") -> Callable:
    """A column function from f(Shape, ...) -> list of shapes (or of values)."""

    @udf(kind)
    def run(geometry: pd.Series, *rest: pd.Series) -> pd.Series:
        out = []
        for values in zip(geometry, *rest, strict=True):
            got = [] if values[0] is None else f(G.from_wkb(values[0]), *values[1:])
            out.append([G.to_wkb(x) if isinstance(x, G.Shape) else x for x in got])
        return pd.Series(out)

    return run


def pair_shapes(f: Callable, kind: str) -> Callable:
    """A column function of two geometries (and other values)."""
    pack = G.to_wkb if kind == "binary" else (lambda x: x)

    @udf(kind)
    def run(a: pd.Series, b: pd.Series, *rest: pd.Series) -> pd.Series:
        seen: dict[bytes, G.Shape] = {}

        def shape(x: bytes) -> G.Shape:
            if x not in seen:
                if len(seen) > 1000:
                    seen.clear()
                seen[x] = G.from_wkb(x)
            return seen[x]

        return pd.Series([None if v[0] is None or v[1] is None else pack(f(shape(v[0]), shape(v[1]), *v[2:])) for v in zip(a, b, *rest, strict=True)], dtype=object)

    return run


def many_shapes(f: Callable, kind: str = "binary") -> Callable:
    """A column function of an array of geometries: f(list of shapes)."""
    pack = G.to_wkb if kind == "binary" else (lambda x: x)

    @udf(kind)
    def run(arrays: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else pack(f([G.from_wkb(x) for x in a if x is not None])) for a in arrays], dtype=object)

    return run


def transformed(column: Column, source: int, target: int) -> Column:
    if source == target:
        return column
    return shapes(lambda g: g.map(lambda a: C.transform(a, source, target)), "binary")(column)


def aligned(ref: DataFrame, df: DataFrame) -> DataFrame:
    """ref in the coordinate system of df."""
    a, b = srid_of(ref), srid_of(df)
    return ref if a == b or not has_geometry(ref) else with_geometry(ref, transformed(F.col(GEOM), a, b), b)


def metric(df: DataFrame, crs_meters) -> int:
    """The system in which to measure: the layer's own unless it is in degrees."""
    own = srid_of(df)
    return C.srid(crs_meters) if C.geographic(own) and crs_meters else own


def in_meters(f: Callable, source: int, target: int) -> Callable:
    """f on the shape in the target system, its result back in the source's."""
    if source == target:
        return f

    def run(g: G.Shape, *rest):
        out = f(g.map(lambda a: C.transform(a, source, target)), *rest)
        return out.map(lambda a: C.transform(a, target, source)) if isinstance(out, G.Shape) else out

    return run


def _box(g: G.Shape):
    b = g.bounds()
    return None if b is None else dict(zip(("xmin", "ymin", "xmax", "ymax"), b, strict=True))


@udf(BOX)
def bbox(geometry: pd.Series) -> pd.DataFrame:
    p = _xy(geometry) if len(geometry) else None
    if p is not None:
        return pd.DataFrame({"xmin": p[:, 0], "ymin": p[:, 1], "xmax": p[:, 0], "ymax": p[:, 1]})
    p = two_point(geometry) if len(geometry) else None
    if p is not None:
        return pd.DataFrame(np.concatenate([np.minimum(p[:, :2], p[:, 2:]), np.maximum(p[:, :2], p[:, 2:])], 1), columns=["xmin", "ymin", "xmax", "ymax"])
    rows = [(math.nan,) * 4 if w is None else (G.from_wkb(w).bounds() or (math.nan,) * 4) for w in geometry]
    return pd.DataFrame(rows, columns=["xmin", "ymin", "xmax", "ymax"])


@udf("binary")
def make_point(x: pd.Series, y: pd.Series) -> pd.Series:
    raw = np.empty(len(x), dtype=[("order", "u1"), ("kind", "<u4"), ("x", "<f8"), ("y", "<f8")])
    raw["order"], raw["kind"], raw["x"], raw["y"] = 1, 1, x, y
    data = raw.tobytes()
    bad = (pd.isna(x) | pd.isna(y)).to_numpy()
    return pd.Series([None if bad[i] else data[21 * i : 21 * i + 21] for i in range(len(x))], dtype=object)


@udf("binary")
def make_line(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    raw = np.empty(len(x0), dtype=[("order", "u1"), ("kind", "<u4"), ("n", "<u4"), ("p", "<f8", 4)])
    raw["order"], raw["kind"], raw["n"], raw["p"] = 1, 2, 2, np.stack([x0, y0, x1, y1], 1)
    data = raw.tobytes()
    return pd.Series([data[41 * i : 41 * i + 41] for i in range(len(x0))], dtype=object)


@udf("binary")
def make_box(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    return pd.Series([G.to_wkb(G.box(*v)) for v in zip(x0, y0, x1, y1, strict=True)], dtype=object)


st_area = shapes(G.area, "double")
st_length = shapes(G.length, "double")
st_x = shapes(lambda g: float(G.centroid(g).coords[0, 0]) if not g.empty else None, "double")
st_y = shapes(lambda g: float(G.centroid(g).coords[0, 1]) if not g.empty else None, "double")
st_centroid = shapes(G.centroid, "binary")
st_union = many_shapes(G.union)
st_collect = many_shapes(lambda s: G.collect(s))
st_intersection = pair_shapes(G.intersection, "binary")
st_difference = pair_shapes(G.difference, "binary")
st_empty = shapes(lambda g: g.empty, "boolean")
st_dim = shapes(lambda g: g.dim, "int")
st_kind = shapes(lambda g: g.kind, "string")
st_valid = shapes(G.valid, "boolean")


def _xy(column: pd.Series) -> np.ndarray | None:
    """Coordinates if the whole column is plain points."""
    if any(w is None or len(w) != 21 or w[:5] != b"\x01\x01\x00\x00\x00" for w in column):
        return None
    raw = np.frombuffer(b"".join(column), dtype=[("head", "V5"), ("x", "<f8"), ("y", "<f8")])
    return np.stack([raw["x"], raw["y"]], 1)


def two_point(column: pd.Series) -> np.ndarray | None:
    """x0, y0, x1, y1 if the whole column is plain lines of two points."""
    if any(w is None or len(w) != 41 or w[:9] != b"\x01\x02\x00\x00\x00\x02\x00\x00\x00" for w in column):
        return None
    return np.frombuffer(b"".join(column), dtype=[("head", "V9"), ("p", "<f8", 4)])["p"].copy()


def _by_shape(p: np.ndarray, shapes_: pd.Series, f: Callable) -> np.ndarray:
    """f(points, shape) for the points that stand beside each distinct shape."""
    code, distinct = pd.factorize(shapes_)
    order = np.argsort(code, kind="stable")
    cuts = np.flatnonzero(np.diff(code[order])) + 1
    out = None
    for rows in np.split(order, cuts):
        got = f(p[rows], G.from_wkb(distinct[code[rows[0]]]))
        if out is None:
            out = np.empty(len(p), got.dtype)
        out[rows] = got
    return out


def _away(p: np.ndarray, g: G.Shape) -> np.ndarray:
    """Distances of points from a shape."""
    d = np.full(len(p), np.inf)
    s, q = G.segments(g), G._points(g)
    for lo in range(0, len(p), 4096):
        if len(s):
            d[lo : lo + 4096] = G.point_segment(p[lo : lo + 4096], s)[0].min(1)
        if len(q):
            d[lo : lo + 4096] = np.minimum(d[lo : lo + 4096], np.hypot(*(p[lo : lo + 4096, None, :] - q[None]).transpose(2, 0, 1)).min(1))
    return np.where(G.in_area(p, g), 0.0, d) if g.dim == 2 else d


def _distances(a: pd.Series, b: pd.Series) -> np.ndarray | None:
    p, q = _xy(a), _xy(b)
    if p is not None and q is not None:
        return np.hypot(*(p - q).T)
    if (p is None and q is None) or a.isna().any() or b.isna().any():
        return None
    return _by_shape(p, b, _away) if p is not None else _by_shape(q, a, _away)


# place of the point (1 inside, 0 on the edge, -1 outside) that fulfils a predicate: point first, and shape first
_POINT_FIRST = {"intersects": (0, 1), "covered_by": (0, 1), "within": (1,), "touches": (0,), "disjoint": (-1,)}
_SHAPE_FIRST = {"intersects": (0, 1), "covers": (0, 1), "contains": (1,), "touches": (0,), "disjoint": (-1,)}


def st_distance(a, b) -> Column:
    slow = lambda x, y: G.distance(G.from_wkb(x), G.from_wkb(y))

    @udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        d = _distances(a, b) if len(a) else None
        return pd.Series(d) if d is not None else pd.Series([None if x is None or y is None else slow(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return run(a, b)


def st_relate(name: str, by: float = 0.0) -> Callable:
    """A column function of two geometries. Columns of points are tested array-wise."""

    @udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        if len(a):
            if name == "dwithin" and (d := _distances(a, b)) is not None:
                return pd.Series(d <= by)
            p, q = _xy(a), _xy(b)
            if p is not None and q is not None and name in ("intersects", "within", "contains", "equals", "covers", "covered_by"):
                return pd.Series(np.hypot(*(p - q).T) <= 1e-9)
            if p is not None and q is None and name in _POINT_FIRST and not b.isna().any():
                return pd.Series(np.isin(_by_shape(p, b, G.place), _POINT_FIRST[name]))
            if q is not None and p is None and name in _SHAPE_FIRST and not a.isna().any():
                return pd.Series(np.isin(_by_shape(q, a, G.place), _SHAPE_FIRST[name]))
        seen: dict[bytes, G.Shape] = {}

        def shape(x: bytes) -> G.Shape:
            if x not in seen:
                if len(seen) > 1000:
                    seen.clear()
                seen[x] = G.from_wkb(x)
            return seen[x]

        return pd.Series([None if x is None or y is None else G.relate(name, shape(x), shape(y), by) for x, y in zip(a, b, strict=True)], dtype=object)

    return run


def cells(df: DataFrame, size: float, by: float = 0.0) -> DataFrame:
    """Rows repeated for each grid cell that `box` (grown by `by`) covers, with cx and cy."""
    span = lambda lo, hi: F.sequence(F.floor((F.col(lo) - by) / size), F.floor((F.col(hi) + by) / size))
    return df.where(~F.isnan("box.xmin")).withColumn("cx", F.explode(span("box.xmin", "box.xmax"))).withColumn("cy", F.explode(span("box.ymin", "box.ymax")))


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores. A table of a few megabytes is read as one task, however much work each row's geometry is."""
    context = df.sparkSession.sparkContext
    return df.repartition(4 * max(context.defaultParallelism, 2))


def cell_size(*frames: DataFrame) -> float:
    """Twice the mean box side, or for points what gives some points to a cell, also of a long and narrow extent: one pass over the boxes."""
    sides, extent, apart = [], 0.0, 0.0
    for df in frames:
        r = df.where(~F.isnan("box.xmin")).agg(F.avg(F.greatest(F.col("box.xmax") - F.col("box.xmin"), F.col("box.ymax") - F.col("box.ymin"))), F.max("box.xmax") - F.min("box.xmin"), F.max("box.ymax") - F.min("box.ymin"), F.count(F.lit(1))).first()
        sides.append(r[0] or 0.0)
        wide, high, n = r[1] or 0.0, r[2] or 0.0, r[3] or 1
        extent, apart = max(extent, wide, high), max(apart, math.sqrt(wide * high / n), max(wide, high) / n)
    return max(2 * max(sides), apart, extent * 1e-6, 1e-9)


def pairs(left: DataFrame, right: DataFrame, predicate: str = "intersects", by: float = 0.0, size: float | None = None) -> DataFrame:
    """Pairs of rows whose geometries hold the predicate: columns of both sides, named l_* and r_*.

    Both sides go to the grid cells their boxes cover and are joined by cell; a pair counts only in the cell of the larger of
    the two lower-left corners, so it is made once. Boxes are compared before the exact test. Nothing is crossed.
    """
    a = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns]).withColumn("box", bbox("l_geometry"))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("box", bbox("r_geometry"))
    size = max(size or cell_size(a, b), by)
    a, b = cells(a, size, by).withColumnRenamed("box", "lb"), cells(b, size).withColumnRenamed("box", "rb")
    j = a.join(b, ["cx", "cy"]).where(
        (F.col("lb.xmin") - by <= F.col("rb.xmax")) & (F.col("rb.xmin") - by <= F.col("lb.xmax")) & (F.col("lb.ymin") - by <= F.col("rb.ymax")) & (F.col("rb.ymin") - by <= F.col("lb.ymax"))
        & (F.col("cx") == F.floor(F.greatest(F.col("lb.xmin") - by, F.col("rb.xmin")) / size)) & (F.col("cy") == F.floor(F.greatest(F.col("lb.ymin") - by, F.col("rb.ymin")) / size))
    )
    return j.drop("cx", "cy", "lb", "rb").where(st_relate(predicate, by)("l_geometry", "r_geometry"))


#: Places that are searched for together, and how many such parts there are at most.
PART, MOST_PARTS = 32, 4096
#: Distances are compared with so much room for rounding.
ROOM = 1e-9


def _kinds(df: DataFrame) -> set[str]:
    """The kinds of the layer's geometries."""
    heads = [bytes(r[0]) for r in df.where(F.col(GEOM).isNotNull()).select(F.substring(GEOM, 1, 5)).distinct().limit(1000).collect()]
    return {G.KINDS[(struct.unpack(("<" if h[0] else ">") + "I", h[1:])[0] & 0x0FFFFFFF) % 1000] for h in heads}


@udf("x double, y double")
def _places(geometry: pd.Series) -> pd.DataFrame:
    p = _xy(geometry) if len(geometry) else None
    if p is None:
        p = np.array([G.from_wkb(w).coords[0, :2] for w in geometry]).reshape(-1, 2)
    return pd.DataFrame({"x": p[:, 0], "y": p[:, 1]})


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of batches of _rowid and lines: the rows and their segments, points as segments without length."""
    for batch in batches:
        row, geometry = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pandas()
        s = two_point(geometry) if len(geometry) else None
        if s is None:
            each = [np.zeros((0, 4)) if w is None else np.concatenate([G.segments(g := G.from_wkb(w)), np.tile(G._points(g), 2)]) for w in geometry]
            row, s = np.repeat(row, [len(x) for x in each]), np.concatenate([np.zeros((0, 4)), *each])
        fits = np.isfinite(s).all(1)
        for lo in range(0, len(s), 1 << 14):
            some = slice(lo, lo + (1 << 14))
            yield row[some][fits[some]], s[some][fits[some]]


class _Tree:
    """Parts of the plane: their centres, half diagonals, and the same of 16, 256, ... of them together."""

    def __init__(self, part: np.ndarray, box: np.ndarray):
        self.part, self.centre = part, (box[:, :2] + box[:, 2:]) / 2
        self.half = np.hypot(*(box[:, 2:] - box[:, :2]).T) / 2
        self.levels: list[list[tuple[slice, np.ndarray, np.ndarray]]] = []  # of each node: its parts, its centre and their centres' distances from it
        shift = 0
        while True:
            ids = part >> shift
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)]])
            nodes = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                c = (box[a:b, :2].min(0) + box[a:b, 2:].max(0)) / 2 if shift else self.centre[a]
                nodes.append((slice(a, b), c, np.hypot(*(self.centre[a:b] - c).T)))
            self.levels.insert(0, nodes)
            if len(nodes) <= 16:
                break
            shift += 4

    def near(self, s: np.ndarray, limit: np.ndarray, shrink: bool) -> Iterator[tuple[int, np.ndarray]]:
        """Of each part the segments not farther from its centre than the limit, found from many parts at once downwards.

        With `shrink` the limits are upper bounds of the least distances, and are lowered to what is met on the way.
        """
        todo = [(self.levels[0], np.arange(len(s)))]
        for level in range(len(self.levels)):
            below = []
            for nodes, at in todo:
                d = G.point_segment(np.array([c for _, c, _ in nodes]), s[at])[0]
                for (parts, _, off), e in zip(nodes, d, strict=True):
                    if shrink:
                        limit[parts] = np.minimum(limit[parts], e.min() + off)
                    own = at[e <= (limit[parts] + off).max() * (1 + ROOM)]
                    if not len(own):
                        continue
                    if level == len(self.levels) - 1:
                        yield parts.start, own
                    else:
                        below.append(([n for n in self.levels[level + 1] if parts.start <= n[0].start < parts.stop], own))
            todo = below


def _splits(p: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and value of the medians that halve the points again and again, in the order of a heap."""
    axis, value = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
    own = {0: p}
    for i in range(2**depth - 1):
        q = own.pop(i)
        if len(q):
            axis[i] = int(np.argmax(q.max(0) - q.min(0)))
            value[i] = np.median(q[:, axis[i]])
        left = q[:, axis[i]] <= value[i]
        own[2 * i + 1], own[2 * i + 2] = q[left], q[~left]
    return axis, value


def _closest(p: np.ndarray, s: np.ndarray, at: np.ndarray, out: np.ndarray, far: np.ndarray, rows: np.ndarray) -> None:
    """Into out and far for the points p[rows]: the first of the nearest segments s[at] and its distance.

    Halves of the points keep the segments that can be nearest to one of them: those at most a diagonal farther from the centre than the nearest.
    """
    if len(rows) <= 4 or len(rows) * len(at) <= 1 << 16:
        step = max(1, (1 << 18) // len(at))
        for lo in range(0, len(rows), step):
            some = rows[lo : lo + step]
            d = G.point_segment(p[some], s[at])[0]
            i = d.argmin(1)
            out[some], far[some] = at[i], d[np.arange(len(some)), i]
        return
    low, high = p[rows].min(0), p[rows].max(0)
    rows = rows[np.argsort(p[rows, int(np.argmax(high - low))], kind="stable")]
    for half in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        low, high = p[half].min(0), p[half].max(0)
        d = G.point_segment((low + high)[None] / 2, s[at])[0][0]
        _closest(p, s, at[d <= (d.min() + np.hypot(*(high - low))) * (1 + ROOM) + ROOM * np.abs([low, high]).max()], out, far, half)


def _nearest_lines(left: DataFrame, right: DataFrame, most: float | None) -> DataFrame:
    """nearest() of points among lines, which may be long: the boxes of such hold much of the plane and say little.

    The distinct places are dealt into parts by the medians of a sample of them. One pass over the lines finds for each part an
    upper bound of its centre's distance from the nearest line, a second one the lines that can be nearest to a place in the part:
    those at most the part's diagonal farther from its centre. Both go down a tree of the parts, of which 4096 at most are sent
    to the tasks. A part's places are then compared with its lines in one task. Lines that all touch one part meet there.
    `right` is read several times, so it should be saved.
    """
    places = cut(left.where(F.col(GEOM).isNotNull()).select(GEOM).distinct().withColumn("p", _places(GEOM)).select(GEOM, "p.x", "p.y").where("abs(x) < 'inf' and abs(y) < 'inf'"))  # NaN is above
    n = places.count()
    depth = min(math.ceil(math.log2(max(1, n / PART))), int(math.log2(MOST_PARTS)))
    share = 16 * 2**depth / max(n, 1)
    some = places.select("x", "y") if share >= 1 else places.select("x", "y").sample(share, 1)
    axis, value = _splits(some.toPandas().to_numpy(float).reshape(-1, 2), depth)

    @udf("int")
    def part_of(x: pd.Series, y: pd.Series) -> pd.Series:
        p, node = np.stack([x, y], 1), np.zeros(len(x), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (p[np.arange(len(p)), axis[node]] > value[node])
        return pd.Series((node - 2**depth + 1).astype(np.int32))

    placed = places.withColumn("part", part_of("x", "y"))
    boxes = np.array(sorted(tuple(r) for r in placed.groupBy("part").agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).collect()), float).reshape(-1, 5)
    lines = right.select(F.col(ROW).cast("long"), GEOM)
    if len(boxes):
        tree = _Tree(boxes[:, 0].astype(np.int64), boxes[:, 1:])

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            least = np.full(len(tree.part), np.inf)
            for _, s in _segments(batches):
                for _ in tree.near(s, least, True) if len(s) else ():
                    pass
            has = np.flatnonzero(np.isfinite(least))
            yield pa.RecordBatch.from_pydict({"i": has, "least": least[has]})

        limit = np.full(len(tree.part), -1.0)
        for i, least in lines.mapInArrow(bound, "i long, least double").groupBy("i").agg(F.min("least")).collect():
            limit[i] = least + 2 * tree.half[i]
        if most is not None:
            limit = np.minimum(limit, most + tree.half)
        limit += ROOM * np.abs(boxes[:, 1:]).max()

        def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row, s in _segments(batches):
                for i, at in tree.near(s, limit, False) if len(s) else ():
                    yield pa.RecordBatch.from_pydict({"part": np.full(len(at), tree.part[i], np.int32), "row": row[at], **{c: s[at, k] for k, c in enumerate(("x0", "y0", "x1", "y1"))}})

        def settle(places: pa.Table, lines: pa.Table) -> pa.Table:
            if not places.num_rows or not lines.num_rows:
                places, lines = places.slice(0, 0), lines.slice(0, 0)
            lines = lines.sort_by("row")
            p, s = (np.stack([t[c].to_numpy() for c in names], 1) for t, names in ((places, ("x", "y")), (lines, ("x0", "y0", "x1", "y1"))))
            at, far = np.zeros(len(p), np.int64), np.zeros(len(p))
            if len(p):
                _closest(p, s, np.arange(len(s)), at, far, np.arange(len(p)))
            return pa.table({"place": places[GEOM], "row": lines["row"].take(pa.array(at)), "distance": far})

        parts = 4 * max(left.sparkSession.sparkContext.defaultParallelism, 2)
        offered = lines.mapInArrow(offer, "part int, row long, x0 double, y0 double, x1 double, y1 double").repartition(parts, "part")
        near = placed.repartition(parts, "part").groupBy("part").cogroup(offered.groupBy("part")).applyInArrow(settle, "place binary, row long, distance double")
    else:
        near = left.sparkSession.createDataFrame([], "place binary, row long, distance double")
    near = cut(near if most is None else near.where(F.col("distance") <= most))
    # merged: Spark takes the saved tables for as small as the compressed files they came from, and would broadcast them
    out = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns]).join(near.hint("merge"), F.col(f"l_{GEOM}") == F.col("place"))
    out = out.hint("merge").join(right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]), F.col("row") == F.col(f"r_{ROW}"))
    return out.select(*[f"l_{c}" for c in left.columns], *[f"r_{c}" for c in right.columns], "distance", F.lit(1).alias("rank"))


def nearest(left: DataFrame, right: DataFrame, k: int = 1, most: float | None = None) -> DataFrame:
    """For each left row its k nearest right rows: l_*, r_*, distance, rank. Ties go to the smaller r__rowid.

    Rings of cells round each row are searched, doubling their width for the rows that are not settled yet. The one nearest line
    of a point is sought by _nearest_lines().
    """
    if k == 1 and dict(right.dtypes)[ROW] in ("bigint", "int") and _kinds(left) == {"Point"}:
        right = cut(spread(right))  # computed once, for its kinds and for the search
        if (kinds := _kinds(right)) & {"LineString", "MultiLineString"} and kinds <= {"LineString", "MultiLineString", "Point", "MultiPoint"}:
            return _nearest_lines(left, right, most)
    a, b = left.withColumn("box", bbox(GEOM)), right.withColumn("box", bbox(GEOM))
    r = b.agg(F.min("box.xmin"), F.min("box.ymin"), F.max("box.xmax"), F.max("box.ymax"), F.count(F.lit(1))).first()
    if not r[4] or r[0] is None:
        return left.limit(0).select(*[F.col(c).alias(f"l_{c}") for c in left.columns]).join(right.limit(0).select(*[F.col(c).alias(f"r_{c}") for c in right.columns]), F.lit(True)).withColumn("distance", F.lit(0.0)).withColumn("rank", F.lit(1))
    s = a.agg(F.min("box.xmin"), F.min("box.ymin"), F.max("box.xmax"), F.max("box.ymax")).first()
    whole = math.hypot(max(r[2], s[2] or r[2]) - min(r[0], s[0] or r[0]), max(r[3], s[3] or r[3]) - min(r[1], s[1] or r[1])) or 1.0
    reach = min(most, whole) if most is not None else min(whole, cell_size(b) * max(1.0, math.sqrt(k)))
    todo, found = left, None
    from pyspark.sql import Window

    order = Window.partitionBy(f"l_{ROW}").orderBy("distance", f"r_{ROW}")
    while True:
        near = pairs(todo, right, "dwithin", reach, reach).withColumn("distance", st_distance(f"l_{GEOM}", f"r_{GEOM}"))
        near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if reach >= whole or (most is not None and reach >= most):
            return near if found is None else found.unionByName(near)
        near = near.cache()
        done = near.groupBy(f"l_{ROW}").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col(f"l_{ROW}").alias(ROW))
        found_now = near.join(done.withColumnRenamed(ROW, f"l_{ROW}"), f"l_{ROW}", "left_semi")
        found = found_now if found is None else found.unionByName(found_now)
        todo = todo.join(done, ROW, "left_anti").where(F.col(GEOM).isNotNull())
        if todo.isEmpty():
            return found
        reach = min(reach * 4, whole, most if most is not None else math.inf)
