"""Rasters and point clouds. Files are read through Spark (binaryFile), so any store that it reads will do."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs as C
from ..functions import geometry as G
from ..sources import geotiff
from .attribute import _names, _need
from .layer import GEOM, ROW, identified, make_box, make_point, pairs, srid_of, st_x, st_y, transformed, with_geometry, with_srid, udf
from .registry import NotSupported, operator

TILE = "band int, row0 int, col0 int, height int, width int, x0 double, y0 double, dx double, dy double, nodata double, data binary, geometry binary"


def tiles(spark: SparkSession, path: str, size: int = 256, band: int | None = None) -> DataFrame:
    """A row for each band and tile: its place, its pixels (float64) and its box as geometry."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for raw in f["content"]:
                r = geotiff.read(raw)
                b, h, w = r.data.shape
                for k in range(b):
                    if band is not None and k + 1 != band:
                        continue
                    rows = []
                    for i in range(0, h, size):
                        for j in range(0, w, size):
                            a = r.data[k, i : i + size, j : j + size].astype("<f8")
                            x0, y0 = r.x0 + j * r.dx, r.y0 - i * r.dy
                            rows.append((k + 1, i, j, *a.shape, x0, y0, r.dx, r.dy, r.nodata, a.tobytes(), G.to_wkb(G.box(x0, y0 - a.shape[0] * r.dy, x0 + a.shape[1] * r.dx, y0))))
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in TILE.split(", ")])

    head = _load(spark, path)
    return with_srid(spark.read.format("binaryFile").load(path).select("content").mapInPandas(cut, TILE), head.srid)


def _load(spark: SparkSession, path: str) -> geotiff.Raster:
    """The whole raster on the driver: for operators whose result is one file again."""
    return geotiff.read(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))


def _store(spark: SparkSession, path: str, r: geotiff.Raster) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(geotiff.write(r)))
    out.close()


def _one(spark: SparkSession, r: geotiff.Raster, **values) -> DataFrame:
    df = spark.createDataFrame(pd.DataFrame([values]))
    return with_srid(df.withColumn(GEOM, F.lit(bytearray(G.to_wkb(G.box(*r.bounds))))), r.srid)


def _inside(g: G.Shape, x0, y0, dx, dy, h, w, touched: bool = False) -> np.ndarray:
    """Pixels whose middles (or, touched, any place) lie in the shape."""
    x, y = np.meshgrid(x0 + (np.arange(w) + 0.5) * dx, y0 - (np.arange(h) + 0.5) * dy)
    p = np.stack([x.ravel(), y.ravel()], 1)
    hit = G.in_area(p, g)
    if touched:
        for s in G.segments(g):
            n = max(2, int(4 * np.hypot(*(s[2:] - s[:2])) / min(dx, dy)) + 2)
            q = s[:2] + np.linspace(0, 1, n)[:, None] * (s[2:] - s[:2])
            i, j = ((y0 - q[:, 1]) / dy).astype(int), ((q[:, 0] - x0) / dx).astype(int)
            ok = (i >= 0) & (i < h) & (j >= 0) & (j < w)
            hit[i[ok] * w + j[ok]] = True
    return hit.reshape(h, w)


@operator("zonal_stats", "raster")
def zonal_stats(df: DataFrame, raster_path: str = "", stats=None, prefix: str = "rs_", nodata=None, band: int = 1) -> DataFrame:
    """Statistics of the pixels in each area: min, max, mean, std, count, sum, median. Areas meet tiles by a grid join; each pair gives partial sums."""
    stats = _names(stats) or ["min", "max", "mean", "std", "count"]
    had = ROW in df.columns
    df = identified(df)
    t = tiles(df.sparkSession, raster_path, band=band)
    zones = df.select(ROW, transformed(F.col(GEOM), srid_of(df), srid_of(t)).alias(GEOM))
    p = pairs(zones, t, "intersects")

    @udf("array<double>")
    def pixels(g: pd.Series, x0: pd.Series, y0: pd.Series, dx: pd.Series, dy: pd.Series, h: pd.Series, w: pd.Series, none: pd.Series, data: pd.Series) -> pd.Series:
        out = []
        for v in zip(g, x0, y0, dx, dy, h, w, none, data, strict=True):
            a = np.frombuffer(v[8], "<f8").reshape(v[5], v[6])
            skip = nodata if nodata is not None else v[7]
            ok = _inside(G.from_wkb(v[0]), *v[1:7]) & ~np.isnan(a)
            if skip is not None and skip == skip:
                ok &= a != skip
            out.append(a[ok])
        return pd.Series(out)

    vals = p.select(F.col(f"l_{ROW}").alias("_l"), F.explode(pixels(f"l_{GEOM}", *[f"r_{c}" for c in ("x0", "y0", "dx", "dy", "height", "width", "nodata", "data")])).alias("v"))
    how = {"min": F.min("v"), "max": F.max("v"), "mean": F.avg("v"), "std": F.stddev_pop("v"), "count": F.count("v"), "sum": F.sum("v"), "median": F.median("v")}
    got = vals.groupBy("_l").agg(*[how[s].alias(f"{prefix}{s}") for s in stats])
    out = df.join(got, F.col(ROW) == F.col("_l"), "left").drop("_l")
    if "count" in stats:
        out = out.withColumn(f"{prefix}count", F.coalesce(f"{prefix}count", F.lit(0)))
    return with_srid(out if had else out.drop(ROW), srid_of(df))


MOST_SHAPES = 100_000


def _mask_shapes(df: DataFrame, srid: int) -> G.Shape:
    rows = df.where(F.col(GEOM).isNotNull()).select(transformed(F.col(GEOM), srid_of(df), srid).alias("g")).limit(MOST_SHAPES + 1).collect()
    if len(rows) > MOST_SHAPES:
        raise ValueError(f"a raster mask takes {MOST_SHAPES} shapes")
    return G.Shape("GeometryCollection", parts=[G.from_wkb(bytes(r[0])) for r in rows])


@operator("raster_clip", "raster")
def raster_clip(df: DataFrame, raster_path: str = "", output_path: str = "", all_touched: bool = False, crop: bool = True, nodata=None) -> DataFrame:
    spark = df.sparkSession
    r = _load(spark, raster_path)
    g = _mask_shapes(df, r.srid)
    ok = _inside(g, r.x0, r.y0, r.dx, r.dy, *r.data.shape[1:], all_touched)
    none = nodata if nodata is not None else r.nodata if r.nodata is not None else 0
    data = np.where(ok, r.data, np.array(none).astype(r.data.dtype))
    x0, y0 = r.x0, r.y0
    if crop and ok.any():
        i, j = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
        data, x0, y0 = data[:, i[0] : i[-1] + 1, j[0] : j[-1] + 1], x0 + j[0] * r.dx, y0 - i[0] * r.dy
    out = geotiff.Raster(data, x0, y0, r.dx, r.dy, r.srid, float(none))
    _store(spark, output_path, out)
    return _one(spark, out, output_path=output_path)


@operator("ndvi", "raster")
def ndvi(df: DataFrame, raster_path: str = "", output_path: str = "", red_band: int = 3, nir_band: int = 4) -> DataFrame:
    spark = df.sparkSession
    r = _load(spark, raster_path)
    if max(red_band, nir_band) > len(r.data):
        raise ValueError(f"the raster has {len(r.data)} bands")
    red, nir = r.data[red_band - 1].astype(float), r.data[nir_band - 1].astype(float)
    ok = r.valid(red_band - 1) & r.valid(nir_band - 1) & (red + nir != 0)
    v = np.full(red.shape, np.nan, np.float32)
    v[ok] = ((nir - red)[ok] / (nir + red)[ok]).astype(np.float32)
    out = geotiff.Raster(v[None], r.x0, r.y0, r.dx, r.dy, r.srid, math.nan)
    _store(spark, output_path, out)
    s = [float(f(v[ok].astype(float))) if ok.any() else math.nan for f in (np.min, np.max, np.mean)]
    return _one(spark, out, output_path=output_path, ndvi_min=s[0], ndvi_max=s[1], ndvi_mean=s[2])


def warp(r: geotiff.Raster, srid: int, resampling: str = "nearest") -> geotiff.Raster:
    b, h, w = r.data.shape
    edge = np.concatenate([np.stack([np.linspace(r.bounds[0], r.bounds[2], 50), np.full(50, y)], 1) for y in (r.bounds[1], r.bounds[3])] + [np.stack([np.full(50, x), np.linspace(r.bounds[1], r.bounds[3], 50)], 1) for x in (r.bounds[0], r.bounds[2])])
    q = C.transform(edge, r.srid, srid)
    (x0, y0), (x1, y1) = q.min(0), q.max(0)
    size = math.hypot(x1 - x0, y1 - y0) / math.hypot(w, h)
    nw, nh = max(1, math.ceil((x1 - x0) / size - 1e-9)), max(1, math.ceil((y1 - y0) / size - 1e-9))

    def look(sub: int) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.meshgrid(x0 + (np.arange(nw * sub) + 0.5) * size / sub, y1 - (np.arange(nh * sub) + 0.5) * size / sub)
        p = C.transform(np.stack([x.ravel(), y.ravel()], 1), srid, r.srid)
        return ((r.y0 - p[:, 1]) / r.dy - 0.5).reshape(x.shape), ((p[:, 0] - r.x0) / r.dx - 0.5).reshape(x.shape)

    none = r.nodata if r.nodata is not None else 0
    src = np.where(np.stack([r.valid(k) for k in range(b)]), r.data, np.nan).astype(float)

    def kernel(t: np.ndarray) -> np.ndarray:
        t = np.abs(t)
        if resampling == "bilinear":
            return np.maximum(0, 1 - t)
        if resampling == "cubic":
            return np.where(t < 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0))
        return np.where(t < 3, np.sinc(t) * np.sinc(t / 3), 0)

    if resampling in ("bilinear", "cubic", "lanczos"):
        reach = {"bilinear": 1, "cubic": 2, "lanczos": 3}[resampling]
        i, j = look(1)
        total, weight = np.zeros((b, nh, nw)), np.zeros((b, nh, nw))
        for di in range(-reach + 1, reach + 1):
            for dj in range(-reach + 1, reach + 1):
                a, c = np.floor(i).astype(int) + di, np.floor(j).astype(int) + dj
                ok = (a >= 0) & (a < h) & (c >= 0) & (c < w)
                v = src[:, a.clip(0, h - 1), c.clip(0, w - 1)]
                k = kernel(i - a) * kernel(j - c) * ok * ~np.isnan(v)
                total += np.where(np.isnan(v), 0, v) * k
                weight += k
        inside = (i > -0.5 - 1e-9) & (i < h - 0.5 + 1e-9) & (j > -0.5 - 1e-9) & (j < w - 0.5 + 1e-9)
        with np.errstate(invalid="ignore", divide="ignore"):
            out = np.where((np.abs(weight) > 1e-6) & inside, total / weight, np.nan)
    else:
        sub = 1 if resampling == "nearest" else 4
        i, j = look(sub)
        a, c = np.rint(i).astype(int), np.rint(j).astype(int)
        ok = (a >= 0) & (a < h) & (c >= 0) & (c < w)
        v = np.where(ok, src[:, a.clip(0, h - 1), c.clip(0, w - 1)], np.nan)
        if sub == 1:
            out = v
        else:
            v = v.reshape(b, nh, sub, nw, sub).transpose(0, 1, 3, 2, 4).reshape(b, nh, nw, sub * sub)
            if resampling == "average":
                n = (~np.isnan(v)).sum(-1)
                out = np.where(n > 0, np.nansum(v, -1) / np.maximum(n, 1), np.nan)
            elif resampling == "mode":
                s = np.sort(v, -1)
                same = (s[..., :, None] == s[..., None, :]).sum(-1)
                out = np.take_along_axis(s, same.argmax(-1)[..., None], -1)[..., 0]
            else:
                raise ValueError(f"unknown resampling {resampling}")
    if r.data.dtype.kind in "iu":
        out = np.rint(out)
    return geotiff.Raster(np.where(np.isnan(out), none, out).astype(r.data.dtype), x0, y1, size, size, srid, float(none))


@operator("raster_reproject", "raster")
def raster_reproject(df: DataFrame, raster_path: str = "", output_path: str = "", target_crs="EPSG:4326", resampling: str = "nearest") -> DataFrame:
    spark = df.sparkSession
    out = warp(_load(spark, raster_path), C.srid(target_crs), resampling)
    _store(spark, output_path, out)
    return _one(spark, out, output_path=output_path, target_crs=f"EPSG:{out.srid}")


@operator("raster_merge", "raster")
def raster_merge(df: DataFrame, raster_paths=None, output_path: str = "", method: str = "first", nodata=None) -> DataFrame:
    """Rasters of one grid step laid over each other; method first, last, min, max, sum or count."""
    paths = list(raster_paths or [])
    if len(paths) < 2:
        raise ValueError("at least two rasters")
    if method not in ("first", "last", "min", "max", "sum", "count"):
        raise ValueError(f"unknown method {method}")
    spark = df.sparkSession
    rs = [_load(spark, p) for p in paths]
    r = rs[0]
    x0, y0 = min(q.bounds[0] for q in rs), max(q.bounds[3] for q in rs)
    x1, y1 = max(q.bounds[2] for q in rs), min(q.bounds[1] for q in rs)
    h, w = round((y0 - y1) / r.dy), round((x1 - x0) / r.dx)
    b = len(r.data)
    acc, seen = np.full((b, h, w), np.nan), np.zeros((b, h, w))
    for q in rs:
        i, j = round((y0 - q.y0) / r.dy), round((q.x0 - x0) / r.dx)
        v = np.where(np.stack([q.valid(k) for k in range(b)]), q.data[:b], np.nan).astype(float)
        s = (slice(None), slice(i, i + v.shape[1]), slice(j, j + v.shape[2]))
        old, ok = acc[s], ~np.isnan(v)
        new = {"first": np.where(np.isnan(old), v, old), "last": np.where(ok, v, old), "min": np.fmin(old, v), "max": np.fmax(old, v), "sum": np.where(np.isnan(old), v, old + np.where(ok, v, 0)), "count": old}[method]
        acc[s] = new
        seen[s] += ok
    none = nodata if nodata is not None else r.nodata if r.nodata is not None else 0
    data = seen if method == "count" else np.where(np.isnan(acc), none, acc)
    out = geotiff.Raster(data.astype(r.data.dtype), x0, y0, r.dx, r.dy, r.srid, float(none))
    _store(spark, output_path, out)
    return _one(spark, out, output_path=output_path, n_sources=len(paths))


@operator("change_detection", "raster")
def change_detection(df: DataFrame, raster_before: str = "", raster_after: str = "", threshold: float = 0.0, band: int = 1, output_crs=None) -> DataFrame:
    """Connected areas (by edges) of pixels that changed by more than the threshold, with diff_mean."""
    spark = df.sparkSession
    a, b = _load(spark, raster_before), _load(spark, raster_after)
    if a.data.shape[1:] != b.data.shape[1:]:
        raise ValueError("the rasters differ in size")
    diff = b.data[band - 1].astype(float) - a.data[band - 1].astype(float)
    hit = (np.abs(diff) > threshold) & a.valid(band - 1) & b.valid(band - 1)
    label = np.where(hit, np.arange(hit.size).reshape(hit.shape), -1)
    while True:
        low = label.copy()
        for s, t in (((slice(1, None), slice(None)), (slice(None, -1), slice(None))), ((slice(None), slice(1, None)), (slice(None), slice(None, -1)))):
            for p, q in ((s, t), (t, s)):
                both = hit[p] & hit[q]
                low[p] = np.where(both, np.minimum(low[p], low[q]), low[p])
        if (low == label).all():
            break
        label = low
    rows = []
    for k in np.unique(label[hit]):
        i, j = np.nonzero(label == k)
        sides: dict[tuple, list] = {}
        for y, x in zip(i.tolist(), j.tolist(), strict=True):
            for p, q in (((x, y + 1), (x + 1, y + 1)), ((x + 1, y + 1), (x + 1, y)), ((x + 1, y), (x, y)), ((x, y), (x, y + 1))):
                if (q, p) in sides:
                    del sides[q, p]
                else:
                    sides[p, q] = []
        e = np.array([[a.x0 + p[0] * a.dx, a.y0 - p[1] * a.dy, a.x0 + q[0] * a.dx, a.y0 - q[1] * a.dy] for p, q in sides])
        rows.append((float(diff[i, j].mean()), len(i), bytearray(G.to_wkb(G.build_area(G.trace(e))))))
    out = with_srid(spark.createDataFrame(rows, "diff_mean double, n_pixels long, geometry binary"), a.srid)
    if output_crs:
        to = C.srid(output_crs)
        out = with_geometry(out, transformed(F.col(GEOM), a.srid, to), to)
    return out


# ---------------------------------------------------------------- point clouds

LAS = "x double, y double, z double, intensity int, return_number int, number_of_returns int, classification int, scan_angle double, gps_time double"


def read_las(raw: bytes) -> pd.DataFrame:
    if raw[:4] != b"LASF":
        raise ValueError("no LAS file")
    kind = raw[104]
    if kind & 0x80:
        raise NotSupported("compressed point clouds (LAZ) need a LASzip library")
    head, size = struct.unpack_from("<I", raw, 96)[0], struct.unpack_from("<H", raw, 105)[0]
    n = struct.unpack_from("<I", raw, 107)[0] or (struct.unpack_from("<Q", raw, 247)[0] if raw[25] >= 4 else 0)
    scale, shift = struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155)
    a = np.frombuffer(raw, np.uint8, n * size, head).reshape(n, size)
    get = lambda at, t: np.ascontiguousarray(a[:, at : at + np.dtype(t).itemsize]).view(t).ravel()
    out = {c: get(4 * i, "<i4") * scale[i] + shift[i] for i, c in enumerate("xyz")}
    out["intensity"] = get(12, "<u2").astype(int)
    flags = a[:, 14].astype(int)
    if kind >= 6:
        out |= {"return_number": flags & 15, "number_of_returns": flags >> 4, "classification": a[:, 16].astype(int), "scan_angle": get(18, "<i2") * 0.006, "gps_time": get(22, "<f8")}
    else:
        out |= {"return_number": flags & 7, "number_of_returns": flags >> 3 & 7, "classification": a[:, 15].astype(int) & 31, "scan_angle": get(16, "i1").astype(float), "gps_time": get(20, "<f8") if kind in (1, 3, 4, 5) else np.full(n, np.nan)}
    return pd.DataFrame(out)


@operator("pointcloud_load_las", "pointcloud")
def pointcloud_load_las(df: DataFrame, path: str = "", crs=None, max_points=None, classifications=None) -> DataFrame:
    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for raw in f["content"]:
                t = read_las(raw)
                if classifications:
                    t = t[t["classification"].isin(list(classifications))]
                if max_points:
                    t = t.head(max_points)
                for lo in range(0, len(t), 100_000):
                    part = t.iloc[lo : lo + 100_000].copy()
                    part[GEOM] = [G.to_wkb(G.point(*p)) for p in part[["x", "y", "z"]].to_numpy()]
                    yield part.drop(columns=["x", "y"])

    spark = df.sparkSession
    schema = LAS.replace("x double, y double, ", "") + f", {GEOM} binary"
    out = spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, schema)
    return with_srid(out, C.srid(crs) if crs else 2154)


@operator("pointcloud_filter_classification", "pointcloud")
def pointcloud_filter_classification(df: DataFrame, keep=None, drop=None, col: str = "classification") -> DataFrame:
    _need(df, col)
    if keep:
        df = df.where(F.col(col).isin(list(keep)))
    return df.where(~F.col(col).isin(list(drop)) | F.col(col).isNull()) if drop else df


def _z(df: DataFrame):
    from .layer import shapes

    return F.col("z").cast("double") if "z" in df.columns else shapes(lambda g: float(g.coords[0, 2]) if g.z and not g.empty else None, "double")(GEOM)


def _z_stats(names, z: str, prefix: str):
    how = {"min": F.min(z), "max": F.max(z), "mean": F.avg(z), "median": F.median(z), "std": F.stddev_pop(z), "count": F.count(z), "p90": F.percentile(z, 0.9), "p95": F.percentile(z, 0.95), "p99": F.percentile(z, 0.99)}
    if bad := [n for n in names if n not in how]:
        raise ValueError(f"unknown statistic {bad[0]}")
    return [how[n].alias(f"{prefix}{n}") for n in names]


@operator("pointcloud_zonal_height", "pointcloud")
def pointcloud_zonal_height(df: DataFrame, ref_gdf=None, stats=None, prefix: str = "z_", ground_col=None) -> DataFrame:
    """Heights of the points (ref_gdf) in each area, and height: the highest less the ground (ground_col, or the lowest)."""
    stats = _names(stats) or ["min", "max", "mean", "count"]
    had = ROW in df.columns
    df = identified(df)
    from .layer import aligned

    ref = identified(aligned(ref_gdf, df))
    pts = ref.select(ROW, _z(ref).alias("z"), GEOM)
    p = pairs(pts, df.select(ROW, GEOM), "within").select(F.col(f"r_{ROW}").alias("_r"), F.col("l_z").alias("z"))
    got = p.groupBy("_r").agg(*_z_stats(stats, "z", prefix), F.min("z").alias("_lo"), F.max("z").alias("_hi"))
    out = df.join(got, F.col(ROW) == F.col("_r"), "left")
    ground = F.col(ground_col).cast("double") if ground_col else F.col("_lo")
    out = out.withColumn(f"{prefix}height", F.col("_hi") - ground).drop("_r", "_lo", "_hi")
    if "count" in stats:
        out = out.withColumn(f"{prefix}count", F.coalesce(f"{prefix}count", F.lit(0)))
    return with_srid(out if had else out.drop(ROW), srid_of(df))


@operator("pointcloud_grid_summary", "pointcloud")
def pointcloud_grid_summary(df: DataFrame, cell_size: float = 1.0, stats=None, drop_empty: bool = True) -> DataFrame:
    """Statistics by square cell from the lower left point: row, col, z_*, geometry. Only cells with points exist."""
    stats = _names(stats) or ["min", "max", "mean", "count"]
    pts = df.where(F.col(GEOM).isNotNull()).select(st_x(GEOM).alias("x"), st_y(GEOM).alias("y"), _z(df).alias("z"))
    x0, y0 = pts.agg(F.min("x"), F.min("y")).first()
    x0, y0 = x0 or 0.0, y0 or 0.0
    at = lambda c, o: F.floor((F.col(c) - o) / cell_size)
    out = pts.groupBy(at("y", y0).alias("row"), at("x", x0).alias("col")).agg(*_z_stats(stats, "z", "z_"))
    x, y = F.lit(x0) + F.col("col") * cell_size, F.lit(y0) + F.col("row") * cell_size
    return with_srid(out.withColumn(GEOM, make_box(x, y, x + cell_size, y + cell_size)), srid_of(df))


__all__ = ["make_point"]
