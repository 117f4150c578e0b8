"""Clusters and spatial statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .attribute import _need
from .graph import components, cut, running_total
from .layer import GEOM, ROW, identified, metric, nearest, pair_shapes, pairs, srid_of, st_centroid, st_x, st_y, transformed, with_srid, udf
from .registry import operator


def _centroids(df: DataFrame, crs_meters) -> DataFrame:
    """_rowid, x, y in metres, and the centroid as geometry."""
    c = df.where(F.col(GEOM).isNotNull()).select(ROW, st_centroid(transformed(F.col(GEOM), srid_of(df), metric(df, crs_meters))).alias(GEOM))
    return c.withColumns({"x": st_x(GEOM), "y": st_y(GEOM)})


def near_points(p: DataFrame, eps: float) -> DataFrame:
    """Pairs a, b, d of points (_rowid, x, y) not farther than eps apart, both ways and not with themselves: cells of side eps, plain columns."""
    cell = p.select(F.col(ROW).alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.floor(F.col("x") / eps).alias("cx"), F.floor(F.col("y") / eps).alias("cy"))
    own = p.select(F.col(ROW).alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    own = own.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
    own = own.select("a", "ax", "ay", (F.floor(F.col("ax") / eps) + F.col("dx")).alias("cx"), (F.floor(F.col("ay") / eps) + F.col("dy")).alias("cy"))
    d = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    return own.join(cell, ["cx", "cy"]).where("a <> b").withColumn("d", d).where(F.col("d") <= eps).select("a", "b", "d")


@operator("cluster_dbscan", "clustering")
def cluster_dbscan(df: DataFrame, eps: float = 100.0, min_samples: int = 5, cluster_col: str = "cluster", crs_meters="EPSG:3857") -> DataFrame:
    """Clusters of centroids, numbered by their first core row; -1 is noise. A border row joins its core neighbour's lowest cluster."""
    had = ROW in df.columns
    df = identified(df)
    links = cut(near_points(_centroids(df, crs_meters), eps).select("a", "b"))
    cores = links.groupBy("a").agg((F.count(F.lit(1)) + 1).alias("n")).where(F.col("n") >= min_samples).select(F.col("a").alias("core"))
    if min_samples <= 1:
        cores = df.where(F.col(GEOM).isNotNull()).select(F.col(ROW).alias("core"))
    between = links.join(cores, F.col("a") == F.col("core"), "left_semi").join(cores.withColumnRenamed("core", "c2"), F.col("b") == F.col("c2"), "left_semi")
    root = cores.join(components(between), F.col("core") == F.col("node"), "left").select("core", F.coalesce("root", "core").alias("root"))
    order = running_total(root.select("root").distinct().withColumn("_one", F.lit(1)), [F.col("root")], "_one", cluster_col).drop("_one")
    root = cut(root.join(order, "root").select("core", cluster_col))
    border = links.join(cores, F.col("a") == F.col("core"), "left_anti").join(root, F.col("b") == F.col("core")).groupBy(F.col("a").alias("core")).agg(F.min(cluster_col).alias(cluster_col))
    label = root.unionByName(border)
    out = df.join(label, F.col(ROW) == F.col("core"), "left").drop("core").withColumn(cluster_col, F.coalesce(cluster_col, F.lit(-1)).cast("long"))
    return with_srid(out if had else out.drop(ROW), srid_of(df))


@operator("cluster_kmeans", "clustering")
def cluster_kmeans(df: DataFrame, k: int = 5, cluster_col: str = "cluster", distance_col: str = "cluster_dist", random_state: int = 42, crs_meters="EPSG:3857") -> DataFrame:
    """Spark's k-means|| on centroids; labels are in the order of the centres' coordinates."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    had = ROW in df.columns
    df = identified(df)
    pts = VectorAssembler(inputCols=["x", "y"], outputCol="v").transform(_centroids(df, crs_meters).drop(GEOM))
    centres = [tuple(map(float, c)) for c in KMeans(k=k, seed=random_state, featuresCol="v", maxIter=100, tol=1e-9).fit(pts).clusterCenters()]
    centres.sort()
    d = [F.sqrt((F.col("x") - a) ** 2 + (F.col("y") - b) ** 2) for a, b in centres]
    near = F.array_min(F.array(*[F.struct(x.alias("d"), F.lit(i).cast("long").alias("i")) for i, x in enumerate(d)]))
    label = pts.select(F.col(ROW).alias("_r"), near.alias("_n")).select("_r", F.col("_n.i").alias(cluster_col), F.col("_n.d").alias(distance_col))
    out = df.join(label, F.col(ROW) == F.col("_r"), "left").drop("_r")
    return with_srid(out if had else out.drop(ROW), srid_of(df))


def hdbscan(p: np.ndarray, size: int, samples: int, epsilon: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Labels and probabilities: minimum spanning tree of mutual reachability, condensed, the most stable clusters taken."""
    n = len(p)
    if n < max(2, size):
        return np.full(n, -1), np.zeros(n)
    # equal points have the same core distance, at which they join each other; the tree is sought between distinct places
    _, first, place, times = np.unique(p, axis=0, return_index=True, return_inverse=True, return_counts=True)
    rank = np.argsort(first)
    first, times, back = first[rank], times[rank], np.empty(len(rank), int)
    back[rank] = np.arange(len(rank))
    place = back[place.ravel()]
    u, k, need = p[first], len(first), min(samples, n)
    core = np.empty(k)
    for i in range(k):
        d = np.hypot(*(u - u[i]).T)
        if k == n:
            core[i] = np.partition(d, need - 1)[need - 1]
        else:
            close = np.argpartition(d, min(need, k) - 1)[: min(need, k)]  # each stands for one point at least
            close = close[np.argsort(d[close])]
            core[i] = d[close[np.searchsorted(np.cumsum(times[close]), need)]]
    edges = [(core[place[i]], int(first[place[i]]), i) for i in range(n) if first[place[i]] != i]
    near, origin, left_x, left_y, left_core, ids = np.full(k, np.inf), np.zeros(k, int), u[:, 0], u[:, 1], core, np.arange(k)
    cur = 0
    for _ in range(k - 1):
        x, y, c = u[cur, 0], u[cur, 1], core[cur]
        live = ids != cur
        near, origin, left_x, left_y, left_core, ids = (v[live] for v in (near, origin, left_x, left_y, left_core, ids))
        d = np.maximum(np.maximum(np.hypot(left_x - x, left_y - y), left_core), c)
        better = d < near
        near[better], origin[better] = d[better], cur
        at = int(near.argmin())
        cur = int(ids[at])
        edges.append((near[at], int(first[origin[at]]), int(first[cur])))
    edges.sort()
    root, left, weight = list(range(2 * n - 1)), [1] * n + [0] * (n - 1), [0.0] * (2 * n - 1)
    kids: list[tuple[int, int] | None] = [None] * (2 * n - 1)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, (d, a, b) in enumerate(edges):
        a, b, new = find(a), find(b), n + k
        root[a] = root[b] = new
        kids[new], weight[new], left[new] = (a, b), d, left[a] + left[b]

    def leaves(x: int) -> list[int]:
        todo, got = [x], []
        while todo:
            v = todo.pop()
            got.append(v) if v < n else todo.extend(kids[v])
        return got

    birth, parent, stable, fell = {0: 0.0}, {0: -1}, {0: 0.0}, np.zeros(n)
    member = np.zeros(n, int)
    todo, count = [(2 * n - 2, 0)], 1
    while todo:
        v, c = todo.pop()
        while v >= n:
            lam = 1 / weight[v] if weight[v] else np.inf
            a, b = kids[v]
            if left[a] >= size and left[b] >= size:
                stable[c] += (left[a] + left[b]) * (lam - birth[c]) if lam < np.inf else 0
                for x in (a, b):
                    birth[count], parent[count], stable[count] = lam, c, 0.0
                    todo.append((x, count))
                    count += 1
                break
            small = [x for x in (a, b) if left[x] < size]
            for x in small:
                for leaf in leaves(x):
                    member[leaf], fell[leaf] = c, lam
                    stable[c] += (lam if lam < np.inf else 0) - (birth[c] if birth[c] < np.inf else 0)
            if len(small) == 2:
                break
            v = a if small[0] == b else b
        else:
            member[v] = c
    chosen = {c: True for c in birth if c}
    total = dict(stable)
    under: dict[int, list[int]] = {}
    for x in birth:
        under.setdefault(parent[x], []).append(x)
    for c in sorted(birth, reverse=True):
        below = under.get(c, [])
        if below and c:
            s = sum(total[x] for x in below)
            if s > total[c]:
                total[c] = s
                chosen[c] = False
            else:
                todo = list(below)
                while todo:
                    x = todo.pop()
                    if chosen.pop(x, None) is not None:  # what lies under one left out before is left out too
                        todo += under.get(x, [])
    if epsilon:
        for c in [c for c in chosen if chosen[c] and 1 / birth[c] < epsilon]:
            x = c
            while parent[x] > 0 and 1 / birth[x] < epsilon:
                x = parent[x]
            chosen[c] = False
            if not any(chosen.get(y) for y in _above(x, parent)):
                chosen[x] = True
    take = {c: i for i, c in enumerate(sorted(c for c in chosen if chosen[c]))}
    of = np.full(len(birth), -1)  # a cluster's number comes after its parent's
    for c in range(1, len(birth)):
        of[c] = take.get(c, of[parent[c]])
    label = of[member]
    prob = np.zeros(n)
    order = np.argsort(label, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        if label[own[0]] < 0:
            continue
        f = np.where(np.isinf(fell[own]), np.nan, fell[own])
        top = np.nanmax(f) if np.isfinite(f).any() else 1.0
        prob[own] = np.where(np.isnan(f), 1.0, f / top if top else 1.0)
    return label, prob


def _above(c: int, parent: dict) -> list[int]:
    out = [c]
    while parent[out[-1]] >= 0:
        out.append(parent[out[-1]])
    return out


@operator("cluster_hdbscan", "clustering")
def cluster_hdbscan(df: DataFrame, min_cluster_size: int = 5, min_samples=None, cluster_selection_epsilon: float = 0.0, cluster_col: str = "cluster", probability_col: str = "cluster_probability", crs_meters="EPSG:3857") -> DataFrame:
    """One task holds all rows and compares all distinct places with each other: time in their square, memory in their number."""
    had = ROW in df.columns
    df = identified(df)
    p = _centroids(df, crs_meters).select(ROW, "x", "y")

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(ROW)
        label, prob = hdbscan(t[["x", "y"]].to_numpy(float), min_cluster_size, min_samples or min_cluster_size, cluster_selection_epsilon)
        return pd.DataFrame({"_r": t[ROW].to_numpy(), cluster_col: label, probability_col: prob})

    got = p.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, f"_r long, {cluster_col} long, {probability_col} double")
    out = df.join(got, F.col(ROW) == F.col("_r"), "left").drop("_r")
    return with_srid(out if had else out.drop(ROW), srid_of(df))


# ---------------------------------------------------------------- weights and statistics


def _border(a: G.Shape, b: G.Shape) -> float:
    """Length that two areas' edges share."""
    s, t = G.segments(a), G.segments(b)
    total = 0.0
    for seg in s:
        d = seg[2:] - seg[:2]
        n = float(np.hypot(*d))
        if not n:
            continue
        u = d / n
        rel = t.reshape(-1, 2, 2) - seg[:2]
        off = np.abs(rel[:, :, 0] * u[1] - rel[:, :, 1] * u[0]).max(1)
        at = rel @ u
        on = off <= 1e-9 * max(1.0, n)
        lo, hi = at.min(1).clip(0, n), at.max(1).clip(0, n)
        total += float((hi - lo)[on].sum())
    return total


st_border = pair_shapes(_border, "double")


def neighbours(df: DataFrame, method: str = "queen", k: int = 8, threshold=None, crs_meters="EPSG:3857") -> DataFrame:
    """Pairs a, b of neighbouring rows, both ways: queen (touch), rook (share a border), knn or distance_band (of centroids)."""
    own, to = srid_of(df), metric(df, crs_meters)
    if method in ("queen", "rook"):
        g = df.select(ROW, transformed(F.col(GEOM), own, to).alias(GEOM))
        p = pairs(g, g, "intersects").where(f"l_{ROW} <> r_{ROW}")
        if method == "rook":
            p = p.where(st_border(f"l_{GEOM}", f"r_{GEOM}") > 1e-9)
        return p.select(F.col(f"l_{ROW}").alias("a"), F.col(f"r_{ROW}").alias("b"))
    c = _centroids(df, crs_meters)
    if method == "knn":
        p = nearest(c.select(ROW, GEOM), c.select(ROW, GEOM), k + 1).where(f"l_{ROW} <> r_{ROW}")
        rank = F.row_number().over(Window.partitionBy(f"l_{ROW}").orderBy("distance", f"r_{ROW}"))
        return p.withColumn("_k", rank).where(F.col("_k") <= k).select(F.col(f"l_{ROW}").alias("a"), F.col(f"r_{ROW}").alias("b"))
    if method == "distance_band":
        if threshold is None:
            raise ValueError("distance_band needs a threshold")
        return near_points(c, float(threshold)).select("a", "b")
    raise ValueError(f"unknown method {method}")


@operator("spatial_weights", "statistics")
def spatial_weights(df: DataFrame, method: str = "queen", k: int = 8, threshold=None, crs_meters="EPSG:3857", col_prefix: str = "w") -> DataFrame:
    had = ROW in df.columns
    df = identified(df)
    n = neighbours(df, method, k, threshold, crs_meters).groupBy(F.col("a").alias("_a")).agg(F.count(F.lit(1)).alias("_n"))
    out = df.join(n, F.col(ROW) == F.col("_a"), "left").withColumn(f"{col_prefix}_neighbors", F.coalesce("_n", F.lit(0)).cast("long")).drop("_a", "_n")
    return with_srid(out if had else out.drop(ROW), srid_of(df))


MOST_PERMUTED = 200_000


@operator("morans_i", "statistics")
def morans_i(df: DataFrame, field: str = "", method: str = "queen", k: int = 8, threshold=None, permutations: int = 999, crs_meters="EPSG:3857") -> DataFrame:
    """One row: morans_i, expected_i, z_score, p_value, n, n_links. Row-standardised weights; the p-value is from permutations.

    The statistic itself is sums over the links, which stay in the tasks. Permutations need all values at once, which each task is
    sent, for at most 200 000 rows; beyond it p_value and z_score are null. They run only where one of these columns is used.
    """
    _need(df, field)
    df = identified(df)
    x = df.where(F.col(GEOM).isNotNull()).select(F.col(ROW).alias("r"), F.col(field).cast("double").alias("x"))
    n, bad, mean, ss = x.agg(F.count(F.lit(1)), F.count_if(F.col("x").isNull() | F.isnan("x")), F.avg("x"), F.var_pop("x") * F.count("x")).first()
    if bad:
        raise ValueError(f"{field} has missing values")
    spark = df.sparkSession
    schema = "morans_i double, expected_i double, z_score double, p_value double, n long, n_links long"
    if not n or not ss:
        return spark.createDataFrame([(math.nan, -1 / (n - 1) if n and n > 1 else math.nan, math.nan, math.nan, n or 0, 0)], schema)
    link = neighbours(df, method, k, threshold, crs_meters)
    z = x.withColumn("z", F.col("x") - mean)
    # summed by row, so that the links, which can be thousands a row, are neither stored nor moved to the driver
    lag = cut(link.join(z.select(F.col("r").alias("b"), "z"), "b").groupBy("a").agg(F.sum("z").alias("s"), F.count(F.lit(1)).alias("d")))
    num, s0, m = lag.join(z.select(F.col("r").alias("a"), F.col("z").alias("za")), "a").agg(F.sum(F.col("za") * F.col("s") / F.col("d")), F.count(F.lit(1)), F.sum("d")).first()
    if not s0:
        return spark.createDataFrame([(math.nan, -1 / (n - 1), math.nan, math.nan, n, 0)], schema)
    i = float(n / s0 * num / ss)
    none = F.lit(None).cast("double")
    p, zs = none, none
    if permutations and n <= MOST_PERMUTED:
        sims = _permuted(link.join(lag.select("a", "d"), "a").select("a", "b", "d"), z, permutations)
        stat = F.col("sum") * (n / s0 / ss)
        tell = sims.agg(F.count_if(stat >= i).alias("more"), F.avg(stat).alias("mean"), F.stddev_pop(stat).alias("sd"))
        p = tell.select((F.least("more", F.lit(permutations) - F.col("more")) + 1) / (permutations + 1)).scalar()  # not run unless it is wanted
        zs = tell.select(F.when(F.col("sd") > 0, (F.lit(i) - F.col("mean")) / F.col("sd")).otherwise(math.nan)).scalar()
    one = spark.createDataFrame([(i, -1 / (n - 1), n, m)], "morans_i double, expected_i double, n long, n_links long")
    return one.select("morans_i", "expected_i", zs.alias("z_score"), p.alias("p_value"), "n", "n_links")


def _permuted(links: DataFrame, z: DataFrame, permutations: int) -> DataFrame:
    """q, sum: of y[a] * y[b] / d over all links (a, b, d) for each seeded shuffle y of the values (r, z). Every task makes the same
    shuffles and goes through its own links, a few million at a time."""
    rows = z.select("r", "z").orderBy("r").toPandas()  # bounded by MOST_PERMUTED
    spark = z.sparkSession
    values = spark.sparkContext.broadcast((rows["r"].to_numpy(), rows["z"].to_numpy()))

    def run(batches):
        r, v = values.value
        total = np.zeros(permutations)
        held: list[tuple] = []

        def spend() -> None:
            if not held:
                return
            a, b, w = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.argsort(a, kind="stable")
            a, b, w = a[order], b[order], w[order]
            first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            own, w = a[first], w[first]
            rng = np.random.default_rng(42)
            for q in range(permutations):
                y = rng.permutation(v)
                total[q] += (y[own] * w * np.add.reduceat(y[b], first)).sum()

        for t in batches:
            held.append((np.searchsorted(r, t["a"].to_numpy()), np.searchsorted(r, t["b"].to_numpy()), 1 / t["d"].to_numpy()))
            if sum(len(x[0]) for x in held) > 4_000_000:
                spend()
        spend()
        yield pd.DataFrame({"q": np.arange(permutations), "sum": total})

    return links.mapInPandas(run, "q long, sum double").groupBy("q").agg(F.sum("sum").alias("sum"))


@udf("double")
def two_sided(z: pd.Series) -> pd.Series:
    """Probability that a standard normal is farther from 0 than z."""
    return z.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2)))


@operator("getis_ord_g", "statistics")
def getis_ord_g(df: DataFrame, field: str = "", method: str = "queen", k: int = 8, threshold=None, include_self: bool = True, crs_meters="EPSG:3857") -> DataFrame:
    """gi_star, gi_p and gi_class (hot_spot, cold_spot, not_significant at 0.05), binary weights."""
    _need(df, field)
    had = ROW in df.columns
    df = identified(df)
    x = df.where(F.col(GEOM).isNotNull()).select(F.col(ROW).alias("b"), F.col(field).cast("double").alias("x"))
    n, mean, sd = x.agg(F.count("x"), F.avg("x"), F.stddev_pop("x")).first()
    link = neighbours(df, method, k, threshold, crs_meters)
    if include_self:
        link = link.unionByName(x.select(F.col("b").alias("a"), "b"))
    s = link.join(x, "b").groupBy(F.col("a").alias("_a")).agg(F.sum("x").alias("_s"), F.count(F.lit(1)).cast("double").alias("_w"))
    out = df.join(s, F.col(ROW) == F.col("_a"), "left")
    if n and n > 1 and sd:
        w = F.col("_w")
        z = F.try_divide(F.col("_s") - mean * w, sd * F.sqrt((n * w - w * w) / (n - 1)))
        out = out.withColumn("gi_star", F.coalesce(z, F.lit(0.0)))
    else:
        out = out.withColumn("gi_star", F.lit(0.0))
    out = out.withColumn("gi_p", two_sided("gi_star"))
    hot = F.when((F.col("gi_p") < 0.05) & (F.col("gi_star") > 0), "hot_spot").when((F.col("gi_p") < 0.05) & (F.col("gi_star") < 0), "cold_spot").otherwise("not_significant")
    out = out.withColumn("gi_class", hot).drop("_a", "_s", "_w")
    return with_srid(out if had else out.drop(ROW), srid_of(df))
