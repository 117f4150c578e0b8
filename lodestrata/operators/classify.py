"""Classes, colours and normalised values for maps."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attribute import _need
from .graph import running_total
from .layer import srid_of, with_srid
from .registry import operator

# fixed values: colour ramps as published with the ColorBrewer and matplotlib palettes
PALETTES = {
    "YlOrRd": ["#ffffb2", "#fecc5c", "#fd8d3c", "#f03b20", "#bd0026"],
    "YlGnBu": ["#ffffcc", "#a1dab4", "#41b6c4", "#2c7fb8", "#253494"],
    "Blues": ["#eff3ff", "#bdd7e7", "#6baed6", "#3182bd", "#08519c"],
    "Greens": ["#edf8e9", "#bae4b3", "#74c476", "#31a354", "#006d2c"],
    "Reds": ["#fee5d9", "#fcae91", "#fb6a4a", "#de2d26", "#a50f15"],
    "RdYlGn": ["#d7191c", "#fdae61", "#ffffbf", "#a6d96a", "#1a9641"],
    "RdYlBu": ["#d7191c", "#fdae61", "#ffffbf", "#abd9e9", "#2c7bb6"],
    "Viridis": ["#440154", "#3b528b", "#21918c", "#5ec962", "#fde725"],
    "Oranges": ["#feedde", "#fdbe85", "#fd8d3c", "#e6550d", "#a63603"],
    "Purples": ["#f2f0f7", "#cbc9e2", "#9e9ac8", "#756bb1", "#54278f"],
    "Greys": ["#f7f7f7", "#cccccc", "#969696", "#636363", "#252525"],
    "YlOrBr": ["#ffffd4", "#fed98e", "#fe9929", "#d95f0e", "#993404"],
    "YlGn": ["#ffffcc", "#c2e699", "#78c679", "#31a354", "#006837"],
    "BuPu": ["#edf8fb", "#b3cde3", "#8c96c6", "#8856a7", "#810f7c"],
    "PuRd": ["#f1eef6", "#d7b5d8", "#df65b0", "#dd1c77", "#980043"],
    "Plasma": ["#0d0887", "#7e03a8", "#cc4778", "#f89541", "#f0f921"],
    "Magma": ["#000004", "#51127c", "#b63679", "#fb8761", "#fcfdbf"],
    "Inferno": ["#000004", "#57106e", "#bc3754", "#f98e09", "#fcffa4"],
    "Cividis": ["#00224e", "#414878", "#7c7b78", "#bcae5d", "#fee838"],
    "RdBu": ["#ca0020", "#f4a582", "#f7f7f7", "#92c5de", "#0571b0"],
    "BrBG": ["#a6611a", "#dfc27d", "#f5f5f5", "#80cdc1", "#018571"],
    "PiYG": ["#d01c8b", "#f1b6da", "#f7f7f7", "#b8e186", "#4dac26"],
    "PuOr": ["#e66101", "#fdb863", "#f7f7f7", "#b2abd2", "#5e3c99"],
    "Spectral": ["#d7191c", "#fdae61", "#ffffbf", "#abdda4", "#2b83ba"],
    "UrbanRose": ["#fbeae4", "#f2c6bb", "#dd8a7d", "#b85752", "#7a2c2e"],
    "UrbanSage": ["#f2f1e3", "#cfd8bd", "#96ae8b", "#5e8058", "#2f4d34"],
    "UrbanTerracotta": ["#f7ead9", "#ecc7ad", "#d28f7c", "#a95a4f", "#722a2a"],
    "UrbanAtlas": ["#3f5f3a", "#a2b892", "#f4ede1", "#dea090", "#913d3a"],
    "Set2": ["#66c2a5", "#fc8d62", "#8da0cb", "#e78ac3", "#a6d854", "#ffd92f", "#e5c494", "#b3b3b3"],
    "Set1": ["#e41a1c", "#377eb8", "#4daf4a", "#984ea3", "#ff7f00", "#ffff33", "#a65628", "#f781bf", "#999999"],
}
OTHER = "#bdbdbd"
# Published 3 x 3 tables, rows by y, columns by x.
BIVARIATE = {
    "BlueOrange": [["#e8e8e8", "#e4acac", "#c85a5a"], ["#b0d5df", "#ad9ea5", "#985356"], ["#64acbe", "#627f8c", "#574249"]],
    "PurpleGreen": [["#e8e8e8", "#ace4e4", "#5ac8c8"], ["#dfb0d6", "#a5add3", "#5698b9"], ["#be64ac", "#8c62aa", "#3b4994"]],
    "BluePink": [["#e8e8e8", "#e4d9ac", "#c8b35a"], ["#cbb8d7", "#c8ada0", "#af8e53"], ["#9972af", "#976b82", "#804d36"]],
}


def _rgb(h: str) -> np.ndarray:
    return np.array([int(h[i : i + 2], 16) for i in (1, 3, 5)], float)


def _hex(c) -> str:
    return "#" + "".join(f"{int(round(float(x))):02x}" for x in np.clip(c, 0, 255))


def palette_colors(palette, n: int) -> list[str]:
    """n colours evenly along the palette; _r turns it round."""
    if isinstance(palette, str):
        name, back = (palette[:-2], True) if palette.endswith("_r") else (palette, False)
        stops = PALETTES.get(next((p for p in PALETTES if p.lower() == name.lower()), None))
        if stops is None:
            raise ValueError(f"unknown palette {palette}; known: {', '.join(PALETTES)}")
        stops = stops[::-1] if back else stops
    else:
        stops = list(palette)
    if n == 1:
        return [stops[0]]
    at = np.linspace(0, len(stops) - 1, n)
    rgb = np.array([_rgb(s) for s in stops])
    return [_hex([np.interp(t, range(len(stops)), rgb[:, k]) for k in range(3)]) for t in at]


def color_column(cls: Column, n: int, palette) -> Column:
    out = F.lit(None).cast("string")
    for i, c in enumerate(palette_colors(palette, n)):
        out = F.when(cls == i + 1, c).otherwise(out)
    return out


def _round_steps(lo: float, hi: float, n: int) -> list[float]:
    raw = (hi - lo) / n
    if raw <= 0:
        return [lo, hi]
    mag = 10 ** math.floor(math.log10(raw))
    step = next((m * mag for m in (1, 2, 5, 10) if m * mag >= raw - 1e-12 * mag), 10 * mag)
    k = math.floor(lo / step)
    out = [k * step]
    while out[-1] < hi - 1e-12 * step:
        k += 1
        out.append(k * step)
    return out


def jenks(values: np.ndarray, n: int) -> list[float]:
    """Natural breaks of sorted values, by dynamic programming on the squared deviations."""
    v = np.sort(np.asarray(values, float))
    m = len(v)
    n = min(n, len(np.unique(v)))
    if n < 1:
        return []
    s, q = np.concatenate([[0], np.cumsum(v)]), np.concatenate([[0], np.cumsum(v * v)])
    best = np.array([q[j] - s[j] ** 2 / j if j else 0.0 for j in range(m + 1)])
    cut = np.zeros((n + 1, m + 1), int)
    for k in range(2, n + 1):
        new = np.full(m + 1, np.inf)
        for j in range(k, m + 1):
            i = np.arange(k - 1, j)
            cost = best[i] + (q[j] - q[i]) - (s[j] - s[i]) ** 2 / (j - i)
            at = int(cost.argmin())
            new[j], cut[k, j] = cost[at], i[at]
        best = new
    out, j = [v[-1]], m
    for k in range(n, 1, -1):
        j = cut[k, j]
        out.append(v[j - 1])
    return [float(v[0]), *map(float, out[::-1])]


def percentiles(rows: DataFrame, shares: list[float]) -> list[float]:
    """Interpolated percentiles of v, as F.percentile gives them, for many shares: by the ranks of the distinct values, of which only
    those that are asked for (two a share at most) reach the driver."""
    counts = running_total(rows.groupBy("v").agg(F.count(F.lit(1)).alias("n")), [F.col("v")], "n", "below")
    at = (rows.count() - 1) * np.array(shares)
    lower, higher = np.floor(at).astype(np.int64), np.ceil(at).astype(np.int64)
    wanted = np.union1d(lower, higher)

    def pick(batches):
        for t in batches:
            first = np.searchsorted(wanted, t["below"].to_numpy())
            yield t[first < np.searchsorted(wanted, (t["below"] + t["n"]).to_numpy())]

    got = sorted((r.below, r.v) for r in counts.select("below", "n", "v").mapInPandas(pick, "below long, n long, v double").collect())  # two a share at most
    below, value = np.array([r[0] for r in got]), np.array([r[1] for r in got])
    lo, hi = value[np.searchsorted(below, lower, "right") - 1], value[np.searchsorted(below, higher, "right") - 1]
    return [float(v) for v in np.where(lo == hi, lo, (higher - at) * lo + (at - lower) * hi)]


def class_breaks(df: DataFrame, field: str, method: str = "quantile", bins: int = 5, breaks=None, std_multiplier: float = 1.0) -> list[float]:
    """Edges of the classes, from one pass of aggregates (jenks: of at most 1000 evenly ranked values)."""
    x = F.col(field).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x))
    if method == "manual":
        if not breaks:
            raise ValueError("manual needs breaks")
        lo, hi = rows.agg(F.min(x), F.max(x)).first()
        inner = sorted(map(float, breaks))
        if lo is None:
            return inner
        return sorted({min(lo, inner[0]), *inner, max(hi, inner[-1])})
    if method == "quantile":
        q = rows.agg(F.percentile(x, F.array(*[F.lit(i / bins) for i in range(bins + 1)]))).first()[0]
        return sorted(set(q)) if q else []
    if method == "jenks":
        total = rows.count()
        if not total:
            return []
        if total <= 1000:
            sample = [r[0] for r in rows.select(x.alias("v")).collect()]  # 1000 at most
        else:
            sample = percentiles(rows.select(x.alias("v")), [i / 999 for i in range(1000)])
        return sorted(set(jenks(np.array(sample), bins)))
    lo, hi, mean, sd = rows.agg(F.min(x), F.max(x), F.avg(x), F.stddev_pop(x)).first()
    if lo is None:
        return []
    if method == "equal_interval":
        return [lo + (hi - lo) * i / bins for i in range(bins)] + [hi] if hi > lo else [lo, hi]
    if method == "pretty":
        return _round_steps(lo, hi, bins)
    if method == "std_dev":
        k = bins if bins % 2 else bins + 1
        step = std_multiplier * sd
        if not step:
            return [lo, hi]
        mid = [mean + (i - k / 2) * step for i in range(1, k)]
        return sorted({lo, *[m for m in mid if lo < m < hi], hi})
    raise ValueError(f"unknown method {method}")


def class_column(field: str, edges: list[float]) -> Column:
    """1-based class of right-closed intervals, the lowest edge included; null outside."""
    x = F.col(field).cast("double")
    if len(edges) < 2 or edges[0] == edges[-1]:
        return F.when(x.isNotNull() & ~F.isnan(x), 1).cast("long") if edges else F.lit(None).cast("long")
    out = F.when((x < edges[0]) | x.isNull() | F.isnan(x), None)
    for i, e in enumerate(edges[1:]):
        out = out.when(x <= e, i + 1)
    return out.cast("long")


@operator("classify", "classification")
def classify(df: DataFrame, field=None, method: str = "quantile", bins: int = 5, class_col: str = "class", color_col: str = "color", palette=None, breaks=None, std_multiplier: float = 1.0) -> DataFrame:
    _need(df, field)
    edges = class_breaks(df, field, method, bins, breaks, std_multiplier)
    n = max(1, len(edges) - 1)
    out = df.withColumn(class_col, class_column(field, edges))
    return out.withColumn(color_col, color_column(F.col(class_col), n, palette or "YlOrRd"))


def legend(df: DataFrame, field: str, method: str = "quantile", bins: int = 5, palette="YlOrRd", breaks=None, std_multiplier: float = 1.0, label_fmt=None) -> DataFrame:
    """class, low, high, color, label and the number of rows."""
    edges = class_breaks(df, field, method, bins, breaks, std_multiplier)
    n = max(1, len(edges) - 1)
    fmt = label_fmt or "{0:.2f} - {1:.2f}"
    rows = [(i + 1, edges[i], edges[min(i + 1, len(edges) - 1)], c, fmt.format(edges[i], edges[min(i + 1, len(edges) - 1)])) for i, c in enumerate(palette_colors(palette, n))] if edges else []
    names = df.sparkSession.createDataFrame(rows, "class long, low double, high double, color string, label string")
    counts = df.select(class_column(field, edges).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "class", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@operator("choropleth", "classification")
def choropleth(df: DataFrame, field=None, method: str = "quantile", bins: int = 5, palette="YlOrRd", class_col: str = "class", color_col: str = "color", breaks=None, std_multiplier: float = 1.0, geom_type=None, label_fmt=None) -> DataFrame:
    """classify; `legend` gives the legend."""
    return classify(df, field, method, bins, class_col, color_col, palette, breaks, std_multiplier)


@operator("classify_categorical", "classification")
def classify_categorical(df: DataFrame, field=None, palette="Set2", class_col: str = "class", color_col: str = "color", other_label: str = "Other", max_categories=None) -> DataFrame:
    """Class 1 is the most frequent value (ties by value). Beyond max_categories, or not in a palette given as a dict: one last class."""
    _need(df, field)
    v = F.col(field).cast("string")
    counts = df.where(v.isNotNull()).groupBy(v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    if isinstance(palette, dict):
        counts = counts.where(F.col("_v").isin([str(k) for k in palette]))
    ranked = running_total(counts.withColumn("_one", F.lit(1)), [F.desc("_n"), F.col("_v")], "_one", "_c").withColumn("_c", (F.col("_c") + 1).cast("long")).drop("_one")
    if max_categories:
        ranked = ranked.where(F.col("_c") <= max_categories)
    n = ranked.count()
    if isinstance(palette, dict):
        pairs = {str(k): c for k, c in palette.items()}
        color = F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), v)
        other = OTHER
    else:
        stops = PALETTES.get(palette, PALETTES["Set2"]) if isinstance(palette, str) else list(palette)
        color = F.get(F.array(*map(F.lit, stops)), ((F.col("_c") - 1) % len(stops)).cast("int"))
        other = stops[n % len(stops)]
    out = df.join(ranked.drop("_n"), v == F.col("_v"), "left")
    out = out.withColumn(class_col, F.when(v.isNotNull(), F.coalesce("_c", F.lit(n + 1).cast("long"))))
    out = out.withColumn(color_col, F.when(F.col("_c").isNotNull(), color).when(v.isNotNull(), other)).drop("_v", "_c")
    return with_srid(out, srid_of(df))


@operator("normalize", "classification")
def normalize(df: DataFrame, field=None, method: str = "minmax", out_field=None, denom_field=None) -> DataFrame:
    """minmax, zscore, log, log1p, rank (0 to 1, ties their mean) or percent; divided by denom_field first."""
    _need(df, field)
    out_field = out_field or f"{field}_norm"
    x = F.col(field).cast("double")
    if denom_field:
        d = F.col(denom_field).cast("double")
        x = F.when(d != 0, F.try_divide(x, d))
    df = df.withColumn("_x", F.when(~F.isnan(x), x))
    x = F.col("_x")
    if method in ("log", "log1p"):
        bad = x <= (0 if method == "log" else -1)
        out = F.when(bad, F.raise_error(F.lit(f"{method} of a value that is too small")).cast("double")).otherwise((F.ln if method == "log" else F.log1p)(x))
    elif method == "rank":
        # ties from counts of distinct values; a running count over them
        counts = df.where(x.isNotNull()).groupBy("_x").agg(F.count(F.lit(1)).alias("_n"))
        total = df.agg(F.count(x)).first()[0]
        below = running_total(counts, [F.col("_x")], "_n", "_below")
        ranks = below.select(F.col("_x").alias("_v"), ((F.col("_below") + (F.col("_n") - 1) / 2) / (total - 1) if total > 1 else F.lit(0.0)).alias("_r"))
        return with_srid(df.join(ranks, x == F.col("_v"), "left").withColumn(out_field, F.col("_r")).drop("_x", "_v", "_r"), srid_of(df))
    else:
        lo, hi, mean, sd, total = df.agg(F.min(x), F.max(x), F.avg(x), F.stddev_pop(x), F.sum(x)).first()
        if lo is None:
            out = F.lit(None).cast("double")
        elif method == "minmax":
            out = (x - lo) / (hi - lo) if hi > lo else F.when(x.isNotNull(), 0.5)
        elif method == "zscore":
            out = (x - mean) / sd if sd else F.when(x.isNotNull(), 0.0)
        elif method == "percent":
            out = x / total * 100 if total else F.when(x.isNotNull(), 0.0)
        else:
            raise ValueError(f"unknown method {method}")
    return df.withColumn(out_field, out).drop("_x")


@operator("graduated_size", "classification")
def graduated_size(df: DataFrame, field=None, method: str = "quantile", bins: int = 5, size_range=(4.0, 20.0), size_col: str = "marker_size", scaling: str = "linear", class_col: str = "class", breaks=None, std_multiplier: float = 1.0) -> DataFrame:
    _need(df, field)
    edges = class_breaks(df, field, method, bins, breaks, std_multiplier)
    n = max(1, len(edges) - 1)
    f = {"linear": lambda t: t, "sqrt": math.sqrt, "log": lambda t: math.log1p(t * (math.e - 1))}[scaling]
    lo, hi = size_range
    sizes = [lo + (hi - lo) * f(i / (n - 1) if n > 1 else 0.5) for i in range(n)]
    out = df.withColumn(class_col, class_column(field, edges))
    return out.withColumn(size_col, F.get(F.array(*map(F.lit, sizes)), (F.col(class_col) - 1).cast("int")))


@operator("head_tail_breaks", "classification")
def head_tail_breaks(df: DataFrame, field=None, class_col: str = "class", color_col: str = "color", palette=None, max_depth: int = 12, head_ratio_cutoff: float = 0.4) -> DataFrame:
    """Breaks at the mean, then at the mean of the head, while the head is a minority (one small aggregate a round)."""
    _need(df, field)
    x = F.col(field).cast("double")
    rows = df.select(x.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    lo, hi, mean, n = rows.agg(F.min("v"), F.max("v"), F.avg("v"), F.count("v")).first()
    breaks: list[float] = []
    while lo is not None and len(breaks) < max_depth and n > 1:
        m, k = rows.where(F.col("v") > mean).agg(F.avg("v"), F.count("v")).first()
        if not k:
            break
        breaks.append(mean)
        if k / n > head_ratio_cutoff:
            break
        mean, n = m, k
    edges = sorted({lo, *breaks, hi}) if lo is not None else []
    out = df.withColumn(class_col, class_column(field, edges))
    return out.withColumn(color_col, color_column(F.col(class_col), max(1, len(edges) - 1), palette or "YlOrRd"))


@operator("continuous_ramp", "classification")
def continuous_ramp(df: DataFrame, field=None, palette="Viridis", color_col: str = "color", domain="auto", scaling: str = "linear", stops: int = 9) -> DataFrame:
    _need(df, field)
    x = F.col(field).cast("double")
    lo, hi = df.where(~F.isnan(x)).agg(F.min(x), F.max(x)).first() if domain == "auto" else tuple(map(float, domain))
    if lo is None:
        return df.withColumn(color_col, F.lit(None).cast("string"))
    f = {"linear": lambda c: c, "sqrt": F.sqrt, "log": F.log1p}[scaling]
    base = F.greatest(F.least(x, F.lit(float(hi))), F.lit(float(lo))) - lo
    t = f(base) / f(F.lit(float(hi - lo))) if hi > lo else F.lit(0.5)
    rgb = np.array([_rgb(c) for c in palette_colors(palette, max(2, stops))])
    n = len(rgb) - 1
    k = F.least(F.floor(t * n), F.lit(n - 1)).cast("int")
    u = t * n - k
    part = []
    for c in range(3):
        a, b = F.get(F.array(*[F.lit(float(v)) for v in rgb[:-1, c]]), k), F.get(F.array(*[F.lit(float(v)) for v in rgb[1:, c]]), k)
        part.append(F.lpad(F.lower(F.hex(F.bround(a + (b - a) * u).cast("long"))), 2, "0"))
    return df.withColumn(color_col, F.when(x.isNotNull() & ~F.isnan(x), F.concat(F.lit("#"), *part)))


@operator("bivariate_choropleth", "classification")
def bivariate_choropleth(df: DataFrame, field_x=None, field_y=None, method_x: str = "quantile", method_y: str = "quantile", grid: int = 3, palette="BlueOrange", class_col: str = "bi_class", color_col: str = "bi_color") -> DataFrame:
    """Class "y_x" of both fields' classes and the colour of that cell, from a table of the palette's name or of one's own (rows by
    y); between the table's cells for another grid."""
    if not 2 <= grid <= 5:
        raise ValueError("grid is 2 to 5")
    _need(df, field_x, field_y)
    if isinstance(palette, str) and palette not in BIVARIATE:
        raise ValueError(f"unknown bivariate palette {palette}; known: {', '.join(BIVARIATE)}")
    cx = class_column(field_x, class_breaks(df, field_x, method_x, grid))
    cy = class_column(field_y, class_breaks(df, field_y, method_y, grid))
    table = np.array([[_rgb(c) for c in row] for row in (BIVARIATE[palette] if isinstance(palette, str) else palette)])

    def cell(x: float, y: float) -> str:
        along = [np.array([np.interp(x * (table.shape[1] - 1), range(table.shape[1]), row[:, k]) for k in range(3)]) for row in table]
        return _hex([np.interp(y * (len(table) - 1), range(len(table)), [c[k] for c in along]) for k in range(3)])

    colors = F.create_map(*[F.lit(v) for y in range(grid) for x in range(grid) for v in (f"{y + 1}_{x + 1}", cell(x / (grid - 1), y / (grid - 1)))])
    out = df.withColumn(class_col, F.when(cx.isNotNull() & cy.isNotNull(), F.concat_ws("_", cy, cx)))
    return out.withColumn(color_col, F.try_element_at(colors, F.col(class_col)))


COLOR = re.compile("#[0-9a-f]{6}")
