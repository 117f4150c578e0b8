"""Operators on attributes: projection, reshaping, selection, filters on values, joins on keys and times, set operations."""

from __future__ import annotations

import operator as op_
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as E
from .layer import GEOM, ROW, aligned, attributes, has_geometry, identified, many_shapes, srid_of, st_dim, st_kind, st_union, with_geometry, with_srid
from .registry import operator

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,62}")
TYPES = {
    "int": "bigint", "integer": "bigint", "int64": "bigint", "bigint": "bigint", "int32": "int", "float": "double", "float64": "double", "double": "double", "float32": "float", "real": "float",
    "str": "string", "string": "string", "text": "string", "varchar": "string", "object": "string", "bool": "boolean", "boolean": "boolean", "datetime": "timestamp_ntz", "timestamp": "timestamp_ntz", "date": "timestamp_ntz", "datetime64[ns]": "timestamp_ntz",
}


def _name(name: str) -> str:
    if not NAME.fullmatch(name):
        raise ValueError(f"not a column name: {name!r}")
    return name


def _type(name: str) -> str:
    if str(name).lower() not in TYPES:
        raise ValueError(f"unknown type {name!r}")
    return TYPES[str(name).lower()]


def _names(x) -> list[str]:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


def _need(df: DataFrame, *names: str) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise KeyError(f"no column {', '.join(missing)}")


# ---------------------------------------------------------------- projection


@operator("select_columns", "projection")
def select_columns(df: DataFrame, fields=None) -> DataFrame:
    if not fields:
        return df
    return df.select([c for c in df.columns if c in set(fields) or c in (GEOM, ROW)])


@operator("drop_field", "projection")
def drop_field(df: DataFrame, fields=None, ignore_missing: bool = True) -> DataFrame:
    fields = _names(fields)
    if GEOM in fields:
        raise ValueError("the geometry can't be dropped")
    if not ignore_missing:
        _need(df, *fields)
    return df.drop(*fields)


@operator("rename_field", "projection")
def rename_field(df: DataFrame, mapping=None, ignore_missing: bool = True) -> DataFrame:
    mapping = dict(mapping or {})
    if GEOM in mapping:
        raise ValueError("the geometry can't be renamed")
    if not ignore_missing:
        _need(df, *mapping)
    mapping = {a: _name(b) for a, b in mapping.items() if a in df.columns}
    after = [mapping.get(c, c) for c in df.columns]
    if len(set(after)) < len(after):
        raise ValueError("two columns would have one name")
    return df.withColumnsRenamed(mapping)


@operator("add_field", "projection")
def add_field(df: DataFrame, fields=None, overwrite: bool = False) -> DataFrame:
    """fields: {name: value}, or a list of {name, dtype, value}."""
    items = fields.items() if isinstance(fields, dict) else [(f["name"], f) for f in fields or []]
    new = {}
    for name, spec in items:
        spec = spec if isinstance(spec, dict) else {"value": spec, "dtype": {bool: "bool", int: "int", float: "float"}.get(type(spec), "string")}
        spec = {"dtype": "string", "value": None} | {("value" if k == "default" else "dtype" if k == "type" else k): v for k, v in spec.items()}
        if name not in df.columns or overwrite:
            new[_name(name)] = F.lit(spec["value"]).cast(_type(spec["dtype"]))
    return df.withColumns(new) if new else df


@operator("cast_field", "projection")
def cast_field(df: DataFrame, casts=None, errors: str = "raise") -> DataFrame:
    """errors: raise fails when run, coerce makes what can't be cast null, ignore keeps a column that can't be cast whole."""
    if errors not in ("raise", "coerce", "ignore"):
        raise ValueError("errors is raise, coerce or ignore")
    casts = {c: _type(t) for c, t in (casts or {}).items()}
    _need(df, *casts)
    soft = {c: F.col(c).try_cast(t) for c, t in casts.items()}
    if errors == "ignore" and casts:
        lost = df.agg(*[F.count_if(F.col(c).isNotNull() & s.isNull()).alias(c) for c, s in soft.items()]).first()
        return df.withColumns({c: s for c, s in soft.items() if not lost[c]})
    return df.withColumns({c: F.col(c).cast(t) for c, t in casts.items()} if errors == "raise" else soft)


@operator("coalesce_fields", "projection")
def coalesce_fields(df: DataFrame, sources=None, target_col: str = "") -> DataFrame:
    _need(df, *sources)
    return df.withColumn(_name(target_col), F.coalesce(*sources))


@operator("case_when", "projection")
def case_when(df: DataFrame, target_col: str = "", cases=None, else_=None) -> DataFrame:
    """cases: [{when, then}]; the first condition that holds decides, null conditions don't hold."""
    out = None
    for c in cases or []:
        test, then = E.filter_column(df, c["when"]), F.lit(c["then"])
        out = F.when(test, then) if out is None else out.when(test, then)
    return df.withColumn(_name(target_col), F.lit(else_) if out is None else out.otherwise(F.lit(else_)))


@operator("lookup_table", "projection")
def lookup_table(df: DataFrame, source_col: str = "", mapping=None, target_col=None, default=None) -> DataFrame:
    """default "__source__" passes unmapped values through."""
    _need(df, source_col)
    target = _name(target_col or source_col)
    if not mapping:
        got = F.lit(None).cast("string")
    elif len(mapping) <= 1000:
        got = F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), F.col(source_col))
    else:
        rows = df.sparkSession.createDataFrame(list(mapping.items()), ["_key", "_value"])  # the parameter's size
        df = df.join(F.broadcast(rows), F.col(source_col) == F.col("_key"), "left")
        got = F.col("_value")
    if default == "__source__":
        got = F.coalesce(got, F.col(source_col).cast("string") if mapping and isinstance(next(iter(mapping.values())), str) else F.col(source_col))
    elif default is not None:
        got = F.coalesce(got, F.lit(default))
    return df.withColumn(target, got).drop("_key", "_value")


@operator("calculate", "projection")
def calculate(df: DataFrame, expressions=None) -> DataFrame:
    """{column: expression}, in order; later ones see earlier results."""
    for name, text in (expressions or {}).items():
        df = df.withColumn(_name(name), E.value_column(df, text))
    return df


def describe_report(df: DataFrame, sample_size: int = 0, include_geometry: bool = True) -> DataFrame:
    """A row for each column: column, dtype, n_rows, n_nulls, n_unique, samples; for the geometry type counts and bounds too."""
    names = attributes(df)
    parts = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(names):
        parts += [F.count_if(F.col(c).isNull()).alias(f"nulls{i}"), F.count_distinct(c).alias(f"unique{i}")]
        if sample_size:
            parts.append(F.slice(F.array_sort(F.collect_set(F.when(F.xxhash64(c) % 97 < 3, F.col(c).cast("string")))), 1, sample_size).alias(f"sample{i}"))
    one = df.agg(*parts)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col("n_rows"), F.col(f"nulls{i}").alias("n_nulls"), F.col(f"unique{i}").alias("n_unique"), (F.col(f"sample{i}") if sample_size else F.array().cast("array<string>")).alias("samples")) for i, (c, t) in enumerate((c, dict(df.dtypes)[c]) for c in names)])
    out = one.select(F.inline(rows)) if names else df.sparkSession.createDataFrame([], "column string, dtype string, n_rows long, n_nulls long, n_unique long, samples array<string>")
    if include_geometry and has_geometry(df):
        from .layer import bbox

        g = df.select(F.col(GEOM), st_kind(GEOM).alias("kind"), bbox(GEOM).alias("box"))
        kinds = g.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("kind").isNull(), F.col("n")).otherwise(0)).alias("n_nulls"), F.count("kind").alias("n_unique"), F.array_sort(F.collect_list(F.concat_ws("=", "kind", "n"))).alias("samples"))
        out = out.unionByName(kinds.select(F.lit(GEOM).alias("column"), F.lit(f"geometry({srid_of(df)})").alias("dtype"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_nulls", F.lit(0)).alias("n_nulls"), "n_unique", "samples"))
    return out


@operator("describe", "projection")
def describe(df: DataFrame, sample_size: int = 0, include_geometry: bool = True) -> DataFrame:
    """Passes the rows through; `describe_report` gives the report."""
    return df


@operator("attribute_prep", "projection")
def attribute_prep(df: DataFrame, rename=None, drop=None, keep_only=None) -> DataFrame:
    if rename:
        df = rename_field(df, rename)
    if drop:
        df = drop_field(df, drop)
    return select_columns(df, keep_only) if keep_only else df


#: Columns that tags are made into.
MOST_KEYS = 2_000


@operator("osm_tag_extract", "projection")
def osm_tag_extract(df: DataFrame, tags_column: str = "tags", extract_keys=None) -> DataFrame:
    """JSON tags to columns tag_<key>; without keys those that occur, sorted. Bad JSON gives nulls."""
    _need(df, tags_column)
    tags = F.col(tags_column) if dict(df.dtypes)[tags_column].startswith("map") else F.from_json(tags_column, "map<string,string>")
    keys = _names(extract_keys) or sorted(r[0] for r in df.select(F.explode(F.map_keys(tags)).alias("k")).distinct().limit(MOST_KEYS + 1).collect())
    if len(keys) > MOST_KEYS:
        raise ValueError(f"{tags_column} has more than {MOST_KEYS} keys; name those that are wanted")
    return df.withColumns({f"tag_{k}": F.try_element_at(tags, F.lit(k)) for k in keys}) if keys else df


# ---------------------------------------------------------------- reshaping


@operator("pivot", "reshape")
def pivot(df: DataFrame, index=None, columns: str = "", values: str = "", aggfunc: str = "first", fill_value=None, geom_strategy: str = "first") -> DataFrame:
    """Columns <values>_<category>. geom_strategy: first, union or raise_if_differs."""
    index = _names(index)
    _need(df, *index, columns, values)
    df = identified(df)
    v = F.col(values)
    how = {"first": F.min_by(v, F.when(v.isNotNull(), F.col(ROW))), "last": F.max_by(v, F.when(v.isNotNull(), F.col(ROW))), "mean": F.avg(v), "sum": F.sum(v), "min": F.min(v), "max": F.max(v), "count": F.count(v), "median": F.median(v)}
    if aggfunc not in how:
        raise ValueError(f"unknown aggfunc {aggfunc}")
    rows = df.where(F.col(columns).isNotNull())
    out = rows.groupBy(*index).pivot(columns).agg(how[aggfunc])
    out = out.withColumnsRenamed({c: f"{values}_{c}" for c in out.columns[len(index) :]})
    if fill_value is not None:
        out = out.fillna(fill_value, subset=out.columns[len(index) :])
    if has_geometry(df):
        if geom_strategy == "union":
            g = rows.groupBy(*index).agg(F.collect_list(GEOM).alias(GEOM)).withColumn(GEOM, st_union(GEOM))
        else:
            first = F.min_by(GEOM, ROW)
            if geom_strategy == "raise_if_differs":
                first = F.when(F.count_distinct(GEOM) > 1, F.raise_error(F.lit("geometries differ in a group")).cast("binary")).otherwise(first)
            g = rows.groupBy(*index).agg(first.alias(GEOM))
        out = with_srid(out.join(g, index), srid_of(df)) if index else out
    return out


@operator("unpivot", "reshape")
def unpivot(df: DataFrame, id_vars=None, value_vars=None, var_name: str = "variable", value_name: str = "value") -> DataFrame:
    ids = _names(id_vars)
    ids += [c for c in (GEOM,) if c in df.columns and c not in ids]
    values = _names(value_vars) or [c for c in df.columns if c not in ids and c != ROW]
    _need(df, *ids, *values)
    return with_srid(df.unpivot(ids, values, var_name, value_name), srid_of(df))


# ---------------------------------------------------------------- order and selection


def _order(by, ascending, na: str = "last") -> list[Column]:
    by = _names(by)
    asc = [ascending] * len(by) if isinstance(ascending, bool) else list(ascending)
    if len(asc) != len(by):
        raise ValueError("ascending needs a value for each key")
    return [getattr(F.col(c), f"{'asc' if a else 'desc'}_nulls_{na}")() for c, a in zip(by, asc, strict=True)]


@operator("sort", "selection")
def sort(df: DataFrame, by=None, ascending=True, na_position: str = "last") -> DataFrame:
    _need(df, *_names(by))
    if na_position not in ("first", "last"):
        raise ValueError("na_position is first or last")
    tie = [F.col(ROW)] if ROW in df.columns else []
    return df.orderBy(*_order(by, ascending, na_position), *tie)


@operator("top_n", "selection")
def top_n(df: DataFrame, n: int = 10, by=None, ascending=False) -> DataFrame:
    """The first n in that order; ties in input order. Without `by` the first n rows."""
    df = identified(df)
    return df.orderBy(*_order(by, ascending), ROW).limit(n)


@operator("deduplicate", "selection")
def deduplicate(df: DataFrame, keys=None, keep: str = "first", order_by=None, ascending=True) -> DataFrame:
    had = ROW in df.columns
    df = identified(df)
    keys = _names(keys) or attributes(df)
    _need(df, *keys, *_names(order_by))
    order = _order(order_by, ascending) + [F.col(ROW).asc()]
    if keep == "last":
        order = [o for o in _order(order_by, [not a for a in ([ascending] * len(_names(order_by)) if isinstance(ascending, bool) else ascending)], "first")] + [F.col(ROW).desc()]
    out = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")
    return out if had else out.drop(ROW)


@operator("random_sample", "selection")
def random_sample(df: DataFrame, n=None, fraction=None, seed=None, replace: bool = False) -> DataFrame:
    """Exactly n rows, or exactly fraction of them (rounded); the same seed and rows give the same sample."""
    if (n is None) == (fraction is None):
        raise ValueError("give n or fraction")
    had = ROW in df.columns
    df = identified(df)
    total = df.count()
    n = round(total * fraction) if n is None else n
    seed = 0 if seed is None else seed
    if not replace:
        out = df.orderBy(F.xxhash64(F.lit(seed), ROW), ROW).limit(min(n, total))
    else:
        place = df.select(ROW).orderBy(ROW)
        place = place.withColumn("_place", F.row_number().over(Window.orderBy(ROW)) - 1) if total < 1_000_000 else place.rdd.map(lambda r: r[0]).zipWithIndex().toDF([ROW, "_place"])
        draws = df.sparkSession.range(n).select(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(total, 1))).alias("_place"))
        out = draws.join(place, "_place").drop("_place").join(df, ROW)
    return out if had else out.drop(ROW)


@operator("temporal_filter", "filter")
def temporal_filter(df: DataFrame, time_col: str = "", start=None, end=None, include_start: bool = True, include_end: bool = True, invert: bool = False) -> DataFrame:
    _need(df, time_col)
    t = F.col(time_col).try_cast("timestamp_ntz") if dict(df.dtypes)[time_col] == "string" else F.col(time_col).cast("timestamp_ntz")
    tests = [t.isNotNull()]
    if start is not None:
        s = F.lit(str(start)).cast("timestamp_ntz")
        tests.append(t >= s if include_start else t > s)
    if end is not None:
        e = F.lit(str(end)).cast("timestamp_ntz")
        tests.append(t <= e if include_end else t < e)
    inside = reduce(op_.and_, tests)
    return df.where(t.isNotNull() & ~inside if invert else inside)


# ---------------------------------------------------------------- joins


def _joined(df: DataFrame, ref: DataFrame, taken: list[str], prefix: str, suffix: str) -> dict[str, str]:
    """Output names of the reference's columns."""
    out = {}
    for c in taken:
        name = f"{prefix}{c}{suffix}"
        out[c] = f"{name}_ref" if name in df.columns else name
    return out


@operator("attribute_join", "join")
def attribute_join(df: DataFrame, ref_gdf=None, left_on: str = "", right_on=None, how: str = "left", columns=None, prefix: str = "", suffix: str = "") -> DataFrame:
    """Equi join; missing keys match missing keys."""
    right_on = right_on or left_on
    _need(df, left_on)
    ref = ref_gdf.drop(GEOM, ROW)
    _need(ref, right_on)
    taken = [c for c in (_names(columns) or ref.columns) if c != right_on]
    names = _joined(df, ref, taken, prefix, suffix)
    right = ref.select(F.col(right_on).alias("_key"), *[F.col(c).alias(n) for c, n in names.items()])
    how = {"outer": "full_outer"}.get(how, how)
    out = df.join(right, F.col(left_on).eqNullSafe(F.col("_key")), how)
    if how in ("right", "full_outer"):
        out = out.withColumn(left_on, F.coalesce(left_on, "_key"))
    return out.drop("_key")


@operator("temporal_join", "join")
def temporal_join(df: DataFrame, ref_gdf=None, left_on: str = "", right_on=None, strategy: str = "backward", by=None, tolerance=None, columns=None) -> DataFrame:
    """exact: left join on the time. Otherwise each row gets the reference row nearest before (backward), after (forward) or both.

    Both sides are put in one time order for each `by` key and slice of time, the last (next) reference row is carried along,
    and from slice to slice; so no pairs are made and no key is one task's.
    """
    right_on = right_on or left_on
    by = _names(by)
    _need(df, left_on, *by)
    ref = ref_gdf.drop(GEOM, ROW)
    taken = [c for c in (_names(columns) or ref.columns) if c not in (right_on, *by)]
    names = _joined(df, ref, taken, "", "")
    if strategy == "exact":
        right = ref.select(F.col(right_on).alias("_t"), *[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], *[F.col(c).alias(n) for c, n in names.items()])
        test = reduce(op_.and_, [F.col(left_on) == F.col("_t"), *[F.col(b) == F.col(f"_b{i}") for i, b in enumerate(by)]])
        return df.join(right, test, "left").drop("_t", *[f"_b{i}" for i in range(len(by))])
    if strategy not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown strategy {strategy}")
    value = F.struct(F.col(right_on).cast("timestamp_ntz").alias("t"), *[F.col(c) for c in taken])
    right = ref.where(F.col(right_on).isNotNull()).select(*[F.col(b) for b in by], F.col(right_on).cast("timestamp_ntz").alias("_t"), value.alias("_ref"))
    left = df.select(*[F.col(b) for b in by], F.col(left_on).cast("timestamp_ntz").alias("_t"), F.struct(*df.columns).alias("_row"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_side", F.col("_ref").isNull().cast("int"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    lo, hi = both.agg(F.min(micros(F.col("_t"))), F.max(micros(F.col("_t")))).first()
    slices = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = ((hi or 0) - (lo or 0)) // slices + 1
    both = both.withColumn("_k", F.coalesce(F.floor((micros(F.col("_t")) - (lo or 0)) / width), F.lit(0)))
    part = [F.col(b) for b in by] + [F.col("_k")]
    # at equal times references come first for backward and, in the reverse order, for forward
    back = Window.partitionBy(*part).orderBy(F.col("_t").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*part).orderBy(F.col("_t").desc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    # what a slice of time hands on to the later (earlier) ones of its key: a row for each key and slice
    edges = both.groupBy(*part).agg(F.max_by("_ref", F.when(F.col("_ref").isNotNull(), F.col("_t"))).alias("_hi"), F.min_by("_ref", F.when(F.col("_ref").isNotNull(), F.col("_t"))).alias("_lo"))
    keys = [F.col(b) for b in by] or [F.lit(0)]
    before = F.last("_hi", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("_lo", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.select(*[F.col(b).alias(f"_e{i}") for i, b in enumerate(by)], F.col("_k").alias("_ek"), before.alias("_before"), after.alias("_after"))
    both = both.withColumns({"_b": F.last("_ref", ignorenulls=True).over(back), "_f": F.last("_ref", ignorenulls=True).over(ahead)}).where("_side = 1")
    both = both.join(edges, reduce(op_.and_, [F.col("_k") == F.col("_ek"), *[F.col(b).eqNullSafe(F.col(f"_e{i}")) for i, b in enumerate(by)]]))
    both = both.withColumns({"_b": F.coalesce("_b", "_before"), "_f": F.coalesce("_f", "_after")})
    gap_b, gap_f = micros(F.col("_t")) - micros(F.col("_b.t")), micros(F.col("_f.t")) - micros(F.col("_t"))
    pick = {"backward": F.col("_b"), "forward": F.col("_f"), "nearest": F.when(gap_f.isNull() | (gap_b <= gap_f), F.col("_b")).otherwise(F.col("_f"))}[strategy]
    both = both.withColumn("_m", F.when(F.col("_t").isNotNull(), pick))
    if tolerance is not None:
        both = both.withColumn("_m", F.when(F.abs(micros(F.col("_t")) - micros(F.col("_m.t"))) <= E.seconds(tolerance) * 1e6, F.col("_m")))
    out = both.select("_row.*", *[F.col(f"_m.{c}").alias(n) for c, n in names.items()])
    return with_srid(out, srid_of(df))


# ---------------------------------------------------------------- set operations


@operator("merge_layers", "set")
def merge_layers(df: DataFrame, ref_gdfs=None) -> DataFrame:
    out = df
    for r in ref_gdfs or []:
        out = out.unionByName(aligned(r, df), allowMissingColumns=True)
    return with_srid(out, srid_of(df))


@operator("vector_diff", "set")
def vector_diff(df: DataFrame, ref_gdf=None, id_field: str = "id", tolerance: float = 0.001, check_attrs: bool = True, attr_fields=None) -> DataFrame:
    """df against the older ref by id: change_type added, removed, modified or unchanged, attr_changed, geom_changed."""
    from ..functions import geometry as G
    from .layer import pair_shapes

    _need(df, id_field)
    _need(ref_gdf, id_field)
    ref_gdf = aligned(ref_gdf, df)
    one = lambda d: deduplicate(identified(d), [id_field], "last").drop(ROW)
    a = one(df).withColumn("_new", F.lit(True))
    b = one(ref_gdf).select(*[F.col(c).alias(f"_old_{c}") for c in ref_gdf.columns if c != ROW], F.lit(True).alias("_old"))
    shared = [c for c in (_names(attr_fields) or attributes(df)) if c != id_field and c in df.columns and c in ref_gdf.columns] if check_attrs else []
    j = a.join(b, F.col(id_field).eqNullSafe(F.col(f"_old_{id_field}")), "full_outer")
    both = F.col("_new").isNotNull() & F.col("_old").isNotNull()
    changed = reduce(op_.or_, [~F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in shared], F.lit(False))
    moved = F.lit(False)
    if has_geometry(df) and has_geometry(ref_gdf):
        far = pair_shapes(lambda x, y: bool(G.hausdorff(x, y) > tolerance) if not (x.empty or y.empty) else x.empty != y.empty, "boolean")
        old = F.col(f"_old_{GEOM}")
        moved = F.when(F.col(GEOM).eqNullSafe(old), False).otherwise(F.coalesce(far(F.when(both, F.col(GEOM)), F.when(both, old)), F.lit(True)))
    j = j.withColumn("attr_changed", both & changed).withColumn("geom_changed", both & moved)
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("attr_changed") | F.col("geom_changed"), "modified").otherwise("unchanged")
    j = j.withColumn("change_type", kind)
    cols = [F.when(F.col("_new").isNotNull(), F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c) if c in ref_gdf.columns else F.col(c) for c in df.columns if c != ROW]
    return with_srid(j.select(*cols, "change_type", "attr_changed", "geom_changed"), srid_of(df))


# ---------------------------------------------------------------- grouping of geometries


@operator("dissolve", "aggregation")
def dissolve(df: DataFrame, by=None) -> DataFrame:
    """Geometries united by group, the first value of the other attributes. Groups are united piece by piece before they meet."""
    df = identified(df)
    by = _names(by)
    _need(df, *by)
    rest = [c for c in attributes(df) if c not in by]
    partial = df.withColumn("_part", F.pmod(F.xxhash64(ROW), F.lit(64))).groupBy(*by, "_part").agg(F.collect_list(GEOM).alias("_g"), *[F.min_by(F.struct(F.col(c), F.col(ROW)), ROW).alias(c) for c in rest])
    partial = partial.withColumn("_g", st_union("_g"))
    out = partial.groupBy(*by).agg(F.collect_list("_g").alias("_g"), *[F.min_by(F.col(f"`{c}`.{c}"), F.col(f"`{c}`.{ROW}")).alias(c) for c in rest])
    out = out.withColumn(GEOM, st_union("_g")).drop("_g") if not by else out.where(F.coalesce(*[F.col(b).isNotNull() for b in by])).withColumn(GEOM, st_union("_g")).drop("_g")
    return with_srid(out, srid_of(df))


@operator("union", "aggregation")
def union(df: DataFrame) -> DataFrame:
    return with_srid(dissolve(df.select(GEOM)).select(GEOM), srid_of(df))


@operator("singleparts_to_multipart", "aggregation")
def singleparts_to_multipart(df: DataFrame, by=None, agg: str = "first", collect: bool = False) -> DataFrame:
    """Without `by` one Multi of all rows; with it a dissolve by group (collect=True keeps the parts apart). Mixed families are an error."""
    df = identified(df)
    by = _names(by)
    mixed = F.raise_error(F.lit("points, lines and areas can't be one Multi")).cast("binary")
    g = F.when(F.count_distinct("_dim") > 1, mixed).otherwise(F.lit(None).cast("binary"))
    checked = df.withColumn("_dim", st_dim(GEOM))
    rest = [c for c in attributes(df) if c not in by]
    pick = F.min_by if agg == "first" else F.max_by
    out = checked.groupBy(*by).agg(g.alias("_bad"), F.transform(F.array_sort(F.collect_list(F.struct(F.col(ROW), F.col(GEOM)))), lambda x: x[GEOM]).alias("_g"), *[pick(F.col(c), F.col(ROW)).alias(c) for c in rest])
    from ..functions import geometry as G

    whole = many_shapes(lambda s: G.collect(s, {0: "MultiPoint", 1: "MultiLineString", 2: "MultiPolygon"}[max(x.dim for x in s)])) if not by or collect else st_union
    return with_geometry(out.withColumn(GEOM, F.coalesce("_bad", whole("_g"))).drop("_g", "_bad"), F.col(GEOM), srid_of(df))
