"""Data quality: issues as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .attribute import TYPES, _names
from .layer import GEOM, ROW, attributes, has_geometry, identified, pair_shapes, pairs, shapes, srid_of, st_area, st_dim, st_valid, with_srid
from .network import greedy_first
from .graph import cut
from .registry import operator


def _id(id_col, df: DataFrame):
    return F.col(id_col if id_col and id_col in df.columns else ROW).cast("string")


@operator("topology_check", "quality")
def topology_check(df: DataFrame, check_overlaps: bool = True, check_self_intersections: bool = True, check_validity: bool = True, id_col=None) -> DataFrame:
    """feature_id, issue (null_geometry, invalid_geometry, self_intersection, overlap), detail, geometry; overlaps are "a+b"."""
    df = identified(df)
    rows = df.select(ROW, _id(id_col, df).alias("feature_id"), GEOM)
    none = F.lit(None).cast("binary")
    issue = lambda d, name, detail: d.select("feature_id", F.lit(name).alias("issue"), F.lit(detail).cast("string").alias("detail"), F.col(GEOM))
    out = issue(rows.where(F.col(GEOM).isNull()).withColumn(GEOM, none), "null_geometry", "no geometry")
    here = rows.where(F.col(GEOM).isNotNull())
    if check_validity:
        out = out.unionByName(issue(here.where(~st_valid(GEOM)), "invalid_geometry", "not valid"))
    if check_self_intersections:
        crossed = shapes(lambda g: any(s.kind == "LineString" and not s.empty and G._cross_any(G.segments(s), G.segments(s)) or s.kind == "Polygon" and bool(s.rings) and G._cross_any(G.segments(s), G.segments(s)) for s in g.simple()), "boolean")
        out = out.unionByName(issue(here.where(crossed(GEOM)), "self_intersection", "edges cross"))
    if check_overlaps:
        areas = here.where(st_dim(GEOM) == 2).where(st_valid(GEOM))
        p = pairs(areas, areas, "overlaps").unionByName(pairs(areas, areas, "within").where(f"l_{ROW} <> r_{ROW}")).where(f"l_{ROW} <> r_{ROW}")
        p = p.select(F.when(F.col(f"l_{ROW}") < F.col(f"r_{ROW}"), F.struct(F.col("l_feature_id").alias("a"), F.col("r_feature_id").alias("b"), F.col(f"l_{GEOM}").alias("g"), F.col(f"r_{GEOM}").alias("h"))).otherwise(F.struct(F.col("r_feature_id").alias("a"), F.col("l_feature_id").alias("b"), F.col(f"r_{GEOM}").alias("g"), F.col(f"l_{GEOM}").alias("h"))).alias("x")).select("x.*").dropDuplicates(["a", "b"])
        from .layer import st_intersection

        p = p.withColumn(GEOM, st_intersection("g", "h")).withColumn("_a", st_area(GEOM)).where("_a > 0")
        out = out.unionByName(p.select(F.concat_ws("+", "a", "b").alias("feature_id"), F.lit("overlap").alias("issue"), F.concat(F.lit("area "), F.round("_a", 6).cast("string")).alias("detail"), GEOM))
    return with_srid(out, srid_of(df))


@operator("duplicate_geometry", "quality")
def duplicate_geometry(df: DataFrame, tolerance: float = 0.0, id_col=None) -> DataFrame:
    """Rows whose geometry an earlier row has (tolerance 0), or is that near: feature_id, duplicate_of, geometry."""
    df = identified(df)
    rows = df.where(F.col(GEOM).isNotNull()).select(ROW, _id(id_col, df).alias("feature_id"), GEOM)
    if tolerance <= 0:
        first = rows.groupBy(GEOM).agg(F.min(F.struct(ROW, "feature_id")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(GEOM).alias("_g"), "f")
        out = rows.join(first, F.col(GEOM) == F.col("_g")).where(F.col(ROW) != F.col(f"f.{ROW}")).select("feature_id", F.col("f.feature_id").alias("duplicate_of"), GEOM)
        return with_srid(out, srid_of(df))
    near = pairs(rows, rows, "dwithin", tolerance).where(f"l_{ROW} < r_{ROW}").select(F.col(f"l_{ROW}").alias("a"), F.col(f"r_{ROW}").alias("b"))
    gone = greedy_first(rows, cut(near))
    names = rows.select(F.col(ROW).alias("_r"), F.col("feature_id").alias("duplicate_of"))
    out = rows.join(gone, F.col(ROW) == F.col("r")).join(names, F.col("of") == F.col("_r")).select("feature_id", "duplicate_of", GEOM)
    return with_srid(out, srid_of(df))


@operator("attribute_validation", "quality")
def attribute_validation(df: DataFrame, schema=None, id_col=None) -> DataFrame:
    """feature_id, column, rule, value, message. schema: {column: {nullable, type, min, max, pattern, allowed}}; a wrong type ends the column's checks."""
    df = identified(df)
    types, tests = dict(df.dtypes), []
    for c, rules in (schema or {}).items():
        make = lambda test, rule, value, text, c=c: F.when(test, F.struct(F.lit(c).alias("column"), F.lit(rule).alias("rule"), value.cast("string").alias("value"), F.lit(text).alias("message")))
        if c not in df.columns:
            tests.append(make(F.lit(True), "missing_column", F.lit(None).cast("string"), f"no column {c}"))
            continue
        v = F.col(c)
        if not rules.get("nullable", True):
            tests.append(make(v.isNull(), "nullable", v, "missing value"))
        good = v.isNotNull()
        if want := rules.get("type"):
            to = TYPES.get(str(want).lower(), "string")
            fits = F.lit(True) if to == types[c] or (to == "bigint" and types[c] in ("int", "smallint", "tinyint")) or (to == "double" and types[c] in ("int", "bigint", "float")) else v.cast("string").try_cast(to).isNotNull() if types[c] == "string" else F.lit(False)
            tests.append(make(good & ~fits, "type", v, f"not of type {want}"))
            good &= fits
        text = types[c] == "string" and rules.get("type") in (None, "str", "string", "text", "varchar")
        size = F.length(c) if text else v.try_cast("double")
        if rules.get("min") is not None:
            tests.append(make(good & (size < rules["min"]), "min", v, f"under {rules['min']}"))
        if rules.get("max") is not None:
            tests.append(make(good & (size > rules["max"]), "max", v, f"over {rules['max']}"))
        if rules.get("pattern"):
            tests.append(make(good & ~v.cast("string").rlike(f"^(?:{rules['pattern']})$"), "pattern", v, "does not match"))
        if rules.get("allowed") is not None:
            tests.append(make(good & ~v.isin(list(rules["allowed"])), "allowed", v, "not allowed"))
    kind = "array<struct<column:string,rule:string,value:string,message:string>>"
    found = F.array_compact(F.array(*tests)) if tests else F.array().cast(kind)
    return df.select(_id(id_col, df).alias("feature_id"), F.explode(found).alias("x")).select("feature_id", "x.*")


@operator("completeness_check", "quality")
def completeness_check(df: DataFrame, columns=None, reference_gdf=None, null_threshold: float = 0.0) -> DataFrame:
    """column_name, total, null_count, null_ratio, is_complete; with a reference a row _spatial_coverage (share of it covered)."""
    names = _names(columns) or attributes(df)
    counts = df.agg(F.count(F.lit(1)).alias("total"), *[(F.count_if(F.col(c).isNull()) if c in df.columns else F.count(F.lit(1))).alias(f"c{i}") for i, c in enumerate(names)])
    ratio = lambda n: F.round(F.when(F.col("total") > 0, n / F.col("total")).otherwise(F.lit(0.0)), 6)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("total"), F.col(f"c{i}").alias("null_count"), ratio(F.col(f"c{i}")).alias("null_ratio"), (ratio(F.col(f"c{i}")) <= null_threshold).alias("is_complete")) for i, c in enumerate(names)])
    out = counts.select(F.inline(rows))
    if reference_gdf is not None and has_geometry(df):
        from .spatial import clip

        ref = identified(reference_gdf)
        whole = ref.agg(F.sum(st_area(GEOM))).first()[0] or 0.0
        part = clip(ref, ref_gdf=df).agg(F.sum(st_area(GEOM))).first()[0] or 0.0
        share = round(part / whole, 6) if whole else 0.0
        out = out.unionByName(df.sparkSession.createDataFrame([("_spatial_coverage", ref.count(), 0, round(1 - share, 6), 1 - share <= null_threshold + 1e-9)], out.schema))
    return out


__all__ = ["pair_shapes"]
