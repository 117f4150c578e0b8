"""Validation rules: scalar expressions with geometry measures and looks at other layers, compiled to columns and joins."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions import geometry as G
from ..operators.layer import GEOM, ROW, aligned, identified, pairs, shapes, srid_of, st_valid, transformed, with_srid


def _epsg(n: ast.Call, default: int = 2154) -> int:
    return next((ast.literal_eval(k.value) for k in n.keywords if k.arg == "epsg"), default)


def _arg(n: ast.Call, name: str, at: int, default=None):
    for k in n.keywords:
        if k.arg == name:
            return k.value.id if isinstance(k.value, ast.Name) else ast.literal_eval(k.value)
    if len(n.args) > at:
        a = n.args[at]
        return a.id if isinstance(a, ast.Name) else ast.literal_eval(a)
    return default


def rule_layer(df: DataFrame, text: str, layers: dict[str, DataFrame] | None = None) -> tuple[DataFrame, Column]:
    """df with the helper columns that the rule needs (names starting with _q), and the rule's column.

    geom_area_m2, geom_perimeter_m, geom_length_m, geom_centroid_x, geom_centroid_y (epsg=2154), geom_npoints, geom_is_valid;
    geom_within(layer=L), geom_overlaps_any(layer=L, exclude_self=False), layer_lookup(layer=L, match=col, value=col).
    """
    layers = layers or {}
    state = {"df": identified(df), "n": 0}

    def measure(f, kind="double"):
        def build(_, n: ast.Call) -> Column:
            return shapes(f, kind)(transformed(F.col(GEOM), srid_of(df), _epsg(n)))

        return build

    def flag(predicate: str):
        def build(_, n: ast.Call) -> Column:
            name = _arg(n, "layer", 0)
            if name not in layers:
                raise E.ExpressionError(f"no layer {name}")
            me = state["df"]
            ref = identified(aligned(layers[name], df))
            p = pairs(me.select(ROW, GEOM), ref.select(ROW, GEOM), predicate)
            if predicate == "intersects":
                p = p.where(shapes_overlap(f"l_{GEOM}", f"r_{GEOM}"))
                if _arg(n, "exclude_self", 1, False):
                    p = p.where(f"l_{ROW} <> r_{ROW}")
            state["n"] += 1
            q = f"_q{state['n']}"
            hit = p.select(F.col(f"l_{ROW}").alias(ROW)).distinct().withColumn(q, F.lit(True))
            state["df"] = me.join(hit, ROW, "left")
            return F.coalesce(F.col(q), F.lit(False))

        return build

    def lookup(_, n: ast.Call) -> Column:
        name, match, value = _arg(n, "layer", 0), _arg(n, "match", 1), _arg(n, "value", 2)
        state["n"] += 1
        q = f"_q{state['n']}"
        ref = identified(layers[name]).groupBy(F.col(match).alias(f"{q}k")).agg(F.min_by(value, ROW).alias(q))
        state["df"] = state["df"].join(ref, F.col(match) == F.col(f"{q}k"), "left").drop(f"{q}k")
        return F.col(q)

    from ..operators.layer import pair_shapes

    shapes_overlap = pair_shapes(lambda a, b: G.relation(a, b)[0], "boolean")
    tables = {
        "geom_area_m2": measure(G.area), "geom_perimeter_m": measure(G.length), "geom_length_m": measure(G.length), "geom_centroid_x": measure(lambda g: float(G.centroid(g).coords[0, 0])), "geom_centroid_y": measure(lambda g: float(G.centroid(g).coords[0, 1])),
        "geom_npoints": lambda _, n: shapes(lambda g: len(g.all_coords()), "int")(F.col(GEOM)), "geom_is_valid": lambda _, n: st_valid(GEOM), "geom_within": flag("within"), "geom_overlaps_any": flag("intersects"), "layer_lookup": lookup,
    }
    column = E.rule_column(df, text, tables)
    return with_srid(state["df"], srid_of(df)), column


def failures(df: DataFrame, rules: list[dict], layers: dict[str, DataFrame] | None = None) -> DataFrame:
    """Rows that break a rule {name, rule, severity?}: rule, severity and the row's _rowid. A rule that is null isn't broken."""
    out = None
    for r in rules:
        rows, c = rule_layer(df, r["rule"], layers)
        part = rows.where(~c).select(F.lit(r.get("name", r["rule"])).alias("rule"), F.lit(r.get("severity", "warn")).alias("severity"), F.col(ROW))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.sparkSession.createDataFrame([], "rule string, severity string, _rowid long")


def tagged(df: DataFrame, rules: list[dict], layers: dict[str, DataFrame] | None = None, tag_col: str = "validation") -> DataFrame:
    """df with the names of the rules each row breaks."""
    base = identified(df)
    got = failures(base, rules, layers).groupBy(F.col(ROW).alias("_r")).agg(F.array_sort(F.collect_set("rule")).alias(tag_col))
    out = base.join(got, F.col(ROW) == F.col("_r"), "left").drop("_r").withColumn(tag_col, F.coalesce(tag_col, F.array().cast("array<string>")))
    return with_srid(out if ROW in df.columns else out.drop(ROW), srid_of(df))
