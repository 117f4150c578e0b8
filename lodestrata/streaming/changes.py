"""The change stream: snapshot differences, triggers, actions, enter and exit, windows with late data."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..operators.layer import GEOM, ROW, aligned, identified, nearest, pairs, st_area, st_centroid, st_length

CHANGE = "session_id string, table_name string, feature_id string, operation string, old_values map<string,string>, new_values map<string,string>, old_geom_wkt string, new_geom_wkt string, geom_changed boolean, recorded_at timestamp"
OPERATIONS = ("INSERT", "UPDATE", "UPDATE_GEOM", "UPDATE_ATTR", "DELETE", "BULK")


def read_changes(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A folder of Parquet change files as a stream."""
    reader = spark.readStream.schema(CHANGE)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def granular(changes: DataFrame) -> DataFrame:
    """UPDATE told apart into UPDATE_GEOM and UPDATE_ATTR."""
    op = F.when(F.col("operation") != "UPDATE", F.col("operation")).when(F.col("geom_changed"), "UPDATE_GEOM").otherwise("UPDATE_ATTR")
    return changes.withColumn("operation", op)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str | None = None, table: str = "layer") -> DataFrame:
    """table_name, operation, row_key, and the row's values. Rows are compared whole; one that changed is a DELETE and an INSERT, and
    copies count once. With a key a row of both that differs is one UPDATE."""
    cols = [c for c in old.columns if c in new.columns]
    digest = F.sha2(F.to_json(F.struct(*[F.base64(c) if dict(new.dtypes)[c] == "binary" else F.col(c) for c in cols]), {"ignoreNullFields": "false"}), 256)
    if key is None:
        a, b = old.select(*cols).withColumn("row_key", digest).dropDuplicates(["row_key"]), new.select(*cols).withColumn("row_key", digest).dropDuplicates(["row_key"])
        gone = a.join(b.select("row_key"), "row_key", "left_anti").withColumn("operation", F.lit("DELETE"))
        came = b.join(a.select("row_key"), "row_key", "left_anti").withColumn("operation", F.lit("INSERT"))
        return gone.unionByName(came).select(F.lit(table).alias("table_name"), "operation", "row_key", *cols)
    a = old.select(F.struct(*cols).alias("o"), digest.alias("od"), F.col(key).cast("string").alias("ok"))
    b = new.select(F.struct(*cols).alias("n"), digest.alias("nd"), F.col(key).cast("string").alias("nk"))
    j = a.join(b, F.col("ok").eqNullSafe(F.col("nk")), "full_outer").where("od is null or nd is null or od <> nd")
    op = F.when(F.col("od").isNull(), "INSERT").when(F.col("nd").isNull(), "DELETE").otherwise("UPDATE")
    return j.select(F.lit(table).alias("table_name"), op.alias("operation"), F.coalesce("nk", "ok").alias("row_key"), F.coalesce("n", "o").alias("x")).select("table_name", "operation", "row_key", "x.*")


# ---------------------------------------------------------------- triggers


@dataclass
class Trigger:
    """kind dml, threshold, validation, business_rule, topology, spatial_constraint, composite, generic, source_changed."""

    id: str
    kind: str = "dml"
    table: str | None = None
    operations: tuple[str, ...] = ()
    predicate: str | None = None  # in the trigger language
    tree: dict | None = None  # a predicate object
    config: dict = field(default_factory=dict)
    actions: tuple[dict, ...] = ()


def _path(df: DataFrame) -> Callable[[str], Column]:
    types = dict(df.dtypes)

    def resolve(path: str) -> Column:
        head, _, rest = path.partition(".")
        if head in ("old", "new") and rest:
            text = F.try_element_at(f"{head}_values", F.lit(rest)) if f"{head}_values" in types else F.col(f"{head}.{rest}")
            return text
        if path in types:
            return F.col(path)
        if "new_values" in types:
            return F.try_element_at("new_values", F.lit(path))
        raise E.ExpressionError(f"unknown name {path}")

    return resolve


def matches(changes: DataFrame, t: Trigger) -> Column:
    """The changes that fire a trigger by table, operation and predicate."""
    tests = [F.lit(True)]
    if t.table:
        tests.append(F.col("table_name") == t.table)
    if t.operations:
        ops = set(t.operations) | ({"UPDATE_GEOM", "UPDATE_ATTR"} if "UPDATE" in t.operations else set())
        tests.append(F.col("operation").isin(*sorted(ops)))
    if t.predicate:
        tests.append(E.trigger_column(t.predicate, _path(changes)))
    if t.tree:
        tests.append(E.predicate_column(changes, t.tree))
    return reduce(lambda a, b: a & b, tests)


def fire(changes: DataFrame, triggers: list[Trigger], layers: dict[str, DataFrame] | None = None) -> DataFrame:
    """A row for each trigger that fires: trigger_id, the change, and its action types. Works on batches and streams for kinds that
    look at the change alone; threshold, topology and spatial kinds look at whole layers, so they need a batch."""
    out = None
    for t in triggers:
        rows = changes.where(matches(changes, t))
        if t.kind == "threshold":
            rows = rows.where(F.lit(threshold(layers[t.table or t.config["layer"]], t.config)))
        elif t.kind in ("topology", "spatial_constraint"):
            bad = broken(layers, t).select(F.col("feature_id").alias("_f")).distinct()
            rows = rows.join(bad, F.col("feature_id") == F.col("_f"), "left_semi")
        elif t.kind == "composite":
            parts = [matches(changes, p) for p in t.config["parts"]]
            mode = t.config.get("mode", "all")
            if mode in ("all", "any"):
                rows = rows.where(reduce((lambda a, b: a & b) if mode == "all" else (lambda a, b: a | b), parts))
            else:  # sequence: each part's first match, per feature, in order of time
                times = changes.groupBy("feature_id").agg(*[F.min(F.when(p, F.col("recorded_at"))).alias(f"t{i}") for i, p in enumerate(parts)])
                ok = reduce(lambda a, b: a & b, [F.col(f"t{i}") < F.col(f"t{i + 1}") for i in range(len(parts) - 1)], F.lit(True)) & F.col(f"t{len(parts) - 1}").isNotNull()
                rows = rows.where(parts[-1]).join(times.where(ok).select("feature_id"), "feature_id", "left_semi")
        kinds = F.array(*[F.lit(a.get("type", "notify")) for a in t.actions]) if t.actions else F.array().cast("array<string>")
        part = rows.select(F.lit(t.id).alias("trigger_id"), *[F.col(c) for c in changes.columns], kinds.alias("actions"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else changes.limit(0).select(F.lit("").alias("trigger_id"), "*", F.array().cast("array<string>").alias("actions"))


def threshold(layer: DataFrame, config: dict) -> bool:
    """Whether a layer's number (feature_count, total_area, total_length, sum/avg/min/max_value of a field) passes its limit."""
    field_ = config.get("field")
    how = {"feature_count": lambda: F.count(F.lit(1)), "total_area": lambda: F.sum(st_area(GEOM)), "total_length": lambda: F.sum(st_length(GEOM)), "sum_value": lambda: F.sum(field_), "avg_value": lambda: F.avg(field_), "max_value": lambda: F.max(field_), "min_value": lambda: F.min(field_)}
    v = layer.agg(how[config["metric"]]().alias("v")).first()[0]
    x, op = config["value"], config.get("op", "gt")
    return v is not None and {"gt": v > x, "gte": v >= x, "lt": v < x, "lte": v <= x, "eq": v == x, "neq": v != x}[op]


def broken(layers: dict[str, DataFrame], t: Trigger) -> DataFrame:
    """feature_id of the rows that break a topology or distance rule {rule, layer, other?, distance?, id_col?}."""
    c = t.config
    me = identified(layers[t.table or c["layer"]])
    name = F.col(c.get("id_col", "id")).cast("string").alias("feature_id")
    ids = me.select(F.col(ROW).alias("_r"), name)
    own = me.select(ROW, GEOM)
    other = identified(aligned(layers[c["other"]], me)).select(ROW, GEOM) if c.get("other") else own
    rule, d = c["rule"], float(c.get("distance", 0))
    self_ = F.col(f"l_{ROW}") != F.col(f"r_{ROW}") if other is own else F.lit(True)
    hit = lambda predicate, by=0.0: pairs(own, other, predicate, by).where(self_).select(F.col(f"l_{ROW}").alias("_r")).distinct()
    if rule == "no_gap":
        return ids.limit(0).select("feature_id")
    if rule in ("no_overlap", "must_not_overlap_with"):
        got = hit("overlaps").unionByName(hit("within")).unionByName(hit("contains")).distinct()
    elif rule == "must_not_cross":
        got = hit("crosses")
    elif rule in ("must_be_inside", "must_be_within"):
        got = ids.select("_r").join(hit("within"), "_r", "left_anti")
    elif rule == "min_distance":
        got = hit("dwithin", d)
        if d:
            got = pairs(own, other, "dwithin", d).where(self_).where(_distance() < d).select(F.col(f"l_{ROW}").alias("_r")).distinct()
    elif rule == "max_distance":
        got = ids.select("_r").join(hit("dwithin", d), "_r", "left_anti")
    elif rule == "exclusion_zone":
        got = hit("intersects")
    else:
        raise ValueError(f"unknown rule {rule}")
    return ids.join(got, "_r").select("feature_id")


def _distance() -> Column:
    from ..operators.layer import st_distance

    return st_distance(f"l_{GEOM}", f"r_{GEOM}")


MOST_CASCADES = 3


def cascade(changes: DataFrame, triggers: list[Trigger], react: Callable[[DataFrame], DataFrame | None], layers=None, most: int = MOST_CASCADES) -> DataFrame:
    """Fires triggers, lets `react` make the changes that follow, and goes on until none do; deeper than `most` is an error."""
    out, depth = None, 0
    while True:
        fired = fire(changes, triggers, layers).withColumn("depth", F.lit(depth))
        if fired.isEmpty():
            return out if out is not None else fired
        if depth >= most:
            raise RuntimeError(f"more than {most} cascades")
        out = fired if out is None else out.unionByName(fired)
        following = react(fired)
        if following is None:
            return out
        changes, depth = following, depth + 1


def set_field(layer: DataFrame, fired: DataFrame, field_: str, value, id_col: str = "id", tag: bool = False) -> DataFrame:
    """The layer with a field set (or, tag, a word added to it) for the rows that fired."""
    ids = fired.select(F.col("feature_id").alias("_f")).distinct().withColumn("_hit", F.lit(True))
    j = layer.join(ids, F.col(id_col).cast("string") == F.col("_f"), "left")
    old = F.col(field_) if field_ in layer.columns else F.lit(None).cast("string")
    new = F.concat_ws(",", old.cast("string"), F.lit(str(value))) if tag else F.lit(value)
    return j.withColumn(field_, F.when(F.col("_hit"), new).otherwise(old)).drop("_f", "_hit")


def update_aggregate(layer: DataFrame, source: DataFrame, by: str, field_: str, function: str, value: str | None = None) -> DataFrame:
    """The layer with field_ = COUNT, SUM, AVG, MIN or MAX of the source's rows with the same `by`."""
    f = {"COUNT": lambda: F.count(F.lit(1)), "SUM": lambda: F.sum(value), "AVG": lambda: F.avg(value), "MIN": lambda: F.min(value), "MAX": lambda: F.max(value)}[function.upper()]()
    got = source.groupBy(F.col(by).alias("_k")).agg(f.alias("_v"))
    out = layer.drop(field_).join(got, F.col(by) == F.col("_k"), "left").drop("_k")
    return out.withColumn(field_, F.coalesce("_v", F.lit(0)) if function.upper() in ("COUNT", "SUM") else F.col("_v")).drop("_v")


def bulk_summary(changes: DataFrame, least: int = 100) -> DataFrame:
    """One bulk.changed row for each table with at least `least` changes: counts by operation."""
    g = changes.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_changes"), *[F.count_if(F.col("operation").startswith(o)).alias(f"n_{o.lower()}") for o in ("INSERT", "UPDATE", "DELETE")])
    return g.where(F.col("n_changes") >= least).withColumn("event", F.lit("bulk.changed"))


# ---------------------------------------------------------------- computed on change


def before_change(df: DataFrame, operations: list[dict], layers: dict[str, DataFrame] | None = None) -> DataFrame:
    """Columns computed on changed rows, in order: {op, target, layer?, value?, distance?, expression?, skip_if_set?}.

    st_length, st_area, centroid_x, centroid_y, st_within / st_contains / st_intersects (value of the first match), st_nearest,
    st_dwithin_startpoint, st_dwithin_endpoint (nearest within distance), custom_expression.
    """
    from ..functions import geometry as G
    from ..operators.layer import shapes, st_x, st_y

    df = identified(df)
    for o in operations:
        op, target = o["op"], o["target"]
        if op in ("st_length", "st_area"):
            v = (st_length if op == "st_length" else st_area)(GEOM)
        elif op in ("centroid_x", "centroid_y"):
            v = (st_x if op == "centroid_x" else st_y)(st_centroid(GEOM))
        elif op == "custom_expression":
            v = E.value_column(df, o["expression"])
        else:
            ref = identified(aligned(layers[o["layer"]], df))
            value = o.get("value", "id")
            if op in ("st_within", "st_contains", "st_intersects"):
                p = pairs(df.select(ROW, GEOM), ref.select(ROW, GEOM, value), op[3:]).groupBy(F.col(f"l_{ROW}").alias("_l")).agg(F.min_by(f"r_{value}", f"r_{ROW}").alias("_v"))
            else:
                end = {"st_dwithin_startpoint": 0, "st_dwithin_endpoint": -1}.get(op)
                place = F.col(GEOM) if end is None else shapes(lambda g, k=end: G.point(*g.simple()[k].coords[k, :2]), "binary")(F.col(GEOM))
                p = nearest(df.select(ROW, place.alias(GEOM)), ref.select(ROW, GEOM, value), 1, o.get("distance")).select(F.col(f"l_{ROW}").alias("_l"), F.col(f"r_{value}").alias("_v"))
            df = df.join(p, F.col(ROW) == F.col("_l"), "left").drop("_l")
            v = F.col("_v")
        old = F.col(target) if target in df.columns and o.get("skip_if_set") else F.lit(None)
        df = df.withColumn(target, F.coalesce(old, v)).drop("_v")
    return df


def after_change(target: DataFrame, changed: DataFrame, source: DataFrame, field_: str, function: str = "count", predicate: str = "intersects", value: str | None = None) -> DataFrame:
    """The target with an aggregate (count, sum, string_agg) of the source rows it relates to, anew only for rows that a changed geometry touches."""
    target = identified(target)
    touched = pairs(target.select(ROW, GEOM), identified(changed).select(GEOM), "intersects").select(F.col(f"l_{ROW}").alias(ROW)).distinct()
    part = target.join(touched, ROW, "left_semi")
    src = identified(source)
    p = pairs(part.select(ROW, GEOM), src.select(ROW, GEOM, *([value] if value else [])), predicate).groupBy(F.col(f"l_{ROW}").alias("_l"))
    f = {"count": lambda: F.count(F.lit(1)), "sum": lambda: F.sum(f"r_{value}"), "string_agg": lambda: F.array_join(F.array_sort(F.collect_list(F.col(f"r_{value}").cast("string"))), ",")}[function]()
    got = p.agg(f.alias("_v"))
    none = F.lit(0) if function in ("count", "sum") else F.lit(None)
    hit = touched.withColumnRenamed(ROW, "_t").withColumn("_touched", F.lit(True))
    out = target.join(hit, F.col(ROW) == F.col("_t"), "left").join(got, F.col(ROW) == F.col("_l"), "left")
    old = F.col(field_) if field_ in target.columns else F.lit(None)
    return out.withColumn(field_, F.when(F.col("_touched"), F.coalesce("_v", none)).otherwise(old)).drop("_t", "_l", "_v", "_touched")


# ---------------------------------------------------------------- enter and exit


def transitions(events: DataFrame, object_col: str, time_col: str, inside: Column, order_col: str | None = None) -> DataFrame:
    """ENTER and EXIT rows of a batch. The first sight of an object inside is an ENTER, outside nothing."""
    w = Window.partitionBy(object_col).orderBy(time_col, *([order_col] if order_col else []))
    e = events.withColumn("_in", F.coalesce(inside, F.lit(False))).withColumn("_was", F.lag("_in").over(w))
    kind = F.when(F.col("_in") & ~F.coalesce("_was", F.lit(False)), "ENTER").when(~F.col("_in") & F.col("_was"), "EXIT")
    return e.withColumn("transition", kind).where("transition is not null").drop("_in", "_was")


def transitions_stream(events: DataFrame, object_col: str, time_col: str, inside: Column) -> DataFrame:
    """The same on a stream, with each object's state kept between batches: object, time, transition. Events older than the last
    one seen of their object are passed over, so a batch that is replayed changes nothing."""
    src = events.select(F.col(object_col).cast("string").alias("object"), F.col(time_col).cast("timestamp").alias("time"), F.coalesce(inside, F.lit(False)).alias("inside"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, was = state.get if state.exists else (None, None)
        out = []
        for t in sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: r.time):
            micros = int(t.time.value // 1000)
            if last is not None and micros <= last:
                continue
            if t.inside and not was:
                out.append((key[0], t.time, "ENTER"))
            elif not t.inside and was:
                out.append((key[0], t.time, "EXIT"))
            last, was = micros, bool(t.inside)
        if last is not None:
            state.update((last, was))
        yield pd.DataFrame(out, columns=["object", "time", "transition"])

    return src.groupBy("object").applyInPandasWithState(step, "object string, time timestamp, transition string", "last long, inside boolean", "append", "NoTimeout")


def windowed(events: DataFrame, time_col: str, width: str, slide: str | None = None, late: str | None = None, by: list[str] | None = None, value: str | None = None) -> DataFrame:
    """Counts (and the sum of a value) by tumbling or sliding window; on a stream rows later than `late` are left out."""
    e = events.withWatermark(time_col, late) if late else events
    w = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    g = e.groupBy(w, *(by or [])).agg(F.count(F.lit(1)).alias("n"), *([F.sum(value).alias("total")] if value else []))
    return g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *(by or []), "n", *(["total"] if value else []))


def sessions(events: DataFrame, time_col: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    """Counts by session: runs of an object's events with no longer pause than `gap`."""
    e = events.withWatermark(time_col, late) if late else events
    g = e.groupBy(F.session_window(time_col, gap).alias("s"), *by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*by, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def watch(changes: DataFrame, triggers: list[Trigger], out_path: str, checkpoint: str, least_bulk: int | None = None):
    """A running query that appends fired triggers to out_path; each batch is written under its own number, so a replay replaces it."""

    def batch(df: DataFrame, number: int) -> None:
        df = granular(df)
        fire(df, triggers).write.mode("overwrite").parquet(f"{out_path}/fired/batch={number}")
        if least_bulk:
            bulk_summary(df, least_bulk).write.mode("overwrite").parquet(f"{out_path}/bulk/batch={number}")

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
