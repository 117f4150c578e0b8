"""The registered queries of the engine's own operators, each over whole tables, and SQL that gives the same rows.

The tables have no geometry; layers are derived from keys by modular arithmetic (points on a 10007 lattice, nation boxes on a
5-wide grid, a network between neighbouring parts), so that both engines have the same exact numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as G
from .operators import apply
from .operators.classify import legend
from .operators.layer import GEOM, ROW, make_box, make_line, make_point, shapes, srid_of, st_area, st_dim, st_length, st_x, st_y, with_srid
from .plans import pipeline, rules
from .streaming import changes as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(f):
        name = f.__name__.rstrip("_")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return wrap


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _points(df: DataFrame, key: str, tiles: bool = False) -> DataFrame:
    k = F.col(key).cast("long")
    above = F.floor(k / 10007) * 10007 if tiles else F.lit(0)
    df = df.withColumn(ROW, k).withColumns({"x": (k * 7919 % 10007).cast("double"), "y": (k * 104729 % 10007 + above).cast("double")})
    return with_srid(df.withColumn(GEOM, make_point("x", "y")), 3857)


def customers(spark, d):
    return _points(table(spark, d, "customer"), "c_custkey")


def suppliers(spark, d):
    return _points(table(spark, d, "supplier"), "s_suppkey")


def parts(spark, d):
    return _points(table(spark, d, "part"), "p_partkey")


def junctions(spark, d):
    """Parts as nodes of the network: the lattice holds 10007 places, so each further 10007 parts lie on a lattice above."""
    return _points(table(spark, d, "part"), "p_partkey", tiles=True)


def nations(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    x, y = (k % 5 * 2000).cast("double"), (F.floor(k / 5) * 2000).cast("double")
    return with_srid(n.withColumn(ROW, k.cast("long")).withColumn(GEOM, make_box(x, y, x + 2400, y + 2400)), 3857)


def network(spark, d):
    """Lines from each part to the next and the seventh next, weights 1 to 97."""
    p = junctions(spark, d).select("p_partkey", "x", "y")  # the join deals them out
    e = p.withColumn("step", F.explode(F.array(F.lit(1), F.lit(7)))).withColumn("other", F.col("p_partkey") + F.col("step"))
    q = p.select(F.col("p_partkey").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    e = e.join(q.hint("merge"), "other").withColumn("w", (1 + F.col("p_partkey") * 31 % 97).cast("double"))
    return with_srid(e.withColumn(ROW, F.col("p_partkey") * 10 + F.col("step")).withColumn(GEOM, make_line("x", "y", "x2", "y2")), 3857)


_C = "(select *, cast(c_custkey * 7919 % 10007 as double) as x, cast(c_custkey * 104729 % 10007 as double) as y from customer)"
_S = "(select *, cast(s_suppkey * 7919 % 10007 as double) as x, cast(s_suppkey * 104729 % 10007 as double) as y from supplier)"
_P = "(select *, cast(p_partkey * 7919 % 10007 as double) as x, cast(p_partkey * 104729 % 10007 as double) as y from part)"
_N = "(select *, cast(n_nationkey % 5 * 2000 as double) as x0, cast(n_nationkey // 5 * 2000 as double) as y0 from nation)"
_E = """(select a.p_partkey * 10 + s.step as edge, a.p_partkey as u, b.p_partkey as v, cast(1 + a.p_partkey * 31 % 97 as double) as w
        from part a, (values (1), (7)) s(step), part b where b.p_partkey = a.p_partkey + s.step)"""


# ---------------------------------------------------------------- flagship: a step graph over three tables


@query("""select c_custkey, c_mktsegment, revenue, orders from (
    select c_custkey, c_mktsegment, round(sum(o_totalprice * (1 - 0.01 * (o_orderkey % 7))), 4) as revenue, count(*) as orders
    from orders join customer on o_custkey = c_custkey where o_totalprice > 1000 group by all) order by revenue desc, c_custkey limit 100""")
def flagship(spark, d):
    spec = {
        "steps": [
            {"id": "big", "capability": "filter", "params": {"expression": "o_totalprice > 1000"}, "input": "orders"},
            {"id": "net", "capability": "calculate", "params": {"expressions": {"net": "o_totalprice * (1 - 0.01 * (o_orderkey % 7))"}}},
            {"id": "named", "capability": "attribute_join", "params": {"left_on": "o_custkey", "right_on": "c_custkey", "how": "inner", "columns": ["c_mktsegment"]}, "ref_layer": "customer"},
        ]
    }
    out = pipeline.run(spec, {"orders": table(spark, d, "orders"), "customer": table(spark, d, "customer")})
    out = out.groupBy(F.col("o_custkey").alias("c_custkey"), "c_mktsegment").agg(F.round(F.sum("net"), 4).alias("revenue"), F.count(F.lit(1)).alias("orders"))
    return apply("top_n", out.withColumn(ROW, F.col("c_custkey")), n=100, by=["revenue"]).drop(ROW)


# ---------------------------------------------------------------- projection


@query("select n_nationkey, n_name from nation")
def select_columns(spark, d):
    return apply("select_columns", table(spark, d, "nation"), fields=["n_name", "n_nationkey", "unknown"])


@query("select n_nationkey, n_name from nation")
def drop_field(spark, d):
    return apply("drop_field", table(spark, d, "nation"), fields=["n_regionkey", "unknown"])


@query("select n_nationkey as id, n_name as name, n_regionkey from nation")
def rename_field(spark, d):
    return apply("rename_field", table(spark, d, "nation"), mapping={"n_nationkey": "id", "n_name": "name"})


@query("select n_nationkey, 'x' as tag, cast(3 as bigint) as n, cast(null as varchar) as empty from nation")
def add_field(spark, d):
    return apply("add_field", table(spark, d, "nation").select("n_nationkey"), fields=[{"name": "tag", "value": "x"}, {"name": "n", "dtype": "int", "value": 3}, {"name": "empty"}])


@query("select o_orderkey, cast(o_orderkey as varchar) as text, try_cast(o_orderpriority as bigint) as number from orders")
def cast_field(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("text"), F.col("o_orderpriority").alias("number"))
    return apply("cast_field", o, casts={"text": "string", "number": "int"}, errors="coerce")


@query("select c_custkey, coalesce(case when c_acctbal > 0 then c_acctbal end, cast(c_nationkey as double)) as v from customer")
def coalesce_fields(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("a"), F.col("c_nationkey").cast("double").alias("b"))
    return apply("coalesce_fields", c, sources=["a", "b"], target_col="v").select("c_custkey", "v")


@query("select o_orderkey, case when o_totalprice > 200000 then 'big' when o_totalprice > 50000 and o_orderstatus = 'F' then 'done' else 'other' end as kind from orders")
def case_when(spark, d):
    return apply("case_when", table(spark, d, "orders"), target_col="kind", cases=[{"when": "o_totalprice > 200000", "then": "big"}, {"when": "o_totalprice > 50000 and o_orderstatus == 'F'", "then": "done"}], else_="other").select("o_orderkey", "kind")


@query("select o_orderkey, case o_orderstatus when 'F' then 'final' when 'O' then 'open' else o_orderstatus end as status from orders")
def lookup_table(spark, d):
    return apply("lookup_table", table(spark, d, "orders"), source_col="o_orderstatus", mapping={"F": "final", "O": "open"}, target_col="status", default="__source__").select("o_orderkey", "status")


@query("select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as net, round(ln(1 + l_quantity), 9) as q, case when l_tax > 0.04 then 1 else 0 end as taxed, l_orderkey - 7 * cast(floor(l_orderkey / 7) as bigint) as m from lineitem")
def calculate(spark, d):
    out = apply("calculate", table(spark, d, "lineitem"), expressions={"net": "l_extendedprice * (1 - l_discount)", "q0": "np.log1p(l_quantity)", "taxed": "1 if l_tax > 0.04 else 0", "m": "l_orderkey % 7"})
    return out.select("l_orderkey", "l_linenumber", "net", F.round("q0", 9).alias("q"), "taxed", "m")


@query("""select 'c_mktsegment' as "column", count(*) as n_rows, count(*) - count(c_mktsegment) as n_nulls, count(distinct c_mktsegment) as n_unique from customer
    union all select 'c_nationkey', count(*), count(*) - count(c_nationkey), count(distinct c_nationkey) from customer""")
def describe(spark, d):
    from .operators.attribute import describe_report

    return describe_report(apply("describe", table(spark, d, "customer").select("c_mktsegment", "c_nationkey"))).select("column", "n_rows", "n_nulls", "n_unique")


@query("select r_regionkey as id from region")
def attribute_prep(spark, d):
    return apply("attribute_prep", table(spark, d, "region"), rename={"r_regionkey": "id"}, drop=["r_name"], keep_only=["id"])


@query("select event_id, json_extract_string(props, '$.k') as tag_k from events")
def osm_tag_extract(spark, d):
    return apply("osm_tag_extract", table(spark, d, "events"), tags_column="props", extract_keys=["k"]).select("event_id", "tag_k")


# ---------------------------------------------------------------- reshape, order, selection


@query(f"select c_mktsegment, {', '.join(f'cast(sum(case when c_nationkey = {k} then 1 end) as bigint) as bal_{k}' for k in range(25))} from customer group by 1")
def pivot(spark, d):
    c = table(spark, d, "customer").select("c_mktsegment", F.col("c_nationkey").alias("n"), F.lit(1).cast("long").alias("bal"))
    return apply("pivot", c, index=["c_mktsegment"], columns="n", values="bal", aggfunc="sum")


@query("select l_orderkey, l_linenumber, 'l_tax' as variable, l_tax as value from lineitem union all select l_orderkey, l_linenumber, 'l_discount', l_discount from lineitem")
def unpivot(spark, d):
    return apply("unpivot", table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_discount"), id_vars=["l_orderkey", "l_linenumber"])


@query("select o_orderkey, cast(row_number() over (order by o_orderdate desc, o_orderkey) as bigint) as pos from orders")
def sort_pos(spark, d):
    from pyspark.sql import Window

    from .operators.graph import cut

    o = apply("sort", table(spark, d, "orders").withColumn(ROW, F.col("o_orderkey")), by=["o_orderdate", "o_orderkey"], ascending=[False, True])
    # the number has the partition in its upper bits and the place in the sorted partition in its lower 33
    o = cut(o.select("o_orderkey", F.monotonically_increasing_id().alias("i"))).withColumn("p", F.shiftright("i", 33))
    n = o.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    n = n.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return o.join(F.broadcast(n), "p").select("o_orderkey", (F.col("before") + F.col("i").bitwiseAND(F.lit(2**33 - 1)) + 1).alias("pos"))  # a row for each partition


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50")
def top_n(spark, d):
    return apply("top_n", table(spark, d, "orders").withColumn(ROW, F.col("o_orderkey")), n=50, by="o_totalprice").select("o_orderkey", "o_totalprice")


@query("select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1")
def deduplicate(spark, d):
    return apply("deduplicate", table(spark, d, "orders").withColumn(ROW, F.col("o_orderkey")), keys=["o_custkey"], keep="last", order_by=["o_orderdate"]).select("o_custkey", "o_orderkey")


@query("select cast(round(count(*) * 0.1) as bigint) as n from orders")
def random_sample(spark, d):
    return apply("random_sample", table(spark, d, "orders").withColumn(ROW, F.col("o_orderkey")), fraction=0.1, seed=7).agg(F.count_distinct("o_orderkey").alias("n"))


# ---------------------------------------------------------------- filters and joins


@query("select o_orderkey from orders where o_totalprice > 100000 and o_orderstatus in ('F', 'O') and not (o_orderpriority = '1-URGENT')")
def filter_query(spark, d):
    return apply("filter", table(spark, d, "orders"), expression="o_totalprice > 100000 and o_orderstatus in ['F', 'O'] and not (o_orderpriority == '1-URGENT')").select("o_orderkey")


@query(f"select distinct c_custkey from {_C} c where exists (select 1 from {_S} s where (c.x - s.x) ** 2 + (c.y - s.y) ** 2 <= 250000)")
def filter_dwithin(spark, d):
    return apply("filter", customers(spark, d), spatial_predicate="dwithin", buffer_distance=500.0, ref_gdf=suppliers(spark, d)).select("c_custkey")


@query(f"select c_custkey from {_C} c where exists (select 1 from {_N} n where c.x between x0 and x0 + 2400 and c.y between y0 and y0 + 2400 and n_regionkey = 2)")
def intersects(spark, d):
    return apply("intersects", customers(spark, d), ref_gdf=nations(spark, d).where("n_regionkey = 2")).select("c_custkey")


@query(f"select c_custkey from {_C} c join {_N} n on c.x between x0 and x0 + 2400 and c.y between y0 and y0 + 2400")
def spatial_filter(spark, d):
    return apply("spatial_filter", customers(spark, d), mask_gdf=nations(spark, d)).select("c_custkey")


@query("select o_orderkey from orders where not (o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1997-01-01')")
def temporal_filter(spark, d):
    return apply("temporal_filter", table(spark, d, "orders"), time_col="o_orderdate", start="1995-01-01", end="1997-01-01", include_end=False, invert=True).select("o_orderkey")


@query("select c_custkey, n_name from customer left join nation on c_nationkey = n_nationkey and n_regionkey = 1")
def attribute_join_left(spark, d):
    return apply("attribute_join", table(spark, d, "customer").select("c_custkey", "c_nationkey"), ref_gdf=table(spark, d, "nation").where("n_regionkey = 1"), left_on="c_nationkey", right_on="n_nationkey", columns=["n_name"]).select("c_custkey", "n_name")


@query("select coalesce(s_nationkey, n_nationkey) as s_nationkey, s_suppkey, n_name from supplier s full join (select * from nation where n_regionkey < 3) n on s_nationkey = n_nationkey")
def attribute_join_outer(spark, d):
    return apply("attribute_join", table(spark, d, "supplier").select("s_nationkey", "s_suppkey"), ref_gdf=table(spark, d, "nation").where("n_regionkey < 3"), left_on="s_nationkey", right_on="n_nationkey", how="outer", columns=["n_name"])


_CLICK = "(select user_id, ts, max(event_id) as ref_id from events where event_type = (select min(event_type) from events) group by 1, 2)"


def _clicks(spark, d):
    e = table(spark, d, "events")
    first = e.agg(F.min("event_type").alias("t"))
    return e.join(F.broadcast(first), F.col("event_type") == F.col("t")).groupBy("user_id", "ts").agg(F.max("event_id").alias("ref_id"))  # one row


@query(f"select e.event_id, r.ref_id from events e asof left join {_CLICK} r on e.user_id = r.user_id and e.ts >= r.ts")
def asof_backward(spark, d):
    return apply("temporal_join", table(spark, d, "events"), ref_gdf=_clicks(spark, d), left_on="ts", by="user_id", strategy="backward").select("event_id", "ref_id")


@query(f"select e.event_id, r.ref_id from events e asof left join {_CLICK} r on e.user_id = r.user_id and e.ts <= r.ts")
def asof_forward(spark, d):
    return apply("temporal_join", table(spark, d, "events"), ref_gdf=_clicks(spark, d), left_on="ts", by="user_id", strategy="forward").select("event_id", "ref_id")


@query(f"""with b as (select e.event_id, e.ts, r.ref_id, r.ts as rt from events e asof left join {_CLICK} r on e.user_id = r.user_id and e.ts >= r.ts),
    f as (select e.event_id, r.ref_id, r.ts as rt from events e asof left join {_CLICK} r on e.user_id = r.user_id and e.ts <= r.ts)
    select b.event_id, case when least(coalesce(b.ts - b.rt, interval 999 days), coalesce(f.rt - b.ts, interval 999 days)) > interval 6 hours then null
      when f.rt is null or (b.rt is not null and b.ts - b.rt <= f.rt - b.ts) then b.ref_id else f.ref_id end as ref_id from b join f using (event_id)""")
def asof_nearest_tolerance(spark, d):
    return apply("temporal_join", table(spark, d, "events"), ref_gdf=_clicks(spark, d), left_on="ts", by="user_id", strategy="nearest", tolerance="6h").select("event_id", "ref_id")


@query(f"select e.event_id, r.ref_id from events e left join {_CLICK} r on e.ts = r.ts and e.user_id = r.user_id")
def temporal_exact(spark, d):
    return apply("temporal_join", table(spark, d, "events"), ref_gdf=_clicks(spark, d), left_on="ts", by="user_id", strategy="exact").select("event_id", "ref_id")


@query(f"select c_custkey, n_name from {_C} c join {_N} n on c.x between x0 and x0 + 2400 and c.y between y0 and y0 + 2400")
def spatial_join_inner(spark, d):
    return apply("spatial_join", customers(spark, d).select(ROW, "c_custkey", GEOM), ref_gdf=nations(spark, d)).select("c_custkey", "n_name")


@query(f"select c_custkey, n_name from {_C} c left join {_N} n on c.x between x0 and x0 + 2400 and c.y between y0 and y0 + 2400")
def spatial_join_left(spark, d):
    return apply("spatial_join", customers(spark, d).select(ROW, "c_custkey", GEOM), ref_gdf=nations(spark, d), how="left").select("c_custkey", "n_name")


@query(f"""select c_custkey, s_suppkey, round(dist, 6) as dist from (select c_custkey, s_suppkey, sqrt((c.x - s.x) ** 2 + (c.y - s.y) ** 2) as dist,
    row_number() over (partition by c_custkey order by (c.x - s.x) ** 2 + (c.y - s.y) ** 2, s_suppkey) as rn from {_C} c, {_S} s) where rn <= 2""")
def nearest_k(spark, d):
    return apply("nearest_neighbor", customers(spark, d).select(ROW, "c_custkey", GEOM), ref_gdf=suppliers(spark, d), k=2, columns=["s_suppkey"]).select("c_custkey", "s_suppkey", F.round("nn_distance", 6).alias("dist"))


@query()
def line_locate_point(spark, d):
    out = apply("line_locate_point", suppliers(spark, d).select(ROW, "s_suppkey", GEOM), ref_gdf=network(spark, d))
    return out.select("s_suppkey", F.round("measure", 6).alias("measure"), "ref_index")


_RING = f"(select s_suppkey % 3 * 100 + 100 as b, x, y, 400 + 300 * (s_suppkey % 3) as r from {_S})"


@query(f"""select c_custkey, coalesce(v, 99999.0) as ring_value, cast(case v when 100 then 1 when 200 then 2 when 300 then 3 else 4 end as bigint) as ring_class
    from {_C} c left join (select k, cast(min(b) as double) as v from (select c.c_custkey as k, s.b from {_C} c join {_RING} s on c.x between s.x - s.r and s.x + s.r and c.y between s.y - s.r and s.y + s.r) group by 1) on k = c_custkey""")
def classify_by_ring(spark, d):
    s = suppliers(spark, d).withColumn("cost_budget", F.col("s_suppkey") % 3 * 100 + 100).withColumn("r", 400 + 300 * (F.col("s_suppkey") % 3))
    rings = with_srid(s.select("cost_budget", make_box(F.col("x") - F.col("r"), F.col("y") - F.col("r"), F.col("x") + F.col("r"), F.col("y") + F.col("r")).alias(GEOM)), 3857)
    return apply("classify_by_ring", customers(spark, d).select(ROW, "c_custkey", GEOM), ref_gdfs=[rings]).select("c_custkey", "ring_value", "ring_class")


@query()
def ftth_nearest_node(spark, d):
    out = apply("ftth_nearest_node", suppliers(spark, d).select(ROW, "s_suppkey", GEOM), road_network=network(spark, d), max_distance_m=200)
    return out.select("s_suppkey", "snap_status", F.round("snap_distance", 6).alias("snap_distance"))


# ---------------------------------------------------------------- aggregates and sets


@query(f"""select n_name, coalesce(n, 0) as count, coalesce(s, 0) as c_acctbal_sum, a as c_acctbal_mean, md as c_acctbal_median, sd as c_acctbal_std from nation left join (
    select n_nationkey as k, count(*) as n, round(sum(c_acctbal), 4) as s, round(avg(c_acctbal), 6) as a, round(median(c_acctbal), 6) as md, round(stddev_samp(c_acctbal), 6) as sd
    from {_N} n join {_C} c on c.x between x0 and x0 + 2400 and c.y between y0 and y0 + 2400 group by 1) on k = n_nationkey""")
def spatial_aggregate(spark, d):
    out = apply("spatial_aggregate", nations(spark, d), ref_gdf=customers(spark, d), agg={"*": "count", "c_acctbal": ["sum", "mean", "median", "std"]})
    r = {c: F.round(c, n) for c, n in (("c_acctbal_sum", 4), ("c_acctbal_mean", 6), ("c_acctbal_median", 6), ("c_acctbal_std", 6))}
    return out.withColumns(r).select("n_name", "count", *r)


@query(f"""with cells as (select n_regionkey, gx, gy from {_N}, range(0, 31) a(gx), range(0, 31) b(gy) where gx * 400 >= x0 and gx * 400 < x0 + 2400 and gy * 400 >= y0 and gy * 400 < y0 + 2400 group by all)
    select n_regionkey, cast(count(*) * 160000 as double) as area, min(n) as n_name from cells join (select n_regionkey as k, min_by(n_name, n_nationkey) as n from nation group by 1) on k = n_regionkey group by 1""")
def dissolve(spark, d):
    out = apply("dissolve", nations(spark, d), by="n_regionkey")
    return out.select("n_regionkey", F.round(st_area(GEOM), 3).alias("area"), "n_name")


@query(f"select cast(count(*) * 160000 as double) as area from (select distinct gx, gy from {_N}, range(0, 31) a(gx), range(0, 31) b(gy) where gx * 400 >= x0 and gx * 400 < x0 + 2400 and gy * 400 >= y0 and gy * 400 < y0 + 2400)")
def union_(spark, d):
    return apply("union", nations(spark, d)).select(F.round(st_area(GEOM), 3).alias("area"))


@query("select c_nationkey, count(*) as parts from customer group by 1")
def singleparts_to_multipart(spark, d):
    out = apply("singleparts_to_multipart", customers(spark, d).select(ROW, "c_nationkey", GEOM), by=["c_nationkey"], collect=True)
    return out.select("c_nationkey", shapes(lambda g: len(g.simple()), "long")(GEOM).alias("parts"))


@query("select s_suppkey as key, s_name as name, cast(null as double) as bal from supplier union all select c_custkey, null, c_acctbal from customer")
def merge_layers(spark, d):
    return apply("merge_layers", suppliers(spark, d).select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")), ref_gdfs=[customers(spark, d).select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("bal"))])


@query("""select coalesce(a.o_orderkey, b.o_orderkey) as id, case when b.o_orderkey is null then 'added' when a.o_orderkey is null then 'removed' when a.p <> b.p then 'modified' else 'unchanged' end as change_type
    from (select o_orderkey, case when o_orderkey % 11 = 0 then o_totalprice + 1 else o_totalprice end as p from orders where o_orderkey % 5 <> 0) a
    full join (select o_orderkey, o_totalprice as p from orders where o_orderkey % 7 <> 0) b using (o_orderkey)""")
def vector_diff(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("p"))
    new = o.where("id % 5 <> 0").withColumn("p", F.when(F.col("id") % 11 == 0, F.col("p") + 1).otherwise(F.col("p")))
    return apply("vector_diff", new, ref_gdf=o.where("id % 7 <> 0"), id_field="id").select("id", "change_type")


# ---------------------------------------------------------------- overlays: boxes against boxes


_PAIRS = f"""(select a.n_nationkey as a, b.n_nationkey as b, (least(a.x0, b.x0) + 2400 - greatest(a.x0, b.x0)) * (least(a.y0, b.y0) + 2400 - greatest(a.y0, b.y0)) as area
    from {_N} a, {_N} b where least(a.x0, b.x0) + 2400 > greatest(a.x0, b.x0) and least(a.y0, b.y0) + 2400 > greatest(a.y0, b.y0))"""


def _two(spark, d):
    n = nations(spark, d).select(ROW, "n_nationkey", "n_regionkey", GEOM)
    return n.where("n_nationkey % 2 = 0").drop("n_regionkey").withColumnRenamed("n_nationkey", "a"), n.where("n_nationkey % 2 = 1").drop("n_regionkey").withColumnRenamed("n_nationkey", "b")


@query(f"select a, b, round(area, 3) as area from {_PAIRS} where a % 2 = 0 and b % 2 = 1")
def overlay_intersection(spark, d):
    a, b = _two(spark, d)
    return apply("overlay_intersection", a, ref_gdf=b).select("a", "b", F.round(st_area(GEOM), 3).alias("area"))


def _cells(test: str) -> str:
    """Area of each even box whose 400-cells hold the test against the odd boxes."""
    return f"""with e as (select n_nationkey as a, gx, gy from {_N}, range(0, 31) s(gx), range(0, 31) t(gy) where n_nationkey % 2 = 0 and gx * 400 >= x0 and gx * 400 < x0 + 2400 and gy * 400 >= y0 and gy * 400 < y0 + 2400),
        o as (select distinct gx, gy from {_N}, range(0, 31) s(gx), range(0, 31) t(gy) where n_nationkey % 2 = 1 and gx * 400 >= x0 and gx * 400 < x0 + 2400 and gy * 400 >= y0 and gy * 400 < y0 + 2400)
        select a, cast(count(*) * 160000 as double) as area from e {test} join o using (gx, gy) group by 1"""


@query(_cells("semi"))
def clip(spark, d):
    a, b = _two(spark, d)
    return apply("clip", a, ref_gdf=b).select("a", F.round(st_area(GEOM), 3).alias("area"))


@query(_cells("anti"))
def erase(spark, d):
    a, b = _two(spark, d)
    return apply("erase", a, ref_gdf=b).select("a", F.round(st_area(GEOM), 3).alias("area"))


@query(f"""with c as (select n_nationkey as k, gx, gy from {_N}, range(0, 31) s(gx), range(0, 31) t(gy) where gx * 400 >= x0 and gx * 400 < x0 + 2400 and gy * 400 >= y0 and gy * 400 < y0 + 2400)
    select cast(sum(n * m) * 160000 as double) as both_area, cast(sum(case when m = 0 then n end) * 160000 as double) as left_area, cast(sum(case when n = 0 then m end) * 160000 as double) as right_area
    from (select gx, gy, count(*) filter (k % 2 = 0) as n, count(*) filter (k % 2 = 1) as m from c group by 1, 2)""")
def overlay_union(spark, d):
    a, b = _two(spark, d)
    out = apply("overlay_union", a, ref_gdf=b).withColumn("s", st_area(GEOM))
    pick = lambda t: F.round(F.sum(F.when(t, F.col("s"))), 3)
    return out.agg(pick(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both_area"), pick(F.col("b").isNull()).alias("left_area"), pick(F.col("a").isNull()).alias("right_area"))


@query()
def symmetric_difference(spark, d):
    a, b = _two(spark, d)
    return apply("symmetric_difference", a, ref_gdf=b).select("a", F.round(st_area(GEOM), 3).alias("area"))


# ---------------------------------------------------------------- single geometries


def _lines(spark, d):
    return network(spark, d).select(ROW, "p_partkey", "step", "w", GEOM)


@query(f"select s_suppkey, round(x, 6) as x, round(y, 6) as y, round(2 * 100 * sin(pi() / 32) * 32 / 2, 0) >= 0 as ok from {_S}")
def buffer(spark, d):
    b = apply("buffer", suppliers(spark, d).select(ROW, "s_suppkey", GEOM), distance=100.0)
    area = 0.5 * 32 * 100.0**2 * 0.19509032201612825  # sine of a 32nd of the circle
    return b.select("s_suppkey", F.round(st_x(GEOM), 6).alias("x"), F.round(st_y(GEOM), 6).alias("y"), (F.abs(st_area(GEOM) - area) < 1e-3).alias("ok"))


@query(f"select n_nationkey, x0 + 1200 as x, y0 + 1200 as y from {_N}")
def centroid(spark, d):
    c = apply("centroid", nations(spark, d))
    return c.select("n_nationkey", F.round(st_x(GEOM), 6).alias("x"), F.round(st_y(GEOM), 6).alias("y"))


@query("select n_nationkey, cast(5760000 as double) as area_m2, cast(9600 as double) as length_m from nation")
def area_length(spark, d):
    return apply("area_length", nations(spark, d)).select("n_nationkey", "area_m2", "length_m")


@query("select s_suppkey, round(x / 6378137.0 / pi() * 180, 8) as lon, round((2 * atan(exp(y / 6378137.0)) - pi() / 2) / pi() * 180, 8) as lat from " + _S)
def reproject(spark, d):
    r = apply("reproject", suppliers(spark, d).select(ROW, "s_suppkey", GEOM), target_crs="EPSG:4326")
    return r.select("s_suppkey", F.round(st_x(GEOM), 8).alias("lon"), F.round(st_y(GEOM), 8).alias("lat"))


def _shape_query(name: str, layer: Callable, params: dict, key: str):
    """A query that gives what a geometry operator leaves: kind's dimension, area and length by key."""

    def f(spark, d):
        out = apply(name, layer(spark, d), **params)
        g = [st_dim(GEOM).alias("dim"), F.round(st_area(GEOM), 4).alias("area"), F.round(st_length(GEOM), 4).alias("length")]
        return out.select(*([key] if key in out.columns else []), *g)

    QUERIES[name] = f


def _l_shapes(spark, d):
    """Three-point lines over neighbouring parts."""
    p = parts(spark, d).select("p_partkey", "x", "y", ROW)
    bend = shapes(lambda g, x, y: G.line([(x, y), (x + 300, y), (x + 300, y + 400), (x + 310, y + 405)]), "binary")
    return with_srid(p.withColumn(GEOM, bend(make_point("x", "y"), "x", "y")).drop("x", "y"), 3857)


def _multi(spark, d):
    return apply("singleparts_to_multipart", nations(spark, d).select(ROW, "n_regionkey", GEOM), by=["n_regionkey"], collect=True)


def _hollow(spark, d):
    n = nations(spark, d).select(ROW, "n_nationkey", GEOM)
    return with_srid(n.withColumn(GEOM, shapes(lambda g: G.difference(g, G.buffer(G.centroid(g), 500)), "binary")(GEOM)), 3857)


for _name, _layer, _params, _key in (
   
    ("convex_hull", customers, {"by_group": "c_nationkey"}, "c_nationkey"), ("concave_hull", suppliers, {"by_group": "s_nationkey"}, "s_nationkey"), ("alpha_shape", suppliers, {"alpha": 0.0002, "by_group": "s_nationkey"}, "s_nationkey"),
    ("oriented_bbox", _l_shapes, {}, "p_partkey"), ("min_bounding_circle", _l_shapes, {}, "p_partkey"), ("boundary", _hollow, {}, "n_nationkey"), ("make_valid", _hollow, {}, "n_nationkey"),
    ("offset_curve", _l_shapes, {"distance": 10.0}, "p_partkey"),
   
    ("ftth_coverage", suppliers, {"radius_m": 100}, "s_suppkey"), ("multipart_to_singleparts", _multi, {}, "n_regionkey"),
    ("force_geometry_type", _multi, {"target": "Polygon"}, "n_regionkey"), ("polygonize", _l_shapes, {}, ""), ("voronoi_polygons", suppliers, {}, ""), ("delaunay_triangulation", suppliers, {}, ""),
    ("network_snap_endpoints", network, {"tolerance": 0.5}, "p_partkey"), ("network_remove_pseudo_nodes", _l_shapes, {}, ""), ("network_node_lines", _l_shapes, {}, ""), ("network_extend_dangles", _l_shapes, {"tolerance": 5.0}, "p_partkey"),
    ("network_remove_duplicates", _l_shapes, {}, "p_partkey"), ("polygon_fix_gaps", nations, {}, "n_nationkey"), ("polygon_fix_overlaps", nations, {"rule": "first"}, "n_nationkey"),
):
    _shape_query(_name, _layer, _params, _key)

ORACLE_SQL["polygon_fix_gaps"] = "select n_nationkey, cast(2 as integer) as dim, cast(5760000 as double) as area, cast(9600 as double) as length from nation"
ORACLE_SQL["multipart_to_singleparts"] = ORACLE_SQL["force_geometry_type"] = "select n_regionkey, cast(2 as integer) as dim, cast(5760000 as double) as area, cast(9600 as double) as length from nation"


# ---------------------------------------------------------------- lines, vertex by vertex


def _vertices(df: DataFrame, *keys: str) -> DataFrame:
    """Of each shape: vertices, first and last one, sums of the coordinates, whether it has Z and M, and their sums."""

    def tell(g: G.Shape) -> list[float]:
        a = g.all_coords()
        z, m = a[:, 2].sum() if g.z else 0, a[:, 2 + g.z].sum() if g.m else 0
        return [len(a), *a[0, :2], *a[-1, :2], *a[:, :2].sum(0), g.z + 2 * g.m, z, m]

    names = ("n", "x0", "y0", "x1", "y1", "sx", "sy", "dims", "sz", "sm")
    told = df.select(*keys, shapes(tell, "array<double>")(GEOM).alias("_v"))
    return told.select(*keys, *[F.round(F.col("_v")[i], 6).alias(c) for i, c in enumerate(names)])


def _line_sql(points: str, more: str = "0 as dims, 0 as sz, 0 as sm", table: str = _P) -> str:
    """The same numbers from a list of (x, y) pairs as SQL."""
    return f"""with l as (select p_partkey, {points} as p from {table}), q as (select p_partkey, p, list_transform(p, lambda v: v[1]) as xs, list_transform(p, lambda v: v[2]) as ys from l),
        r as (select *, {more} from q)
        select p_partkey, cast(len(p) as double) as n, round(xs[1], 6) as x0, round(ys[1], 6) as y0, round(xs[len(xs)], 6) as x1, round(ys[len(ys)], 6) as y1, round(list_sum(xs), 6) as sx, round(list_sum(ys), 6) as sy,
               cast(dims as double) as dims, cast(sz as double) as sz, cast(sm as double) as sm from r"""


_BEND = "[[x, y], [x + 300, y], [x + 300, y + 400], [x + 310, y + 405]]"


def _line_query(name: str, sql: str, layer: Callable = _l_shapes, **params):
    QUERIES[name] = lambda spark, d: _vertices(apply(name, layer(spark, d), **params), "p_partkey")
    ORACLE_SQL[name] = sql


_line_query("swap_xy", _line_sql(f"list_transform({_BEND}, lambda v: [v[2], v[1]])"))
_line_query("reverse_lines", _line_sql(f"list_reverse({_BEND})"))
_line_query("add_z", _line_sql(_BEND, "1 as dims, 20 as sz, 0 as sm"), z=5.0)
_line_query("add_m", _line_sql(_BEND, "2 as dims, 0 as sz, 4 as sm"), m=1.0)
_line_query("drop_z", _line_sql(_BEND), lambda spark, d: apply("add_z", _l_shapes(spark, d), z=5.0))
_line_query("drop_m", _line_sql(_BEND, "1 as dims, 12 as sz, 0 as sm"), lambda spark, d: apply("add_m", apply("add_z", _l_shapes(spark, d), z=3.0), m=2.0))
# the third vertex is less than 20 from the line between its neighbours
_line_query("simplify", _line_sql("[[x, y], [x + 300, y], [x + 310, y + 405]]"), tolerance=20.0)
_line_query("snap_to_grid", _line_sql(f"list_filter(list_transform({_BEND}, lambda v: [round_even(v[1] / 50, 0) * 50, round_even(v[2] / 50, 0) * 50]), lambda v, i: i = 1 or v <> list_transform({_BEND}, lambda v: [round_even(v[1] / 50, 0) * 50, round_even(v[2] / 50, 0) * 50])[i - 1])"), grid_size=50.0)
_line_query("densify_vertices", _line_sql("list_concat(list_transform(range(0, 6), lambda k: [x + 50 * k, y]), list_transform(range(0, 8), lambda k: [x + 300, y + 50 * k]), [[x + 300, y + 400], [x + 310, y + 405]])"), max_distance=50.0)
_line_query("line_substring", _line_sql("[[x + (700 + sqrt(125)) / 4, y], [x + 300, y], [x + 300, y + (700 + sqrt(125)) * 3 / 4 - 300]]"), start_measure=0.25, end_measure=0.75)
# one round of corner cutting: a quarter and three quarters of each segment, the ends kept
_line_query("chaikin_smooth", _line_sql("[[x, y], [x + 75, y], [x + 225, y], [x + 300, y + 100], [x + 300, y + 300], [x + 302.5, y + 401.25], [x + 307.5, y + 403.75], [x + 310, y + 405]]"), iterations=1)


def _apart(spark, d):
    """Two lines that meet in an end of each, the second the wrong way round."""
    p = parts(spark, d).select("p_partkey", "x", "y", ROW)
    two = shapes(lambda g, x, y: G.collect([G.line([(x, y), (x + 300, y)]), G.line([(x + 310, y + 405), (x + 300, y + 400), (x + 300, y)])]), "binary")
    return with_srid(p.withColumn(GEOM, two(make_point("x", "y"), "x", "y")).drop("x", "y"), 3857)


@query("select p_partkey, 'LineString' as kind, cast(4 as double) as n, 4 * x + 910 as sx, 4 * y + 805 as sy from " + _P)
def line_merge(spark, d):
    out = apply("line_merge", _apart(spark, d))
    kind = shapes(lambda g: g.kind, "string")(GEOM).alias("kind")
    return _vertices(out.withColumn("kind", kind), "p_partkey", "kind").select("p_partkey", "kind", "n", "sx", "sy")


# translated by (10, 5), turned by 30 degrees about the box's middle, then doubled about the middle of the turned line's box
@query(f"""with o as (select * from (values (1, -155.0, -202.5), (2, 145.0, -202.5), (3, 145.0, 197.5), (4, 155.0, 202.5)) t(i, dx, dy)),
    t as (select i, dx * cos(pi() / 6) - dy * sin(pi() / 6) as u, dx * sin(pi() / 6) + dy * cos(pi() / 6) as v from o),
    k as (select (min(u) + max(u)) / 2 as ku, (min(v) + max(v)) / 2 as kv from t),
    w as (select i, ku + 2 * (u - ku) as u, kv + 2 * (v - kv) as v from t, k)
    select p_partkey, cast(4 as double) as n, round(x + 165 + (select u from w where i = 1), 6) as x0, round(y + 207.5 + (select v from w where i = 1), 6) as y0, round(x + 165 + (select u from w where i = 4), 6) as x1,
           round(y + 207.5 + (select v from w where i = 4), 6) as y1, round(4 * (x + 165) + (select sum(u) from w), 6) as sx, round(4 * (y + 207.5) + (select sum(v) from w), 6) as sy from {_P}""")
def affine_transform(spark, d):
    return _vertices(apply("affine_transform", _l_shapes(spark, d), translate=[10, 5], rotate=30, scale=2.0), "p_partkey").drop("dims", "sz", "sm")


@query("select n_nationkey, 2154 as srid from nation")
def assign_projection(spark, d):
    out = apply("assign_projection", nations(spark, d), crs="EPSG:2154")
    return out.select("n_nationkey", F.lit(srid_of(out)).alias("srid"))


@query(f"select n_nationkey, x0, y0, x0 + 2400 as x1, y0 + 2400 as y1 from {_N}")
def polygon_snap_borders(spark, d):
    """Boxes a few metres off the grid come onto it."""
    n = nations(spark, d)
    off = shapes(lambda g, k: g.map(lambda a: a + [[k % 4, -(k % 3)]]), "binary")
    out = apply("polygon_snap_borders", with_srid(n.withColumn(GEOM, off(GEOM, "n_nationkey")), 3857), grid_size=10.0)
    b = shapes(lambda g: list(g.bounds()), "array<double>")(GEOM)
    return out.select("n_nationkey", *[(b[i] + 0.0).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


@query(f"select n_nationkey, cast(0 as integer) as hole_index, x0 + 1000 as x0, y0 + 900 as y0, x0 + 1500 as x1, y0 + 1600 as y1 from {_N}")
def extract_holes(spark, d):
    n = nations(spark, d).select(ROW, "n_nationkey", GEOM)
    hollow = shapes(lambda g: G.Shape("Polygon", rings=[g.rings[0], G.box(g.bounds()[0] + 1000, g.bounds()[1] + 900, g.bounds()[0] + 1500, g.bounds()[1] + 1600).rings[0]]), "binary")
    out = apply("extract_holes", with_srid(n.withColumn(GEOM, hollow(GEOM)), 3857))
    b = shapes(lambda g: list(g.bounds()), "array<double>")(GEOM)
    return out.select("n_nationkey", "hole_index", *[b[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


@query("""with c as (select r, q, cast(q * 750 + r % 2 * 375 as double) as x, r * 500 * sqrt(3) + r % 2 * 250 * sqrt(3) as y from range(0, 15) a(r), range(0, 16) b(q))
    select cast(r as bigint) as "row", cast(q as bigint) as "col", round(x, 6) as x, round(y, 6) as y, round(375000 * sqrt(3), 3) as area from c""")
def hexgrid_create(spark, d):
    """Middles and areas of the hexagons over the nations, whose box is 10400 wide and high."""
    out = apply("hexgrid_create", nations(spark, d), cell_size=500.0, clip_to_extent=False)
    mid = shapes(lambda g: g.rings[0][:-1].mean(0).tolist(), "array<double>")(GEOM)
    return out.select("row", "col", F.round(mid[0], 6).alias("x"), F.round(mid[1], 6).alias("y"), F.round(st_area(GEOM), 3).alias("area"))


@query(f"select min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1, c_nationkey from {_C} group by c_nationkey")
def envelope(spark, d):
    out = apply("envelope", customers(spark, d), by_group=["c_nationkey"])
    b = shapes(lambda g: list(g.bounds()), "array<double>")(GEOM)
    return out.select("c_nationkey", b.alias("b")).select("c_nationkey", *[F.col("b")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@query("select n_nationkey, cast(i as integer) as vertex_index, cast(row_number() over (order by n_nationkey, i) - 1 as bigint) as global_index from nation, range(0, 5) t(i)")
def extract_vertices(spark, d):
    return apply("extract_vertices", nations(spark, d)).select("n_nationkey", "vertex_index", "global_index")


@query("select n_nationkey, cast(i as integer) as segment_index, cast(2400 as double) as length_m from nation, range(0, 4) t(i)")
def extract_segments(spark, d):
    return apply("extract_segments", nations(spark, d)).select("n_nationkey", "segment_index", "length_m")


@query('select cast(r as bigint) as "row", cast(c as bigint) as "col", cast(c * 800 as double) as x, cast(r * 800 as double) as y from range(0, 13) a(r), range(0, 13) b(c)')
def grid_create(spark, d):
    out = apply("grid_create", nations(spark, d), cell_size=800.0, clip_to_extent=False)
    b = shapes(lambda g: list(g.bounds()), "array<double>")(GEOM)
    return out.select("row", "col", b[0].alias("x"), b[1].alias("y"))


@query(f"""with g as (select min(x) - 800 as x0, min(y) - 800 as y0, ceil((max(x) - min(x) + 1600) / 400) as nc, ceil((max(y) - min(y) + 1600) / 400) as nr from {_S}),
    m as (select cast(r as bigint) as "row", cast(c as bigint) as "col", x0 + (c + 0.5) * 400 as mx, y0 + (r + 0.5) * 400 as my from g, range(0, 60) a(r), range(0, 60) b(c) where r < nr and c < nc)
    select "row", "col", round(coalesce(n, 0) / (select count(*) from supplier) / (pi() * 640000) * 1e9, 6) as density from m left join
    (select "row" as r2, "col" as c2, count(*) as n from m, {_S} s where (mx - s.x) ** 2 + (my - s.y) ** 2 < 640000 group by 1, 2) on r2 = "row" and c2 = "col" """)
def kde_heatmap(spark, d):
    out = apply("kde_heatmap", suppliers(spark, d), bandwidth=800.0, cell_size=400.0, kernel="tophat")
    return out.select("row", "col", F.round(F.col("density") * 1e9, 6).alias("density"))


# ---------------------------------------------------------------- classes


def _class_sql(edges: str) -> str:
    """Right-closed classes from a list of edges."""
    return f"""with b as (select list_sort(list_distinct({edges})) as e from orders) select o_orderkey, cast(case when o_totalprice < e[1] or o_totalprice > e[len(e)] then null
        else greatest(1, len(list_filter(e, lambda t: t < o_totalprice))) end as bigint) as class from orders, b"""


def _classify(spark, d, **p):
    return apply("classify", table(spark, d, "orders"), field="o_totalprice", **p).select("o_orderkey", "class")


@query(_class_sql("[quantile_cont(o_totalprice, 0.0), quantile_cont(o_totalprice, 0.2), quantile_cont(o_totalprice, 0.4), quantile_cont(o_totalprice, 0.6), quantile_cont(o_totalprice, 0.8), quantile_cont(o_totalprice, 1.0)]"))
def classify_quantile(spark, d):
    return _classify(spark, d)


@query(_class_sql("[min(o_totalprice), min(o_totalprice) + (max(o_totalprice) - min(o_totalprice)) * 1 / 4, min(o_totalprice) + (max(o_totalprice) - min(o_totalprice)) * 2 / 4, min(o_totalprice) + (max(o_totalprice) - min(o_totalprice)) * 3 / 4, max(o_totalprice)]"))
def classify_equal_interval(spark, d):
    return _classify(spark, d, method="equal_interval", bins=4)


@query(_class_sql("[least(min(o_totalprice), 50000), 50000, 100000, 200000, greatest(max(o_totalprice), 200000)]"))
def classify_manual(spark, d):
    return _classify(spark, d, method="manual", breaks=[50000, 100000, 200000])


@query()
def classify_jenks(spark, d):
    return _classify(spark, d, method="jenks")


@query()
def classify_pretty(spark, d):
    return _classify(spark, d, method="pretty")


@query()
def classify_std_dev(spark, d):
    return _classify(spark, d, method="std_dev")


@query("""with b as (select list_sort(list_distinct([quantile_cont(c_acctbal, 0.0), quantile_cont(c_acctbal, 0.25), quantile_cont(c_acctbal, 0.5), quantile_cont(c_acctbal, 0.75), quantile_cont(c_acctbal, 1.0)])) as e from customer)
    select cast(greatest(1, len(list_filter(e, lambda t: t < c_acctbal))) as bigint) as class, count(*) as n from customer, b group by 1""")
def choropleth(spark, d):
    c = table(spark, d, "customer")
    apply("choropleth", c, field="c_acctbal", bins=4)
    return legend(c, "c_acctbal", bins=4).select("class", "n")


@query("""with r as (select c_mktsegment, cast(row_number() over (order by count(*) desc, c_mktsegment) as bigint) as rk from customer group by 1)
    select c_custkey, least(rk, 4) as class from customer join r using (c_mktsegment)""")
def classify_categorical(spark, d):
    return apply("classify_categorical", table(spark, d, "customer"), field="c_mktsegment", max_categories=3).select("c_custkey", "class")


@query("select c_custkey, round((c_acctbal - min(c_acctbal) over ()) / (max(c_acctbal) over () - min(c_acctbal) over ()), 9) as v from customer")
def normalize_minmax(spark, d):
    return apply("normalize", table(spark, d, "customer"), field="c_acctbal", out_field="n").select("c_custkey", F.round("n", 9).alias("v"))


@query("select c_custkey, round((c_acctbal - avg(c_acctbal) over ()) / stddev_pop(c_acctbal) over (), 6) as v from customer")
def normalize_zscore(spark, d):
    return apply("normalize", table(spark, d, "customer"), field="c_acctbal", method="zscore", out_field="n").select("c_custkey", F.round("n", 6).alias("v"))


@query("select c_custkey, round((rank() over (order by c_nationkey) - 1 + (count(*) over (partition by c_nationkey) - 1) / 2.0) / (count(*) over () - 1), 9) as v from customer")
def normalize_rank(spark, d):
    return apply("normalize", table(spark, d, "customer"), field="c_nationkey", method="rank", out_field="n").select("c_custkey", F.round("n", 9).alias("v"))


@query("select c_custkey, cast([4.0, 8.0, 12.0, 16.0, 20.0][class] as double) as marker_size from (with b as (select list_sort(list_distinct([quantile_cont(c_acctbal, 0.0), quantile_cont(c_acctbal, 0.2), quantile_cont(c_acctbal, 0.4), quantile_cont(c_acctbal, 0.6), quantile_cont(c_acctbal, 0.8), quantile_cont(c_acctbal, 1.0)])) as e from customer) select c_custkey, greatest(1, len(list_filter(e, lambda t: t < c_acctbal))) as class from customer, b)")
def graduated_size(spark, d):
    return apply("graduated_size", table(spark, d, "customer"), field="c_acctbal").select("c_custkey", "marker_size")


@query("""with m1 as (select avg(o_totalprice) as m, count(*) as n from orders), h1 as (select avg(o_totalprice) as m, count(*) as n from orders, m1 where o_totalprice > m1.m)
    select o_orderkey, cast(case when h1.n / m1.n > 0.4 then case when o_totalprice <= m1.m then 1 else 2 end end as bigint) as class from orders, m1, h1""")
def head_tail_breaks(spark, d):
    return apply("head_tail_breaks", table(spark, d, "orders"), field="o_totalprice").select("o_orderkey", "class")


@query("""with b as (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer), t as (select [[68, 1, 84], [59, 82, 139], [33, 145, 140], [94, 201, 98], [253, 231, 37]] as p),
    u as (select c_custkey, (c_acctbal - lo) / (hi - lo) * 4 as v, p from customer, b, t), k as (select *, cast(least(floor(v), 3) as integer) as i from u)
    select c_custkey, '#' || array_to_string(list_transform([1, 2, 3], lambda c: printf('%02x', cast(round_even(p[i + 1][c] + (p[i + 2][c] - p[i + 1][c]) * (v - i), 0) as integer))), '') as color from k""")
def continuous_ramp(spark, d):
    return apply("continuous_ramp", table(spark, d, "customer"), field="c_acctbal", stops=5).select("c_custkey", "color")


def _thirds(c: str) -> str:
    return f"list_sort(list_distinct([{', '.join(f'quantile_cont({c}, {k}.0 / 3)' for k in range(4))}]))"


@query(f"""with b as (select {_thirds('c_acctbal')} as e, {_thirds('c_nationkey')} as f from customer),
    t as (select [['#e8e8e8', '#ace4e4', '#5ac8c8'], ['#dfb0d6', '#a5add3', '#5698b9'], ['#be64ac', '#8c62aa', '#3b4994']] as colors),
    k as (select c_custkey, greatest(1, len(list_filter(f, lambda t: t < c_nationkey))) as y, greatest(1, len(list_filter(e, lambda t: t < c_acctbal))) as x from customer, b)
    select c_custkey, y || '_' || x as bi_class, colors[y][x] as bi_color from k, t""")
def bivariate_choropleth(spark, d):
    return apply("bivariate_choropleth", table(spark, d, "customer"), field_x="c_acctbal", field_y="c_nationkey", grid=3, palette="PurpleGreen").select("c_custkey", "bi_class", "bi_color")


# ---------------------------------------------------------------- statistics


@query(f"""with recursive p as (select s_suppkey as k, x, y from {_S}), l as (select a.k as a, b.k as b from p a, p b where a.k <> b.k and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 810000),
    core as (select a as k from l group by 1 having count(*) + 1 >= 3), cl as (select l.a, l.b from l where a in (select k from core) and b in (select k from core)),
    r as (select k, k as root from core union select cl.b, r.root from r join cl on cl.a = r.k), g as (select k, min(root) as root from r group by 1),
    n as (select root, cast(row_number() over (order by root) - 1 as bigint) as c from (select distinct root from g)), gc as (select k, c from g join n using (root)),
    bd as (select l.a as k, min(c) as c from l join gc on gc.k = l.b where l.a not in (select k from core) group by 1)
    select k as s_suppkey, coalesce(gc.c, bd.c, -1) as cluster from p left join gc using (k) left join bd using (k)""")
def cluster_dbscan(spark, d):
    return apply("cluster_dbscan", suppliers(spark, d).select(ROW, "s_suppkey", GEOM), eps=900.0, min_samples=3).select("s_suppkey", "cluster")


@query()
def cluster_kmeans(spark, d):
    return apply("cluster_kmeans", customers(spark, d).select(ROW, "c_custkey", GEOM), k=5).select("c_custkey", "cluster")


@query()
def cluster_hdbscan(spark, d):
    return apply("cluster_hdbscan", suppliers(spark, d).select(ROW, "s_suppkey", GEOM), min_cluster_size=5).select("s_suppkey", "cluster")


@query(f"select a.s_suppkey, count(b.s_suppkey) as w_neighbors from {_S} a left join {_S} b on a.s_suppkey <> b.s_suppkey and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 1000000 group by 1")
def spatial_weights(spark, d):
    return apply("spatial_weights", suppliers(spark, d).select(ROW, "s_suppkey", GEOM), method="distance_band", threshold=1000.0).select("s_suppkey", "w_neighbors")


@query("select a.n_nationkey, count(b.n_nationkey) as w_neighbors from nation a left join nation b on a.n_nationkey <> b.n_nationkey and abs(a.n_nationkey % 5 - b.n_nationkey % 5) <= 1 and abs(a.n_nationkey // 5 - b.n_nationkey // 5) <= 1 group by 1")
def spatial_weights_queen(spark, d):
    return apply("spatial_weights", nations(spark, d)).select("n_nationkey", "w_neighbors")


_BAND = f"(select a.s_suppkey as a, b.s_suppkey as b, 1.0 / count(*) over (partition by a.s_suppkey) as w from {_S} a join {_S} b on a.s_suppkey <> b.s_suppkey and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 1000000)"


@query(f"""with m as (select avg(s_acctbal) as mean, var_pop(s_acctbal) * count(*) as ss, count(*) as n from supplier)
    select round(n / sum(w) * sum(w * (p.s_acctbal - mean) * (q.s_acctbal - mean)) / ss, 6) as morans_i, n from {_BAND} l join supplier p on p.s_suppkey = a join supplier q on q.s_suppkey = b, m group by n, ss""")
def morans_i(spark, d):
    return apply("morans_i", suppliers(spark, d), field="s_acctbal", method="distance_band", threshold=1000.0).select(F.round("morans_i", 6).alias("morans_i"), "n")


@query(f"""with m as (select avg(s_acctbal) as mean, stddev_pop(s_acctbal) as sd, cast(count(*) as double) as n from supplier), l as (select a, b from {_BAND} union all select s_suppkey, s_suppkey from supplier),
    g as (select a, sum(s_acctbal) as s, cast(count(*) as double) as w from l join supplier on s_suppkey = b group by 1)
    select a as s_suppkey, round((s - mean * w) / (sd * sqrt((n * w - w * w) / (n - 1))), 6) as gi_star from g, m""")
def getis_ord_g(spark, d):
    return apply("getis_ord_g", suppliers(spark, d), field="s_acctbal", method="distance_band", threshold=1000.0).select("s_suppkey", F.round("gi_star", 6).alias("gi_star"))


# ---------------------------------------------------------------- network

_COST = f"""arcs as (select u as a, v as b, w from {_E} union all select v, u, w from {_E})"""


@query(f"""with recursive {_COST}, c as (select 1 as node, cast(0 as double) as cost, 0 as hops union all
    select node, min(cost), any_value(hops) from (select arcs.b as node, c.cost + arcs.w as cost, c.hops + 1 as hops from c join arcs on arcs.a = c.node where c.cost + arcs.w <= 150) group by node having min(cost) <= 150 and any_value(hops) < 60)
    select cast(node as bigint) as node, min(cost) as cost from c group by 1""")
def network_costs(spark, d):
    from .operators.network import _arcs, edges_of, relax

    e = edges_of(network(spark, d), "w")
    p = junctions(spark, d).select(F.col("p_partkey").alias("node"), F.format_string("%.6f,%.6f", "x", "y").alias("key"))
    start = p.where("node = 1").select(F.lit(0).cast("long").alias("label"), F.col("key").alias("node"))
    best = relax(_arcs(e), start, 150.0).select(F.col("node").alias("key"), "cost")
    return best.join(p, "key").select("node", "cost")


@query()
def shortest_path(spark, d):
    return apply("shortest_path", network(spark, d), start_x=7919.0, start_y=4659.0, end_x=5831.0, end_y=9318.0, weight_col="w").select("p_partkey", "step", "path_order", "path_cost")


def _reach(starts: str, most: str) -> str:
    """Least cost of each node from each start that stays within `most`."""
    return f"""recursive {_COST}, c as (select p_partkey as label, p_partkey as node, cast(0 as double) as cost, 0 as hops from part where p_partkey in ({starts}) union all
        select label, node, min(cost), any_value(hops) from (select c.label, arcs.b as node, c.cost + arcs.w as cost, c.hops + 1 as hops from c join arcs on arcs.a = c.node where c.cost + arcs.w <= {most}) group by label, node having any_value(hops) < 60),
        best as (select label, node, min(cost) as cost from c group by all)"""


@query(f"with {_reach('1', '100')} select edge, min(cost) as cost, cast(budget as double) as cost_budget from {_E}, (values (50), (100)) b(budget), best where node in (u, v) and cost <= budget group by edge, budget")
def isochrone(spark, d):
    return apply("isochrone", network(spark, d), start_x=7919.0, start_y=4659.0, cost_budgets=[50, 100], weight_col="w", dissolve=False).select("edge", "cost", "cost_budget")


@query(f"""with recursive {_COST}, c(label, node, cost) using key (label, node) as (select p_partkey, p_partkey, cast(0 as double) from part where p_partkey in (1, 100, 200) union
        select s.label, s.node, s.cost from (select c.label, arcs.b as node, min(c.cost + arcs.w) as cost from c join arcs on arcs.a = c.node group by all) s
        left join recurring.c r on r.label = s.label and r.node = s.node where r.cost is null or s.cost < r.cost)
    select p_partkey, min_by(label, cost * 1e6 + label) as allocated_hub_id, min(cost) as allocation_cost, min(cost) is not null as allocated
    from part left join c on node = p_partkey group by p_partkey""")
def network_allocation(spark, d):
    hubs = junctions(spark, d).where("p_partkey in (1, 100, 200)").select(ROW, F.col("p_partkey").alias("id"), GEOM)
    return apply("network_allocation", junctions(spark, d).select(ROW, "p_partkey", GEOM), network_gdf=network(spark, d), hubs_gdf=hubs, weight_col="w").select("p_partkey", "allocated_hub_id", "allocation_cost", "allocated")


@query(f"select true as is_connected, cast(1 as bigint) as n_components, (select count(*) from part) as n_nodes, (select count(*) from {_E}) as n_edges")
def connectivity_check(spark, d):
    return apply("connectivity_check", network(spark, d)).select("is_connected", "n_components", "n_nodes", "n_edges")


@query(f"with {_reach('1, 5, 9', '400')} select label as origin_id, node as destination_id, cost from best where node in (1, 5, 9) and node <> label")
def od_matrix(spark, d):
    o = junctions(spark, d).where("p_partkey in (1, 5, 9)").select(ROW, F.col("p_partkey").alias("id"), GEOM)
    return apply("od_matrix", network(spark, d), ref_gdf=o, weight_col="w")


@query()
def mst(spark, d):
    return apply("mst", network(spark, d), weight_col="w").select("p_partkey", "step", "w")


@query("select n_nationkey from nation where n_nationkey % 2 = 0")
def polygon_remove_slivers(spark, d):
    n = nations(spark, d)
    thin = shapes(lambda g, k: g if k % 2 == 0 else G.box(0, 0, 5000, 1), "binary")
    return apply("polygon_remove_slivers", with_srid(n.withColumn(GEOM, thin(GEOM, "n_nationkey")), 3857), max_shape_index=10).select("n_nationkey")


# ---------------------------------------------------------------- quality


@query(f"select least(a, b) || '+' || greatest(a, b) as feature_id, 'overlap' as issue from {_PAIRS} where a < b")
def topology_check(spark, d):
    return apply("topology_check", nations(spark, d), id_col="n_nationkey").select("feature_id", "issue")


@query(f"select cast(c_custkey as varchar) as feature_id, cast(f as varchar) as duplicate_of from (select c_custkey, min(c_custkey) over (partition by x, y) as f from {_C}) where f <> c_custkey")
def duplicate_geometry(spark, d):
    return apply("duplicate_geometry", customers(spark, d), id_col="c_custkey").select("feature_id", "duplicate_of")


@query("""select cast(o_orderkey as varchar) as feature_id, 'o_totalprice' as "column", 'max' as rule from orders where o_totalprice > 300000
    union all select cast(o_orderkey as varchar), 'o_orderstatus', 'allowed' from orders where o_orderstatus not in ('F', 'O')
    union all select cast(o_orderkey as varchar), 'o_orderpriority', 'pattern' from orders where not regexp_full_match(o_orderpriority, '[1-3]-.*')""")
def attribute_validation(spark, d):
    schema = {"o_totalprice": {"type": "float", "nullable": False, "min": 0, "max": 300000}, "o_orderstatus": {"allowed": ["F", "O"]}, "o_orderpriority": {"pattern": "[1-3]-.*"}}
    return apply("attribute_validation", table(spark, d, "orders"), schema=schema, id_col="o_orderkey").select("feature_id", "column", "rule")


@query("""select 'p_size' as column_name, count(*) as total, count(*) filter (p_size > 25) as null_count, round(count(*) filter (p_size > 25) / count(*), 6) as null_ratio, false as is_complete from part
    union all select 'p_name', count(*), 0, 0, true from part""")
def completeness_check(spark, d):
    p = table(spark, d, "part").select(F.when(F.col("p_size") <= 25, F.col("p_size")).alias("p_size"), "p_name")
    return apply("completeness_check", p)


# ---------------------------------------------------------------- point clouds


def _cloud(spark, d):
    return customers(spark, d).withColumn("z", F.col("c_acctbal")).withColumn("classification", F.col("c_nationkey") % 4)


@query("select c_custkey from customer where c_nationkey % 4 in (1, 2) and c_nationkey % 4 not in (2)")
def pointcloud_filter_classification(spark, d):
    return apply("pointcloud_filter_classification", _cloud(spark, d), keep=[1, 2], drop=[2]).select("c_custkey")


@query(f"""select n_name, coalesce(n, 0) as z_count, lo as z_min, hi as z_max, hi - lo as z_height from nation left join (select n_nationkey as k, count(*) as n, min(c_acctbal) as lo, max(c_acctbal) as hi
    from {_N} join {_C} c on c.x > x0 and c.x < x0 + 2400 and c.y > y0 and c.y < y0 + 2400 group by 1) on k = n_nationkey""")
def pointcloud_zonal_height(spark, d):
    return apply("pointcloud_zonal_height", nations(spark, d), ref_gdf=_cloud(spark, d), stats=["count", "min", "max"]).select("n_name", "z_count", "z_min", "z_max", "z_height")


@query(f"""with m as (select min(x) as x0, min(y) as y0 from {_C}) select cast(floor((y - y0) / 1000) as bigint) as "row", cast(floor((x - x0) / 1000) as bigint) as "col", min(c_acctbal) as z_min, count(*) as z_count,
    round(quantile_cont(c_acctbal, 0.9), 6) as z_p90 from {_C}, m group by 1, 2""")
def pointcloud_grid_summary(spark, d):
    return apply("pointcloud_grid_summary", _cloud(spark, d), cell_size=1000.0, stats=["min", "count", "p90"]).select("row", "col", "z_min", "z_count", F.round("z_p90", 6).alias("z_p90"))


# ---------------------------------------------------------------- SQL, pipelines, rules, change stream


@query("select c_mktsegment, count(*) as n from customer where c_nationkey = 3 group by 1")
def postgis_sql(spark, d):
    return apply("postgis_sql", table(spark, d, "customer"), sql="select c_mktsegment, count(*) as n from {input_table} where c_nationkey = {key} group by 1", params={"key": 3})


@query("select r_regionkey, r_name from region where r_name is not null and r_regionkey = 1")
def osm_import(spark, d):
    return apply("osm_import", table(spark, d, "region"), tag_filter={"r_name": "*", "r_regionkey": 1, "unknown": "x"})


@query("select 'report' as title from (select 1)")
def report_build(spark, d):
    out = apply("report_build", table(spark, d, "region"), title="report")
    return out.select(F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))


@query("select o_orderkey, 'limit' as rule from orders where not (o_totalprice / 1000 <= 250)")
def rule_failures(spark, d):
    o = with_srid(table(spark, d, "orders").withColumn(ROW, F.col("o_orderkey")), 3857)
    return rules.failures(o, [{"name": "limit", "rule": "o_totalprice / 1000 <= 250"}]).select(F.col(ROW).alias("o_orderkey"), "rule")


@query("""with a as (select * from orders where o_orderkey % 10 <> 3), b as (select o_orderkey, o_custkey, o_orderstatus, case when o_orderkey % 17 = 0 then o_totalprice * 2 else o_totalprice end as o_totalprice, o_orderdate, o_orderpriority from orders where o_orderkey % 10 <> 4)
    select case when a.o_orderkey is null then 'INSERT' when b.o_orderkey is null then 'DELETE' else 'UPDATE' end as operation, count(*) as n from a full join b using (o_orderkey) where a.o_orderkey is null or b.o_orderkey is null or a.o_totalprice <> b.o_totalprice group by 1""")
def snapshot_diff(spark, d):
    o = table(spark, d, "orders")
    new = o.where("o_orderkey % 10 <> 4").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 17 == 0, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice")))
    return S.snapshot_diff(o.where("o_orderkey % 10 <> 3"), new, key="o_orderkey").groupBy("operation").agg(F.count(F.lit(1)).alias("n"))


@query("select event_id, case when inside then 'ENTER' else 'EXIT' end as transition from (select event_id, coalesce(value > 50, false) as inside, lag(coalesce(value > 50, false)) over (partition by user_id order by ts, event_id) as was from events) where (inside and not coalesce(was, false)) or (not inside and was)")
def enter_exit(spark, d):
    return S.transitions(table(spark, d, "events"), "user_id", "ts", F.col("value") > 50, "event_id").select("event_id", "transition")


@query("select event_id, t as trigger_id from (select event_id, 'hot' as t from events where value > 90 and event_type in ('click', 'view') union all select event_id, 'none' from events where event_type <> 'click' and value <= 5)")
def trigger_fire(spark, d):
    e = table(spark, d, "events")
    ts = [S.Trigger("hot", predicate="value > 90 AND event_type IN ['click', 'view']"), S.Trigger("none", predicate="NOT event_type == 'click' AND value <= 5")]
    return S.fire(e, ts).select("event_id", "trigger_id")


@query("select time_bucket(interval 1 day, ts) as window_start, event_type, count(*) as n from events group by 1, 2")
def window_counts(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.windowed(e, "ts", "1 day", by=["event_type"]).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("""with s as (select user_id, ts, case when ts - lag(ts) over w < interval 6 hours then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
    g as (select user_id, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from s) select user_id, count(*) as n from g group by user_id, k""")
def session_counts(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.sessions(e, "ts", "6 hours", ["user_id"]).select("user_id", "n")


# ---------------------------------------------------------------- files made from numbers, then read


def _folder(spark) -> str:
    import uuid

    from .operators.graph import shared_folder

    return f"{shared_folder(spark)}/lodestrata/files-{uuid.uuid4().hex}"


def _raster(spark, shift: int = 0, x0: float = 0.0) -> str:
    """Four bands of 104 x 104 pixels of 100 m: (row * 31 + col * 17 + band + shift) % 97 + 1."""
    import numpy as np

    from .operators.raster import _store
    from .sources.geotiff import Raster

    i, j = np.mgrid[0:104, 0:104]
    data = np.stack([(i * 31 + j * 17 + b + shift * (i < 20)) % 97 + 1 for b in range(1, 5)]).astype(np.float32)
    path = _folder(spark) + ".tif"
    _store(spark, path, Raster(data, x0, 10400.0, 100.0, 100.0, 3857, -9999.0))
    return path


_PIXELS = "(select i, j, (i * 31 + j * 17 + 1) % 97 + 1 as v, (i * 31 + j * 17 + 3) % 97 + 1 as red, (i * 31 + j * 17 + 4) % 97 + 1 as nir, (i * 31 + j * 17 + 1 + 5 * cast(i < 20 as int)) % 97 + 1 as v5, j * 100 + 50 as x, 10400 - i * 100 - 50 as y from range(0, 104) a(i), range(0, 104) b(j))"


@query(f"select n_nationkey, cast(min(v) as double) as rs_min, cast(max(v) as double) as rs_max, round(avg(v), 6) as rs_mean, round(stddev_pop(v), 6) as rs_std, count(*) as rs_count from {_N} n, {_PIXELS} p where x between x0 and x0 + 2400 and y between y0 and y0 + 2400 group by 1")
def zonal_stats(spark, d):
    out = apply("zonal_stats", nations(spark, d), raster_path=_raster(spark))
    return out.select("n_nationkey", "rs_min", "rs_max", F.round("rs_mean", 6).alias("rs_mean"), F.round("rs_std", 6).alias("rs_std"), "rs_count")


@query(f"select round(min(n), 5) as ndvi_min, round(max(n), 5) as ndvi_max, round(avg(n), 5) as ndvi_mean from (select (nir - red) / (nir + red) as n from {_PIXELS})")
def ndvi(spark, d):
    return apply("ndvi", table(spark, d, "region"), raster_path=_raster(spark), output_path=_folder(spark) + ".tif").select(*[F.round(c, 5).alias(c) for c in ("ndvi_min", "ndvi_max", "ndvi_mean")])


def _bounds(out: DataFrame) -> DataFrame:
    b = shapes(lambda g: [round(v, 3) for v in g.bounds()], "array<double>")(GEOM)
    return out.select(*[b[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@query(f"select cast(min(x0) as double) as x0, cast(min(y0) as double) as y0, cast(max(x0) + 2400 as double) as x1, cast(max(y0) + 2400 as double) as y1 from {_N} where n_regionkey = 1")
def raster_clip(spark, d):
    return _bounds(apply("raster_clip", nations(spark, d).where("n_regionkey = 1"), raster_path=_raster(spark), output_path=_folder(spark) + ".tif"))


@query("select cast(0 as double) as x0, cast(0 as double) as y0, cast(15600 as double) as x1, cast(10400 as double) as y1")
def raster_merge(spark, d):
    return _bounds(apply("raster_merge", table(spark, d, "region"), raster_paths=[_raster(spark), _raster(spark, 0, 5200.0)], output_path=_folder(spark) + ".tif", method="max"))


@query()
def raster_reproject(spark, d):
    return apply("raster_reproject", table(spark, d, "region"), raster_path=_raster(spark), output_path=_folder(spark) + ".tif", resampling="bilinear").select("target_crs")


@query(f"select cast(sum(cast(abs(v5 - v) > 2 as int)) as bigint) as pixels from {_PIXELS}")
def change_detection(spark, d):
    out = apply("change_detection", table(spark, d, "region"), raster_before=_raster(spark), raster_after=_raster(spark, 5), threshold=2.0)
    return out.agg(F.sum("n_pixels").alias("pixels"))


@query("select cast(i % 5 as integer) as classification, count(*) as n, cast(max(i) as double) / 10 as z from range(0, 1000) t(i) where i % 5 in (1, 2) group by 1")
def pointcloud_load_las(spark, d):
    import struct

    path = _folder(spark) + ".las"
    head = bytearray(227)
    head[0:4], head[24:26], head[104] = b"LASF", b"\x01\x02", 0
    struct.pack_into("<H", head, 94, 227)
    struct.pack_into("<II", head, 96, 227, 0)
    struct.pack_into("<HI", head, 105, 20, 1000)
    struct.pack_into("<6d", head, 131, 0.1, 0.1, 0.1, 0, 0, 0)
    body = b"".join(struct.pack("<3iHBBbBH", i, 2 * i, i, i % 9, 9, i % 5, 0, 0, 0) for i in range(1000))
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(bytes(head) + body))
    out.close()
    las = apply("pointcloud_load_las", table(spark, d, "region"), path=path, classifications=[1, 2])
    return las.groupBy("classification").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("z"), 6).alias("z"))


@query("select 'i' || n_nationkey as id, 'c' || n_regionkey as collection from nation where n_regionkey in (1, 2) and n_nationkey < 20")
def stac_search(spark, d):
    path = _folder(spark)
    items = table(spark, d, "nation").select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.concat(F.lit("i"), "n_nationkey").alias("id"), F.concat(F.lit("c"), "n_regionkey").alias("collection"), F.struct(F.format_string("2026-01-%02dT00:00:00Z", F.col("n_nationkey") + 1).alias("datetime")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(F.col("n_nationkey").cast("double"), F.lit(1.0)).alias("coordinates")).alias("geometry"))).alias("value"))
    items.write.text(path)
    return apply("stac_search", table(spark, d, "region"), catalog_url=path, collections=["c1", "c2"], bbox=[-1, 0, 50, 2], datetime_range="2026-01-01T00:00:00Z/2026-01-20T12:00:00Z").select("id", "collection")
