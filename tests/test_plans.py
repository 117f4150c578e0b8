"""Languages, pipelines, manifests, rules, sources and the change stream."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import expressions as E
from lodestrata.functions import geometry as G
from lodestrata.operators.layer import GEOM, ROW, st_area, st_x, with_srid
from lodestrata.plans import pipeline, rules
from lodestrata.sources import vector
from lodestrata.streaming import changes as S


@pytest.fixture(scope="module")
def shops(spark):
    rows = [(1, "a", 10, "x"), (2, "b", 20, "x"), (3, "c", None, "y"), (4, None, 40, "y")]
    return spark.createDataFrame(rows, "id long, name string, pop long, grp string")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_filters(shops):
    def f(t):
        got = ids(shops.where(E.filter_column(shops, t)))
        assert ids(shops.where(E.where_column(shops, t))) == got
        return got

    assert f("pop > 10") == [2, 4]
    assert f("10 <= pop < 40 and grp == 'x'") == [1, 2]
    assert f("name in ['a', 'c'] or pop == 40") == [1, 3, 4]
    assert f("not pop > 10") == [1, 3]
    assert f("name not in ['a']") == [2, 3, 4]
    for bad in ("`pop` > 1", "__class__ == 1", "pop >", "open('x')", "zzz > 1"):
        with pytest.raises(E.ExpressionError):
            E.filter_column(shops, bad)


def test_trigger_language(spark):
    df = spark.createDataFrame([(1, {"s": "a", "n": "5"}, {"s": "b"}), (2, {"s": "a"}, {"s": "a"})], "id long, old_values map<string,string>, new_values map<string,string>")
    f = lambda t: ids(df.where(E.trigger_column(t, S._path(df))))
    assert f("old.s != new.s") == [1]
    assert f("old.n IS NOT NULL AND NOT (new.s == 'a')") == [1]
    assert f("old.n NOT IN ['7']") == [1, 2]
    assert f("new.s IN ['a', 'c'] OR id >= 5") == [2]
    with pytest.raises(E.ExpressionError):
        E.trigger_column("(" * 40 + "id == 1" + ")" * 40, S._path(df))


def test_predicates_and_chains(shops):
    now = dt.datetime(2026, 1, 10)
    p = lambda t: ids(shops.where(E.predicate_column(shops, t, now=now)))
    assert p({"and": [{"attr": "grp", "op": "eq", "value": "x"}, {"not": {"attr": "pop", "op": "gt", "value": 15}}]}) == [1]
    assert p({"or": [{"attr": "name", "op": "like", "value": "A%"}, {"attr": "zzz", "op": "is_null"}]}) == [1, 2, 3, 4]
    assert p({"attr": "pop", "op": "neq", "value": 10}) == [2, 4]
    chain = [{"name": "p", "type": "attribute", "expression": "pop > 10"}, {"name": "g", "type": "spatial", "expression": "grp == 'y'"}]
    c = lambda **k: ids(shops.where(E.chain_column(shops, chain, **k)))
    assert (c(), c(strategy="priority_or"), c(strategy="replace"), c(strategy="custom", custom="p AND NOT g")) == ([4], [2, 3, 4], [3, 4], [2])
    assert (E.seconds("15m"), E.seconds("2 h"), E.seconds(3)) == (900, 7200, 3)


def test_pipelines(shops):
    v1 = [{"capability": "top_n", "config": {"n": 1, "by": "pop", "order": 2}}, {"capability": "filter", "config": {"expression": "grp == 'x'", "order": 1}}, {"capability": "nothing", "enabled": False}]
    assert ids(pipeline.run(v1, shops)) == [2]
    v2 = {
        "steps": [
            {"id": "big", "capability": "filter", "params": {"expression": "pop >= $least"}},
            {"id": "x", "type": "branch", "condition": {"field": "grp", "op": "eq", "value": "x"}, "input": "big"},
            {"id": "y", "type": "branch", "condition": {"field": "grp", "op": "eq", "value": "y"}, "input": "big"},
            {"id": "both", "type": "aggregate", "input": ["y", "x"]},
            {"id": "skip", "capability": "top_n", "params": {"n": 0}, "when": {"attr": "pop", "op": "gt", "value": 1000}},
        ]
    }
    v2["steps"][0]["params"]["expression"] = "pop >= 20"
    assert ids(pipeline.run(json.dumps(v2), shops)) == [2, 4]
    loop = {"steps": [{"id": "l", "type": "loop", "items": ["x", "y"], "variable": "g", "body": [{"id": "n", "capability": "add_field", "params": {"fields": {"tag": "$g"}}}]}]}
    assert pipeline.run(loop, shops).groupBy("tag").count().count() == 2
    assert pipeline.validate(v2) == []
    assert pipeline.validate([{"capability": "centroid", "config": {"zzz": 1}}])
    assert pipeline.validate({"steps": [{"id": "a", "capability": "centroid", "input": "b"}, {"id": "b", "capability": "centroid", "input": "a"}]}) == ["a depends on itself"]
    assert "Scan" in "".join(pipeline.explain(v1, shops).values())
    assert [s["status"] for s in pipeline.scenarios([v1, [{"capability": "nothing"}], v1], shops)] == ["ok", "failed"]


def test_plans_reach_the_scan(spark, shops, tmp_path):
    path = str(tmp_path / "shops")
    shops.write.parquet(path)
    steps = {"steps": [{"capability": "filter", "params": {"expression": "pop > 10 and grp in ['x', 'y'] and not name == 'b'"}}, {"capability": "select_columns", "params": {"fields": ["id"]}}]}
    plan = pipeline.explain(steps, spark.read.parquet(path))["step1"]
    assert "GreaterThan(pop,10)" in plan and "In(grp" in plan and "ReadSchema: struct<id:bigint,name:string,pop:bigint,grp:string>" in plan
    assert ids(pipeline.run(steps, spark.read.parquet(path))) == [4]


def test_spatial_joins_compare_boxes_first(spark):
    from lodestrata.operators.layer import pairs

    a = squares(spark, (0, 0, 2, 2), (5, 5, 6, 6))
    plan = pairs(a, a, size=10.0)._jdf.queryExecution().toString()
    assert "xmin" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_manifest(spark, shops, tmp_path):
    m = {"models": {"big": {"from": "shops", "transform": [{"capability": "filter", "params": {"expression": "pop > 10"}}], "materialize": "table", "assert": [{"type": "not_null", "column": "pop"}, {"type": "unique", "column": "id"}, {"type": "expect_rows", "min": 1}]}, "named": {"from": "big", "with": "shops", "transform": [{"capability": "attribute_join", "params": {"left_on": "id", "columns": ["name"]}}]}}}
    out = pipeline.run_manifest(spark, m, {"shops": shops}, str(tmp_path))
    assert ids(out["named"]) == [2, 4] and spark.table("named").count() == 2
    m["models"]["big"]["assert"] = [{"type": "not_null", "column": "name"}]
    with pytest.raises(AssertionError):
        pipeline.run_manifest(spark, m, {"shops": shops}, str(tmp_path))
    inc = {"models": {"i": {"from": "shops", "materialize": "incremental", "key": "id"}}}
    pipeline.run_manifest(spark, inc, {"shops": shops.where("id < 3")}, str(tmp_path))
    assert ids(pipeline.run_manifest(spark, inc, {"shops": shops}, str(tmp_path))["i"]) == [1, 2, 3, 4]


def squares(spark, *boxes):
    return with_srid(spark.createDataFrame([(i, i, bytearray(G.to_wkb(G.box(*b)))) for i, b in enumerate(boxes)], f"{ROW} long, id long, {GEOM} binary"), 2154)


def test_rules(spark):
    df = squares(spark, (0, 0, 2, 2), (1, 1, 5, 5), (20, 20, 21, 21))
    zone = squares(spark, (0, 0, 10, 10))
    r = [{"name": "small", "rule": "geom_area_m2() < 10"}, {"name": "inside", "rule": "geom_within(layer='zone')"}, {"name": "alone", "rule": "not geom_overlaps_any(layer='me', exclude_self=True)"}, {"name": "null", "rule": "id / 0 > None"}]
    for x in r:
        x["rule"] = x["rule"].replace("'zone'", "zone").replace("'me'", "me")
    got = sorted((x.rule, x[ROW]) for x in rules.failures(df, r[:3], {"zone": zone, "me": df}).collect())
    assert got == [("alone", 0), ("alone", 1), ("inside", 2), ("small", 1)]
    assert {x.id: x.validation for x in rules.tagged(df, r[:1]).collect()}[1] == ["small"]
    with pytest.raises(E.ExpressionError):
        rules.failures(df, [{"rule": "id == 'a'"}])


def test_vector_files(spark, tmp_path):
    df = with_srid(spark.createDataFrame([(1, "a", bytearray(G.to_wkb(G.point(2, 48)))), (2, None, None)], f"id long, name string, {GEOM} binary"), 4326)
    for kind in ("geojson", "parquet", "csv"):
        path = str(tmp_path / f"x.{kind}")
        vector.write_vector(df, path)
        back = vector.read_vector(spark, path)
        assert sorted((r.id, r.name) for r in back.collect()) == [(1, "a"), (2, None)]
        assert back.where("id = 1").select(st_x(GEOM)).first()[0] == 2
    assert vector.read_vector(spark, str(tmp_path / "x.parquet"), box=(0, 0, 1, 1)).count() == 0
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"k": i}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}} for i in range(3)]}))
    got = vector.read_vector(spark, str(tmp_path / "c.geojson"))
    assert got.count() == 3 and got.agg(F.sum(st_area(GEOM))).first()[0] == 1.5


def test_geopackage(spark, tmp_path):
    import sqlite3
    import struct

    db = sqlite3.connect(tmp_path / "a.gpkg")
    db.executescript("create table gpkg_contents(table_name text, data_type text); create table gpkg_geometry_columns(table_name text, column_name text, srs_id int); create table p(fid integer primary key, name text, geom blob); insert into gpkg_contents values('p', 'features'); insert into gpkg_geometry_columns values('p', 'geom', 2154);")
    db.execute("insert into p values(1, 'x', ?)", (b"GP\0\1" + struct.pack("<i", 2154) + G.to_wkb(G.point(3, 4)),))
    db.commit()
    row = vector.read_vector(spark, str(tmp_path / "a.gpkg")).withColumn("px", st_x(GEOM)).first()
    assert (row.fid, row["name"], row.px) == (1, "x", 3.0)


def test_snapshots(spark):
    a = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "name string, category long")
    b = spark.createDataFrame([("A", 1), ("B", 5), ("D", 4)], "name string, category long")
    ops = lambda d: sorted((r.operation, r.name) for r in d.collect())
    assert ops(S.snapshot_diff(a, b)) == [("DELETE", "B"), ("DELETE", "C"), ("INSERT", "B"), ("INSERT", "D")]
    assert ops(S.snapshot_diff(a, b, key="name")) == [("DELETE", "C"), ("INSERT", "D"), ("UPDATE", "B")]
    assert S.snapshot_diff(a, a).count() == 0
    assert S.snapshot_diff(a.limit(0), a).count() == 3


def changes(spark, rows):
    t = lambda i: dt.datetime(2026, 1, 1, 0, i)
    data = [("s", "parcels", f, op, {"v": "1"}, new, None, None, moved, t(i)) for i, (f, op, new, moved) in enumerate(rows)]
    return spark.createDataFrame(data, S.CHANGE)


def test_triggers(spark):
    c = S.granular(changes(spark, [("1", "INSERT", {"v": "5"}, True), ("2", "UPDATE", {"v": "1"}, False), ("2", "UPDATE", {"v": "9"}, True), ("3", "DELETE", None, False)]))
    assert [r.operation for r in c.orderBy("recorded_at").collect()] == ["INSERT", "UPDATE_ATTR", "UPDATE_GEOM", "DELETE"]
    fired = lambda *ts, **k: sorted((r.trigger_id, r.feature_id) for r in S.fire(c, list(ts), **k).collect())
    assert fired(S.Trigger("u", operations=("UPDATE",))) == [("u", "2"), ("u", "2")]
    assert fired(S.Trigger("v", predicate="new.v != old.v AND new.v IS NOT NULL")) == [("v", "1"), ("v", "2")]
    assert fired(S.Trigger("t", table="other")) == []
    two = S.Trigger("c", kind="composite", config={"mode": "sequence", "parts": [S.Trigger("a", operations=("UPDATE_ATTR",)), S.Trigger("b", operations=("UPDATE_GEOM",))]})
    assert fired(two) == [("c", "2")]
    df = squares(spark, (0, 0, 2, 2), (1, 1, 3, 3), (9, 9, 10, 10))
    topo = S.Trigger("o", kind="topology", config={"rule": "no_overlap", "layer": "l"})
    assert fired(topo, layers={"l": df}) == [("o", "1")]
    far = S.Trigger("d", kind="spatial_constraint", config={"rule": "min_distance", "distance": 5, "layer": "l"})
    assert fired(far, layers={"l": df}) == [("d", "1")]
    limit = S.Trigger("n", kind="threshold", table=None, config={"layer": "l", "metric": "feature_count", "op": "gte", "value": 3})
    assert len(fired(limit, layers={"l": df})) == 4
    with pytest.raises(RuntimeError):
        S.cascade(c, [S.Trigger("again")], lambda f: f.drop("trigger_id", "actions", "depth"))
    bulk = S.bulk_summary(c, 2).first()
    assert (bulk.n_changes, bulk.n_update) == (4, 2)


def test_layer_updates(spark, shops):
    hit = spark.createDataFrame([("2",)], "feature_id string")
    assert {r.id: r.grp for r in S.set_field(shops, hit, "grp", "z").collect()}[2] == "z"
    t = spark.createDataFrame([("x",), ("z",)], "grp string")
    assert {r.grp: r.n for r in S.update_aggregate(t, shops, "grp", "n", "SUM", "pop").collect()} == {"x": 30, "z": 0}
    zones, pts = squares(spark, (0, 0, 4, 4), (10, 10, 12, 12)), squares(spark, (1, 1, 2, 2), (3, 3, 3.5, 3.5))
    out = S.before_change(pts, [{"op": "st_area", "target": "a"}, {"op": "st_within", "target": "zone", "layer": "z"}, {"op": "st_nearest", "target": "near", "layer": "z"}], {"z": zones})
    assert sorted((r.a, r.zone, r.near) for r in out.collect()) == [(0.25, 0, 0), (1.0, 0, 0)]
    got = S.after_change(zones, pts, pts, "n", "count", "contains")
    assert sorted((r.id, r.n) for r in got.collect()) == [(0, 2), (1, None)]


def test_enter_and_exit(spark, tmp_path):
    t = lambda i: dt.datetime(2026, 1, 1, 0, i)
    rows = [("a", 0, 1), ("a", 1, 9), ("a", 2, 9), ("a", 3, 1), ("b", 0, 9), ("c", 0, 1)]
    df = spark.createDataFrame([(o, t(i), v) for o, i, v in rows], "o string, ts timestamp, v long")
    batch = S.transitions(df, "o", "ts", F.col("v") > 5)
    want = [("a", t(1), "ENTER"), ("a", t(3), "EXIT"), ("b", t(0), "ENTER")]
    assert sorted((r.o, r.ts, r.transition) for r in batch.collect()) == want
    src = str(tmp_path / "in")
    for i in range(4):
        df.where(F.minute("ts") == i).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = S.transitions_stream(stream, "o", "ts", F.col("v") > 5).writeStream.format("memory").queryName("moves").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.object, r.time, r.transition) for r in spark.table("moves").collect()) == want


def test_streams(spark, tmp_path):
    c = changes(spark, [("1", "INSERT", {"v": "5"}, True), ("2", "UPDATE", {"v": "1"}, False)])
    src = str(tmp_path / "log")
    c.write.parquet(src)
    q = S.watch(S.read_changes(spark, src), [S.Trigger("all"), S.Trigger("ins", operations=("INSERT",))], str(tmp_path / "out"), str(tmp_path / "cp"), least_bulk=1)
    q.awaitTermination(120)
    assert sorted(r.trigger_id for r in spark.read.parquet(str(tmp_path / "out/fired")).collect()) == ["all", "all", "ins"]
    w = S.windowed(S.read_changes(spark, src), "recorded_at", "1 minute", late="5 minutes", by=["operation"])
    q = w.writeStream.format("memory").queryName("wins").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("wins").count() == 2
