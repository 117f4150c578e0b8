"""Operators on small layers: the expectations that the survey lists, empty layers, nulls and unknown parameters."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import expressions as E
from lodestrata.functions import geometry as G
from lodestrata.operators import OPERATORS, NotSupported, apply
from lodestrata.operators.layer import GEOM, ROW, srid_of, st_area, st_length, with_srid


def layer(spark, rows, schema, shapes, srid=3857):
    data = [(i, *r, None if s is None else bytearray(G.to_wkb(s))) for i, (r, s) in enumerate(zip(rows, shapes, strict=True))]
    return with_srid(spark.createDataFrame(data, f"{ROW} long, {schema}, {GEOM} binary"), srid)


@pytest.fixture(scope="module")
def cities(spark):
    rows = [("75056", "Paris", 2148000, 3), ("13055", "Marseille", 870000, 2), ("69123", "Lyon", 522000, 1), ("75056", "Paris (dup)", 2140000, 1), ("13055", "Marseille (older)", 860000, 1)]
    return layer(spark, rows, "code string, name string, population long, updated long", [G.point(i, i) for i in range(5)])


@pytest.fixture(scope="module")
def lattice(spark):
    """3 x 3 unit squares."""
    return layer(spark, [(i, 9.0 if i == 4 else 1.0) for i in range(9)], "id long, value double", [G.box(i % 3, i // 3, i % 3 + 1, i // 3 + 1) for i in range(9)])


@pytest.fixture(scope="module")
def lines(spark):
    """Seven unit edges of a 3 x 2 grid of nodes."""
    e = [((0, 0), (1, 0)), ((1, 0), (2, 0)), ((0, 1), (1, 1)), ((1, 1), (2, 1)), ((0, 0), (0, 1)), ((1, 0), (1, 1)), ((2, 0), (2, 1))]
    return layer(spark, [(i,) for i in range(7)], "id long", [G.line(x) for x in e])


def vals(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_registry(cities):
    assert len(OPERATORS) == 127
    with pytest.raises(TypeError):
        apply("centroid", cities, nonsense=1)
    with pytest.raises(KeyError):
        apply("nothing", cities)


def test_selection(cities):
    one = apply("deduplicate", cities, keys=["code"], order_by=["updated"], ascending=False)
    assert vals(one, "code", "population") == [("13055", 870000), ("69123", 522000), ("75056", 2148000)]
    assert apply("random_sample", cities, fraction=0.4, seed=1).count() == 2
    assert apply("random_sample", cities, n=50).count() == 5
    assert apply("random_sample", cities, n=8, replace=True, seed=3).count() == 8
    assert vals(apply("random_sample", cities, n=2, seed=5), "name") == vals(apply("random_sample", cities, n=2, seed=5), "name")
    assert [r.population for r in apply("top_n", cities, n=2, by="population").collect()] == [2148000, 2140000]
    assert [r[ROW] for r in apply("top_n", cities, n=2).collect()] == [0, 1]
    assert [r.population for r in apply("sort", cities, by="population").collect()] == sorted(r.population for r in cities.collect())


def test_projection(cities):
    assert apply("select_columns", cities, fields=["name"]).columns == [ROW, "name", GEOM]
    for bad in (lambda: apply("drop_field", cities, fields=[GEOM]), lambda: apply("rename_field", cities, mapping={"name": "code"}), lambda: apply("add_field", cities, fields={"a-b": 1})):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        apply("drop_field", cities, fields=["zzz"], ignore_missing=False)
    out = apply("calculate", cities, expressions={"d": "population / (updated - 1)", "s": "name + '!'", "k": "1 if updated > 1 else 0"})
    assert vals(out, "d", "k")[-1][0] == float("inf") and out.where("s = 'Lyon!'").count() == 1
    assert vals(apply("cast_field", cities, casts={"name": "int"}, errors="ignore"), "name")[0][0] == "Lyon"
    with pytest.raises(E.ExpressionError):
        apply("calculate", cities, expressions={"x": "__import__('os')"})


def test_reshape(spark):
    rows = [(p, f"y{y}", v) for p, vs in (("A", (10, 11, 12)), ("B", (20, 22, 24))) for y, v in zip((2020, 2021, 2022), vs, strict=True)]
    df = layer(spark, rows, "parcel string, year string, pop long", [G.point(i, 0) for i in range(6)])
    out = apply("pivot", df, index="parcel", columns="year", values="pop", geom_strategy="union")
    assert vals(out, "parcel", "pop_y2020", "pop_y2022") == [("A", 10, 12), ("B", 20, 24)]
    assert {len(G.from_wkb(bytes(r[GEOM])).parts) for r in out.collect()} == {3}
    with pytest.raises(Exception, match="differ"):
        apply("pivot", df, index="parcel", columns="year", values="pop", geom_strategy="raise_if_differs").collect()
    back = apply("unpivot", apply("pivot", df, index="parcel", columns="year", values="pop"), id_vars=["parcel"])
    assert back.count() == 6 and back.agg(F.sum("value")).first()[0] == 99


def test_temporal(spark):
    t = lambda h, m=0: dt.datetime(2026, 1, 1, h, m)
    readings = spark.createDataFrame([("A", t(9), 1), ("A", t(10), 2), ("B", t(9, 30), 3), ("B", t(10, 30), 4), ("B", t(11), 5)], "sensor string, at timestamp_ntz, value long")
    weather = spark.createDataFrame([(t(8, 55), 5.0), (t(9, 55), 7.0), (t(10, 55), 9.0)], "ts timestamp_ntz, temperature double")
    f = lambda **k: apply("temporal_filter", readings, time_col="at", start="2026-01-01 09:30:00", end="2026-01-01 10:30:00", **k).count()
    assert (f(), f(include_start=False, include_end=False), f(invert=True)) == (3, 1, 2)
    out = {r.at: r.temperature for r in apply("temporal_join", readings, ref_gdf=weather, left_on="at", right_on="ts").collect()}
    assert out[t(9)] == 5.0 and out[t(11)] == 9.0
    near = apply("temporal_join", readings, ref_gdf=weather, left_on="at", right_on="ts", strategy="nearest", tolerance="10m")
    assert near.where("temperature is not null").count() == 3
    exact = apply("temporal_join", readings, ref_gdf=weather, left_on="at", right_on="ts", strategy="exact")
    assert exact.count() == 5 and exact.where("temperature is null").count() == 5


def test_classes(spark):
    df = spark.createDataFrame([(i, 1000.0 * i) for i in range(1, 11)], "id long, price double")
    q = apply("classify", df, field="price")
    assert [r["count"] for r in q.groupBy("class").count().orderBy("class").collect()] == [2] * 5
    assert q.orderBy("id").first()["color"] == "#ffffb2" and q.orderBy(F.desc("id")).first()["color"] == "#bd0026"
    m = apply("classify", df, field="price", method="manual", breaks=[3000, 5000, 7000])
    assert m.groupBy("class").count().count() == 4
    same = df.withColumn("price", F.lit(5.0))
    for method in ("quantile", "equal_interval", "std_dev", "pretty", "jenks"):
        assert vals(apply("classify", same, field="price", method=method).select("class").distinct(), "class") == [(1,)]
    assert [r.n for r in apply("normalize", df, field="price", out_field="n").orderBy("id").select("n").collect()][::9] == [0.0, 1.0]
    assert vals(apply("normalize", same, field="price", out_field="n").select("n").distinct(), "n") == [(0.5,)]
    with pytest.raises(Exception, match="too small"):
        apply("normalize", df.withColumn("price", F.lit(0.0)), field="price", method="log").collect()
    cat = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("c",), (None,)], "v string")
    out = dict(vals(apply("classify_categorical", cat, field="v", max_categories=1).where("v is not null").distinct(), "v", "class"))
    assert out == {"a": 1, "b": 2, "c": 2}
    assert vals(apply("classify_categorical", cat, field="v", palette={"a": "#112233"}).where("v = 'b'").distinct(), "color") == [("#bdbdbd",)]


def test_rings(spark):
    rings = layer(spark, [(float(b),) for b in (500, 1000, 1500, 2000)], "cost_budget double", [G.box(0, 0, s, s) for s in (2, 4, 6, 8)])
    b = layer(spark, [(n,) for n in ("inner", "mid", "outer", "far", "beyond")], "name string", [G.point(*p) for p in ((1, 1), (3, 3), (5, 5), (6.5, 6.5), (100, 100))])
    out = {r["name"]: (r.ring_value, r.ring_class) for r in apply("classify_by_ring", b, ref_gdfs=[rings]).collect()}
    assert out == {"inner": (500, 1), "mid": (1000, 2), "outer": (1500, 3), "far": (2000, 4), "beyond": (99999, 5)}


def test_overlays(spark):
    parcels = layer(spark, [(10, "alice"), (11, "bob")], "parcel long, owner string", [G.box(0, 0, 4, 4), G.box(4, 0, 8, 4)])
    zones = layer(spark, [("A", "green"), ("B", "red")], "zone string, category string", [G.box(2, 0, 6, 4), G.box(6, 0, 10, 4)])
    pieces = apply("overlay_intersection", parcels, ref_gdf=zones)
    assert vals(pieces, st_area(GEOM)) == [(8.0,)] * 3
    left = apply("erase", parcels, ref_gdf=zones)
    assert vals(left, "owner", st_area(GEOM)) == [("alice", 8.0)]
    assert apply("overlay_union", parcels, ref_gdf=zones).agg(F.sum(st_area(GEOM))).first()[0] == pytest.approx(40)
    assert apply("overlay_union", parcels.limit(0), ref_gdf=zones).count() == 2 and apply("overlay_union", parcels).count() == 2
    assert vals(apply("clip", parcels, ref_gdf=zones), "owner", st_area(GEOM)) == [("alice", 8.0), ("bob", 16.0)]
    assert vals(apply("filter", parcels, spatial_predicate="within", ref_gdf=zones), "owner") == [("bob",)]
    assert apply("spatial_filter", parcels, mask_gdf=zones).count() == 3
    assert apply("spatial_join", parcels, ref_gdf=zones, how="left").count() >= 3
    agg = apply("spatial_aggregate", zones, ref_gdf=parcels, predicate="overlaps", agg={"*": "count", "parcel": ["sum"]})
    assert agg.count() == 2


def test_spatial_statistics(lattice):
    queen = dict(vals(apply("spatial_weights", lattice), "id", "w_neighbors"))
    assert (queen[4], queen[0]) == (8, 3)
    assert dict(vals(apply("spatial_weights", lattice, method="rook"), "id", "w_neighbors"))[4] == 4
    assert {k for _, k in vals(apply("spatial_weights", lattice, method="knn", k=2), "id", "w_neighbors")} == {2}
    row = apply("morans_i", lattice, field="value", permutations=99).first()
    assert row.morans_i < 0 and row.n == 9 and 0 < row.p_value <= 1
    flat = lattice.withColumn("value", F.lit(1.0))
    got = apply("morans_i", with_srid(flat, 3857), field="value").first()
    assert got.morans_i != got.morans_i and got.n == 9
    assert vals(apply("getis_ord_g", with_srid(flat, 3857), field="value").select("gi_class").distinct(), "gi_class") == [("not_significant",)]
    assert apply("getis_ord_g", lattice.limit(0), field="value").count() == 0


def test_clusters(spark):
    df = layer(spark, [(i,) for i in range(7)], "id long", [G.point(*p) for p in ((0, 0), (1, 0), (0, 1), (5, 5), (6, 5), (5, 6), (50, 50))])
    assert [c for _, c in vals(apply("cluster_dbscan", df, eps=1.5, min_samples=2), "id", "cluster")] == [0, 0, 0, 1, 1, 1, -1]
    assert [c for _, c in vals(apply("cluster_kmeans", df.where("id < 6"), k=2), "id", "cluster")] == [0, 0, 0, 1, 1, 1]
    h = [c for _, c in vals(apply("cluster_hdbscan", df, min_cluster_size=3), "id", "cluster")]
    assert h[0] == h[1] == h[2] != h[3] == h[4] == h[5]


def test_network(spark, lines):
    path = apply("shortest_path", lines, start_x=0, start_y=0, end_x=2, end_y=1)
    assert path.count() == 3 and max(r.path_cost for r in path.collect()) == 3
    assert apply("isochrone", lines, cost_budget=0).count() == 0
    with pytest.raises(ValueError):
        apply("isochrone", lines, cost_budget=-1)
    assert apply("isochrone", lines, cost_budget=100, dissolve=False).count() == 7
    assert apply("isochrone", lines, cost_budget=100, edge_buffer_m=0.1).count() == 1
    one = apply("connectivity_check", lines).first()
    assert (one.is_connected, one.n_components, one.n_nodes, one.n_edges) == (True, 1, 6, 7)
    apart = layer(spark, [(0,), (1,)], "id long", [G.line([(0, 0), (1, 0)]), G.line([(5, 5), (6, 5)])])
    assert apply("connectivity_check", apart).first().n_components == 2
    assert apply("connectivity_check", apart, return_components=True).count() == 2
    assert apply("mst", lines).count() == 5
    hubs = layer(spark, [("a",), ("b",)], "id string", [G.point(0, 0), G.point(2, 1)])
    got = dict(vals(apply("network_allocation", layer(spark, [(0,), (1,)], "k long", [G.point(0, 1), G.point(2, 0)]), network_gdf=lines, hubs_gdf=hubs), "k", "allocated_hub_id"))
    assert got == {0: "a", 1: "b"}
    od = apply("od_matrix", lines, ref_gdf=hubs)
    assert vals(od, "origin_id", "destination_id", "cost") == [("a", "b", 3.0), ("b", "a", 3.0)]


def test_network_cleaning(spark):
    chain = layer(spark, [(i,) for i in range(3)], "id long", [G.line([(10 * i, 0), (10 * i + 10, 0)]) for i in range(3)])
    assert vals(apply("network_remove_pseudo_nodes", chain), st_length(GEOM)) == [(30.0,)]
    cross = layer(spark, [(0,), (1,)], "id long", [G.line([(0, 0), (2, 2)]), G.line([(0, 2), (2, 0)])])
    assert apply("network_node_lines", cross).count() == 4
    twice = layer(spark, [(0,), (1,), (2,)], "id long", [G.line([(0, 0), (1, 0)]), G.line([(0, 0), (1, 0)]), G.line([(0, 5), (1, 5)])])
    assert apply("network_remove_duplicates", twice).count() == 2
    gap = layer(spark, [(0,), (1,)], "id long", [G.line([(0, 0), (9.5, 0)]), G.line([(10, -5), (10, 5)])])
    assert vals(apply("network_extend_dangles", gap), st_length(GEOM)) == [(10.0,), (10.0,)]
    near = layer(spark, [(0,), (1,)], "id long", [G.line([(0, 0), (1, 0)]), G.line([(1.2, 0), (2, 0)])])
    assert [round(x, 6) for (x,) in vals(apply("network_snap_endpoints", near), st_length(GEOM))] == [0.9, 1.1]


def test_coverage(spark):
    over = layer(spark, [(0,), (1,)], "id long", [G.box(0, 0, 10, 10), G.box(8, 0, 18, 10)])
    assert vals(apply("polygon_fix_overlaps", over, rule="first"), "id", st_area(GEOM)) == [(0, 100.0), (1, pytest.approx(80.0))]
    ring = layer(spark, [(0,), (1,)], "id long", [G.difference(G.box(0, 0, 10, 10), G.box(4, 4, 6, 10)), G.box(4, 6, 6, 10)])
    assert apply("polygon_fix_gaps", ring).agg(F.sum(st_area(GEOM))).first()[0] == pytest.approx(100)
    thin = layer(spark, [(0,), (1,)], "id long", [G.box(0, 0, 10, 10), G.box(0, 0, 10, 0.01)])
    assert vals(apply("polygon_remove_slivers", thin), "id") == [(0,)]


def test_quality(spark, lattice):
    over = layer(spark, [(0,), (1,), (2,)], "id long", [G.box(0, 0, 1.5, 1), G.box(1, 0, 2, 1), None])
    assert vals(apply("topology_check", over, id_col="id"), "feature_id", "issue") == [("0+1", "overlap"), ("2", "null_geometry")]
    assert apply("topology_check", lattice).count() == 0
    copies = layer(spark, [(i,) for i in range(4)], "id long", [G.point(0, 0)] * 3 + [G.point(0.5, 0)])
    assert apply("duplicate_geometry", copies).count() == 2
    assert apply("duplicate_geometry", copies, tolerance=0.6).count() == 3
    rows = spark.createDataFrame([(1, "ab", 5), (2, None, 50), (3, "zz", None)], "id long, name string, n long")
    bad = apply("attribute_validation", rows, schema={"name": {"nullable": False, "pattern": "[a-y]+"}, "n": {"max": 10}, "gone": {}}, id_col="id")
    assert vals(bad, "feature_id", "column", "rule") == sorted([("1", "gone", "missing_column"), ("2", "gone", "missing_column"), ("3", "gone", "missing_column"), ("2", "name", "nullable"), ("3", "name", "pattern"), ("2", "n", "max")])
    assert vals(apply("completeness_check", rows, columns=["name"]), "null_count", "null_ratio", "is_complete") == [(1, 0.333333, False)]


def test_point_clouds(spark):
    pts = [(x, y, z) for x, y, z in ((1, 1, 5.0), (2, 2, 12.0), (1.5, 1, 7.0), (6, 6, 3.0))]
    cloud = layer(spark, [(2,)] * 4, "classification int", [G.point(*p) for p in pts])
    areas = layer(spark, [("A", 0.0), ("B", 5.0)], "fid string, ground double", [G.box(0, 0, 3, 3), G.box(5, 5, 8, 8)])
    a = {r.fid: r for r in apply("pointcloud_zonal_height", areas, ref_gdf=cloud).collect()}["A"]
    assert (a.z_max, a.z_min, a.z_count, a.z_height) == (12, 5, 3, 7)
    assert {r.fid: r.z_height for r in apply("pointcloud_zonal_height", areas, ref_gdf=cloud, ground_col="ground").collect()}["A"] == 12
    assert apply("pointcloud_grid_summary", cloud, cell_size=2.0).count() == 2
    assert apply("pointcloud_filter_classification", cloud, drop=[2]).count() == 0


def test_rasters(spark, tmp_path):
    import numpy as np

    from lodestrata.sources import geotiff

    a = np.arange(64, dtype=np.float32).reshape(1, 8, 8)
    r = geotiff.Raster(np.concatenate([a, a * 2, a + 1, a * 3 + 2]), 0.0, 8.0, 1.0, 1.0, 3857, -1.0)
    path = str(tmp_path / "a.tif")
    (tmp_path / "a.tif").write_bytes(geotiff.write(r))
    back = geotiff.read((tmp_path / "a.tif").read_bytes())
    assert (back.data == r.data).all() and back.bounds == r.bounds and back.srid == 3857
    zone = layer(spark, [("z",)], "name string", [G.box(0, 4, 4, 8)])
    got = apply("zonal_stats", zone, raster_path=path).first()
    assert (got.rs_min, got.rs_max, got.rs_count) == (0, 27, 16)
    out = str(tmp_path / "b.tif")
    assert apply("ndvi", zone, raster_path=path, output_path=out).first().ndvi_max <= 1
    assert apply("raster_clip", zone, raster_path=path, output_path=out).count() == 1
    assert geotiff.read((tmp_path / "b.tif").read_bytes()).data.shape == (4, 4, 4)
    for how in ("nearest", "bilinear", "cubic", "lanczos", "average", "mode"):
        assert apply("raster_reproject", zone, raster_path=path, output_path=out, target_crs="EPSG:4326", resampling=how).count() == 1
    (tmp_path / "c.tif").write_bytes(geotiff.write(geotiff.Raster(r.data + 5, 4.0, 8.0, 1.0, 1.0, 3857)))
    apply("raster_merge", zone, raster_paths=[path, str(tmp_path / "c.tif")], output_path=out, method="max")
    assert geotiff.read((tmp_path / "b.tif").read_bytes()).data.shape == (4, 8, 12)
    b = r.data.copy()
    b[0, :2, :2] += 9
    (tmp_path / "d.tif").write_bytes(geotiff.write(geotiff.Raster(b, 0.0, 8.0, 1.0, 1.0, 3857)))
    ch = apply("change_detection", zone, raster_before=path, raster_after=str(tmp_path / "d.tif"), threshold=1.0)
    assert vals(ch, "diff_mean", st_area(GEOM)) == [(9.0, 4.0)]


def test_gated(spark, lattice):
    with pytest.raises(NotSupported):
        apply("h3_aggregate", lattice)
    with pytest.raises(NotSupported):
        apply("stac_search", lattice, catalog_url="https://example.org")


def test_empty_layers(spark, lattice, lines):
    none = lattice.limit(0)
    for name in ("buffer", "centroid", "area_length", "convex_hull", "envelope", "boundary", "make_valid", "extract_vertices", "extract_segments", "multipart_to_singleparts", "swap_xy", "dissolve", "duplicate_geometry", "topology_check", "spatial_weights", "cluster_dbscan", "polygon_fix_overlaps", "kde_heatmap"):
        assert apply(name, none).count() in (0, 1), name
    assert srid_of(apply("reproject", none)) == 4326


def test_null_geometries(spark):
    df = layer(spark, [(0,), (1,)], "id long", [None, G.box(0, 0, 1, 1)])
    for name, n in (("buffer", 2), ("centroid", 2), ("boundary", 1), ("make_valid", 1), ("simplify", 2), ("extract_vertices", 5)):
        assert apply(name, df).count() == n, name


def test_dimensions(spark):
    df = layer(spark, [(0,)], "id long", [G.line([(0, 0), (1, 1)])])
    wkt = lambda d: G.to_wkt(G.from_wkb(bytes(d.first()[GEOM])))
    z = apply("add_z", df, z=3)
    assert wkt(z) == "LINESTRING Z (0 0 3, 1 1 3)" and wkt(apply("drop_z", z)) == "LINESTRING (0 0, 1 1)"
    assert wkt(apply("add_m", z, m=2)) == "LINESTRING ZM (0 0 3 2, 1 1 3 2)"
    assert wkt(apply("reverse_lines", df)) == "LINESTRING (1 1, 0 0)"
    with pytest.raises(ValueError):
        apply("add_z", df)
