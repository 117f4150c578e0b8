"""Vector files: GeoJSON, CSV with places, GeoParquet with boxes, GeoPackage, Shapefile."""

from __future__ import annotations

import json
import os
import sqlite3
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import crs as C
from ..functions import geometry as G
from ..operators.layer import GEOM, bbox, make_point, shapes, srid_of, with_geometry, with_srid, udf
from ..operators.registry import NotSupported

_WKT_NAMES = ("geom", "geometry", "wkt", "the_geom")
_X_NAMES, _Y_NAMES = ("longitude", "lon", "lng", "long", "x"), ("latitude", "lat", "y")


@udf("binary")
def _from_geojson(text: pd.Series) -> pd.Series:
    from ..operators.spatial import from_geojson

    return pd.Series([None if t is None or t == "null" else G.to_wkb(from_geojson(json.loads(t))) for t in text], dtype=object)


@udf("binary")
def from_wkt(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or not t.strip() else G.to_wkb(G.from_wkt(t)) for t in text], dtype=object)


def to_wkt(column):
    return shapes(G.to_wkt, "string")(column)


def read_geojson(spark: SparkSession, path: str, keep: list[str] | None = None, prefix: str = "", crs="EPSG:4326") -> DataFrame:
    """Features of collections (one document a file) or of lines of features; property types are those Spark infers."""
    text = spark.read.option("wholetext", True).text(path)
    doc = text.select(F.from_json("value", "type string, features array<string>").alias("d"), "value")
    one = doc.select(F.explode(F.when(F.col("d.features").isNotNull(), F.col("d.features")).otherwise(F.filter(F.split("value", "\n"), lambda x: F.length(F.trim(x)) > 0))).alias("f"))
    parts = one.select(F.from_json("f", "id string, collection string, properties string, geometry string").alias("p"))
    schema = spark.read.json(parts.select(F.coalesce("p.properties", F.lit("{}"))).rdd.map(lambda r: r[0])).schema
    props = F.from_json(F.coalesce("p.properties", F.lit("{}")), schema) if len(schema) else None
    cols = [F.col(f"p.{c}").alias(c) for c in keep or []]
    out = parts.select(*cols, *([props.alias("q")] if props is not None else []), _from_geojson("p.geometry").alias(GEOM))
    if props is not None:
        out = out.select(*(keep or []), *[F.col(f"q.`{f.name}`").alias(f"{prefix}{f.name}") for f in schema], GEOM)
    return with_srid(out, C.srid(crs))


def _geojson(g: G.Shape) -> dict:
    pt = lambda a: [[float(v) for v in p] for p in a]
    if g.kind == "GeometryCollection":
        return {"type": g.kind, "geometries": [_geojson(p) for p in g.parts]}

    def c(s: G.Shape):
        return (pt(s.coords)[0] if not s.empty else []) if s.kind == "Point" else pt(s.coords) if s.kind == "LineString" else [pt(r) for r in s.rings] if s.kind == "Polygon" else [c(p) for p in s.parts]

    return {"type": g.kind, "coordinates": c(g)}


def write_geojson(df: DataFrame, path: str) -> None:
    """A folder of files with a feature a line, in degrees."""
    from ..operators.layer import transformed

    geom = shapes(lambda g: json.dumps(_geojson(g)), "string")(transformed(F.col(GEOM), srid_of(df), 4326))
    props = [c for c in df.columns if c != GEOM]
    body = F.to_json(F.struct(*props), {"ignoreNullFields": "false"}) if props else F.lit("{}")
    df.select(F.concat(F.lit('{"type":"Feature","properties":'), body, F.lit(',"geometry":'), F.coalesce(geom, F.lit("null")), F.lit("}")).alias("value")).write.text(path)


def read_csv(spark: SparkSession, path: str, crs="EPSG:4326", sep: str = ",") -> DataFrame:
    """A column of WKT, or of longitude and latitude, by the usual names."""
    df = spark.read.csv(path, header=True, inferSchema=True, sep=sep)
    low = {c.lower(): c for c in df.columns}
    wkt = next((low[n] for n in _WKT_NAMES if n in low), None)
    if wkt:
        out = df.withColumn("_g", from_wkt(F.col(wkt))).drop(wkt).withColumnRenamed("_g", GEOM)
        return with_srid(out, C.srid(crs))
    x, y = next((low[n] for n in _X_NAMES if n in low), None), next((low[n] for n in _Y_NAMES if n in low), None)
    return with_srid(df.withColumn(GEOM, make_point(F.col(x).cast("double"), F.col(y).cast("double"))), C.srid(crs)) if x and y else df


def read_geoparquet(spark: SparkSession, path: str, columns: list[str] | None = None, box: tuple | None = None, crs="EPSG:4326") -> DataFrame:
    """With a `bbox` column its bounds are compared first, where Parquet skips row groups by them."""
    df = spark.read.parquet(path)
    if box is not None and "bbox" in df.columns:
        df = df.where((F.col("bbox.xmin") <= float(box[2])) & (F.col("bbox.xmax") >= float(box[0])) & (F.col("bbox.ymin") <= float(box[3])) & (F.col("bbox.ymax") >= float(box[1])))
    elif box is not None:
        from ..operators.spatial import filter_

        df = filter_(with_srid(df, C.srid(crs)), spatial_predicate="intersects", ref_wkt=G.to_wkt(G.box(*box)))
    known = next((f.metadata.get("srid") for f in df.schema.fields if f.name == GEOM), None)
    df = df.select(*[c for c in df.columns if c in columns or c == GEOM]) if columns else df
    return with_srid(df.drop("bbox"), known or C.srid(crs))


def write_geoparquet(df: DataFrame, path: str, sort: bool = True) -> None:
    """WKB with a `bbox` column; sorted by place, so that a box query meets few row groups."""
    out = with_srid(df.withColumn("bbox", bbox(GEOM)), srid_of(df))
    if sort:
        out = out.repartitionByRange("bbox.xmin", "bbox.ymin").sortWithinPartitions("bbox.xmin", "bbox.ymin")
    out.write.parquet(path)


def _gpkg_shape(blob: bytes | None) -> bytes | None:
    """The WKB in a GeoPackage geometry."""
    if blob is None or blob[:2] != b"GP":
        return blob
    return blob[8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7] :]


_SQLITE = {"INT": T.LongType(), "INTEGER": T.LongType(), "MEDIUMINT": T.LongType(), "SMALLINT": T.LongType(), "TINYINT": T.LongType(), "REAL": T.DoubleType(), "DOUBLE": T.DoubleType(), "FLOAT": T.DoubleType(), "BOOLEAN": T.BooleanType()}


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """A layer of a GeoPackage. The file is one SQLite database, which one task opens; the rows are then spread out."""
    files = spark.read.format("binaryFile").load(path).select("content")
    with _database(bytes(files.first()[0])) as db:
        layers = [r[0] for r in db.execute("select table_name from gpkg_contents where data_type in ('features', 'attributes') order by 1")]
        name = layer or layers[0]
        if name not in layers:
            raise KeyError(f"no layer {name}")
        found = db.execute("select column_name, srs_id from gpkg_geometry_columns where table_name = ?", (name,)).fetchone()
        geom, srid = found or (None, 4326)
        fields = [T.StructField(GEOM if r[1] == geom else r[1], T.BinaryType() if r[1] == geom else _SQLITE.get(r[2].upper().split("(")[0], T.StringType())) for r in db.execute(f'pragma table_info("{name}")')]

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for raw in f["content"]:
                with _database(raw) as db:
                    cur = db.execute(f'select * from "{name}"')
                    while rows := cur.fetchmany(50_000):
                        t = pd.DataFrame(rows, columns=[x.name for x in fields], dtype=object)
                        for x in fields:
                            if x.name == GEOM:
                                t[GEOM] = t[GEOM].map(_gpkg_shape)
                            elif isinstance(x.dataType, T.StringType):
                                t[x.name] = t[x.name].map(lambda v: None if v is None else str(v))
                            elif isinstance(x.dataType, T.BooleanType):
                                t[x.name] = t[x.name].map(lambda v: None if v is None else bool(v))
                        yield t

    return with_srid(files.mapInPandas(load, T.StructType(fields)), srid)


class _database:
    """An SQLite database from its bytes."""

    def __init__(self, raw: bytes):
        self.raw = raw

    def __enter__(self) -> sqlite3.Connection:
        self.file = tempfile.NamedTemporaryFile(suffix=".gpkg", delete=False)
        self.file.write(self.raw)
        self.file.close()
        self.db = sqlite3.connect(self.file.name)
        return self.db

    def __exit__(self, *_) -> None:
        self.db.close()
        os.unlink(self.file.name)


def read_shapefile(spark: SparkSession, path: str, crs="EPSG:4326") -> DataFrame:
    """A .shp with the .dbf beside it. Shapes and rows are in the same order in two files, so one task reads both."""
    pair = spark.read.format("binaryFile").load([path, path[:-4] + ".dbf"]).select("path", "content").coalesce(1)
    head = bytes(pair.where(F.col("path").endswith(".dbf")).first()["content"])
    names, kinds = _dbf_fields(head)
    schema = T.StructType([T.StructField(n, T.DoubleType() if k in "NF" else T.BooleanType() if k == "L" else T.StringType()) for n, k in zip(names, kinds, strict=True)] + [T.StructField(GEOM, T.BinaryType())])

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = {}
        for f in frames:
            for p, raw in zip(f["path"], f["content"], strict=True):
                got[p[-3:].lower()] = raw
        if got:
            t = pd.DataFrame(_dbf_rows(got["dbf"]), columns=names, dtype=object)
            t[GEOM] = [None if g is None else G.to_wkb(g) for g in _shp_shapes(got["shp"])]
            yield t

    return with_srid(pair.mapInPandas(load, schema), C.srid(crs))


def _dbf_fields(raw: bytes) -> tuple[list[str], list[str]]:
    n = (struct.unpack_from("<H", raw, 8)[0] - 33) // 32
    return [raw[32 + 32 * i : 43 + 32 * i].split(b"\0")[0].decode("latin1") for i in range(n)], [chr(raw[43 + 32 * i]) for i in range(n)]


def _dbf_rows(raw: bytes) -> list[list]:
    count, head, size = struct.unpack_from("<IHH", raw, 4)
    _, kinds = _dbf_fields(raw)
    widths = [raw[48 + 32 * i] for i in range(len(kinds))]
    out = []
    for r in range(count):
        at, row = head + r * size + 1, []
        for k, w in zip(kinds, widths, strict=True):
            v = raw[at : at + w].decode("latin1").strip()
            at += w
            row.append((float(v) if v and v[0] != "*" else None) if k in "NF" else ({"T": True, "Y": True, "F": False, "N": False}.get(v.upper())) if k == "L" else v or None)
        out.append(row)
    return out


def _shp_shapes(raw: bytes) -> Iterator[G.Shape | None]:
    at = 100
    while at < len(raw):
        size = struct.unpack_from(">I", raw, at + 4)[0] * 2
        kind = struct.unpack_from("<I", raw, at + 8)[0] % 10
        body = at + 12
        if kind == 0:
            yield None
        elif kind == 1:
            yield G.point(*struct.unpack_from("<2d", raw, body))
        elif kind == 8:
            n = struct.unpack_from("<I", raw, body + 32)[0]
            yield G.Shape("MultiPoint", parts=[G.point(*p) for p in np.frombuffer(raw, "<f8", 2 * n, body + 36).reshape(n, 2)])
        else:
            k, n = struct.unpack_from("<II", raw, body + 32)
            cuts = [*struct.unpack_from(f"<{k}I", raw, body + 40), n]
            p = np.frombuffer(raw, "<f8", 2 * n, body + 40 + 4 * k).reshape(n, 2)
            parts = [p[a:b].astype(float) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield G.collect([G.line(a) for a in parts]) if kind == 3 else G.build_area([a[::-1] for a in parts])
        at += 8 + size


READERS = {"parquet": read_geoparquet, "geojson": read_geojson, "json": read_geojson, "csv": read_csv, "gpkg": read_geopackage, "shp": read_shapefile}


def read_vector(spark: SparkSession, path: str, **options) -> DataFrame:
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "tsv":
        return read_csv(spark, path, sep="\t", **options)
    if kind not in READERS:
        raise NotSupported(f"no reader for .{kind}")
    return READERS[kind](spark, path, **options)


def write_vector(df: DataFrame, path: str) -> None:
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        write_geoparquet(df, path)
    elif kind in ("geojson", "json"):
        write_geojson(df, path)
    elif kind in ("csv", "tsv"):
        with_geometry(df, F.col(GEOM)).withColumn("wkt", to_wkt(F.col(GEOM))).drop(GEOM).write.csv(path, header=True, sep="\t" if kind == "tsv" else ",")
    else:
        raise NotSupported(f"no writer for .{kind}")
