"""SQL over layers, imports and reports."""

from __future__ import annotations

import html
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attribute import attributes
from .layer import GEOM, has_geometry, srid_of, st_kind, with_srid
from .registry import NotSupported, operator

_WRITES = re.compile(r"\b(insert|update|delete|drop|alter|create|truncate|grant|merge|copy|call)\b", re.I)


@operator("postgis_sql", "sql")
def postgis_sql(df: DataFrame, dsn: str = "", sql: str = "", params=None, geom_col: str = "geom", input_table=None, input_schema: str = "public") -> DataFrame:
    """A query with {input_table} for the layer and {name} for parameters, which are bound, not pasted. Without dsn it runs on Spark;
    with one, over JDBC, where {input_table} must name a table of the database."""
    if _WRITES.search(sql):
        raise ValueError("only queries are allowed")
    spark = df.sparkSession
    bound = {}
    for k, v in (params or {}).items():
        if not re.fullmatch(r"[A-Za-z_]\w*", k):
            raise ValueError(f"not a parameter name: {k!r}")
        bound[k] = v
    if dsn:
        if not input_table:
            raise NotSupported("a query in the database needs input_table")
        text = sql.replace("{input_table}", f"{input_schema}.{input_table}")
        for k, v in bound.items():
            text = text.replace("{" + k + "}", "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v))
        return spark.read.format("jdbc").option("url", dsn).option("query", text).load()
    name = input_table or "input_layer"
    df.withColumnRenamed(GEOM, geom_col).createOrReplaceTempView(name)
    text = sql.replace("{input_table}", name)
    for k in bound:
        text = text.replace("{" + k + "}", f":{k}")
    out = spark.sql(text, args=bound)
    return with_srid(out.withColumnRenamed(geom_col, GEOM), srid_of(df)) if geom_col in out.columns else out


@operator("osm_import", "import")
def osm_import(df: DataFrame, geojson_path=None, tag_filter=None) -> DataFrame:
    """Features of a GeoJSON file, or the layer; rows whose columns equal the tags ("*": not null). Unknown tags are ignored."""
    if geojson_path:
        from ..sources.vector import read_geojson

        df = read_geojson(df.sparkSession, geojson_path)
    for k, v in (tag_filter or {}).items():
        if k in df.columns:
            df = df.where(F.col(k).isNotNull() if v == "*" else F.col(k) == v)
    return df


@operator("stac_search", "import")
def stac_search(df: DataFrame, catalog_url=None, collections=None, bbox=None, datetime_range=None, max_items: int = 100) -> DataFrame:
    """Items of a STAC item collection (a JSON file that Spark can read): id, collection, datetime, geometry, prop_*."""
    if not catalog_url or re.match(r"https?://", catalog_url):
        raise NotSupported("searching a catalogue over the network; give the path of a saved item collection")
    from ..sources.vector import read_geojson

    items = read_geojson(df.sparkSession, catalog_url, keep=["id", "collection"], prefix="prop_")
    if collections:
        items = items.where(F.col("collection").isin(list(collections)))
    t = F.col("prop_datetime").try_cast("timestamp") if "prop_datetime" in items.columns else F.lit(None).cast("timestamp")
    items = items.withColumn("datetime", t)
    if datetime_range:
        lo, _, hi = datetime_range.partition("/")
        hi = hi or lo
        if lo and lo != "..":
            items = items.where(F.col("datetime") >= F.lit(lo).cast("timestamp"))
        if hi and hi != "..":
            items = items.where(F.col("datetime") <= F.lit(hi).cast("timestamp"))
    if bbox:
        from ..functions import geometry as G
        from .spatial import filter_

        items = filter_(items, spatial_predicate="intersects", ref_wkt=G.to_wkt(G.box(*bbox)))
    return items.limit(max_items)


@operator("report_build", "report")
def report_build(df: DataFrame, title: str = "Analysis report", template_path=None, output_path=None, include_stats: bool = True, include_preview: bool = True) -> DataFrame:
    """An HTML page with statistics of the numbers and the first 20 rows: one row output_path, html. A template is read through Spark
    and may hold {title}, {stats} and {preview}."""
    spark = df.sparkSession
    numbers = [c for c, t in df.dtypes if c in attributes(df) and t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]

    def table(names: list[str], rows: list) -> str:
        cell = lambda v: f"<td>{html.escape('' if v is None else str(v))}</td>"
        return "<table><tr>" + "".join(f"<th>{html.escape(n)}</th>" for n in names) + "</tr>" + "".join("<tr>" + "".join(map(cell, r)) + "</tr>" for r in rows) + "</table>"

    stats = preview = ""
    if include_stats and numbers:
        s = df.select(*numbers).summary("count", "mean", "stddev", "min", "25%", "50%", "75%", "max")
        stats = table(s.columns, s.collect())  # eight rows
    if include_preview:
        p = df.limit(20)
        p = p.withColumn(GEOM, st_kind(GEOM)) if has_geometry(df) else p
        preview = table(p.columns, p.collect())
    page = "<!doctype html><html><head><meta charset='utf-8'><title>{title}</title></head><body><h1>{title}</h1>{stats}{preview}</body></html>"
    if template_path:
        page = spark.read.option("wholetext", True).text(template_path).first()[0]
    for k, v in (("{title}", html.escape(title)), ("{stats}", stats), ("{preview}", preview)):
        page = page.replace(k, v)
    if output_path:
        p = spark._jvm.org.apache.hadoop.fs.Path(output_path)
        out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
        out.write(bytearray(page.encode()))
        out.close()
    return spark.createDataFrame([(output_path, page)], "output_path string, html string")


__all__ = ["json"]
