"""Power-grid files: map features, line and region layers, mapping tables, network tables."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridhazard.functions.fixed_values import FEATURE_TAGS

FEATURE_SCHEMA = """
elements array<struct<type:string, id:bigint, lat:double, lon:double,
  geometry:array<struct<lat:double, lon:double>>, tags:map<string,string>>>"""

GEOJSON_LINES = """
features array<struct<properties:map<string,string>,
  geometry:struct<type:string, coordinates:string>>>"""


def map_features(raw: DataFrame) -> DataFrame:
    """Elements -> features: kept tags, geometry kind and vertices; relations are dropped."""
    e = raw.select(F.explode("elements").alias("e")).select("e.*").filter(F.col("type") != "relation")
    way = F.transform("geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    node = F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")))
    closed = (F.size("geometry") > 3) & (F.get("geometry", F.lit(0)) == F.element_at("geometry", -1))
    kind = F.when(F.col("type") == "node", "point").when(closed, "ring").otherwise("line")
    keep = [F.lit(t) for t in FEATURE_TAGS]
    return e.filter((F.col("type") == "node") | F.col("geometry").isNotNull()).select(
        F.col("id").alias("osmid"), F.col("type").alias("element_type"),
        F.map_filter(F.coalesce("tags", F.create_map().cast("map<string,string>")), lambda k, _: k.isin(*keep)).alias("tags"),
        kind.alias("kind"), F.when(F.col("type") == "node", node).otherwise(way).alias("vertices"),
    )


def read_map_features(spark: SparkSession, path: str) -> DataFrame:
    return map_features(spark.read.schema(FEATURE_SCHEMA).option("multiLine", True).json(path))


def exploded_parts(lines: DataFrame, line_id: str, parts: str) -> DataFrame:
    """Multi-part lines -> one row per part with ids ``id``, ``id_1``, ``id_2``."""
    d = lines.select("*", F.posexplode(parts).alias("_pos", "vertices")).drop(parts)
    own = F.col(line_id).cast("string")
    return d.withColumn(line_id, F.when(F.col("_pos") > 0, F.concat_ws("_", own, "_pos")).otherwise(own)).drop("_pos")


def read_line_layer(spark: SparkSession, path: str, id_property: str = "ID") -> DataFrame:
    """GeoJSON line layer -> (line_id, properties, vertices), multi-part lines split."""
    f = spark.read.schema(GEOJSON_LINES).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    single = F.from_json("f.geometry.coordinates", "array<array<double>>")
    many = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    parts = F.when(F.col("f.geometry.type") == "MultiLineString", many).otherwise(F.array(single))
    as_xy = F.transform(parts, lambda p: F.transform(p, lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))))
    d = f.select(F.col("f.properties")[id_property].alias("line_id"), F.col("f.properties").alias("properties"), as_xy.alias("parts"))
    return exploded_parts(d, "line_id", "parts")


def read_region_layer(spark: SparkSession, path: str, name_property: str, renames: dict, leave_out=("NotOrder1000",)) -> DataFrame:
    """GeoJSON polygons -> (region, ring) with names mapped and some regions left out."""
    f = spark.read.schema(GEOJSON_LINES).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    rings = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    ring = F.transform(rings[0], lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))
    d = f.select(F.col("f.properties")[name_property].alias("region"), ring.alias("ring"))
    return renamed_regions(d, renames, leave_out)


def renamed_regions(regions: DataFrame, renames: dict, leave_out=("NotOrder1000",)) -> DataFrame:
    name = F.col("region")
    if renames:
        m = F.create_map(*[x for k, v in renames.items() for x in (F.lit(k), F.lit(v))])
        name = F.coalesce(m[name], name)
    return regions.withColumn("region", name).filter(~F.col("region").isin(list(leave_out)))


def mapping_attributes(df: DataFrame, column: str) -> DataFrame:
    """Single-quoted dictionary text -> role and type columns, without evaluating code."""
    parsed = F.from_json(column, "role string, type string", {"allowSingleQuotes": "true"})
    return df.withColumn("_a", parsed).withColumns({"role": F.col("_a.role"), "type": F.col("_a.type")}).drop("_a", column)


def normalize_columns(df: DataFrame, aliases: dict[str, tuple], defaults: dict[str, object] | None = None) -> DataFrame:
    """Rename the first alias present to each target name; fill absent targets with a default."""
    have = set(df.columns)
    for target, names in aliases.items():
        found = next((n for n in (target, *names) if n in have), None)
        if found is None:
            df = df.withColumn(target, F.lit((defaults or {}).get(target)))
        elif found != target:
            df = df.withColumnRenamed(found, target)
    return df.na.fill({k: v for k, v in (defaults or {}).items() if v is not None})


def with_row_id(df: DataFrame, target: str, candidates) -> DataFrame:
    """Id from the first candidate column present, else a generated one."""
    found = [c for c in candidates if c in df.columns]
    return df.withColumn(target, F.col(found[0]) if found else F.monotonically_increasing_id())


def wkt_line(text) -> "F.Column":
    """'LINESTRING (x y, x y)' -> vertex array."""
    body = F.regexp_extract(text, r"\(([^)]*)\)", 1)
    return F.transform(
        F.split(body, r",\s*"),
        lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("y")),
    )


def read_network(spark: SparkSession, lines_path: str, stations_path: str) -> tuple[DataFrame, DataFrame]:
    """Line table with WKT geometry, and station table."""
    lines = spark.read.option("header", True).schema(
        "name string, from_bus string, to_bus string, length double, V int, geometry string, R_per_km double, R double"
    ).csv(lines_path)
    stations = spark.read.option("header", True).schema(
        "name string, buses string, latitude double, longitude double, grounding_resistance double"
    ).csv(stations_path)
    return lines.withColumn("vertices", wkt_line(F.col("geometry"))).drop("geometry"), stations
