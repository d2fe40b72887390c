"""Electromagnetic site files: impedance XML and the accepted-site list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EM_XML_SCHEMA = """
SiteId string, Latitude double, Longitude double, Rating int,
Data struct<Period:array<struct<_value:double,
  Z:struct<value:array<struct<_name:string,_VALUE:string>>>,
  `Z.VAR`:struct<value:array<struct<_name:string,_VALUE:string>>>>>>"""


def _elements(raw: DataFrame) -> DataFrame:
    """Parsed site records -> one row per (site, period, element)."""
    per = raw.select(
        F.col("SiteId").alias("site"), F.col("Latitude").alias("latitude"),
        F.col("Longitude").alias("longitude"), F.col("Rating").alias("rating"),
        F.explode("Data.Period").alias("p"),
    )
    variances = F.map_from_arrays(
        F.transform(F.col("p")["Z.VAR"]["value"], lambda v: v["_name"]),
        F.transform(F.col("p")["Z.VAR"]["value"], lambda v: v["_VALUE"].try_cast("double")),
    )
    rows = per.select(
        "site", "latitude", "longitude", "rating", F.col("p._value").alias("period"),
        variances.alias("var"), F.explode(F.col("p")["Z"]["value"]).alias("z"),
    )
    parts = F.split(F.trim("z._VALUE"), r"\s+")
    return rows.select(
        "site", "latitude", "longitude", "rating", "period",
        F.lower(F.regexp_replace("z._name", "(?i)^z", "")).alias("element"),
        F.get(parts, F.lit(0)).try_cast("double").alias("z_re"),
        F.get(parts, F.lit(1)).try_cast("double").alias("z_im"),
        F.col("var")[F.col("z._name")].alias("z_var"),
    )


def read_em_sites(spark: SparkSession, path: str) -> DataFrame:
    """Impedance XML files of a folder tree."""
    return _elements(
        spark.read.format("xml").option("rowTag", "EM_TF").option("valueTag", "_VALUE").schema(EM_XML_SCHEMA)
        .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(path)
    )


def parse_em_xml(df: DataFrame, column: str) -> DataFrame:
    """The same for XML text held in a column."""
    parsed = F.from_xml(column, EM_XML_SCHEMA, {"rowTag": "EM_TF", "valueTag": "_VALUE"})
    return _elements(df.select(parsed.alias("r")).select("r.*"))


def accepted(sites: DataFrame, allow: DataFrame, min_rating: int = 3) -> DataFrame:
    """Sites on the allow-list (any letter case); without a list, sites of good rating."""
    if allow.isEmpty():
        return sites.filter(F.col("rating") >= min_rating)
    names = allow.select(F.upper("name").alias("_name")).distinct()
    return sites.join(names, F.upper(sites["name"]) == F.col("_name"), "left_semi")
