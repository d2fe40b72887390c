"""Economic source files: census text, state output tables, national-accounts tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_upper_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Delimited text with damaged bytes tolerated; all columns text, names in upper case."""
    df = spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8").option("mode", "PERMISSIVE").csv(path)
    return df.toDF(*[c.strip().upper() for c in df.columns])


def read_state_output(spark: SparkSession, pattern: str, kind: str = "SAGDP9N") -> DataFrame:
    """One file per state; the file name carries the table kind and the state."""
    df = spark.read.option("header", True).csv(pattern)
    parts = F.split(F.col("_metadata.file_name"), "_")
    return df.select("*", parts[0].alias("kind"), parts[1].alias("state")).filter(F.col("kind") == kind)


def clean_use_values(long: DataFrame, divide_by: float = 1.0) -> DataFrame:
    """Trim codes and texts; '---' and anything unreadable count as 0."""
    text = F.replace(F.trim("value"), F.lit("---"), F.lit("0"))
    number = F.coalesce(F.replace(text, F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0))
    return long.withColumns({
        "code": F.trim("code"), "column_code": F.trim("column_code"), "value": number / F.lit(float(divide_by)),
    })


def read_use_table(spark: SparkSession, path: str, divide_by: float = 1.0) -> DataFrame:
    """Wide national-accounts table -> (code, description, column_code, value)."""
    df = spark.read.option("header", True).csv(path)
    first, second, *rest = df.columns
    d = df.withColumnRenamed(first, "code").withColumnRenamed(second, "description")
    return clean_use_values(d.unpivot(["code", "description"], rest, "column_code", "value"), divide_by)


def read_alpha_beta(spark: SparkSession, path: str, columns, phases: float = 3.0) -> DataFrame:
    """Point features with one current column per scenario -> (name, lon, lat, scenario, gic).

    Currents are per phase and absolute; coordinates come from the geometry where missing.
    """
    schema = """features array<struct<properties:map<string,string>,
        geometry:struct<type:string, coordinates:array<double>>>>"""
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    p = F.col("f.properties")
    pack = F.array(*[
        F.struct(F.lit(c).alias("scenario"), (F.abs(p[c].try_cast("double")) / phases).alias("gic")) for c in columns
    ])
    return f.select(
        p["name"].alias("name"),
        F.coalesce(p["longitude"].try_cast("double"), F.col("f.geometry.coordinates")[0]).alias("longitude"),
        F.coalesce(p["latitude"].try_cast("double"), F.col("f.geometry.coordinates")[1]).alias("latitude"),
        F.explode(pack).alias("s"),
    ).select("name", "longitude", "latitude", "s.*")


def read_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """ZIP to ZCTA table; rows without a ZCTA go."""
    df = spark.read.option("header", True).csv(path)
    return df.select(
        F.col("ZIP_CODE").alias("zip"), F.col("ZCTA").cast("int").alias("zcta"), F.col("STATE").alias("state")
    ).filter(F.col("zcta").isNotNull())
