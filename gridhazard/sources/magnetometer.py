"""Magnetometer files: IAGA-2002 minute text and already processed CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING_FROM = 88888.0  # 88888 and 99999 mark missing components


def parse_iaga_lines(lines: DataFrame) -> DataFrame:
    """``lines(file, value)`` -> (file, site, ts, x, y, z, f, latitude, longitude).

    Header lines end with a bar and hold a key in columns 2-24 and a value after
    it; the longitude turns from 0..360 to -180..180 by subtracting 360.
    """
    bar = F.rtrim("value").endswith("|")
    key, val = F.lower(F.trim(F.substring("value", 2, 23))), F.trim(F.regexp_replace(F.substring("value", 25, 60), r"\|\s*$", ""))
    pick = lambda name: F.max(F.when(key == name, val))
    head = lines.filter(bar).groupBy("file").agg(
        pick("iaga code").alias("site"), pick("geodetic latitude").try_cast("double").alias("latitude"),
        (pick("geodetic longitude").try_cast("double") - 360).alias("longitude"),
    )
    p = F.split(F.trim("value"), r"\s+")

    def component(k):
        v = F.get(p, F.lit(k)).try_cast("double")
        return F.when(F.abs(v) < MISSING_FROM, v)

    rows = lines.filter(~bar & F.col("value").rlike(r"^\d{4}-\d{2}-\d{2} ")).select(
        "file", F.try_to_timestamp(F.concat_ws(" ", p[0], p[1])).alias("ts"),
        *[component(3 + k).alias(c) for k, c in enumerate("xyzf")],
    )
    return rows.join(head, "file")


def read_iaga(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return parse_iaga_lines(lines.select(F.col("_metadata.file_path").alias("file"), "value"))


def read_processed(spark: SparkSession, path: str, sites=None) -> DataFrame:
    """Processed CSV files; the site is the parent folder's name, optionally an allow-list."""
    d = spark.read.option("header", True).option("recursiveFileLookup", "true").schema(
        "ts timestamp, X double, Y double, Z double, Latitude double, Longitude double"
    ).csv(path)
    d = d.withColumn("site", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
    return on_list(d, sites) if sites else d


def on_list(df: DataFrame, sites) -> DataFrame:
    """Rows of the listed sites, whatever the letter case."""
    return df.filter(F.upper("site").isin([s.upper() for s in sites]))
