"""Geomagnetic index files and the storm catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING_DST = 99999.99
STORM_SCHEMA = "start timestamp_ntz, end timestamp_ntz"


def parse_kp_lines(lines: DataFrame) -> DataFrame:
    """Whitespace text of ten columns -> typed Kp/ap rows with class and timestamp."""
    p = F.split(F.trim("value"), r"\s+")
    i = lambda k, t: F.get(p, F.lit(k)).try_cast(t)
    d = lines.filter(F.size(p) == 10).select(
        i(0, "int").alias("year"), i(1, "int").alias("month"), i(2, "int").alias("day"), i(3, "double").alias("hour"),
        i(4, "double").alias("frac_hour"), i(5, "double").alias("decimal_date1"), i(6, "double").alias("decimal_date2"),
        i(7, "double").alias("kp"), i(8, "int").alias("ap"), i(9, "int").alias("flag"),
    )
    return d.withColumns({
        "kp_0to9": F.bround(F.col("kp") * 3).cast("int"),
        "ts": F.make_timestamp_ntz("year", "month", "day", F.col("hour").cast("int"), F.lit(0), F.lit(0)),
    })


def read_kp(spark: SparkSession, path: str) -> DataFrame:
    return parse_kp_lines(spark.read.text(path))


def parse_dst_lines(lines: DataFrame) -> DataFrame:
    """Dst text: lines with a bar and lines without exactly four tokens go, so do missing values."""
    p = F.split(F.trim("value"), r"\s+")
    d = lines.filter(~F.col("value").contains("|")).filter(F.size(p) == 4)
    return d.select(
        F.try_to_timestamp(F.concat_ws(" ", p[0], p[1])).cast("timestamp_ntz").alias("ts"),
        p[2].try_cast("int").alias("doy"), p[3].try_cast("double").alias("dst"),
    ).filter(F.col("dst") != MISSING_DST)


def read_dst(spark: SparkSession, path: str) -> DataFrame:
    return parse_dst_lines(spark.read.text(path))


def read_storms(spark: SparkSession, path: str, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """Storm catalogue CSV with duration; optionally restricted to a range of start years."""
    d = spark.read.schema(STORM_SCHEMA).option("header", True).csv(path)
    d = d.withColumn("duration", F.col("end") - F.col("start"))
    if first_year is not None:
        d = d.filter(F.year("start") >= first_year)
    if last_year is not None:
        d = d.filter(F.year("start") <= last_year)
    return d
