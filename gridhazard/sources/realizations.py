"""Files written per network realization, and long return-level tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def realization_number(name):
    """'winding_gic_rand_17.csv' -> 17; names without a number give null."""
    digits = F.regexp_extract(name, r"_?(\d+)\.csv$", 1)
    return F.when(digits != "", digits).cast("int")


def read_realizations(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All realization files of a pattern as one table with a ``realization`` column."""
    d = spark.read.option("header", True).schema(schema).csv(pattern)
    return d.withColumn("realization", realization_number(F.col("_metadata.file_name")))


def scenario_period(scenario):
    """Return period in a scenario name, null for named storms."""
    digits = F.regexp_extract(scenario, r"(\d+)", 1)
    return F.when(digits != "", digits).cast("int")


def return_level_store(levels: DataFrame, events: DataFrame) -> DataFrame:
    """Predictions and event maxima in one long table; event fields E are scaled by 1/1000 once."""
    scale = F.when(F.col("quantity") == "E", F.col("value") / 1000).otherwise(F.col("value"))
    ev = events.select("quantity", "entity_id", F.col("event").alias("scenario"), scale.alias("value"))
    lv = levels.select("quantity", "entity_id", F.concat(F.lit("V_"), "period").alias("scenario"), "value")
    return lv.unionByName(ev)
