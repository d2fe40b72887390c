"""Statistics over network realizations and effective transformer currents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridhazard.functions.scalar import finite, nan_to_null
from gridhazard.operators.quantiles import exact_quantiles

PERCENTILES = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def realization_stats(df, keys, value) -> DataFrame:
    """Count, moments, extremes and percentiles over realizations, NaN ignored."""
    v = nan_to_null(F.col(value))
    d = df.select(*keys, v.alias("_x"))
    base = d.groupBy(*keys).agg(
        F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"),
        F.min("_x").alias("min"), F.max("_x").alias("max"),
    )
    q = exact_quantiles(d, keys, "_x", list(PERCENTILES.values()), list(PERCENTILES), bounded=True)  # realizations
    return base.join(q, list(keys), "left")


def running_moments(df, keys, value) -> DataFrame:
    """Mean, population deviation and a two-deviation band; partial sums only."""
    return with_band(
        df.groupBy(*keys).agg(
            F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
        )
    )


def with_band(stats) -> DataFrame:
    return stats.withColumns(
        {"low": F.col("mean") - 2 * F.col("std"), "high": F.col("mean") + 2 * F.col("std")}
    )


def matching_files(df, file) -> DataFrame:
    """Rows of the files whose row count is the most frequent one (ties to the smaller count)."""
    sizes = df.groupBy(file).agg(F.count(F.lit(1)).alias("_rows"))
    common = (
        sizes.groupBy("_rows").agg(F.count(F.lit(1)).alias("_files"))
        .agg(F.min(F.struct((-F.col("_files")).alias("f"), F.col("_rows").alias("r"))).alias("_m"))
        .select(F.col("_m.r"))
    )
    good = sizes.filter(F.col("_rows") == common.scalar()).select(file)
    return df.join(good, file, "left_semi")


def transformer_meta(windings, keys=("realization", "transformer")) -> DataFrame:
    """First substation and rounded coordinates per transformer."""
    first = F.min_by(F.struct("sub_id", "latitude", "longitude"), "seq")
    return windings.groupBy(*keys).agg(first.alias("m")).select(
        *keys, "m.sub_id", F.bround("m.latitude", 2).alias("latitude"),
        F.bround("m.longitude", 2).alias("longitude"),
    )


def winding_table(windings, keys) -> DataFrame:
    """One column per winding."""
    return windings.groupBy(*keys).pivot("winding", ["HV", "LV", "Series", "Common"]).agg(
        F.min_by("gic", "seq")
    )


def voltage_ratio(bus1, bus2):
    """Lower over higher bus voltage, read from the end of the bus names."""
    v1 = F.element_at(F.split(bus1, "_"), -1).try_cast("double")
    v2 = F.element_at(F.split(bus2, "_"), -1).try_cast("double")
    return F.try_divide(F.least(v1, v2), F.greatest(v1, v2))


def effective_current(kind, hv, lv, series, common, ratio):
    """Effective current by transformer type."""
    return (
        F.when(kind.isin("GSU", "GSU w/ GIC BD", "GY-D", "GY-D w/ GIC BD"), hv)
        .when(kind == "Auto", series + common * ratio)
        .when(kind.isin("GY-GY", "GY-GY-D"), hv + lv * ratio)
    )


def polarity(series, key, value) -> DataFrame:
    """Sign of the median of the strongest 5 percent of a line's voltage series.

    Falls back to the sign at the largest magnitude, then to +1.
    """
    d = series.select(key, "t", F.col(value).alias("_v"), F.abs(value).alias("_a"))
    p95 = exact_quantiles(d, [key], "_a", [0.95], ["_p"])
    strong = d.join(p95, key).filter(F.col("_a") >= F.col("_p"))
    med = exact_quantiles(strong, [key], "_v", [0.5], ["_m"])
    peak = d.groupBy(key).agg(
        F.min(F.struct((-F.col("_a")).alias("a"), F.col("t"), F.col("_v").alias("v"))).alias("_k")
    )
    sign = F.coalesce(
        F.nullif(F.signum("_m"), F.lit(0.0)), F.nullif(F.signum("_k.v"), F.lit(0.0)), F.lit(1.0)
    )
    return peak.join(med, key, "left").select(key, sign.alias("sgn"))
