"""Tables behind reports: bins, ratios, rankings, error bars, lattices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binned(x, edges):
    """Label of the half-open bin holding ``x``; values beyond fall in the last bin."""
    label = lambda a, b: F.lit(f"{a}-{b}")
    last = label(edges[-2], edges[-1])
    return reduce(
        lambda rest, ab: F.when((x >= ab[0]) & (x < ab[1]), label(*ab)).otherwise(rest),
        reversed(list(zip(edges, edges[1:]))),
        last,
    )


def ratio_to(df, key, value, base) -> DataFrame:
    """Value of every other scenario over the value of scenario ``base``."""
    b = df.filter(F.col("scenario") == base).select(key, F.col(value).alias("_b"))
    r = df.filter(F.col("scenario") != base).join(b, key)
    return r.withColumn("ratio", F.try_divide(F.col(value), F.col("_b"))).filter(F.col("ratio").isNotNull()).drop("_b")


def impact_by_confidence(io, scale=1.0, leave_out=()) -> DataFrame:
    """|sum of direct| and |sum of total| per scenario: the mean and its distance to p5 and p95."""
    d = io.filter(~F.col("scenario").isin(list(leave_out))) if leave_out else io
    sums = d.groupBy("scenario").pivot("confidence", ["mean", "p5", "p95"]).agg(
        F.abs(F.sum("direct_shock")).alias("direct"), F.abs(F.sum("total_impact")).alias("total")
    )
    cols = ["scenario"]
    for k in ("direct", "total"):
        mean, a, b = (F.col(f"{c}_{k}") / scale for c in ("mean", "p5", "p95"))
        cols += [mean.alias(k), (mean - F.least(a, b)).alias(f"{k}_minus"), (F.greatest(a, b) - mean).alias(f"{k}_plus")]
    return sums.select(*cols)


def sector_ranking(io, scenario) -> DataFrame:
    """Sectors of a scenario by |total| of the mean, with distances to the outer bounds."""
    wide = io.filter(F.col("scenario") == scenario).groupBy("sector").pivot(
        "confidence", ["mean", "p5", "p95"]
    ).agg(F.sum("total_impact"))
    low, high = F.least("p5", "p95"), F.greatest("p5", "p95")
    return wide.select(
        "sector", F.col("mean").alias("total"), F.abs(F.col("mean") - low).alias("err_low"),
        F.abs(high - F.col("mean")).alias("err_high"),
    )


def scenario_totals(io) -> DataFrame:
    """Direct, indirect and total impact per scenario with half the p5-p95 range as error."""
    sums = io.groupBy("scenario").pivot("confidence", ["mean", "p5", "p95"]).agg(
        F.sum("direct_shock").alias("direct"), F.sum("multiplier_effect").alias("indirect"),
        F.sum("total_impact").alias("total"),
    )
    cols = ["scenario"]
    for k in ("direct", "indirect", "total"):
        cols += [F.col(f"mean_{k}").alias(k), (F.abs(F.col(f"p95_{k}") - F.col(f"p5_{k}")) / 2).alias(f"{k}_err")]
    return sums.select(*cols)
