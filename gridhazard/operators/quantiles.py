"""Exact percentiles (linear interpolation) for groups of any size.

Spark's ``percentile`` keeps every distinct value of a group in one aggregation
buffer. That is the cheapest plan where something else bounds the groups, such as
the number of realizations, and the wrong one for a group that holds a third of a
huge table. The caller says which it is. Groups without a bound are narrowed down by
counting: each level splits the value range of a group into cells, counts them with
map-side partial sums and keeps only the cells that hold a wanted rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridhazard.session import cut_lineage

CELLS = 1024


def exact_quantiles(df, keys, value, probs, names=None, bounded=False, levels=2):
    """One row per key with a column per probability; nulls and NaN are ignored.

    ``bounded``: the groups are known to fit an aggregation buffer.
    """
    keys = list(keys)
    names = list(names or [f"p{int(round(p * 100)):02d}" for p in probs])
    d = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    if bounded:
        q = d.groupBy(*keys).agg(F.percentile("_v", [float(p) for p in probs]).alias("_q"))
        return q.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    return _by_counting(d, keys, probs, names, levels)


def _by_counting(d, keys, probs, names, levels):
    d = cut_lineage(d)  # every level reads it twice
    stats = d.groupBy(*keys).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    wanted = F.array(
        *[
            F.struct(F.lit(i).alias("q"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("pos"))
            for i, p in enumerate(probs)
        ]
    )
    ranks = (
        stats.withColumn("_w", F.explode(wanted))
        .withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1))))
        .select(
            *keys,
            F.col("_w.q").alias("_q"),
            F.col("_side"),
            (F.col("_w.pos") - F.floor("_w.pos")).alias("_frac"),
            F.when(F.col("_side") == 0, F.floor("_w.pos"))
            .otherwise(F.ceil("_w.pos"))
            .cast("bigint")
            .alias("_rank"),
            F.lit(0).cast("bigint").alias("_cell"),
            "_lo",
            "_hi",
        )
    )
    d = d.withColumn("_cell", F.lit(0).cast("bigint"))
    for _ in range(levels):
        d, ranks = _narrow(d, ranks, keys)
    return _pick(d, ranks, keys, names)


def _narrow(d, ranks, keys):
    on = keys + ["_cell"]
    bounds = ranks.select(*on, "_lo", "_hi").distinct()
    share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    sub = F.when(F.col("_hi") > F.col("_lo"), F.floor(share * CELLS)).otherwise(F.lit(0))
    sub = F.least(sub, F.lit(CELLS - 1)).cast("bigint")
    d = d.join(bounds, on).select(*on, "_v", sub.alias("_sub"))
    w = Window.partitionBy(*on).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    # At most CELLS rows per (key, cell): small whatever the group size.
    hist = (
        d.groupBy(*on, "_sub")
        .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo2"), F.max("_v").alias("_hi2"))
        .withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    )
    nxt = (
        ranks.join(hist, on)
        .filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_c")))
        .select(
            *keys, "_q", "_side", "_frac",
            (F.col("_rank") - F.col("_before")).alias("_rank"),
            (F.col("_cell") * CELLS + F.col("_sub")).alias("_cell"),
            F.col("_lo2").alias("_lo"),
            F.col("_hi2").alias("_hi"),
        )
    )
    d = d.select(*keys, (F.col("_cell") * CELLS + F.col("_sub")).alias("_cell"), "_v")
    return d, nxt


def _pick(d, ranks, keys, names):
    on = keys + ["_cell"]
    needed = ranks.select(*on).distinct()
    w = Window.partitionBy(*on).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    # Copies of a value collapse to one row before the ordered step.
    values = (
        d.join(needed, on, "left_semi")
        .groupBy(*on, "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    )
    hit = ranks.join(values, on).filter(
        (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_c"))
    )
    low = lambda i: F.max(F.when((F.col("_q") == i) & (F.col("_side") == 0), F.col("_v")))
    high = lambda i: F.max(F.when((F.col("_q") == i) & (F.col("_side") == 1), F.col("_v")))
    frac = lambda i: F.max(F.when(F.col("_q") == i, F.col("_frac")))
    return hit.groupBy(*keys).agg(
        *[(low(i) + (high(i) - low(i)) * frac(i)).alias(n) for i, n in enumerate(names)]
    )


def mode_per_key(df, keys, value, out):
    """Most frequent non-null value per key, smallest on ties, counted in two steps."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_c")
    )
    best = F.min(F.struct((-F.col("_c")).alias("c"), F.col(value).alias("v")))
    return counts.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.v").alias(out))
