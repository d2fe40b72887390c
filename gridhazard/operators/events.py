"""Storm catalogue operators on gridded index series.

A series has an integer position ``t`` (epoch hours) and one row per position,
so its size is bounded by the calendar and not by the raw readings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridhazard.operators.ordered import islands, neighbours_known, shifted
from gridhazard.session import cut_lineage

DAY = 24


def gridded(df: DataFrame, keys, t, **aggs) -> DataFrame:
    """Collapse raw readings to one row per (keys, t); partial sums run before the shuffle."""
    return df.groupBy(*keys, F.col(t).alias("t") if t != "t" else "t").agg(
        *[c.alias(n) for n, c in aggs.items()]
    )


def day_of(t="t"):
    return F.floor(F.col(t) / DAY)


def threshold_times(series, dst="dst", kp="kp", dst_max=-150.0, kp_min=8.0) -> DataFrame:
    """Positions where either index crosses its storm threshold."""
    low = series.filter(F.col(dst) <= dst_max).select("t")
    high = series.filter(F.col(kp) >= kp_min).select("t")
    return low.union(high).distinct()


def storm_sessions(times, gap=DAY, pad=DAY) -> DataFrame:
    """Runs of storm times. Joining runs at most ``2 * gap`` apart after a first pass
    with ``gap`` is the same as one pass with ``2 * gap``."""
    runs = islands(times.withColumn("day", day_of()), [], "day", "t", 2 * gap)
    return (
        runs.groupBy("island")
        .agg(F.min("t").alias("a"), F.max("t").alias("b"))
        .select(
            (F.col("a") - pad).alias("start_t"),
            (F.col("b") + pad).alias("end_t"),
            (F.col("b") - F.col("a") + 2 * pad).alias("duration_h"),
        )
    )


def hour_spine(series, keys, t="t") -> DataFrame:
    """Every hour between the first and last position of each key."""
    return (
        series.groupBy(*keys)
        .agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
        .select(*keys, F.explode(F.sequence("_a", "_b")).alias("t"))
    )


def forward_filled(coarse, fine, value, out) -> DataFrame:
    """Last known coarse value at or before each fine position."""
    d = fine.select("t").join(coarse.select("t", value), "t", "full_outer")
    d = neighbours_known(d.withColumn("day", day_of()), [], "day", "t", value)
    return fine.join(d.select("t", F.col("prev.v").alias(out)), "t", "left")


def _local_minima(cand: DataFrame, half: int, keys=()) -> DataFrame:
    """Candidates that are the least (v, t) of all candidates within ``half``.

    A bucket spans ``half`` positions, so a candidate only has to be shown to its
    own and the two neighbouring buckets: at most 3 * half rows per group.
    """
    keys = list(keys)
    home = F.floor(F.col("t") / half)
    spread = cand.withColumn("_home", home).withColumn(
        "_b", F.explode(F.array(F.col("_home") - 1, F.col("_home"), F.col("_home") + 1))
    )
    w = Window.partitionBy(*keys, "_b").orderBy("t").rangeBetween(-half, half)
    return (
        spread.withColumn("_best", F.min(F.struct("v", "t")).over(w))
        .filter((F.col("_b") == F.col("_home")) & (F.col("_best.t") == F.col("t")))
        .select(*keys, "t", "v")
    )


def around(points: DataFrame, half: int, keys=()) -> DataFrame:
    """Every position within ``half`` of a point."""
    return points.select(
        *keys, F.explode(F.sequence(F.col("t") - half, F.col("t") + half)).alias("t")
    ).distinct()


def exclusion_picks(candidates: DataFrame, half: int, keys=()) -> DataFrame:
    """Greedy extremal exclusion over ``candidates(t, v)``, least ``v`` first, ties to the earliest.

    Taking the global minimum and masking its surroundings again and again picks
    exactly the points that win their surroundings once every stronger winner has
    been masked. So all current local minima can be taken at once; a few rounds
    settle the series. Each round is cut by a reliable checkpoint.
    """
    keys = list(keys)
    left = cut_lineage(candidates.select(*keys, "t", "v"))
    picks = None
    while not left.isEmpty():
        won = cut_lineage(_local_minima(left, half, keys))
        picks = won if picks is None else picks.union(won)
        left = cut_lineage(left.join(around(won, half, keys), keys + ["t"], "left_anti"))
    return picks if picks is not None else candidates.select(*keys, "t", "v").limit(0)


def greedy_phase(series: DataFrame, value, threshold, half, inclusive=False) -> DataFrame:
    """One search phase: all picks below ``threshold`` and the first pick that fails it."""
    open_points = series.filter(F.col(value).isNotNull()).select("t", F.col(value).alias("v"))
    passes = (F.col("v") <= threshold) if inclusive else (F.col("v") < threshold)
    picks = exclusion_picks(open_points.filter(passes), half)
    rest = open_points.join(around(picks, half), "t", "left_anti")
    last = rest.orderBy("v", "t").limit(1)
    return picks.withColumn("terminating", F.lit(0)).union(last.withColumn("terminating", F.lit(1)))


def greedy_storms(series, dst="dst", kp="kp", dst_max=-140.0, kp_min=8.0, half=36) -> DataFrame:
    """Dst phase, then Kp phase (as ``-kp``) on what the first phase left unmasked."""
    first = cut_lineage(greedy_phase(series, dst, dst_max, half))
    open_series = series.join(around(first, half), "t", "left_anti").withColumn("_nk", -F.col(kp))
    second = greedy_phase(open_series, "_nk", -kp_min, half, inclusive=True)
    return first.select("t", F.col("v").alias("value"), "terminating", F.lit(1).alias("phase")).union(
        second.select("t", (-F.col("v")).alias("value"), "terminating", F.lit(2).alias("phase"))
    )


def mask_runs(series, mask, min_hours=3) -> DataFrame:
    """Contiguous runs of masked rows (by row order), short runs dropped."""
    d = series.withColumn("day", day_of())
    d = shifted(d, [], "day", "t", mask, "_before", 1)
    edge = F.col(mask) & ~F.coalesce(F.col("_before"), F.lit(False))
    d = d.withColumn("_start", F.when(edge, F.col("t")))
    d = neighbours_known(d.drop("_before"), [], "day", "t", "_start", prefix="_s")
    return (
        d.filter(F.col(mask))
        .groupBy(F.col("_sprev.v").alias("start_t"))
        .agg(F.max("t").alias("end_t"))
        .filter(F.col("end_t") - F.col("start_t") >= min_hours)
    )


def in_windows(rows, windows, t="t", bucket=DAY) -> DataFrame:
    """Closed interval join: windows are spread over day buckets, rows find theirs by equality."""
    spread = windows.withColumn(
        "_d",
        F.explode(F.sequence(F.floor(F.col("start_t") / bucket), F.floor(F.col("end_t") / bucket))),
    )
    return (
        rows.withColumn("_d", F.floor(F.col(t) / bucket))
        .join(spread, "_d")
        .filter(F.col(t).between(F.col("start_t"), F.col("end_t")))
        .drop("_d")
    )


def classify_runs(runs, series, dst="dst", kp="kp", dst_max=-140.0, kp_min=8.0) -> DataFrame:
    """Which thresholds each run meets."""
    return (
        in_windows(series, runs)
        .groupBy("start_t", "end_t")
        .agg(F.max(kp).alias("max_kp"), F.min(dst).alias("min_dst"))
        .withColumn(
            "class",
            F.when((F.col("max_kp") >= kp_min) & (F.col("min_dst") <= dst_max), "both")
            .when(F.col("max_kp") >= kp_min, "kp")
            .when(F.col("min_dst") <= dst_max, "dst")
            .otherwise("neither"),
        )
    )


def overlapping(windows, named, bucket=DAY) -> DataFrame:
    """Pairs of windows and named events that overlap (closed ends)."""

    def spread(df, a, b):
        return df.withColumn(
            "_d", F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket)))
        )

    left = spread(windows, "start_t", "end_t")
    right = spread(named, "event_start", "event_end")
    first_shared = F.floor(F.greatest("start_t", "event_start") / bucket)
    # A pair that shares several buckets is kept only in the first shared one.
    return (
        left.join(right, "_d")
        .filter((F.col("start_t") <= F.col("event_end")) & (F.col("end_t") >= F.col("event_start")))
        .filter(F.col("_d") == first_shared)
        .drop("_d")
    )
