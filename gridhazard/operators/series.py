"""Cleaning and alignment of sensor series on a fixed time grid."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridhazard.operators.ordered import neighbours_known, shifted

CHUNK = 240  # grid positions per window group
SPINE_ROWS = 1_000_000  # stretched rows per task: they are few before they are stretched, so their bytes say little


def chunk_of(t="t", size=CHUNK):
    return F.floor(F.col(t) / size)


def whole_day_spine(series, keys, day=24) -> DataFrame:
    """All positions of every day between the first and last reading of a key."""
    return (
        series.groupBy(*keys)
        .agg(
            (F.floor(F.min("t") / day) * day).alias("_a"),
            (F.floor(F.max("t") / day) * day + day - 1).alias("_b"),
        )
        .select(*keys, F.explode(F.sequence("_a", "_b")).alias("t"))
    )


def nearest_filled(series, keys, value, out) -> DataFrame:
    """Fill gaps with the nearest reading in time (ties to the earlier one), edges included."""
    d = neighbours_known(series.withColumn("_c", chunk_of()), keys, "_c", "t", value)
    back, ahead = F.col("t") - F.col("prev.o0"), F.col("next.o0") - F.col("t")
    pick = F.when(
        F.col("prev").isNotNull() & (F.col("next").isNull() | (back <= ahead)), F.col("prev.v")
    ).otherwise(F.col("next.v"))
    return d.withColumn(out, pick).drop("_c", "prev", "next")


def detrended(series, keys, value, out) -> DataFrame:
    """Residual of a straight least-squares line over the sample index of each key."""
    # The slope does not depend on where the index starts, so the position itself serves.
    d = series.withColumn("_i", F.col("t").cast("double"))
    fit = d.groupBy(*keys).agg(
        F.regr_slope(value, "_i").alias("_s"), F.avg(value).alias("_m"), F.avg("_i").alias("_im")
    )
    return (
        d.join(fit, list(keys))
        .withColumn(out, F.col(value) - F.col("_m") - F.col("_s") * (F.col("_i") - F.col("_im")))
        .drop("_i", "_s", "_m", "_im")
    )


def complete_channels(df, site, channel, names) -> DataFrame:
    """Rows of the sites that deliver every channel."""
    have = df.groupBy(site).agg(
        *[F.max(F.when(F.col(channel) == n, 1).otherwise(0)).alias(f"_{i}") for i, n in enumerate(names)]
    )
    full = have.filter(sum(F.col(f"_{i}") for i in range(len(names))) == len(names)).select(site)
    return df.join(full, site, "left_semi")


def channels_side_by_side(df, site, t, channel, value, names) -> DataFrame:
    """One column per channel on the union of the timestamps."""
    return df.groupBy(site, t).pivot(channel, list(names)).agg(F.max(value))


def sites_with(df, site, value) -> DataFrame:
    """Drop sites that never have ``value``."""
    dead = df.groupBy(site).agg(F.count(value).alias("_n")).filter(F.col("_n") == 0).select(site)
    return df.join(dead, site, "left_anti")


def on_shared_grid(df, keys, value, out) -> DataFrame:
    """First value per (key, t) on every position that occurs anywhere in the data.

    The positions present are a short list, so every key is stretched over them in place. Rows are dealt by the
    first key before that, and neither the stretched rows nor what is grouped by this key later is exchanged.
    """
    conf = df.sparkSession.conf
    # A join on all keys may stay dealt by the first. Without this setting the result is the same, over more exchanges.
    conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    many, long = df.agg(F.count_distinct(*keys), F.count_distinct("t")).first()
    # With fewer partitions than usual Spark deals again, by all keys.
    parts = max(math.ceil(many * long / SPINE_ROWS), int(conf.get("spark.sql.shuffle.partitions")))
    first = df.repartition(parts, keys[0]).groupBy(*keys, "t").agg(F.min_by(value, "seq").alias(out))
    present = df.agg(F.collect_set("t").alias("ts")).scalar()
    spine = df.select(*keys).distinct().repartition(parts, keys[0]).select(*keys, F.explode(present).alias("t"))
    return spine.join(first, list(keys) + ["t"], "left")


def complete_in_window(cut, window, site, value) -> DataFrame:
    """Rows of the sites without a missing value in a window."""
    broken = (
        cut.groupBy(window, site).agg(F.max(F.col(value).isNull().cast("int")).alias("_m"))
        .filter(F.col("_m") == 1).select(window, site)
    )
    return cut.join(broken, [window, site], "left_anti")


def common_positions(cut, window, site, t="t") -> DataFrame:
    """Positions at which every site of a window has a row."""
    per_pos = cut.select(window, t, site).distinct().groupBy(window, t).agg(
        F.count(F.lit(1)).alias("_k")
    )
    per_win = cut.select(window, site).distinct().groupBy(window).agg(F.count(F.lit(1)).alias("_n"))
    return per_pos.join(per_win, window).filter(F.col("_k") == F.col("_n")).select(window, t)


def moving_average3(series, value, out, keys=()) -> DataFrame:
    """Centred mean of three rows; the end rows repeat themselves."""
    keys = list(keys)
    d = series.withColumn("_c", chunk_of())
    d = shifted(d, keys, "_c", "t", value, "_l", 1)
    d = shifted(d, keys, "_c", "t", value, "_r", -1)
    v = F.col(value)
    return d.withColumn(out, (F.coalesce("_l", v) + v + F.coalesce("_r", v)) / 3.0).drop("_c", "_l", "_r")


def local_maxima(series, value, keys=()) -> DataFrame:
    """Rows strictly above both neighbours."""
    keys = list(keys)
    d = series.withColumn("_c", chunk_of())
    d = shifted(d, keys, "_c", "t", value, "_l", 1)
    d = shifted(d, keys, "_c", "t", value, "_r", -1)
    return d.filter((F.col(value) > F.col("_l")) & (F.col(value) > F.col("_r"))).drop("_c", "_l", "_r")


def window_arrays(series, window, value) -> DataFrame:
    """One row per storm window with its samples in time order.

    A window on a fixed grid holds at most its length over the cadence samples
    (some thousands), whatever the number of sites and raw readings.
    """
    packed = F.array_sort(F.collect_list(F.struct("t", F.col(value).alias("s"))))
    return series.groupBy(window).agg(packed.alias("samples"))


def prominence(height, samples, t):
    """Height above the higher of the two lowest points reached before a higher sample."""
    inf = F.lit(float("inf"))

    def base(items):
        return F.aggregate(
            items, inf,
            lambda acc, x: F.when(x["s"] > height, inf).otherwise(F.least(acc, x["s"])),
        )

    left = base(F.filter(samples, lambda x: x["t"] <= t))
    right = base(F.reverse(F.filter(samples, lambda x: x["t"] >= t)))
    return height - F.greatest(left, right)


def gaussian_weights(sigma: float, radius: int) -> list[float]:
    import math

    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(raw) for x in raw]


def gaussian_smoothed(samples, sigma: float):
    """Gaussian filter of a sample array, mirrored at both ends (radius 4 sigma)."""
    radius = int(4 * sigma + 0.5)
    weights = gaussian_weights(sigma, radius)
    n = F.size(samples)

    def at(i):
        m = F.pmod(i, 2 * n)
        j = F.when(m >= n, 2 * n - 1 - m).otherwise(m)
        return F.element_at(samples, (j + 1).cast("int"))["s"]

    def one(x, i):
        total = sum(F.lit(w) * at(i + (k - radius)) for k, w in enumerate(weights))
        return F.struct(x["t"].alias("t"), total.alias("s"))

    return F.transform(samples, one)


def trimmed(series, window, site, trim: int) -> DataFrame:
    """Drop ``trim`` samples at both ends of each (window, site); fewer when it is too short."""
    w = Window.partitionBy(window, site)
    fewer = F.greatest(F.lit(0), F.floor((F.col("_n") - 1) / 2))
    return (
        series.withColumns(
            {"_n": F.count(F.lit(1)).over(w), "_i": F.row_number().over(w.orderBy("t")) - 1}
        )
        .withColumn("_cut", F.when(2 * trim >= F.col("_n"), fewer).otherwise(F.lit(trim)))
        .filter((F.col("_i") >= F.col("_cut")) & (F.col("_i") < F.col("_n") - F.col("_cut")))
        .drop("_n", "_i", "_cut")
    )


def screened_bands(bands, screened_sites, max_abs_z=100.0, min_periods=8) -> DataFrame:
    """Impedance bands after dropping bad ones at the screened sites.

    A band is bad when any element has a non-positive or non-finite variance, or
    a non-finite or too large impedance; a site left with too few bands goes.
    """
    from gridhazard.functions.scalar import finite, magnitude

    z = magnitude(F.col("z_re"), F.col("z_im"))
    bad = ~(finite(F.col("z_var")) & (F.col("z_var") > 0) & finite(z) & (z <= max_abs_z))
    per_band = bands.groupBy("site", "period").agg(F.max(bad.cast("int")).alias("bad"))
    listed = screened_sites.select("site").distinct().withColumn("_listed", F.lit(1))
    judged = per_band.join(listed, "site", "left")
    kept = judged.filter(F.col("_listed").isNull() | (F.col("bad") == 0))
    poor = (
        judged.filter(F.col("_listed") == 1).groupBy("site")
        .agg(F.sum(1 - F.col("bad")).alias("_k")).filter(F.col("_k") < min_periods).select("site")
    )
    return kept.join(poor, "site", "left_anti").select("site", "period")


def series_faults(df, keys, x, y) -> DataFrame:
    """Why a predicted series is unusable: NaN, infinite or all (almost) zero."""
    inf = float("inf")

    def seen(cond):
        return F.max(cond.cast("int")) == 1

    a, b = F.col(x), F.col(y)
    size = F.greatest(F.abs(a), F.abs(b))
    return df.groupBy(*keys).agg(
        F.concat_ws(
            "; ",
            F.when(seen(F.isnan(a) | F.isnan(b)), "nan"),
            F.when(seen((F.abs(a) == inf) | (F.abs(b) == inf)), "inf"),
            F.when(F.max(size) < 1e-8, "zero"),
        ).alias("reasons")
    ).filter(F.col("reasons") != "")
