"""Field synthesis, line voltages, peaks and storm maxima."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridhazard.operators.events import exclusion_picks
from gridhazard.operators.ordered import top_per_key
from gridhazard.operators.series import gaussian_smoothed, local_maxima, prominence, window_arrays

EARTH_M, CURRENT_HEIGHT_M = 6371e3, 110e3
POLE_LAT, POLE_LON = (15.0, 85.0, 36), (-175.0, -25.0, 76)
GROUP_SITES = 256  # sites of a storm weighed in one group, on average: some 6 MB for each of its matrices
LINE_BLOCKS, FIELD_PARTS = 128, 2  # tasks of the product of weights and field, arrays of a site's field


# ---------------------------------------------------------------- peaks


def _scored(candidates, series, share) -> DataFrame:
    """Add the prominence and keep peaks at least ``share`` of the window's top."""
    arrays = window_arrays(series, "storm", "s")
    top = F.array_max(F.transform("samples", lambda x: x["s"]))
    return (
        candidates.join(arrays, "storm")
        .withColumn("prominence", prominence(F.col("s"), F.col("samples"), F.col("t")))
        .filter(F.col("prominence") >= F.greatest(F.lit(1e-12), F.lit(share) * top))
        .drop("samples")
    )


def activity_peaks(series, distance=10, share=0.2, top=3) -> DataFrame:
    """Highest separated, prominent peaks of ``series(storm, t, s)``; the maximum if there is none."""
    maxima = local_maxima(series, "s", ["storm"]).select("storm", "t", (-F.col("s")).alias("v"))
    apart = exclusion_picks(maxima, distance - 1, ["storm"]).select("storm", "t", (-F.col("v")).alias("s"))
    found = _scored(apart, series, share)
    best = top_per_key(found, ["storm"], [F.desc("s"), "t"], top)
    missing = series.join(found.select("storm").distinct(), "storm", "left_anti")
    fallback = top_per_key(missing, ["storm"], [F.desc("s"), "t"], 1)
    cols = ["storm", "t", "s", "prominence"]
    return best.select(*cols).union(
        fallback.withColumn("prominence", F.lit(None).cast("double")).select(*cols)
    )


def smoothed_storm_peaks(series, sigma=1.0, share=0.1, top=500) -> DataFrame:
    """Most prominent peaks of the Gaussian-smoothed ``series(storm, t, s)``."""
    smooth = (
        window_arrays(series, "storm", "s")
        .select("storm", F.explode(gaussian_smoothed(F.col("samples"), sigma)).alias("x"))
        .select("storm", "x.t", "x.s")
    )
    found = _scored(local_maxima(smooth, "s", ["storm"]).select("storm", "t", "s"), smooth, share)
    return top_per_key(found, ["storm"], [F.desc("prominence"), "t"], top)


# ------------------------------------------------------- current systems


def _unit_currents(lat, lon) -> tuple[np.ndarray, np.ndarray]:
    """North and east ground field of a unit divergence-free current at each pole."""
    plat, plon = np.meshgrid(np.linspace(*POLE_LAT), np.linspace(*POLE_LON), indexing="ij")
    la, lo = np.radians(np.asarray(lat, float))[:, None], np.radians(np.asarray(lon, float))[:, None]
    pa, po = np.radians(plat.ravel())[None, :], np.radians(plon.ravel())[None, :]
    cos_t = np.clip(np.sin(la) * np.sin(pa) + np.cos(la) * np.cos(pa) * np.cos(po - lo), -1.0, 1.0)
    sin_t = np.sqrt(np.maximum(1.0 - cos_t**2, 1e-24))
    x = EARTH_M / (EARTH_M + CURRENT_HEIGHT_M)
    root = np.sqrt(1.0 - 2.0 * x * cos_t + x * x)
    away = -1e-7 / (EARTH_M * sin_t) * ((x - cos_t) / root + cos_t)
    bearing = np.arctan2(
        np.sin(po - lo) * np.cos(pa), np.cos(la) * np.sin(pa) - np.sin(la) * np.cos(pa) * np.cos(po - lo)
    )
    return -away * np.cos(bearing), -away * np.sin(bearing)


def transfer_matrix(obs_lat, obs_lon, site_lat, site_lon, cutoff=0.05) -> np.ndarray:
    """Linear map from (bx, by) at the observatories to (bx, by) at the sites.

    Rows: bx of all sites, then by. Columns: bx of all observatories, then by.
    """
    fit = np.vstack(_unit_currents(obs_lat, obs_lon))
    u, s, vt = np.linalg.svd(fit, full_matrices=False)
    inv = np.where(s > cutoff * s[0], 1.0 / np.where(s > 0, s, 1.0), 0.0)
    back = (vt.T * inv) @ u.T
    return np.vstack(_unit_currents(site_lat, site_lon)) @ back


def transfer_weights(observers, sites, group=GROUP_SITES) -> DataFrame:
    """Weights per (storm, site) from ``observers(storm, obs, lat, lon)`` and ``sites(site, lat, lon)``.

    A storm's observatories are a short list (a few dozen stations). Sites are
    spread over groups of about ``group`` per storm, so a group's memory does not
    grow with them; there are as many partitions as groups of a storm, as a site
    is few bytes but much work.
    """
    chunks = max(1, math.ceil(sites.count() / group))
    lists = observers.groupBy("storm").agg(
        F.array_sort(F.collect_list(F.struct("obs", "lat", "lon"))).alias("stations")
    )
    lists = lists.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    spread = sites.withColumn("chunk", F.pmod(F.xxhash64("site"), F.lit(chunks)).cast("int"))

    def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
        st = pdf["stations"].iloc[0]
        m = transfer_matrix([s["lat"] for s in st], [s["lon"] for s in st], pdf["lat"], pdf["lon"])
        n = len(pdf)
        return pd.DataFrame({"storm": pdf["storm"], "site": pdf["site"],
                             "wx": list(m[:n]), "wy": list(m[n:])})

    key = sites.schema["site"].dataType.simpleString()
    storm = observers.schema["storm"].dataType.simpleString()
    return (
        spread.join(lists, "chunk")
        .repartition(chunks, "storm", "chunk")
        .groupBy("storm", "chunk")
        .applyInPandas(weigh, f"storm {storm}, site {key}, wx array<double>, wy array<double>")
    )


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def synthesised_field(observed, weights, chunk=24) -> DataFrame:
    """Field at every site and time of a storm from ``observed(storm, t, obs, bx, by)``.

    Readings of one instant travel as one short array; the join key carries a
    time chunk beside the storm, so a long storm is not one task.
    """
    instant = observed.groupBy("storm", "t").agg(
        F.array_sort(F.collect_list(F.struct("obs", "bx", "by"))).alias("o")
    ).select(
        "storm", "t", F.floor(F.col("t") / chunk).alias("c"),
        F.concat(F.transform("o", lambda x: x["bx"]), F.transform("o", lambda x: x["by"])).alias("b"),
    )
    spans = instant.select("storm", "c").distinct()
    return (
        instant.join(weights.join(spans, "storm"), ["storm", "c"])
        .select("storm", "t", "site", _dot("b", "wx").alias("bx"), _dot("b", "wy").alias("by"))
    )


# ------------------------------------------------------------ E and V


def electric_field(field, impedance, dt=60.0, pairs=None) -> DataFrame:
    """E(t) of each (storm, site) by filtering (bx, by) with the site impedance.

    ``impedance(site, period, element, z_re, z_im)`` with element xx, xy, yx, yy.
    One group is one site in one storm window: some thousand samples. The impedance
    meets it once, not once for each sample; ``pairs(storm, site)`` spares looking
    them up among the samples where they are known. Series are padded with zeros to twice
    their length, so the filter does not carry one end into the other.
    """
    tensor = impedance.groupBy("site").agg(
        F.array_sort(F.collect_list(F.struct("element", "period", "z_re", "z_im"))).alias("z")
    )
    key = field.schema["site"].dataType.simpleString()
    storm = field.schema["storm"].dataType.simpleString()

    def filtered(pdf: pd.DataFrame, bands: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or bands.empty:
            return pd.DataFrame({"storm": [], "site": [], "t": [], "ex": [], "ey": []})
        pdf = pdf.sort_values("t")
        n = len(pdf)
        freq = np.fft.rfftfreq(2 * n, dt)
        z = {e: np.zeros(len(freq), complex) for e in ("xx", "xy", "yx", "yy")}
        rows = bands["z"].iloc[0]
        for e in z:
            pts = [(1.0 / r["period"], r["z_re"], r["z_im"]) for r in rows if r["element"] == e]
            if pts:
                f, re, im = map(np.asarray, zip(*sorted(pts)))
                z[e] = np.interp(freq, f, re, 0.0, 0.0) + 1j * np.interp(freq, f, im, 0.0, 0.0)
        fx, fy = np.fft.rfft(pdf["bx"].to_numpy(), 2 * n), np.fft.rfft(pdf["by"].to_numpy(), 2 * n)
        return pd.DataFrame({
            "storm": pdf["storm"], "site": pdf["site"], "t": pdf["t"],
            "ex": np.fft.irfft(z["xx"] * fx + z["xy"] * fy, 2 * n)[:n],
            "ey": np.fft.irfft(z["yx"] * fx + z["yy"] * fy, 2 * n)[:n],
        })

    pairs = field.select("storm", "site").distinct() if pairs is None else pairs
    groups = pairs.join(tensor, "site").select(*[F.col(c).alias(c) for c in ("storm", "site", "z")])
    return field.groupBy("storm", "site").cogroup(groups.groupBy("storm", "site")).applyInPandas(
        filtered, f"storm {storm}, site {key}, t bigint, ex double, ey double"
    )


def valid_lines(weights) -> DataFrame:
    """Weights of the lines whose weights are all numbers."""
    from gridhazard.functions.scalar import finite

    broken = (
        weights.groupBy("line").agg(F.max((~(finite(F.col("wx")) & finite(F.col("wy")))).cast("int")).alias("_b"))
        .filter("_b = 1").select("line")
    )
    return weights.join(broken, "line", "left_anti")


def line_voltages(efield, weights, keys=("t",), blocks=LINE_BLOCKS) -> DataFrame:
    """V per (keys, line): sum over sites of weights times field; a sparse matrix product.

    The products are many more than weights and field together, so they are not exchanged: lines are dealt
    to ``blocks``, each block gets the whole field, in short arrays, and all that is summed for a line meets there.
    """
    # A join on (block, site) may stay dealt by block. Without this setting the result is the same, over more exchanges.
    conf = weights.sparkSession.conf
    conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    parts = max(2 * blocks, int(conf.get("spark.sql.shuffle.partitions")))  # with fewer than usual Spark deals again, by both keys
    w = weights.withColumn("_r", F.pmod(F.xxhash64("line"), F.lit(blocks)).cast("int")).repartition(parts, "_r")
    short = F.pmod(F.xxhash64(*keys), F.lit(FIELD_PARTS))
    packed = efield.groupBy("site", short.alias("_p")).agg(F.collect_list(F.struct(*keys, "ex", "ey")).alias("_e"))
    everywhere = packed.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(parts, "_r")
    return (
        w.join(everywhere, ["_r", "site"])
        .select("_r", "line", "wx", "wy", F.explode("_e").alias("_e"))
        .groupBy("_r", *[F.col(f"_e.{k}").alias(k) for k in keys], "line")
        .agg(F.sum(F.col("wx") * F.col("_e.ex") + F.col("wy") * F.col("_e.ey")).alias("v"))
        .drop("_r")
    )


def site_diagnostics(maxima) -> DataFrame:
    """Usability of each site from ``maxima(site, storm, b, e)``."""
    from gridhazard.functions.scalar import finite

    def usable(c):
        return F.count(F.when(finite(F.col(c)) & (F.col(c) != 0), 1))

    def any_missing(c):
        return F.max((F.col(c).isNull() | F.isnan(F.col(c))).cast("int"))

    def all_zero(c):
        return F.min(F.coalesce((F.col(c) == 0).cast("int"), F.lit(0)))

    return maxima.groupBy("site").agg(
        usable("b").alias("valid_b"), usable("e").alias("valid_e"),
        any_missing("b").alias("any_nan_b"), any_missing("e").alias("any_nan_e"),
        all_zero("b").alias("all_zero_b"), all_zero("e").alias("all_zero_e"),
    )
