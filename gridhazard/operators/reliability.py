"""Transformer reliability Monte Carlo as native expressions.

Draws come from counter-hash uniforms, so ``(realization, scenario, draw)`` and
``(..., unit)`` fix every number and no draw matrix is held anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridhazard.functions.rng import uniform, uniform_between
from gridhazard.functions.scalar import with_norm_cdf
from gridhazard.functions.fixed_values import GROUND_SCENARIO
from gridhazard.session import cut_lineage, drop_scratch

THETA0, AGEING = 75.0, 0.4
SEED = 11


def unit_maxima(effective, keys=("realization", "sub_id", "scenario")) -> DataFrame:
    """Largest absolute current of a substation's transformers, with first coordinates."""
    return effective.groupBy(*keys).agg(
        F.max(F.abs("gic")).alias("gic"),
        F.min_by("latitude", "seq").alias("latitude"), F.min_by("longitude", "seq").alias("longitude"),
    )


def ground_units(wide, coords, columns=None) -> DataFrame:
    """Wide three-phase ground currents -> per-phase absolute currents by scenario, with coordinates."""
    columns = columns or [c for c in wide.columns if c in GROUND_SCENARIO]
    pack = F.array(*[
        F.struct(F.lit(GROUND_SCENARIO.get(c, c)).alias("scenario"), (F.abs(c) / 3.0).alias("gic"))
        for c in columns
    ])
    rest = [c for c in wide.columns if c not in columns]
    long = wide.select(*rest, F.explode(pack).alias("_g")).select(*rest, "_g.*")
    return long.join(coords, "sub_id", "left")


def with_draws(units, n_draws, alpha_beta=False, seed=SEED, first=0) -> DataFrame:
    """Every unit once per draw (numbers from ``first``), with fragility, ageing and penalty parameters.

    Parameters shared by all units of a draw are a function of the draw key
    alone, so no join is needed to share them.
    """
    d = units.withColumn("draw", F.explode(F.sequence(F.lit(first), F.lit(first + n_draws - 1))))
    shared, own = ("realization", "scenario", "draw"), ("realization", "scenario", "draw", "sub_id")
    old = uniform_between(33.0, 50.0, F.col("_ua"))
    young = uniform_between(1.0, 32.0, F.col("_ua"))
    return (
        d.withColumns({
            "beta": uniform_between(0.25, 0.5, uniform(seed, *shared)),
            "penalty": F.lit(1.0) if alpha_beta else uniform_between(0.6, 1.0, uniform(seed, *shared, part=1)),
            "shape": uniform_between(1.0, 3.0, uniform(seed + 1, *shared)),
            "eta": uniform_between(30.0, 50.0, uniform(seed + 1, *shared, part=1)),
            "_us": uniform(seed + 2, *own),
            "_ua": uniform(seed + 2, *own, part=1),
        })
        .withColumn("age", F.when(F.col("_us") < 0.55, old).otherwise(young))
        .drop("_us", "_ua")
    )


def with_failure_chance(draws, theta0=THETA0, ageing=AGEING) -> DataFrame:
    """Probability that the unit fails in the draw."""
    aged = 1.0 - F.exp(-F.pow(F.greatest(F.col("age") / F.col("eta"), F.lit(1e-12)), F.col("shape")))
    d = draws.withColumn("_theta", F.lit(theta0) * (1.0 - F.lit(ageing) * aged))
    z = (
        F.ln("penalty")
        + F.ln(F.greatest(F.abs("gic"), F.lit(1e-12)))
        - F.ln(F.greatest(F.col("_theta"), F.lit(1e-12)))
    ) / F.col("beta")
    return with_norm_cdf(d, z, "pf").drop("_theta")


def with_failures(chances, seed=SEED) -> DataFrame:
    u = uniform(seed + 3, "realization", "scenario", "draw", "sub_id")
    return chances.withColumn("fails", (u < F.col("pf")).cast("int"))


def draw_totals(failures, metrics) -> DataFrame:
    """Affected amounts per draw: sums over the failed units, all metrics in one pass."""
    return failures.groupBy("realization", "scenario", "draw").agg(
        *[F.sum(F.when(F.col("fails") == 1, F.col(m)).otherwise(0.0)).alias(m) for m in metrics]
    )


def settled(run, metric, minimum, give_up, tolerance):
    """Whether sampling may stop after the draws of ``run`` (n, sum and sum of squares of the metric)."""
    n, mean = F.col("n"), F.col(metric) / F.col("n")
    var = F.try_divide(F.greatest(F.lit(0.0), F.col("squares") - n * mean * mean), n - 1)
    half = 1.96 * F.sqrt(var) / F.sqrt(n)
    return (n >= minimum) & F.when(mean != 0, F.try_divide(half, mean) < tolerance).otherwise(n > give_up)


def stopped_means(units, metrics, metric, batch=2_000, minimum=5_000, give_up=10_000, tolerance=0.1, cap=20_000, alpha_beta=False, seed=SEED) -> DataFrame:
    """(realization, scenario, n_stop, metrics): mean affected amounts over as many draws as the stopping rule asks for.

    Draws are made batch by batch for the (realization, scenario) pairs that are still open, so none past a pair's stop is
    ever made. A pair stops with ``minimum`` draws or more once the half width of its 95 percent interval is below
    ``tolerance`` of the mean, with more than ``give_up`` if nothing was affected yet, and at ``cap``. What is carried from round
    to round, and written, is one row of sums per pair; a lost executor repeats one batch.
    """
    key = ["realization", "scenario"]
    rows = cut_lineage(units)
    run = cut_lineage(rows.select(*key).distinct().select(*key, F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("squares"), *[F.lit(0.0).alias(m) for m in metrics]))
    done = None
    for first in range(0, cap, batch):
        count = min(batch, cap - first)
        drawn = with_draws(rows.join(run.select(*key), key, "left_semi"), count, alpha_beta, seed, first)
        totals = draw_totals(with_failures(with_failure_chance(drawn), seed), metrics)
        more = totals.groupBy(*key).agg(
            F.count("*").alias("n"), F.sum(F.col(metric) * F.col(metric)).alias("squares"), *[F.sum(m).alias(m) for m in metrics])
        sums = run.unionByName(more).groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("n", "squares", *metrics)])
        stop = settled(sums, metric, minimum, give_up, tolerance) if first + count < cap else F.lit(True)
        sums = cut_lineage(sums.withColumn("stop", F.coalesce(stop, F.lit(False))))
        drop_scratch(run)
        ended = sums.filter("stop").drop("stop")
        done = ended if done is None else done.union(ended)
        run = cut_lineage(sums.filter("not stop").drop("stop"))
        if run.isEmpty():
            break
    return done.select(*key, F.col("n").alias("n_stop"), *[(F.col(m) / F.col("n")).alias(m) for m in metrics])


def failure_probability(failures) -> DataFrame:
    return failures.groupBy("realization", "scenario", "sub_id").agg(
        F.avg(F.col("fails").cast("double")).alias("failure_prob")
    )


def mean_over_realizations(probabilities, first_n) -> DataFrame:
    """Mean probability and count per (unit, scenario) over the first ``n`` realizations in order."""
    order = Window.orderBy("realization")
    # One row per realization: a few thousand at most.
    chosen = (
        probabilities.select("realization").distinct()
        .withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= first_n).select("realization")
    )
    return probabilities.join(chosen, "realization", "left_semi").groupBy("sub_id", "scenario").agg(
        F.avg("failure_prob").alias("mean_prob"), F.count(F.lit(1)).alias("n")
    )


def vulnerable_in_all(mean_probs, scenarios, threshold=0.5) -> DataFrame:
    """Units above the threshold in every one of ``scenarios``."""
    hit = mean_probs.filter(F.col("scenario").isin(list(scenarios)) & (F.col("mean_prob") > threshold))
    per_unit = hit.select("sub_id", "scenario").distinct().groupBy("sub_id").agg(F.count(F.lit(1)).alias("k"))
    return per_unit.filter(F.col("k") == len(scenarios)).select("sub_id")


def on_scenario_spine(df, keys, scenarios) -> DataFrame:
    """All scenarios for every key, missing ones as null rows."""
    spine = df.select(*keys).distinct().select(
        *keys, F.explode(F.array(*[F.lit(s) for s in scenarios])).alias("scenario")
    )
    return spine.join(df, list(keys) + ["scenario"], "left")
