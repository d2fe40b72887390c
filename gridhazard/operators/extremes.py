"""Bootstrap return levels of storm maxima."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridhazard.functions import scalar as S
from gridhazard.functions.rng import uniform
from gridhazard.operators.ordered import running_sum
from gridhazard.session import cut_lineage

#: Cut of a truncated fit in standard deviations, and halvings of that range.
CUT_RANGE, HALVINGS = (-40.0, 30.0), 60
DRAW_ROWS = 500_000  # draws made per task: entities are few before they are drawn for, so their bytes say little


def sampling_pool(maxima, entity, value, scale=1.0, min_points=5) -> DataFrame:
    """Usable values per entity, copies collapsed to (value, copies)."""
    v = F.col(value) / scale
    pool = (
        maxima.select(F.col(entity).alias("entity"), v.alias("x"))
        .filter(S.finite(F.col("x")) & (F.abs("x") > 1e-12))
        .groupBy("entity", "x").agg(F.count(F.lit(1)).alias("copies"))
    )
    short = pool.groupBy("entity").agg(F.sum("copies").alias("_n")).filter(F.col("_n") < min_points)
    return pool.join(short.select("entity"), "entity", "left_anti")


def ranked_pool(pool, width) -> DataFrame:
    """Rank interval [lo, hi) of every value in its entity's sorted pool.

    Values are ordered inside slices of ``width``; only the slice totals are
    ordered per entity.
    """
    d = pool.withColumn("slice", F.floor(F.col("x") / width))
    d = running_sum(d, ["entity"], ["slice"], ["x"], "copies", "hi")
    return d.withColumn("lo", F.col("hi") - F.col("copies")).select("entity", "slice", "x", "lo", "hi")


def bootstrap_draws(pool, width, attempts=100, n_years=39, seed=7) -> DataFrame:
    """``attempts`` x ``n_years`` draws with replacement per entity: (entity, attempt, k, x).

    A draw is a rank; its value is found by an ordered merge of draws and rank
    intervals, first over slices, then inside a slice, so the pool itself is
    never multiplied and never sorted as a whole.
    """
    # Read three times below, so the scan and the ranking behind it are done once.
    ranked = cut_lineage(ranked_pool(pool, width))
    sizes = cut_lineage(ranked.groupBy("entity").agg(F.max("hi").alias("n")))
    parts = math.ceil(sizes.count() * attempts * n_years / DRAW_ROWS)
    draws = (
        sizes.repartition(max(parts, 1), "entity").withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_years - 1))))
        .withColumn("pos", F.floor(uniform(seed, "entity", "attempt", "k") * F.col("n")))
        .select("entity", "attempt", "k", "pos")
    )
    slices = ranked.groupBy("entity", "slice").agg(F.min("lo").alias("pos"))
    placed = _merge(draws, slices, ["entity"], "slice")
    values = ranked.select("entity", "slice", F.col("lo").alias("pos"), "x")
    return _merge(placed, values, ["entity", "slice"], "x").select("entity", "attempt", "k", "x")


def _merge(draws, marks, keys, payload) -> DataFrame:
    """Attach to each draw the payload of the last mark at or before its position."""
    both = draws.withColumn(payload, F.lit(None).cast(marks.schema[payload].dataType)).withColumn(
        "_d", F.lit(1)
    ).unionByName(marks.select(*keys, "pos", payload).withColumn("_d", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("pos", "_d").rowsBetween(Window.unboundedPreceding, 0)
    return (
        both.withColumn(payload, F.last(payload, ignorenulls=True).over(w))
        .filter(F.col("_d") == 1).drop("_d")
    )


def fitted_closed(draws) -> DataFrame:
    """Lognormal moments of |x| per attempt (no truncation), with the sign of the mean."""
    ln = F.ln(F.abs("x"))
    return draws.groupBy("entity", "attempt").agg(
        F.avg(ln).alias("mu"), F.stddev_pop(ln).alias("sigma"), F.min(F.abs("x")).alias("xmin"),
        F.count(F.lit(1)).alias("n"), F.signum(F.avg("x")).alias("sgn"),
    )


def _tail(z):
    """Upper tail of the standard normal."""
    return S.let(-z, lambda x: S.let(F.abs(x), lambda a: S.norm_cdf_parts(x, a, F.exp(-a * a / 2.0))))


def _above(z):
    """Mean above the cut, less the cut, of a standard normal cut off below z."""
    return F.exp(-z * z / 2.0) / (math.sqrt(2.0 * math.pi) * _tail(z)) - z


def _excess_ratio(z):
    """Mean square over squared mean of what a normal cut off below z has above z; rises from 1 to 2."""
    return S.let(_above(z), lambda above: (1.0 - z * above) / (above * above))


def _at_share(sorted_values, share):
    """Linear percentile of a sorted array."""
    at = share * (F.size(sorted_values) - 1)
    low = F.floor(at).cast("int")
    below, above = F.get(sorted_values, low), F.get(sorted_values, F.least(low + 1, F.size(sorted_values) - 1))
    return below + (above - below) * (at - low)


def fitted_truncated(draws) -> DataFrame:
    """Maximum-likelihood lognormal cut off below xmin, per attempt: (mu, sigma, xmin, n, sgn).

    xmin is the larger of the least value and the 1st percentile. The likelihood needs the count and two moments of the
    logarithms above ln xmin alone. At its maximum mean and mean square equal the model's, so their ratio gives the cut in
    standard deviations, by bisection, and this gives sigma and mu. A ratio of 2 or more has no maximum, nor has one value
    repeated; such attempts, those of fewer than five values and those whose distribution function is not finite at eight
    points up to the 99th percentile give no fit. An attempt is a short array of n_years values.
    """
    size = F.abs("x")
    packed = draws.groupBy("entity", "attempt").agg(
        F.array_sort(F.collect_list(F.when(S.finite(F.col("x")) & (size > 0), size))).alias("xs"), F.signum(F.avg("x")).alias("sgn"))
    d = packed.filter(F.size("xs") >= 5).withColumns({"xmin": _at_share(F.col("xs"), 0.01), "top": _at_share(F.col("xs"), 0.99)})
    d = d.withColumn("es", F.transform(F.filter("xs", lambda x: x >= F.col("xmin")), lambda x: F.ln(x) - F.ln("xmin"))).drop("xs")
    total = lambda f: F.aggregate("es", F.lit(0.0), lambda acc, e: acc + f(e))
    d = d.withColumn("n", F.size("es").cast("bigint")).withColumns({"m1": F.try_divide(total(lambda e: e), "n"), "m2": F.try_divide(total(lambda e: e * e), "n")})
    d = d.filter("m1 > 0").withColumn("ratio", F.try_divide(F.col("m2"), F.col("m1") * F.col("m1"))).filter(F.col("ratio") < 2.0 - 1e-3)
    d = cut_lineage(d.drop("es"))  # a row per attempt: what follows is long arithmetic on plain columns

    def halve(span, _):
        return S.let((span["lo"] + span["hi"]) / 2.0, lambda mid: F.when(
            _excess_ratio(mid) < F.col("ratio"), F.struct(mid.alias("lo"), span["hi"].alias("hi"))).otherwise(F.struct(span["lo"].alias("lo"), mid.alias("hi"))))

    span = F.struct(F.lit(CUT_RANGE[0]).alias("lo"), F.lit(CUT_RANGE[1]).alias("hi"))
    d = d.withColumn("span", F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), span, halve))
    d = cut_lineage(d.withColumn("z", (F.col("span.lo") + F.col("span.hi")) / 2.0).drop("span"))  # the search runs once
    d = d.withColumn("sigma", F.col("m1") / _above(F.col("z"))).withColumn("mu", F.ln("xmin") - F.col("z") * F.col("sigma"))
    step = (F.col("top") - F.col("xmin")) / 7.0
    at = lambda k: (F.ln(F.col("xmin") + k * step) - F.col("mu")) / F.col("sigma")
    cdf = lambda k: 1.0 - F.try_divide(_tail(at(k)), _tail(F.col("z")))
    sound = F.forall(F.sequence(F.lit(0), F.lit(7)), lambda k: S.let(cdf(k.cast("double")), S.finite))
    ok = S.finite(F.col("mu")) & S.finite(F.col("sigma")) & (F.col("sigma") > 0)
    return d.filter(ok).filter(sound).select("entity", "attempt", "mu", "sigma", "xmin", "n", "sgn")


def return_levels(fits, periods, n_years=39) -> DataFrame:
    """Signed return level per (entity, attempt, period)."""
    d = fits.withColumn("period", F.explode(F.array(*[F.lit(int(p)) for p in periods])))
    x = S.clip(1.0 - F.lit(float(n_years)) / (F.col("period") * F.col("n")), 1e-12, 1.0 - 1e-12)
    d = S.with_truncated_lognormal_quantile(d, 1.0 - x, "mu", "sigma", "xmin", "_level")
    value = S.finite_or(F.col("_level") * F.col("sgn"), 0.0)
    return d.select("entity", "attempt", "period", value.alias("value"))


def first_valid(levels, n_samples) -> DataFrame:
    """First ``n_samples`` attempts per entity whose levels are all numbers.

    Levels are dealt by entity and read once; an entity holds a row per attempt and period, whatever its pool.
    """
    d = levels.dropna(subset=["entity", "attempt"]).repartition("entity")
    d = d.withColumn("_ok", F.min(S.finite(F.col("value")).cast("int")).over(Window.partitionBy("entity", "attempt"))).filter("_ok = 1")
    turn = F.dense_rank().over(Window.partitionBy("entity").orderBy("attempt"))
    return d.withColumn("sample", turn - 1).filter(F.col("sample") < n_samples).drop("_ok")


def level_intervals(levels) -> DataFrame:
    """5, 50 and 95 percent points per (entity, period); a group holds one row per sample."""
    v = F.when(S.finite(F.col("value")), F.col("value"))
    q = F.percentile(v, [0.05, 0.5, 0.95])
    return levels.groupBy("entity", "period").agg(q.alias("q")).select(
        "entity", "period", F.col("q")[0].alias("p05"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p95")
    )
