"""Extreme-value queries. Entity: supplier; pool: line prices (thousands)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridhazard.operators import extremes as P
from gridhazard.plans import sqltext as X
from gridhazard.plans.catalogue import NAMED_SQL, SESSIONS_SQL, named_events, sessions
from gridhazard.plans.registry import epoch_hour, query, table

ATTEMPTS, YEARS, WIDTH, SAMPLES = 20, 39, 5.0, 15
PERIODS = (25, 50, 75, 100, 125, 150, 175, 200, 225, 250)


def pool(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice")
    return P.sampling_pool(li, "l_suppkey", "l_extendedprice", 1000.0)


POOL_SQL = """
base AS (SELECT l_suppkey AS entity, l_extendedprice / 1000 AS x FROM lineitem WHERE abs(l_extendedprice / 1000) > 1e-12),
pool AS (SELECT * FROM base WHERE entity IN (SELECT entity FROM base GROUP BY 1 HAVING count(*) >= 5))"""

DRAW_SQL = f"""{POOL_SQL},
ranked AS (SELECT entity, x, row_number() OVER (PARTITION BY entity ORDER BY x) - 1 AS pos FROM pool),
sizes AS (SELECT entity, count(*) AS n FROM pool GROUP BY 1),
idx AS (SELECT entity, a.attempt, k.k, CAST(floor({X.uniform(7, 'entity', 'a.attempt', 'k.k')} * n) AS BIGINT) AS pos
  FROM sizes, range({ATTEMPTS}) a(attempt), range({YEARS}) k(k)),
draws AS (SELECT entity, attempt, k, x FROM idx JOIN ranked USING (entity, pos))"""


def draws(spark, sf):
    return P.bootstrap_draws(pool(spark, sf), WIDTH, ATTEMPTS, YEARS)


@query("SX01", f"WITH {POOL_SQL} SELECT entity, count(*) AS n, round(avg(x), 6) AS mean_x, min(x) AS min_x, max(x) AS max_x FROM pool GROUP BY 1")
def bootstrap_pool(spark, sf):
    d = pool(spark, sf)
    return d.groupBy("entity").agg(
        F.sum("copies").alias("n"),
        F.round(F.sum(F.col("x") * F.col("copies")) / F.sum("copies"), 6).alias("mean_x"),
        F.min("x").alias("min_x"), F.max("x").alias("max_x"),
    )


@query("SX02", f"WITH {DRAW_SQL} SELECT entity, CAST(attempt AS BIGINT) AS attempt, CAST(k AS BIGINT) AS k, x FROM draws")
def bootstrap_draws(spark, sf):
    return draws(spark, sf).select(
        "entity", F.col("attempt").cast("bigint").alias("attempt"), F.col("k").cast("bigint").alias("k"), "x"
    )


FIT_SQL = f"""{DRAW_SQL},
fit AS (SELECT entity, attempt, avg(ln(abs(x))) AS mu, stddev_pop(ln(abs(x))) AS sigma, min(abs(x)) AS xmin,
  CAST(count(*) AS DOUBLE) AS n, sign(avg(x)) AS sgn FROM draws GROUP BY 1, 2)"""

_A = f"least(greatest(q * y - y + 1e0, -1e0 + 1e-12), 1e0 - 1e-12)"
LEVELS_OF = f"""
per AS (SELECT fit.*, p.period, least(greatest({YEARS}e0 / (p.period * n), 1e-12), 1e0 - 1e-12) AS y,
   (ln(greatest(xmin, 1e-12)) - mu) / sigma AS z FROM fit, (VALUES {', '.join(f'({p})' for p in PERIODS)}) p(period)),
qq AS (SELECT *, least(greatest(2e0 * {X.norm_cdf('z')} - 1e0, -1e0 + 1e-12), 1e0 - 1e-12) AS q FROM per),
aa AS (SELECT *, ({_A} + 1e0) / 2e0 AS pp FROM qq),
levels AS (SELECT entity, attempt, period, sgn * exp(mu + sigma * {X.probit('pp')}) AS value FROM aa)"""
LEVEL_SQL = f"{FIT_SQL},{LEVELS_OF}"


def levels(spark, sf):
    return P.return_levels(P.fitted_closed(draws(spark, sf)), PERIODS, YEARS)


@query("SX03 SF04", f"WITH {FIT_SQL} SELECT entity, CAST(attempt AS BIGINT) AS attempt, round(mu, 6) AS mu, round(sigma, 6) AS sigma, xmin, sgn FROM fit")
def lognormal_fit(spark, sf):
    f = P.fitted_closed(draws(spark, sf))
    return f.select("entity", F.col("attempt").cast("bigint").alias("attempt"), F.round("mu", 6).alias("mu"),
                    F.round("sigma", 6).alias("sigma"), "xmin", "sgn")


@query("SX04 SF01 SF02", f"WITH {LEVEL_SQL} SELECT entity, CAST(attempt AS BIGINT) AS attempt, CAST(period AS BIGINT) AS period, round(value, 5) AS value FROM levels")
def return_levels(spark, sf):
    return levels(spark, sf).select(
        "entity", F.col("attempt").cast("bigint").alias("attempt"), F.col("period").cast("bigint").alias("period"),
        F.round("value", 5).alias("value"),
    )


CI_SQL = f"""{LEVEL_SQL},
kept AS (SELECT * FROM levels WHERE attempt < {SAMPLES}),
ci AS (SELECT entity, period, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM kept GROUP BY 1, 2)"""


@query("SX05 SX06", f"WITH {CI_SQL} SELECT entity, CAST(period AS BIGINT) AS period, round(p05, 5) AS p05, round(p50, 5) AS p50, round(p95, 5) AS p95 FROM ci")
def bootstrap_ci(spark, sf):
    ci = P.level_intervals(P.first_valid(levels(spark, sf), SAMPLES))
    return ci.select("entity", F.col("period").cast("bigint").alias("period"),
                     *[F.round(c, 5).alias(c) for c in ("p05", "p50", "p95")])


@query("SX06", f"WITH {CI_SQL} SELECT CAST(period AS BIGINT) AS period, round(avg(p05), 5) AS p05, round(avg(p50), 5) AS p50, round(avg(p95), 5) AS p95 FROM ci GROUP BY 1")
def site_mean_ci(spark, sf):
    ci = P.level_intervals(P.first_valid(levels(spark, sf), SAMPLES))
    return ci.groupBy(F.col("period").cast("bigint").alias("period")).agg(
        *[F.round(F.avg(c), 5).alias(c) for c in ("p05", "p50", "p95")]
    )


@query(
    "SX07",
    f"WITH {CI_SQL} SELECT entity, {', '.join(f'round(max(CASE WHEN period = {p} THEN p50 END), 5) AS y{p}' for p in PERIODS)} FROM ci GROUP BY 1",
)
def median_levels_wide(spark, sf):
    ci = P.level_intervals(P.first_valid(levels(spark, sf), SAMPLES))
    wide = ci.groupBy("entity").pivot("period", list(PERIODS)).agg(F.max("p50"))
    return wide.select("entity", *[F.round(str(p), 5).alias(f"y{p}") for p in PERIODS])


@query(
    "SX08",
    f"""WITH {SESSIONS_SQL}, {NAMED_SQL},
        hits AS (SELECT DISTINCT name, start_t, end_t FROM storms, named WHERE start_t <= event_end AND end_t >= event_start)
        SELECT name, user_id AS site, max(value) AS max_b FROM events JOIN hits ON {X.hour('ts')} BETWEEN start_t AND end_t GROUP BY 1, 2""",
)
def event_maxima(spark, sf):
    from gridhazard.operators import events as E

    hits = E.overlapping(sessions(spark, sf), named_events(spark)).select("name", "start_t", "end_t")
    ev = table(spark, sf, "events").select(epoch_hour("ts").alias("t"), F.col("user_id").alias("site"), "value")
    return E.in_windows(ev, hits).groupBy("name", "site").agg(F.max("value").alias("max_b"))


_MID = "((s.lo + s.hi) / 2e0)"


def _mills_sql(z):
    return f"(exp(-({z}) * ({z}) / 2e0) / ({X.num(math.sqrt(2 * math.pi))} * {X.norm_cdf(f'(-({z}))')}))"


def _ratio_sql(z):
    above = f"({_mills_sql(z)} - {z})"
    return f"((1e0 - {z} * {above}) / ({above} * {above}))"


TRUNCATED_SQL = f"""{DRAW_SQL},
cut AS (SELECT entity, attempt, sign(avg(x)) AS sgn, quantile_cont(abs(x), 0.01) AS xmin, quantile_cont(abs(x), 0.99) AS top FROM draws GROUP BY 1, 2 HAVING count(*) >= 5),
moments AS (SELECT entity, attempt, sgn, xmin, top, CAST(count(*) AS DOUBLE) AS n, avg(ln(abs(x)) - ln(xmin)) AS m1, avg(pow(ln(abs(x)) - ln(xmin), 2)) AS m2
  FROM draws JOIN cut USING (entity, attempt) WHERE abs(x) >= xmin GROUP BY ALL),
ratios AS (SELECT *, m2 / (m1 * m1) AS ratio FROM moments WHERE m1 > 0),
spans AS (SELECT *, list_reduce(list_prepend({{'lo': {P.CUT_RANGE[0]}e0, 'hi': {P.CUT_RANGE[1]}e0}}, list_transform(range({P.HALVINGS}), lambda k: {{'lo': 0e0, 'hi': 0e0}})),
  lambda s, k: CASE WHEN {_ratio_sql(_MID)} < ratio THEN {{'lo': {_MID}, 'hi': s.hi}} ELSE {{'lo': s.lo, 'hi': {_MID}}} END) AS s FROM ratios WHERE ratio < 2e0 - 1e-3),
cuts AS (SELECT *, {_MID} AS z FROM spans),
scaled AS (SELECT *, m1 / ({_mills_sql('z')} - z) AS sigma FROM cuts),
located AS (SELECT *, ln(xmin) - z * sigma AS mu FROM scaled),
fit AS (SELECT entity, attempt, mu, sigma, xmin, n, sgn FROM located WHERE isfinite(mu) AND isfinite(sigma) AND sigma > 0
  AND len(list_filter(range(8), lambda k: NOT coalesce(isfinite(1e0 - {X.norm_cdf('(-((ln(xmin + k * (top - xmin) / 7e0) - mu) / sigma))')} / nullif({X.norm_cdf('(-z)')}, 0e0)), false))) = 0),
{LEVELS_OF},
turn AS (SELECT *, dense_rank() OVER (PARTITION BY entity ORDER BY attempt) - 1 AS sample FROM levels),
ci AS (SELECT entity, period, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM turn WHERE sample < {SAMPLES} GROUP BY 1, 2)"""


@query("SX03", f"WITH {TRUNCATED_SQL} SELECT entity, CAST(period AS BIGINT) AS period, round(p05, 4) AS p05, round(p50, 4) AS p50, round(p95, 4) AS p95 FROM ci")
def truncated_levels(spark, sf):
    """Return levels from the truncated maximum-likelihood fit."""
    fits = P.fitted_truncated(draws(spark, sf))
    ci = P.level_intervals(P.first_valid(P.return_levels(fits, PERIODS, YEARS), SAMPLES))
    return ci.select("entity", F.col("period").cast("bigint").alias("period"), *[F.round(c, 4).alias(c) for c in ("p05", "p50", "p95")])
