"""Sensor queries. A site is ``user_id``, a channel ``event_type``, the grid is one hour."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridhazard.operators import events as E
from gridhazard.operators import series as R
from gridhazard.operators.quantiles import exact_quantiles, mode_per_key
from gridhazard.plans import sqltext as X
from gridhazard.plans.catalogue import SESSIONS_SQL, sessions
from gridhazard.plans.registry import epoch_hour, query, stamp, table
from gridhazard.session import cut_lineage

CHANNELS = ("click", "error", "purchase", "signup", "view")
H = X.hour("ts")


def readings(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("site"), epoch_hour("ts").alias("t"), "event_type", "value",
        F.col("event_id").alias("seq"),
    )


def site_hours(spark, sf):
    """site x hour, highest reading; the spine covers whole days, so gaps are null."""
    s = E.gridded(readings(spark, sf), ["site"], "t", v=F.max("value"))
    return R.whole_day_spine(s, ["site"]).join(s, ["site", "t"], "left")


SITE_SQL = f"""
s AS (SELECT user_id AS site, {H} AS t, max(value) AS v FROM events GROUP BY 1, 2),
span AS (SELECT site, min(t) // 24 * 24 AS a, max(t) // 24 * 24 + 23 AS b FROM s GROUP BY 1),
spine AS (SELECT site, unnest(range(a, b + 1)) AS t FROM span),
g AS (SELECT spine.site, spine.t, v FROM spine LEFT JOIN s USING (site, t))"""

FILL_SQL = f"""{SITE_SQL},
n AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN t END) OVER (PARTITION BY site ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pt,
        min(CASE WHEN v IS NOT NULL THEN t END) OVER (PARTITION BY site ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt FROM g),
filled AS (SELECT n.site, n.t, k.v AS filled FROM n JOIN s k ON k.site = n.site
   AND k.t = CASE WHEN pt IS NOT NULL AND (nt IS NULL OR n.t - pt <= nt - n.t) THEN pt ELSE nt END)"""


@query("TS01", f"WITH {FILL_SQL} SELECT site, {X.stamp('t')} AS ts, filled FROM filled")
def gap_fill(spark, sf):
    return R.nearest_filled(site_hours(spark, sf), ["site"], "v", "filled").select(
        "site", stamp("t").alias("ts"), "filled"
    )


@query(
    "TS02",
    f"""WITH {FILL_SQL}, i AS (SELECT *, CAST(t - min(t) OVER (PARTITION BY site) AS DOUBLE) AS i FROM filled),
        fit AS (SELECT site, regr_slope(filled, i) AS s, regr_intercept(filled, i) AS k FROM i GROUP BY 1)
        SELECT site, {X.stamp('t')} AS ts, round(filled - (k + s * i), 5) AS residual FROM i JOIN fit USING (site)""",
)
def detrend(spark, sf):
    # Read twice (fit and residual), filled once.
    filled = cut_lineage(R.nearest_filled(site_hours(spark, sf), ["site"], "v", "filled"))
    return R.detrended(filled, ["site"], "filled", "r").select(
        "site", stamp("t").alias("ts"), F.round("r", 5).alias("residual")
    )


@query("TS03", "SELECT vec_id, CASE WHEN embedding[1] IS NULL THEN NULL ELSE round(CAST(embedding[1] AS DOUBLE) * 180 + 180 - 360, 6) END AS lon FROM embeddings")
def longitude_wrap(spark, sf):
    d = table(spark, sf, "embeddings")
    return d.select("vec_id", F.round(F.col("embedding")[0].cast("double") * 180 + 180 - 360, 6).alias("lon"))


@query(
    "TS04",
    f"""WITH ok AS (SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = {len(CHANNELS)})
        SELECT user_id AS site, {X.stamp(H)} AS ts, {', '.join(f"max(CASE WHEN event_type = '{c}' THEN value END) AS {c}" for c in CHANNELS)}
        FROM events WHERE user_id IN (SELECT user_id FROM ok) GROUP BY 1, 2""",
)
def channel_pivot(spark, sf):
    full = R.complete_channels(readings(spark, sf), "site", "event_type", CHANNELS)
    return R.channels_side_by_side(full, "site", "t", "event_type", "value", CHANNELS).select(
        "site", stamp("t").alias("ts"), *CHANNELS
    )


@query(
    "TS05 TS11 S06",
    """WITH f AS (SELECT user_id AS site, CASE WHEN event_type = 'click' AND value > 100 THEN value END AS x, value FROM events),
       dead AS (SELECT site FROM f GROUP BY 1 HAVING count(x) = 0)
       SELECT site, count(*) AS n, round(sum(x), 4) AS x_total FROM f
       WHERE site NOT IN (SELECT site FROM dead) AND site NOT IN (7, 11) GROUP BY 1""",
)
def usable_sites(spark, sf):
    ev = readings(spark, sf)
    x = F.when(F.col("value") > 100, F.col("value"))
    with_x = ev.filter(F.col("event_type") == "click").select("site", x.alias("x"), "value")
    rest = ev.filter(F.col("event_type") != "click").select("site", "value")
    frames = with_x.unionByName(rest, allowMissingColumns=True)
    live = R.sites_with(frames, "site", "x").filter(~F.col("site").isin(7, 11))
    return live.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("x_total"))


@query(
    "TS06",
    """WITH c AS (SELECT user_id AS site, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2)
       SELECT site, arg_min(k, {'a': -n, 'b': k}) AS k_mode FROM c GROUP BY 1""",
)
def mode_per_site(spark, sf):
    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("site"), F.from_json("props", "k bigint")["k"].alias("k")
    )
    return mode_per_key(ev, ["site"], "k", "k_mode")


@query(
    "TS07",
    f"""WITH f AS (SELECT user_id AS site, event_type, {H} AS t, arg_min(value, event_id) AS v FROM events GROUP BY 1, 2, 3),
        k AS (SELECT DISTINCT event_type, site FROM f), h AS (SELECT DISTINCT t FROM f)
        SELECT k.site, {X.stamp('h.t')} AS ts, {', '.join(f"max(CASE WHEN k.event_type = '{c}' THEN v END) AS {c}" for c in CHANNELS)}
        FROM k, h LEFT JOIN f ON f.site = k.site AND f.event_type = k.event_type AND f.t = h.t GROUP BY 1, 2""",
)
def pivot_spine(spark, sf):
    grid = R.on_shared_grid(readings(spark, sf), ["site", "event_type"], "value", "v")
    wide = grid.groupBy("site", "t").pivot("event_type", list(CHANNELS)).agg(F.max("v"))
    return wide.select("site", stamp("t").alias("ts"), *CHANNELS)


def cut_windows(spark, sf, group=60):
    """Group readings of stations (blocks of sites) by storm window."""
    ev = readings(spark, sf).withColumn("station", F.floor(F.col("site") / group))
    g = E.gridded(ev, ["station"], "t", v=F.max("value"))
    full = R.whole_day_spine(g, ["station"]).join(g, ["station", "t"], "left")
    return E.in_windows(full, sessions(spark, sf)).select("start_t", "station", "t", "v")


STATION_SQL = f"""{SESSIONS_SQL},
s AS (SELECT user_id // 60 AS station, {H} AS t, max(value) AS v FROM events GROUP BY 1, 2),
span AS (SELECT station, min(t) // 24 * 24 AS a, max(t) // 24 * 24 + 23 AS b FROM s GROUP BY 1),
spine AS (SELECT station, unnest(range(a, b + 1)) AS t FROM span),
g AS (SELECT spine.station, spine.t, v FROM spine LEFT JOIN s USING (station, t)),
cut AS (SELECT start_t, station, t, v FROM g JOIN storms ON t BETWEEN start_t AND end_t)"""


@query(
    "TS09",
    f"""WITH {STATION_SQL} SELECT {X.stamp('start_t')} AS start_ts, station, count(*) AS n, round(sum(v), 4) AS total
        FROM cut GROUP BY start_t, station HAVING count(*) = count(v)""",
)
def complete_sites(spark, sf):
    ok = R.complete_in_window(cut_windows(spark, sf), "start_t", "station", "v")
    return ok.groupBy("start_t", "station").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total")
    ).select(stamp("start_t").alias("start_ts"), "station", "n", "total")


@query(
    "TS10",
    f"""WITH {STATION_SQL}, have AS (SELECT * FROM cut WHERE v IS NOT NULL),
        ns AS (SELECT start_t, count(DISTINCT station) AS k FROM have GROUP BY 1)
        SELECT {X.stamp('h.start_t')} AS start_ts, {X.stamp('t')} AS ts FROM have h JOIN ns USING (start_t)
        GROUP BY h.start_t, t, k HAVING count(DISTINCT station) = k""",
)
def common_hours(spark, sf):
    have = cut_windows(spark, sf).filter(F.col("v").isNotNull())
    return R.common_positions(have, "start_t", "station").select(
        stamp("start_t").alias("start_ts"), stamp("t").alias("ts")
    )


@query(
    "FV04 SF06",
    f"""SELECT user_id AS site, {H} // 24 AS day, round(max(sqrt(value * value + event_id % 7 * (event_id % 7))), 6) AS max_b
        FROM events GROUP BY 1, 2""",
)
def site_max(spark, sf):
    from gridhazard.functions.scalar import magnitude

    ev = readings(spark, sf)
    return ev.groupBy("site", F.floor(F.col("t") / 24).alias("day")).agg(
        F.round(F.max(magnitude(F.col("value"), (F.col("seq") % 7).cast("double"))), 6).alias("max_b")
    )


ACTIVITY_SQL = f"""
sh AS (SELECT user_id AS site, {H} AS t, max(value) AS v FROM events GROUP BY 1, 2),
act AS (SELECT t // 240 AS storm, t, quantile_cont(v, 0.5) AS s, sum(v) AS total FROM sh GROUP BY t),
sm AS (SELECT storm, t, (coalesce(lag(s) OVER w, s) + s + coalesce(lead(s) OVER w, s)) / 3 AS s
       FROM act WINDOW w AS (PARTITION BY storm ORDER BY t))"""


def activity(spark, sf):
    """Network activity per hour: median over sites; storm windows of 240 hours."""
    sh = E.gridded(readings(spark, sf), ["site"], "t", v=F.max("value"))
    med = exact_quantiles(sh, ["t"], "v", [0.5], ["s"], bounded=True)  # sites
    return med.withColumn("storm", F.floor(F.col("t") / 240))


@query("FV08", f"WITH {ACTIVITY_SQL} SELECT {X.stamp('t')} AS ts, round(s, 6) AS smooth FROM sm")
def moving_avg(spark, sf):
    return R.moving_average3(activity(spark, sf), "s", "sm", ["storm"]).select(
        stamp("t").alias("ts"), F.round("sm", 6).alias("smooth")
    )


PROM = """(SELECT {h} - greatest(
   (SELECT min(x.s) FROM {src} x WHERE x.storm = c.storm AND x.t <= c.t AND x.t > coalesce((SELECT max(y.t) FROM {src} y WHERE y.storm = c.storm AND y.t < c.t AND y.s > c.s), -1)),
   (SELECT min(x.s) FROM {src} x WHERE x.storm = c.storm AND x.t >= c.t AND x.t < coalesce((SELECT min(y.t) FROM {src} y WHERE y.storm = c.storm AND y.t > c.t AND y.s > c.s), 1e15))))"""

PEAKS_SQL = f"""{ACTIVITY_SQL},
nb AS (SELECT *, lag(s) OVER w AS l, lead(s) OVER w AS r FROM sm WINDOW w AS (PARTITION BY storm ORDER BY t)),
c0 AS (SELECT storm, t, s FROM nb WHERE s > l AND s > r),
g(n, picks, t) AS (
  SELECT 0, CAST([] AS BIGINT[]), CAST(NULL AS BIGINT)
  UNION ALL
  SELECT any_value(g.n) + 1, list_append(any_value(g.picks), arg_min(c.t, {{'v': -c.s, 't': c.t}})), arg_min(c.t, {{'v': -c.s, 't': c.t}})
  FROM g, c0 c WHERE len(list_filter(g.picks, lambda p: p // 240 = c.storm AND abs(p - c.t) < 10)) = 0 HAVING count(*) > 0),
kept AS (SELECT c0.* FROM c0 JOIN g USING (t)),
tops AS (SELECT storm, max(s) AS top FROM sm GROUP BY 1),
scored AS (SELECT c.storm, c.t, c.s, {PROM.format(h='c.s', src='sm')} AS prom FROM kept c),
ranked AS (SELECT storm, t, s, prom, row_number() OVER (PARTITION BY storm ORDER BY s DESC, t) AS r FROM scored JOIN tops USING (storm) WHERE prom >= 0.2 * top)"""


@query(
    "FV09",
    f"WITH RECURSIVE {PEAKS_SQL} SELECT storm, {X.stamp('t')} AS ts, round(s, 6) AS height, round(prom, 6) AS prominence FROM ranked WHERE r <= 3",
)
def peaks(spark, sf):
    from gridhazard.operators.fields import activity_peaks

    smooth = R.moving_average3(activity(spark, sf), "s", "sm", ["storm"]).select(
        "storm", "t", F.col("sm").alias("s")
    )
    return activity_peaks(smooth, distance=10, share=0.2, top=3).select(
        "storm", stamp("t").alias("ts"), F.round("s", 6).alias("height"),
        F.round("prominence", 6).alias("prominence"),
    )


def _gauss_sql():
    weights = R.gaussian_weights(1.0, 4)
    vals = ", ".join(f"({k - 4}, {X.num(w)})" for k, w in enumerate(weights))
    return f"""
tot AS (SELECT t // 240 AS storm, t, row_number() OVER (PARTITION BY t // 240 ORDER BY t) - 1 AS i,
   count(*) OVER (PARTITION BY t // 240) AS n, s FROM (SELECT {H} AS t, sum(value) AS s FROM events GROUP BY 1)),
kern(k, w) AS (VALUES {vals}),
idx AS (SELECT storm, t, w, ((i + k) % (2 * n) + 2 * n) % (2 * n) AS m, n FROM tot, kern),
sm AS (SELECT a.storm, a.t, sum(a.w * b.s) AS s FROM idx a JOIN tot b ON b.storm = a.storm
   AND b.i = CASE WHEN a.m >= a.n THEN 2 * a.n - 1 - a.m ELSE a.m END GROUP BY 1, 2),
nb AS (SELECT *, lag(s) OVER w AS l, lead(s) OVER w AS r FROM sm WINDOW w AS (PARTITION BY storm ORDER BY t)),
c0 AS (SELECT storm, t, s FROM nb WHERE s > l AND s > r),
tops AS (SELECT storm, max(s) AS top FROM sm GROUP BY 1),
scored AS (SELECT c.storm, c.t, c.s, {PROM.format(h='c.s', src='sm')} AS prom FROM c0 c),
ranked AS (SELECT storm, t, s, prom, row_number() OVER (PARTITION BY storm ORDER BY prom DESC, t) AS r
   FROM scored JOIN tops USING (storm) WHERE prom >= 0.1 * top)"""


@query(
    "FV10",
    f"WITH {_gauss_sql()} SELECT storm, {X.stamp('t')} AS ts, round(s, 5) AS smoothed, round(prom, 5) AS prominence FROM ranked WHERE r <= 20",
)
def storm_peak_list(spark, sf):
    from gridhazard.operators.fields import smoothed_storm_peaks

    total = E.gridded(readings(spark, sf), [], "t", s=F.sum("value"))
    total = total.withColumn("storm", F.floor(F.col("t") / 240))
    return smoothed_storm_peaks(total, sigma=1.0, share=0.1, top=20).select(
        "storm", stamp("t").alias("ts"), F.round("s", 5).alias("smoothed"),
        F.round("prominence", 5).alias("prominence"),
    )


@query(
    "FV06 FV07",
    f"""WITH sh AS (SELECT user_id AS site, {H} // 240 AS storm, {H} AS t, max(value) AS v FROM events GROUP BY 1, 2, 3),
        i AS (SELECT *, row_number() OVER (PARTITION BY site, storm ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY site, storm) AS n FROM sh),
        cut AS (SELECT *, CASE WHEN 8 >= n THEN greatest(0, (n - 1) // 2) ELSE 4 END AS c FROM i)
        SELECT storm, site, count(*) AS n, round(max(CASE WHEN v > 200 THEN 0 ELSE v END), 6) AS max_e
        FROM cut WHERE i >= c AND i < n - c GROUP BY 1, 2""",
)
def trimmed_max(spark, sf):
    from gridhazard.functions.scalar import finite_or

    sh = E.gridded(readings(spark, sf), ["site"], "t", v=F.max("value"))
    v = F.when(F.col("v") > 200, F.lit(float("inf"))).otherwise(F.col("v"))
    cut = R.trimmed(sh.withColumn("storm", F.floor(F.col("t") / 240)).withColumn("v", v), "storm", "site", 4)
    return cut.groupBy("storm", "site").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max(finite_or(F.col("v"), 0.0)), 6).alias("max_e")
    )


@query(
    "FV03 SF07",
    """WITH x AS (SELECT user_id AS site, event_type = 'view' AND value > 200 AS is_nan, event_type = 'click' AND value > 220 AS is_inf FROM events),
       a AS (SELECT site, max(CASE WHEN is_nan THEN 1 ELSE 0 END) AS f_nan, max(CASE WHEN is_inf THEN 1 ELSE 0 END) AS f_inf FROM x GROUP BY 1)
       SELECT site, concat_ws('; ', CASE WHEN f_nan = 1 THEN 'nan' END, CASE WHEN f_inf = 1 THEN 'inf' END) AS reasons FROM a WHERE f_nan + f_inf > 0""",
)
def series_faults(spark, sf):
    ev = readings(spark, sf)
    bx = F.when((F.col("event_type") == "view") & (F.col("value") > 200), F.lit(float("nan"))).otherwise(F.col("value"))
    by = F.when((F.col("event_type") == "click") & (F.col("value") > 220), F.lit(float("inf"))).otherwise(F.lit(1.0))
    return R.series_faults(ev.select("site", bx.alias("bx"), by.alias("by")), ["site"], "bx", "by")


@query(
    "FV17",
    f"""WITH m AS (SELECT user_id AS site, {H} // 24 AS storm, max(CASE WHEN event_type = 'click' THEN value END) AS b,
            max(CASE WHEN event_type = 'view' THEN CASE WHEN value < 10 THEN 0 ELSE value END END) AS e FROM events GROUP BY 1, 2)
        SELECT site, count(CASE WHEN b <> 0 THEN 1 END) AS valid_b, count(CASE WHEN e <> 0 THEN 1 END) AS valid_e,
          max(CASE WHEN b IS NULL THEN 1 ELSE 0 END) AS any_nan_b, max(CASE WHEN e IS NULL THEN 1 ELSE 0 END) AS any_nan_e,
          min(CASE WHEN b = 0 THEN 1 ELSE 0 END) AS all_zero_b, min(CASE WHEN e = 0 THEN 1 ELSE 0 END) AS all_zero_e
        FROM m GROUP BY 1""",
)
def site_diagnostics(spark, sf):
    from gridhazard.operators.fields import site_diagnostics as diag

    return diag(site_storm_maxima(spark, sf))


def site_storm_maxima(spark, sf):
    ev = readings(spark, sf)
    e = F.when(F.col("value") < 10, F.lit(0.0)).otherwise(F.col("value"))
    return ev.groupBy("site", F.floor(F.col("t") / 24).alias("storm")).agg(
        F.max(F.when(F.col("event_type") == "click", F.col("value"))).alias("b"),
        F.max(F.when(F.col("event_type") == "view", e)).alias("e"),
    )


@query(
    "FV17",
    f"""WITH m AS (SELECT user_id AS site, {H} // 24 AS storm, max(CASE WHEN event_type = 'click' THEN value END) AS b,
            max(CASE WHEN event_type = 'view' THEN CASE WHEN value < 10 THEN 0 ELSE value END END) AS e FROM events GROUP BY 1, 2)
        SELECT site, count(CASE WHEN b <> 0 THEN 1 END) AS valid_b, count(CASE WHEN e <> 0 THEN 1 END) AS valid_e
        FROM m GROUP BY 1 ORDER BY valid_e, valid_b, site LIMIT 3""",
)
def worst_sites(spark, sf):
    from gridhazard.operators.fields import site_diagnostics as diag

    d = diag(site_storm_maxima(spark, sf))
    return d.orderBy("valid_e", "valid_b", "site").limit(3).select("site", "valid_b", "valid_e")


@query(
    "FV15 K03 K04",
    f"""WITH p AS (SELECT DISTINCT {H} // 24 AS storm FROM events),
        done AS (SELECT {H} // 24 AS storm FROM events GROUP BY 1 HAVING count(CASE WHEN value > 300 THEN 1 END) > 0)
        SELECT storm FROM p WHERE storm NOT IN (SELECT storm FROM done)""",
)
def storms_to_do(spark, sf):
    from gridhazard.sources.sinks import still_to_do

    ev = readings(spark, sf).withColumn("storm", F.floor(F.col("t") / 24))
    planned = ev.select("storm").distinct()
    done = ev.groupBy("storm").agg(F.count(F.when(F.col("value") > 300, 1)).alias("k")).filter("k > 0")
    return still_to_do(planned, done, ["storm"])
