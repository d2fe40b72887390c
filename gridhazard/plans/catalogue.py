"""Storm catalogue queries. Index series: hourly maxima of the ``events`` stream;
Dst is minus the hourly maximum of 'error' readings, Kp that of 'click' readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridhazard.operators import events as E
from gridhazard.operators.ordered import top_per_key
from gridhazard.plans import sqltext as X
from gridhazard.plans.registry import epoch_hour, query, stamp, table

DST_MAX, KP_MIN = -120.0, 160.0
GAP, PAD, HALF = 6, 3, 12


def index_series(spark, sf):
    ev = table(spark, sf, "events").withColumn("h", epoch_hour("ts"))
    hourly = E.gridded(
        ev, [], "h",
        dst=-F.max(F.when(F.col("event_type") == "error", F.col("value"))),
        kp=F.max(F.when(F.col("event_type") == "click", F.col("value"))),
        ap=F.max("value"),
    )
    return hourly


INDEX_SQL = f"""
ix AS (SELECT {X.hour('ts')} AS t,
         -max(CASE WHEN event_type = 'error' THEN value END) AS dst,
         max(CASE WHEN event_type = 'click' THEN value END) AS kp,
         max(value) AS ap FROM events GROUP BY 1)"""

TIMES_SQL = f"""{INDEX_SQL},
times AS (SELECT t FROM ix WHERE dst <= {DST_MAX} UNION SELECT t FROM ix WHERE kp >= {KP_MIN})"""


@query("ST01", f"WITH {TIMES_SQL} SELECT {X.stamp('t')} AS ts FROM times")
def threshold_times(spark, sf):
    times = E.threshold_times(index_series(spark, sf), dst_max=DST_MAX, kp_min=KP_MIN)
    return times.select(stamp("t").alias("ts"))


SESSIONS_SQL = f"""{TIMES_SQL},
marked AS (SELECT t, CASE WHEN t - lag(t) OVER (ORDER BY t) <= {2 * GAP} THEN 0 ELSE 1 END AS s FROM times),
numbered AS (SELECT t, sum(s) OVER (ORDER BY t) AS k FROM marked),
storms AS (SELECT min(t) - {PAD} AS start_t, max(t) + {PAD} AS end_t,
             CAST(max(t) - min(t) + {2 * PAD} AS BIGINT) AS duration_h FROM numbered GROUP BY k)"""


def sessions(spark, sf):
    times = E.threshold_times(index_series(spark, sf), dst_max=DST_MAX, kp_min=KP_MIN)
    return E.storm_sessions(times, GAP, PAD)


@query(
    "ST02",
    f"""WITH {SESSIONS_SQL} SELECT {X.stamp('start_t')} AS start_ts, {X.stamp('end_t')} AS end_ts,
        duration_h FROM storms""",
)
def storm_sessions(spark, sf):
    s = sessions(spark, sf)
    return s.select(
        stamp("start_t").alias("start_ts"), stamp("end_t").alias("end_ts"),
        F.col("duration_h").cast("bigint").alias("duration_h"),
    )


@query(
    "ST03",
    f"""WITH coarse AS (SELECT {X.hour('ts')} // 3 * 3 AS t, max(value) AS v FROM events
          WHERE event_type = 'signup' GROUP BY 1),
        {INDEX_SQL},
        both_t AS (SELECT t FROM ix UNION SELECT t FROM coarse),
        filled AS (SELECT b.t, last_value(c.v IGNORE NULLS) OVER (ORDER BY b.t
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kp_filled
          FROM both_t b LEFT JOIN coarse c USING (t))
        SELECT {X.stamp('ix.t')} AS ts, dst, kp_filled FROM ix JOIN filled USING (t)""",
)
def asof_ffill(spark, sf):
    ev = table(spark, sf, "events").filter(F.col("event_type") == "signup")
    coarse = E.gridded(
        ev.withColumn("h", F.floor(epoch_hour("ts") / 3) * 3), [], "h", v=F.max("value")
    )
    fine = index_series(spark, sf).select("t", "dst")
    return E.forward_filled(coarse, fine, "v", "kp_filled").select(
        stamp("t").alias("ts"), "dst", "kp_filled"
    )


def _greedy_sql(value, thr_cond, src, name):
    return f"""
{name}(n, picks, t, v) AS (
  SELECT 0, CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE)
  UNION ALL
  SELECT any_value(g.n) + 1, list_append(any_value(g.picks), arg_min(s.t, {{'v': {value}, 't': s.t}})),
         arg_min(s.t, {{'v': {value}, 't': s.t}}), min({value})
  FROM {name} g, {src} s
  WHERE (g.n = 0 OR g.v {thr_cond}) AND {value} IS NOT NULL
    AND len(list_filter(g.picks, lambda p: abs(p - s.t) <= {HALF})) = 0
  HAVING count(*) > 0)"""


GREEDY_SQL = f"""{INDEX_SQL},
{_greedy_sql('s.dst', f'< {DST_MAX}', 'ix', 'g1')},
open2 AS (SELECT * FROM ix WHERE NOT EXISTS (SELECT 1 FROM g1 WHERE g1.n > 0 AND abs(g1.t - ix.t) <= {HALF})),
{_greedy_sql('-s.kp', f'<= -{KP_MIN}', 'open2', 'g2')},
picks AS (
  SELECT t, v AS value, CASE WHEN v < {DST_MAX} THEN 0 ELSE 1 END AS terminating, 1 AS phase FROM g1 WHERE n > 0
  UNION ALL
  SELECT t, -v, CASE WHEN -v >= {KP_MIN} THEN 0 ELSE 1 END, 2 FROM g2 WHERE n > 0)"""


def greedy_picks(spark, sf):
    return E.greedy_storms(index_series(spark, sf), dst_max=DST_MAX, kp_min=KP_MIN, half=HALF)


@query(
    "ST04",
    f"""WITH RECURSIVE {GREEDY_SQL} SELECT {X.stamp('t')} AS ts, value,
          CAST(terminating AS BIGINT) AS terminating, CAST(phase AS BIGINT) AS phase FROM picks""",
)
def greedy_exclusion(spark, sf):
    return greedy_picks(spark, sf).select(
        stamp("t").alias("ts"), "value",
        F.col("terminating").cast("bigint").alias("terminating"),
        F.col("phase").cast("bigint").alias("phase"),
    )


RUNS_SQL = f"""{GREEDY_SQL},
flagged AS (SELECT ix.*, EXISTS (SELECT 1 FROM picks WHERE abs(picks.t - ix.t) <= {HALF}) AS storm FROM ix),
edges AS (SELECT *, CASE WHEN storm AND NOT coalesce(lag(storm) OVER (ORDER BY t), false) THEN 1 ELSE 0 END AS f FROM flagged),
numbered AS (SELECT *, sum(f) OVER (ORDER BY t) AS k FROM edges),
runs AS (SELECT min(t) AS start_t, max(t) AS end_t FROM numbered WHERE storm GROUP BY k
         HAVING max(t) - min(t) >= 3)"""


def storm_runs(spark, sf):
    series = index_series(spark, sf)
    masked = E.around(greedy_picks(spark, sf).select("t"), HALF).withColumn("_m", F.lit(True))
    flagged = series.join(masked, "t", "left").withColumn("storm", F.coalesce("_m", F.lit(False)))
    return series, E.mask_runs(flagged.drop("_m"), "storm", 3)


@query(
    "ST05",
    f"WITH RECURSIVE {RUNS_SQL} SELECT {X.stamp('start_t')} AS start_ts, {X.stamp('end_t')} AS end_ts FROM runs",
)
def mask_islands(spark, sf):
    _, runs = storm_runs(spark, sf)
    return runs.select(stamp("start_t").alias("start_ts"), stamp("end_t").alias("end_ts"))


@query(
    "ST06",
    f"""WITH RECURSIVE {RUNS_SQL},
        c AS (SELECT start_t, max(kp) AS max_kp, min(dst) AS min_dst FROM runs JOIN ix
              ON ix.t BETWEEN start_t AND end_t GROUP BY start_t)
        SELECT CASE WHEN max_kp >= {KP_MIN} AND min_dst <= {DST_MAX} THEN 'both' WHEN max_kp >= {KP_MIN} THEN 'kp'
                    WHEN min_dst <= {DST_MAX} THEN 'dst' ELSE 'neither' END AS class,
               count(*) AS n, round(max(max_kp), 4) AS max_kp, round(min(min_dst), 4) AS min_dst
        FROM c GROUP BY 1""",
)
def run_classes(spark, sf):
    series, runs = storm_runs(spark, sf)
    c = E.classify_runs(runs, series, dst_max=DST_MAX, kp_min=KP_MIN)
    return c.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("max_kp"), 4).alias("max_kp"),
        F.round(F.min("min_dst"), 4).alias("min_dst"),
    )


@query(
    "ST07",
    f"""WITH {INDEX_SQL} SELECT {X.stamp('min(t)')} AS first_ts, {X.stamp('max(t)')} AS last_ts, count(ap) AS n,
        round(avg(ap), 6) AS mean_ap, round(stddev_samp(ap), 6) AS std_ap, min(ap) AS min_ap, max(ap) AS max_ap FROM ix""",
)
def index_profile(spark, sf):
    d = index_series(spark, sf)
    return d.agg(
        F.min("t").alias("a"), F.max("t").alias("b"), F.count("ap").alias("n"),
        F.round(F.avg("ap"), 6).alias("mean_ap"), F.round(F.stddev_samp("ap"), 6).alias("std_ap"),
        F.min("ap").alias("min_ap"), F.max("ap").alias("max_ap"),
    ).select(stamp("a").alias("first_ts"), stamp("b").alias("last_ts"), "n", "mean_ap", "std_ap", "min_ap", "max_ap")


@query(
    "ST07",
    f"""WITH {INDEX_SQL} SELECT {X.stamp('t')} AS ts, ap, kp FROM ix ORDER BY ap DESC, t LIMIT 10""",
)
def index_top10(spark, sf):
    return (
        index_series(spark, sf).orderBy(F.desc("ap"), "t").limit(10)
        .select(stamp("t").alias("ts"), "ap", "kp")
    )


@query(
    "ST07 S01",
    f"""WITH {INDEX_SQL} SELECT CAST(least(floor(kp / 30), 9) AS BIGINT) AS kp_class, count(*) AS n
        FROM ix WHERE kp IS NOT NULL GROUP BY 1""",
)
def index_histogram(spark, sf):
    d = index_series(spark, sf).filter(F.col("kp").isNotNull())
    return d.groupBy(F.least(F.floor(F.col("kp") / 30), F.lit(9)).cast("bigint").alias("kp_class")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "ST08",
    """SELECT p.period AS period, count(*) AS n, round(sum(value), 4) AS total FROM events
       JOIN (VALUES ('first_week', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-08'),
                    ('mid', TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-20'),
                    ('whole', TIMESTAMP '2000-01-01', TIMESTAMP '2025-01-01')) p(period, a, b)
         ON ts > p.a AND ts < p.b GROUP BY 1""",
)
def period_slices(spark, sf):
    ev = table(spark, sf, "events")
    spans = (("first_week", "2024-01-01", "2024-01-08"), ("mid", "2024-01-10", "2024-01-20"),
             ("whole", "2000-01-01", "2025-01-01"))
    tags = F.array_compact(F.array(*[
        F.when((F.col("ts") > F.lit(a).cast("timestamp")) & (F.col("ts") < F.lit(b).cast("timestamp")), F.lit(n))
        for n, a, b in spans
    ]))
    return ev.select(F.explode(tags).alias("period"), "value").groupBy("period").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


# Named events: the hour of each month-day window is fixed, as a storm list would be.
NAMED = (("early", "2024-01-03", "2024-01-05"), ("middle", "2024-01-14", "2024-01-15"),
         ("late", "2024-01-24", "2024-01-27"))
NAMED_SQL = "named(name, event_start, event_end) AS (VALUES " + ", ".join(
    f"('{n}', CAST(epoch(TIMESTAMP '{a}') / 3600 AS BIGINT), CAST(epoch(TIMESTAMP '{b}') / 3600 AS BIGINT))"
    for n, a, b in NAMED
) + ")"


def named_events(spark):
    rows = spark.createDataFrame(list(NAMED), "name string, a string, b string")
    to_h = lambda c: F.expr(f"unix_timestamp(cast({c} as timestamp)) div 3600")
    return rows.select("name", to_h("a").alias("event_start"), to_h("b").alias("event_end"))


@query(
    "ST09",
    f"""WITH {SESSIONS_SQL}, {NAMED_SQL} SELECT name, {X.stamp('start_t')} AS start_ts FROM storms, named
        WHERE start_t <= event_end AND end_t >= event_start""",
)
def event_overlap(spark, sf):
    return E.overlapping(sessions(spark, sf), named_events(spark)).select(
        "name", stamp("start_t").alias("start_ts")
    )


@query(
    "ST10",
    f"""WITH {SESSIONS_SQL}, {NAMED_SQL},
        ranked AS (SELECT *, row_number() OVER (ORDER BY start_t) - 1 AS k FROM storms)
        SELECT {X.stamp('start_t')} AS start_ts, CASE WHEN min(name) IS NULL THEN 0 ELSE 1 END AS special,
          coalesce(min(name), 'storm_' || any_value(k)) AS storm_name
        FROM ranked LEFT JOIN named ON start_t <= event_end AND end_t >= event_start GROUP BY start_t""",
)
def storm_names(spark, sf):
    from gridhazard.operators.ordered import dense_position

    s = sessions(spark, sf).withColumn("month", F.floor(F.col("start_t") / (24 * 30)))
    ranked = dense_position(s, [], "month", "start_t", "k")
    hits = E.overlapping(s, named_events(spark)).groupBy("start_t").agg(F.min("name").alias("name"))
    return ranked.join(hits, "start_t", "left").select(
        stamp("start_t").alias("start_ts"),
        F.when(F.col("name").isNull(), 0).otherwise(1).alias("special"),
        F.coalesce("name", F.concat(F.lit("storm_"), (F.col("k") - 1).cast("string"))).alias("storm_name"),
    )


@query(
    "TS08",
    f"""WITH {SESSIONS_SQL} SELECT {X.stamp('start_t')} AS start_ts, event_type, count(*) AS n, round(sum(value), 4) AS total
        FROM events JOIN storms ON {X.hour('ts')} BETWEEN start_t AND end_t GROUP BY 1, 2""",
)
def window_cut(spark, sf):
    ev = table(spark, sf, "events").select(epoch_hour("ts").alias("t"), "event_type", "value")
    return E.in_windows(ev, sessions(spark, sf)).groupBy(
        stamp("start_t").alias("start_ts"), "event_type"
    ).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
