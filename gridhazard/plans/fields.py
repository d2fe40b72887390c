"""Field and voltage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridhazard.operators import events as E
from gridhazard.operators import fields as V
from gridhazard.operators import series as R
from gridhazard.plans import sqltext as X
from gridhazard.plans.catalogue import sessions
from gridhazard.plans.registry import epoch_hour, query, table
from gridhazard.session import cut_lineage

DAYSQL = f"{X.hour('ts')} // 24"


def bands(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("period"), F.col("l_linenumber").alias("element"),
        (F.col("l_extendedprice") / 1000).alias("z_re"), F.col("l_quantity").alias("z_im"),
        F.col("l_discount").alias("z_var"),
    )


@query(
    "FV01 S08",
    """WITH b AS (SELECT l_suppkey AS site, l_partkey AS period, max(CASE WHEN l_discount > 0 AND
            sqrt(power(l_extendedprice / 1000, 2) + power(l_quantity, 2)) <= 60 THEN 0 ELSE 1 END) AS bad FROM lineitem GROUP BY 1, 2),
       listed AS (SELECT s_suppkey AS site FROM supplier WHERE s_acctbal < 5000),
       poor AS (SELECT site FROM b WHERE site IN (SELECT site FROM listed) GROUP BY 1 HAVING sum(1 - bad) < 380)
       SELECT site, count(*) AS kept FROM b WHERE (bad = 0 OR site NOT IN (SELECT site FROM listed)) AND site NOT IN (SELECT site FROM poor) GROUP BY 1""",
)
def screened_bands(spark, sf):
    listed = table(spark, sf, "supplier").filter(F.col("s_acctbal") < 5000).select(F.col("s_suppkey").alias("site"))
    kept = R.screened_bands(bands(spark, sf), listed, max_abs_z=60.0, min_periods=380)
    return kept.groupBy("site").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "S08",
    """WITH ok AS (SELECT DISTINCT upper(s_name) AS n FROM supplier WHERE s_acctbal > 4000),
       sites AS (SELECT s_suppkey AS site, s_name, s_nationkey AS rating FROM supplier)
       SELECT site, rating FROM sites WHERE CASE WHEN (SELECT count(*) FROM ok) = 0 THEN rating >= 3 ELSE upper(s_name) IN (SELECT n FROM ok) END""",
)
def accepted_sites(spark, sf):
    from gridhazard.sources.em_files import accepted

    sup = table(spark, sf, "supplier")
    sites = sup.select(F.col("s_suppkey").alias("site"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("rating"))
    allow = sup.filter(F.col("s_acctbal") > 4000).select(F.lower("s_name").alias("name"))
    return accepted(sites, allow).select("site", "rating")


def day_field(spark, sf):
    ev = table(spark, sf, "events")
    return ev.groupBy(
        F.floor(epoch_hour("ts") / 24).alias("t"), F.col("user_id").alias("site")
    ).agg(
        F.coalesce(F.max(F.when(F.col("event_type") == "click", F.col("value"))), F.lit(0.0)).alias("ex"),
        F.coalesce(F.max(F.when(F.col("event_type") == "view", F.col("value"))), F.lit(0.0)).alias("ey"),
    )


def line_weights(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("line"), F.col("l_suppkey").alias("site")).agg(
        F.sum("l_discount").alias("wx"), F.sum("l_tax").alias("wy")
    )


VOLT_SQL = f"""
e AS (SELECT {DAYSQL} AS t, user_id AS site, coalesce(max(CASE WHEN event_type = 'click' THEN value END), 0) AS ex,
   coalesce(max(CASE WHEN event_type = 'view' THEN value END), 0) AS ey FROM events GROUP BY 1, 2),
w AS (SELECT l_partkey AS line, l_suppkey AS site, sum(l_discount) AS wx, sum(l_tax) AS wy FROM lineitem GROUP BY 1, 2),
v AS (SELECT t, line, sum(wx * ex + wy * ey) AS v FROM e JOIN w USING (site) GROUP BY 1, 2)"""


@query("FV11", f"WITH {VOLT_SQL} SELECT t AS day, line, round(v, 5) AS v FROM v")
def line_voltages(spark, sf):
    v = V.line_voltages(day_field(spark, sf), line_weights(spark, sf))
    return v.select(F.col("t").alias("day"), "line", F.round("v", 5).alias("v"))


@query("FV13", f"WITH {VOLT_SQL} SELECT line, round(max(abs(v)), 5) AS max_v, count(*) AS n FROM v GROUP BY 1")
def line_max(spark, sf):
    v = V.line_voltages(day_field(spark, sf), line_weights(spark, sf))
    return v.groupBy("line").agg(F.round(F.max(F.abs("v")), 5).alias("max_v"), F.count(F.lit(1)).alias("n"))


@query(
    "FV12",
    """WITH bad AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount = 0 AND l_tax = 0)
       SELECT l_partkey AS line, count(*) AS n, round(sum(l_discount), 4) AS wx FROM lineitem
       WHERE l_partkey NOT IN (SELECT l_partkey FROM bad) GROUP BY 1""",
)
def valid_lines(spark, sf):
    li = table(spark, sf, "lineitem")
    none = (F.col("l_discount") == 0) & (F.col("l_tax") == 0)
    w = li.select(
        F.col("l_partkey").alias("line"),
        F.when(none, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("wx"), F.col("l_tax").alias("wy"),
    )
    return V.valid_lines(w).groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("wx"), 4).alias("wx"))


def storm_observations(spark, sf):
    """Observatory = nation of the customer a reading belongs to; B = its hourly extremes in a storm."""
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("obs"))
    ev = table(spark, sf, "events").withColumn("t", epoch_hour("ts")).join(cust, "user_id")
    hourly = ev.groupBy("obs", "t").agg(F.max("value").alias("bx"), F.min("value").alias("by"))
    spine = R.whole_day_spine(hourly, ["obs"]).join(hourly, ["obs", "t"], "left")
    for c in ("bx", "by"):
        spine = R.nearest_filled(spine, ["obs"], c, f"{c}_f").drop(c).withColumnRenamed(f"{c}_f", c)
    cut = E.in_windows(spine, sessions(spark, sf)).withColumnRenamed("start_t", "storm")
    full = R.common_positions(cut, "storm", "obs")
    return cut.join(full, ["storm", "t"], "left_semi").select("storm", "t", "obs", "bx", "by")


def station_coordinates(df, key):
    k = F.col(key).cast("double")
    return df.withColumns({"lat": 28.0 + F.pmod(k * 7.3, F.lit(20.0)), "lon": -120.0 + F.pmod(k * 13.7, F.lit(50.0))})


def synthesised(spark, sf):
    """Field at every site and time of the storms, and the pairs of storm and site."""
    # The aligned readings feed both the weights and the synthesis.
    obs = cut_lineage(storm_observations(spark, sf))
    stations = station_coordinates(obs.select("storm", "obs").distinct(), "obs")
    sites = station_coordinates(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("site")), "site")
    pairs = stations.select("storm").distinct().crossJoin(sites.select("site"))
    return V.synthesised_field(obs, V.transfer_weights(stations, sites)), pairs


@query("FV02 FV04")
def field_synthesis(spark, sf):
    """Highest horizontal field per storm and site from current-system interpolation (SVD, no SQL)."""
    from gridhazard.functions.scalar import magnitude

    b, _ = synthesised(spark, sf)
    return b.groupBy("storm", "site").agg(
        F.round(F.max(magnitude(F.col("bx"), F.col("by"))), 4).alias("max_b"), F.count(F.lit(1)).alias("n")
    )


@query("FV05 FV07")
def electric_field_maxima(spark, sf):
    """Highest electric field per storm and site, without the 1.2 days at either end, after impedance filtering (FFT, no SQL)."""
    from gridhazard.functions.scalar import finite_or, magnitude

    element = F.element_at(F.array(*[F.lit(e) for e in ("xx", "xy", "yx", "yy")]), (F.col("l_linenumber") % 4 + 1))
    z = table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("site"), (F.col("l_quantity") * 3600).alias("period"), element.alias("element")
    ).agg(F.avg("l_discount").alias("z_re"), F.avg("l_tax").alias("z_im"))
    field, pairs = synthesised(spark, sf)
    e = R.trimmed(V.electric_field(field, z, dt=3600.0, pairs=pairs), "storm", "site", int(1.2 * 24))  # 1.2 days of hours
    size = magnitude(finite_or(F.col("ex"), 0.0), finite_or(F.col("ey"), 0.0))
    return e.groupBy("storm", "site").agg(F.round(F.max(size), 6).alias("max_e"))
