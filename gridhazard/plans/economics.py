"""Economic allocation, input-output and reporting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridhazard.functions.fixed_values import (
    NAICS_SECTOR, SECTORS, USE_FINAL_DEMAND_COLUMNS, USE_OUTPUT_ROW, USE_TABLE_SECTOR, USE_VALUE_ADDED_ROWS,
)
from gridhazard.operators import economy as E
from gridhazard.operators import reporting as V
from gridhazard.plans import sqltext as X
from gridhazard.plans.registry import query, table

CODES = ("11", "21", "22", "23", "31", "42", "44", "48", "51", "52", "53", "54", "55", "56", "61", "62", "71", "72", "81")
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
LST = lambda xs: f"[{', '.join(repr(x) for x in xs)}]"


def pick(options, i):
    return F.element_at(F.array(*[F.lit(o) for o in options]), (i + 1).cast("int"))


@query(
    "E01 S15",
    """SELECT c_nationkey AS zcta, count(*) AS n, CAST(sum(CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(floor(c_acctbal) AS BIGINT) END) AS BIGINT) AS pop20 FROM customer
       WHERE c_custkey % 17 <> 0 GROUP BY 1""",
)
def census_population(spark, sf):
    c = table(spark, sf, "customer")
    # Census text: padded codes, blanks for areas without a code, unreadable counts.
    code = F.when(F.col("c_custkey") % 17 == 0, "   ").otherwise(F.concat(F.lit("  "), F.col("c_nationkey").cast("string"), F.lit(" ")))
    pop = F.when(F.col("c_acctbal") < 0, "n/a").otherwise(F.concat(F.lit(" "), F.floor("c_acctbal").cast("string")))
    d = E.clean_population(c.select(code.alias("zcta"), pop.alias("pop20")))
    return d.groupBy(F.col("zcta").cast("int").alias("zcta")).agg(F.count(F.lit(1)).alias("n"), F.sum("pop20").alias("pop20"))


def zip_detail(spark, sf):
    """Establishment detail: a two-digit row per line, finer rows, and one all-industries row per zip."""
    li = table(spark, sf, "lineitem")
    code = F.concat(pick(CODES, F.col("l_partkey") % len(CODES)), F.when(F.col("l_linenumber") == 7, "1---").otherwise("----"))
    rows = li.select(F.col("l_suppkey").alias("zip"), code.alias("naics"), F.col("l_quantity").alias("est"))
    total = li.groupBy(F.col("l_suppkey").alias("zip")).agg(F.lit("------").alias("naics"), F.sum("l_quantity").alias("est"))
    return rows.unionByName(total.filter(F.col("zip") % 10 != 0))


EST = f"""
sec AS (SELECT l_suppkey AS zip, {LST(CODES)}[l_partkey % {len(CODES)} + 1] AS naics, sum(l_quantity) AS est FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1, 2),
tt AS (SELECT l_suppkey AS zip, sum(l_quantity) AS t FROM lineitem WHERE l_suppkey % 10 <> 0 GROUP BY 1),
ss AS (SELECT zip, sum(est) AS s FROM sec GROUP BY 1),
est AS (SELECT zip, naics, est FROM sec UNION ALL SELECT coalesce(tt.zip, ss.zip), 'UNCLFD', coalesce(t, 0) - coalesce(s, 0) FROM tt FULL OUTER JOIN ss ON tt.zip = ss.zip)"""


@query("E02", f"WITH {EST} SELECT zip, naics, est FROM est")
def residual_sector(spark, sf):
    return E.establishments(zip_detail(spark, sf)).select("zip", "naics", "est")


def crosswalk(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(
        F.col("s_suppkey").alias("zip"), F.when(F.col("s_acctbal") > 500, F.floor(F.col("s_suppkey") / 2)).alias("zcta"), F.col("s_nationkey").alias("state")
    )


ZC = f"""{EST},
zc AS (SELECT s_suppkey // 2 AS zcta, naics, s_nationkey AS state, sum(est) AS est FROM est JOIN supplier ON s_suppkey = zip WHERE s_acctbal > 500 GROUP BY 1, 2, 3)"""


def zcta_est(spark, sf):
    return E.by_zcta(E.establishments(zip_detail(spark, sf)), crosswalk(spark, sf))


@query("E03 S23", f"WITH {ZC} SELECT zcta, naics, state, est FROM zc")
def zcta_establishments(spark, sf):
    return zcta_est(spark, sf).select("zcta", "naics", "state", "est")


@query(
    "E04",
    """WITH g AS (SELECT c_nationkey AS k, round(sum(o_totalprice), 2) AS gdp FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
       e AS (SELECT s_nationkey AS k, count(*) AS employment FROM supplier GROUP BY 1), p AS (SELECT c_nationkey AS k, count(*) AS population FROM customer GROUP BY 1)
       SELECT CAST(g.k AS BIGINT) AS fips, gdp, employment, population FROM g JOIN e USING (k) JOIN p USING (k)""",
)
def state_gdp_employment(spark, sf):
    fips = lambda c: F.substring(F.concat(F.lit("US"), F.lpad(F.col(c).cast("string"), 2, "0")), 3, 2).cast("bigint").alias("fips")
    cust = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    g = o.join(cust, "c_custkey").groupBy(fips("c_nationkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("gdp"))
    e = table(spark, sf, "supplier").groupBy(fips("s_nationkey")).agg(F.count(F.lit(1)).alias("employment"))
    p = cust.groupBy(fips("c_nationkey")).agg(F.count(F.lit(1)).alias("population"))
    return g.join(e, "fips").join(p, "fips")


def state_rows(spark, sf):
    """State industry rows; some codes are ranges, some are sub-totals to be ignored."""
    cust = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf, "orders")
    code = pick(CODES + ("92",), F.col("o_orderkey") % (len(CODES) + 1))
    text = F.when(code == "31", "31-33").when(code == "44", "44-45").when(code == "48", "48-49").otherwise(code)
    text = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(text, F.lit(",x"))).otherwise(text)
    return o.select(F.col("o_custkey").alias("c_custkey"), text.alias("industry"), F.col("o_totalprice").alias("gdp")).join(cust, "c_custkey").select(
        F.col("c_nationkey").alias("state"), "industry", "gdp"
    )


SG = f"""
so AS (SELECT c_nationkey AS state, {LST(CODES + ('92',))}[o_orderkey % {len(CODES) + 1} + 1] AS naics, o_totalprice AS gdp FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority <> '1-URGENT'),
sg AS (SELECT state, naics, sum(gdp) AS gdp FROM so GROUP BY 1, 2 UNION ALL SELECT state, '--', sum(gdp) FROM so GROUP BY 1)"""


@query("E07", f"WITH {SG} SELECT state, naics, round(gdp, 2) AS gdp FROM sg")
def total_row(spark, sf):
    return E.state_industries(state_rows(spark, sf)).select("state", "naics", F.round("gdp", 2).alias("gdp"))


AL = f"""{ZC}, {SG},
al AS (SELECT zcta, zc.naics, zc.state, est, round(est / sum(est) OVER (PARTITION BY zc.state, zc.naics) * gdp, 2) AS gdp FROM zc
  LEFT JOIN sg ON sg.state = zc.state AND sg.naics = CASE WHEN zc.naics = 'UNCLFD' THEN '92' ELSE zc.naics END)"""


def allocated(spark, sf):
    return E.allocated_output(zcta_est(spark, sf), E.state_industries(state_rows(spark, sf)))


@query("E08", f"WITH {AL} SELECT zcta, naics, state, est, gdp FROM al")
def proportional_alloc(spark, sf):
    return allocated(spark, sf).select("zcta", "naics", "state", "est", "gdp")


_SEC = "CASE naics " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAICS_SECTOR.items()) + " END"


@query(
    "E09 E10",
    f"""WITH {AL}, mn AS (SELECT zcta, naics, avg(gdp / 365) AS g, avg(est) AS e FROM al GROUP BY 1, 2), sx AS (SELECT *, {_SEC} AS sector FROM mn)
        SELECT zcta, {', '.join(f"round(coalesce(sum(CASE WHEN sector = '{s}' THEN g END), 0), 2) AS gdp_{s}, round(coalesce(sum(CASE WHEN sector = '{s}' THEN e END), 0), 4) AS est_{s}" for s in SECTORS)},
          coalesce((SELECT sum(c_acctbal) FROM customer WHERE c_custkey = zcta AND c_acctbal > 0), 0) AS pop20 FROM sx GROUP BY 1""",
)
def sector_wide(spark, sf):
    wide = E.sector_table(allocated(spark, sf), "zcta", SECTORS, CODES + ("UNCLFD",))
    pop = table(spark, sf, "customer").filter("c_acctbal > 0").groupBy(F.col("c_custkey").alias("zcta")).agg(F.sum("c_acctbal").alias("pop20"))
    d = wide.join(pop, "zcta", "left").na.fill(0.0, ["pop20"])
    return d.select("zcta", *[F.round(f"gdp_{s}", 2).alias(f"gdp_{s}") for s in SECTORS], *[F.round(f"est_{s}", 4).alias(f"est_{s}") for s in SECTORS], "pop20")


# ------------------------------------------------------------------- raster


def pixels(spark, sf):
    """Pixel (row = part, column = supplier), class from the quantity (0 = no data)."""
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col")).agg(
        F.min(F.floor("l_quantity") % 30).cast("bigint").alias("class")
    )


PX = "px AS (SELECT l_partkey AS row, l_suppkey AS col, min(CAST(floor(l_quantity) AS BIGINT) % 30) AS class FROM lineitem GROUP BY 1, 2)"


@query(
    "E12",
    f"WITH {PX}, c AS (SELECT row // 4 AS row, col // 4 AS col, class, count(*) AS n FROM px GROUP BY 1, 2, 3) SELECT row, col, arg_min(class, {{'n': -n, 'c': class}}) AS class FROM c GROUP BY 1, 2",
)
def block_mode(spark, sf):
    return E.block_mode(pixels(spark, sf), 4)


TL = f"""{PX},
sz AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM px),
tl AS (SELECT px.*, least(row // greatest(h // 8, 1), 7) * 8 + least(col // greatest(w // 8, 1), 7) AS tile FROM px, sz)"""


def tiled(spark, sf):
    px = pixels(spark, sf)
    # The raster size is a property of the grid: two scalars.
    size = px.agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    h, w = size.select("h").scalar(), size.select("w").scalar()
    return px.withColumn("tile", E.tile_of(F.col("row"), F.col("col"), h, w))


@query("E14", f"WITH {TL} SELECT CAST(tile AS BIGINT) AS tile, count(*) AS n, min(row) AS first_row, max(col) AS last_col FROM tl GROUP BY 1")
def tiling(spark, sf):
    return tiled(spark, sf).groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"), F.max("col").alias("last_col"))


MK = f"""{TL},
hs AS (SELECT row AS strip, max(CASE WHEN class IN (21, 22, 23, 24) THEN 1 ELSE 0 END) AS any_m FROM px GROUP BY 1),
mk AS (SELECT px.* FROM px JOIN hs ON strip = row WHERE CASE WHEN any_m = 1 THEN class IN (21, 22, 23, 24) ELSE class <> 0 END)"""


def masked(spark, sf):
    """Mask with a row of pixels as the window, so that some windows need the fallback."""
    return E.masked(pixels(spark, sf), "row")


@query("E13", f"WITH {MK} SELECT row, col, class FROM mk")
def binary_mask(spark, sf):
    return masked(spark, sf).select("row", "col", "class")


DS = f"""{MK},
n AS (SELECT row % 97 AS zcta, col AS sub, count(*) AS n FROM mk GROUP BY 1, 2), a AS (SELECT zcta, sum(n) AS al FROM n GROUP BY 1),
am AS (SELECT c_custkey % 97 AS zcta, sum(c_acctbal) AS gdp, CAST(count(*) AS DOUBLE) AS pop FROM customer GROUP BY 1)"""


@query("E15", f"WITH {DS} SELECT sub, round(sum(n::DOUBLE / al * gdp), 3) AS gdp, round(sum(n::DOUBLE / al * pop), 6) AS pop FROM n JOIN a USING (zcta) JOIN am USING (zcta) GROUP BY 1")
def dasymetric(spark, sf):
    px = masked(spark, sf).select((F.col("row") % 97).alias("zcta"), F.col("col").alias("sub"))
    amounts = table(spark, sf, "customer").groupBy((F.col("c_custkey") % 97).alias("zcta")).agg(
        F.sum("c_acctbal").alias("gdp"), F.count(F.lit(1)).cast("double").alias("pop")
    )
    d = E.dasymetric(px, "zcta", "sub", amounts, ["gdp", "pop"])
    return d.select("sub", F.round("gdp", 3).alias("gdp"), F.round("pop", 6).alias("pop"))


@query(
    "E16",
    f"""WITH {TL}, t AS (SELECT col AS sub, tile, CAST(sum(class) AS DOUBLE) AS v FROM tl GROUP BY 1, 2)
        SELECT sub, round(sum(v), 4) AS total, round(avg(v), 6) AS mean FROM t GROUP BY 1""",
)
def tile_totals(spark, sf):
    part = tiled(spark, sf).groupBy(F.col("col").alias("sub"), "tile").agg(F.sum("class").cast("double").alias("v"))
    total = E.tile_aggregate(part, "sub", ["v"]).withColumnRenamed("v", "total")
    mean = E.tile_aggregate(part, "sub", ["v"], "mean").withColumnRenamed("v", "mean")
    return total.join(mean, "sub").select("sub", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


# ------------------------------------------------------------ input-output

USE_CODES = tuple(USE_TABLE_SECTOR)


def use_table(spark, sf):
    """Long Use table: codes from part and supplier, text values with '---' for nothing."""
    from gridhazard.sources.econ_files import clean_use_values

    li = table(spark, sf, "lineitem")
    value = F.when(F.col("l_quantity") < 3, "---").otherwise(F.col("l_extendedprice").cast("string"))
    raw = li.select(
        F.concat(F.lit(" "), pick(USE_CODES, F.col("l_partkey") % len(USE_CODES))).alias("code"),
        pick(USE_CODES, F.col("l_suppkey") % len(USE_CODES)).alias("column_code"), value.alias("value"),
    )
    return clean_use_values(raw)


_G = lambda c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in USE_TABLE_SECTOR.items()) + " END"
UT = f"""
ut AS (SELECT {LST(USE_CODES)}[l_partkey % {len(USE_CODES)} + 1] AS code, {LST(USE_CODES)}[l_suppkey % {len(USE_CODES)} + 1] AS cc, CASE WHEN l_quantity < 3 THEN 0 ELSE l_extendedprice END AS v FROM lineitem),
fl AS (SELECT {_G('code')} AS r, {_G('cc')} AS c, sum(v) AS u FROM ut GROUP BY 1, 2),
xo AS (SELECT c AS sector, sum(u) * 2.7e0 AS x FROM fl GROUP BY 1),
aa AS (SELECT r, c, round(u / x, 6) AS a FROM fl JOIN xo ON sector = c)"""


def technology(spark, sf):
    from gridhazard.session import cut_lineage

    flows = cut_lineage(E.transactions(use_table(spark, sf), USE_TABLE_SECTOR))
    output = flows.groupBy(F.col("col").alias("sector")).agg((F.sum("u") * 2.7).alias("x"))
    return E.requirements(flows, output), output


@query("I01 S17", f"WITH {UT} SELECT r AS row, c AS col, a FROM aa")
def tech_matrix(spark, sf):
    a, _ = technology(spark, sf)
    return a.select("row", "col", "a")


# The whole Use table: sector codes, value added and the output row down, sector codes and
# final demand across; T001 and T019 are totals of the source that take no part.
USE_ROWS = USE_CODES + USE_VALUE_ADDED_ROWS + (USE_OUTPUT_ROW, "T001")
USE_COLUMNS = USE_CODES + USE_FINAL_DEMAND_COLUMNS + ("T019",)


def full_use_table(spark, sf):
    from gridhazard.sources.econ_files import clean_use_values

    li = table(spark, sf, "lineitem")
    # An industry's output is several times any of its inputs.
    amount = F.col("l_extendedprice") * F.when(F.col("l_partkey") % len(USE_ROWS) == USE_ROWS.index(USE_OUTPUT_ROW), 64).otherwise(1)
    value = F.when(F.col("l_quantity") < 3, "---").otherwise(amount.cast("string"))
    return clean_use_values(li.select(
        F.concat(F.lit(" "), pick(USE_ROWS, F.col("l_partkey") % len(USE_ROWS))).alias("code"),
        pick(USE_COLUMNS, F.col("l_suppkey") % len(USE_COLUMNS)).alias("column_code"), value.alias("value"),
    ))


def accounts(spark, sf):
    return E.use_accounts(full_use_table(spark, sf), USE_TABLE_SECTOR, USE_VALUE_ADDED_ROWS, USE_FINAL_DEMAND_COLUMNS, USE_OUTPUT_ROW)


USE = f"""
us AS (SELECT {LST(USE_ROWS)}[l_partkey % {len(USE_ROWS)} + 1] AS code, {LST(USE_COLUMNS)}[l_suppkey % {len(USE_COLUMNS)} + 1] AS cc, l_extendedprice AS p, l_quantity AS q FROM lineitem),
uk AS (SELECT code, cc, {_G('code')} AS gr, {_G('cc')} AS gc, CASE WHEN q < 3 THEN 0 WHEN code = '{USE_OUTPUT_ROW}' THEN p * 64 ELSE p END AS v FROM us),
ua AS (SELECT 'flow' AS account, gr AS row, gc AS col, v FROM uk WHERE gr IS NOT NULL AND gc IS NOT NULL
  UNION ALL SELECT 'value_added', code, gc, v FROM uk WHERE list_contains({LST(USE_VALUE_ADDED_ROWS)}, code) AND gc IS NOT NULL
  UNION ALL SELECT 'final_demand', gr, cc, v FROM uk WHERE gr IS NOT NULL AND list_contains({LST(USE_FINAL_DEMAND_COLUMNS)}, cc)
  UNION ALL SELECT 'output', code, gc, v FROM uk WHERE code = '{USE_OUTPUT_ROW}' AND gc IS NOT NULL)"""


@query(
    "I01",
    f"""WITH {USE} SELECT account, row, col, round(sum(v), 2) AS value FROM ua GROUP BY account, row, col
        UNION ALL SELECT account, NULL, col, round(sum(v), 2) FROM ua GROUP BY account, col
        UNION ALL SELECT account, row, NULL, round(sum(v), 2) FROM ua GROUP BY account, row""",
)
def use_margins(spark, sf):
    """Transactions, value added, final demand and output by sector, with totals both ways."""
    return accounts(spark, sf).select("account", "row", "col", F.round("value", 2).alias("value"))


def production(spark, sf):
    """Requirements, output, value added and final demand of the whole Use table."""
    from gridhazard.session import cut_lineage

    acc = cut_lineage(accounts(spark, sf))
    output = E.account_totals(acc, "output").withColumnRenamed("value", "x")
    return E.requirements(E.account_cells(acc, "flow").withColumnRenamed("value", "u"), output), output, acc


@query(
    "I01",
    f"""WITH {USE}, fw AS (SELECT row, col, sum(v) AS u FROM ua WHERE account = 'flow' GROUP BY 1, 2), go AS (SELECT col, sum(v) AS x FROM ua WHERE account = 'output' GROUP BY 1)
        SELECT row, col, round_even(u / x, 6) AS a FROM fw JOIN go USING (col)""",
)
def direct_requirements(spark, sf):
    a, _, _ = production(spark, sf)
    return a.select("row", "col", "a")


def _inverse_sql(src, name, doublings=7):
    out = [f"{name}p0 AS (SELECT r, c, a FROM {src})",
           f"{name}s0 AS (SELECT r, c, sum(a) AS a FROM (SELECT DISTINCT r, r AS c, 1e0 AS a FROM {src} UNION ALL SELECT r, c, a FROM {src}) GROUP BY 1, 2)"]
    for k in range(1, doublings):
        out.append(f"{name}p{k} AS (SELECT x.r, y.c, sum(x.a * y.a) AS a FROM {name}p{k-1} x JOIN {name}p{k-1} y ON x.c = y.r GROUP BY 1, 2)")
        out.append(f"{name}s{k} AS (SELECT r, c, sum(a) AS a FROM (SELECT r, c, a FROM {name}s{k-1} UNION ALL SELECT x.r, y.c, x.a * y.a FROM {name}s{k-1} x JOIN {name}p{k} y ON x.c = y.r) GROUP BY 1, 2)")
    out.append(f"{name} AS (SELECT * FROM {name}s{doublings-1})")
    return ",\n".join(out)


LEO = f"{UT},\n{_inverse_sql('aa', 'leo')}"
GHO = f"{UT},\nbb AS (SELECT r, c, a * xj.x / xi.x AS a FROM aa JOIN xo xi ON xi.sector = r JOIN xo xj ON xj.sector = c),\n{_inverse_sql('bb', 'gho')}"


@query("I04", f"WITH {LEO} SELECT c AS sector, round(sum(a), 6) AS multiplier FROM leo GROUP BY 1")
def output_multipliers(spark, sf):
    a, _ = technology(spark, sf)
    return E.sector_inverse(a).groupBy(F.col("col").alias("sector")).agg(F.round(F.sum("a"), 6).alias("multiplier"))


DEMAND = f"""fd AS (SELECT l_orderkey % 97 AS case_id, l_returnflag AS scenario, {LST(SECTORS)}[l_partkey % 10 + 1] AS sector, sum(l_extendedprice) / 1e5 AS shock FROM lineitem GROUP BY 1, 2, 3)"""


@query("I04", f"WITH {LEO}, {DEMAND} SELECT case_id, scenario, r AS sector, round(sum(a * shock), 6) AS output FROM leo JOIN fd ON c = sector GROUP BY 1, 2, 3")
def demand_shock_output(spark, sf):
    """Output that changes in final demand call for, per case and scenario."""
    a, _ = technology(spark, sf)
    fd = table(spark, sf, "lineitem").groupBy(
        (F.col("l_orderkey") % 97).alias("case_id"), F.col("l_returnflag").alias("scenario"), pick(SECTORS, F.col("l_partkey") % 10).alias("sector")
    ).agg((F.sum("l_extendedprice") / 1e5).alias("shock"))
    return E.demand_outputs(a, fd, ["case_id", "scenario"]).select("case_id", "scenario", "sector", F.round("x", 6).alias("output"))


def ghosh(spark, sf):
    a, x = technology(spark, sf)
    return E.sector_inverse(E.allocation_coefficients(a, x)), x


# Impacts per realization: supplier; sector by part number; scenario by return flag.
SH = f"sh AS (SELECT l_suppkey AS realization, l_returnflag AS scenario, {LST(SECTORS)}[l_partkey % 10 + 1] AS sector, -sum(l_extendedprice) / 1e5 AS shock FROM lineitem GROUP BY 1, 2, 3)"


def shocks(spark, sf):
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("realization"), F.col("l_returnflag").alias("scenario"), pick(SECTORS, F.col("l_partkey") % 10).alias("sector")
    ).agg((-F.sum("l_extendedprice") / 1e5).alias("shock"))


@query("I05", f"WITH {GHO}, {SH} SELECT realization, scenario, c AS sector, round(sum(shock * a), 5) AS total_impact FROM sh JOIN gho ON r = sector GROUP BY 1, 2, 3")
def ghosh_impact(spark, sf):
    inverse, _ = ghosh(spark, sf)
    d = E.shock_outputs(shocks(spark, sf), inverse, ["realization", "scenario"])
    return d.select("realization", "scenario", "sector", F.round("total_impact", 5).alias("total_impact"))


def summary(spark, sf):
    """Wide realization summaries: output and establishments by sector, population."""
    li = table(spark, sf, "lineitem").withColumn("k", F.col("l_partkey") % 10)
    aggs = [F.sum(F.when(F.col("k") == i, F.col("l_extendedprice")).otherwise(0.0)).alias(f"gdp_{s}") for i, s in enumerate(SECTORS)]
    aggs += [F.sum(F.when(F.col("k") == i, F.col("l_quantity")).otherwise(0.0)).alias(f"est_{s}") for i, s in enumerate(SECTORS)]
    return li.groupBy(F.col("l_suppkey").alias("realization"), F.concat(F.lit("e_"), "l_returnflag", F.lit("-year-hazard A/ph")).alias("scenario")).agg(
        *aggs, (F.sum("l_tax") * 1000).alias("pop")
    )


METRICS = [f"gdp_{s}" for s in SECTORS] + [f"est_{s}" for s in SECTORS] + ["pop"]
VR = f"""
vr AS (SELECT l_suppkey AS realization, l_returnflag AS f, 'GDP_' || {LST(SECTORS)}[l_partkey % 10 + 1] AS variable, sum(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2, 3
  UNION ALL SELECT l_suppkey, l_returnflag, 'EST_TOTAL', sum(l_quantity) FROM lineitem GROUP BY 1, 2
  UNION ALL SELECT l_suppkey, l_returnflag, 'POP_AFFECTED', sum(l_tax) * 1000 FROM lineitem GROUP BY 1, 2),
gr AS (SELECT k.realization, k.f, v.variable, coalesce(x.value, 0) AS value FROM (SELECT DISTINCT realization, f FROM vr) k CROSS JOIN (SELECT DISTINCT variable FROM vr) v
  LEFT JOIN vr x ON x.realization = k.realization AND x.f = k.f AND x.variable = v.variable),
ci AS (SELECT f, variable, avg(value) AS mean, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.95) AS p95 FROM gr GROUP BY 1, 2)"""


def confidence(spark, sf):
    return E.confidence_table(E.impact_variables(summary(spark, sf), METRICS))


@query(
    "I06",
    f"""WITH {VR} SELECT 'e_' || f || '-year-hazard A/ph' AS scenario, variable, round(mean, 6) AS mean, round(p5, 6) AS p5, round(p95, 6) AS p95,
          round(p95 - p5, 6) AS ci_width, round((p95 - p5) / mean * 100, 3) AS uncertainty_pct FROM ci""",
)
def ci_table(spark, sf):
    c = confidence(spark, sf)
    w = F.col("p95") - F.col("p5")
    return c.select("scenario", "variable", *[F.round(k, 6).alias(k) for k in ("mean", "p5", "p95")], F.round(w, 6).alias("ci_width"),
                    F.round(w / F.col("mean") * 100, 3).alias("uncertainty_pct"))


@query(
    "I07 S20",
    """WITH v AS (SELECT [75, 100, 125, 150, 175, 200, 225][l_linenumber] AS period, l_returnflag AS f, p_type AS variable, sum(l_extendedprice) AS value
         FROM lineitem JOIN part ON p_partkey = l_partkey WHERE NOT (l_linenumber = 3 AND l_returnflag = 'A') GROUP BY 1, 2, 3),
       w AS (SELECT period, variable, max(CASE WHEN f = 'N' THEN value END) AS m, max(CASE WHEN f = 'A' THEN value END) AS lo, max(CASE WHEN f = 'R' THEN value END) AS hi FROM v GROUP BY 1, 2)
       SELECT 'gic_' || period || 'yr' AS scenario, variable, round(m, 4) AS mean, round(coalesce(lo, m), 4) AS p5, round(coalesce(hi, m), 4) AS p95 FROM w WHERE m IS NOT NULL""",
)
def alpha_beta_table(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("variable"))
    li = table(spark, sf, "lineitem").filter(~((F.col("l_linenumber") == 3) & (F.col("l_returnflag") == "A")))
    period = pick(("75", "100", "125", "150", "175", "200", "225"), F.col("l_linenumber") - 1)
    level = F.when(F.col("l_returnflag") == "A", "conf_68_lower").when(F.col("l_returnflag") == "N", "mean_prediction").otherwise("conf_68_upper")
    v = li.join(part, "l_partkey").groupBy(F.concat(F.lit("gic_"), period, F.lit("yr_"), level).alias("scenario"), "variable").agg(F.sum("l_extendedprice").alias("value"))
    return E.level_table(v).select("scenario", "variable", *[F.round(k, 4).alias(k) for k in ("mean", "p5", "p95")])


IO = f"""{GHO}, {VR},
sk AS (SELECT f || '-year' AS scenario, conf AS confidence, substr(variable, 5) AS sector, -v / 1e5 AS shock FROM
  (SELECT f, variable, unnest(['mean', 'p5', 'p95']) AS conf, unnest([mean, p5, p95]) AS v FROM ci WHERE variable LIKE 'GDP_%')),
tt AS (SELECT scenario, confidence, c AS sector, sum(shock * a) AS t FROM sk JOIN gho ON r = sector GROUP BY 1, 2, 3),
io AS (SELECT scenario, confidence, sector, shock AS direct_shock, t AS total_impact, t - shock AS multiplier_effect FROM tt JOIN sk USING (scenario, confidence, sector))"""


def io_run(spark, sf):
    from gridhazard.session import cut_lineage

    c = confidence(spark, sf).filter(F.col("variable").startswith("GDP_"))
    long = c.unpivot(["scenario", "variable"], ["mean", "p5", "p95"], "confidence", "value")
    sk = long.select(E.plain_scenario(F.col("scenario")).alias("scenario"), "confidence", F.substring("variable", 5, 100).alias("sector"), (-F.col("value") / 1e5).alias("shock"))
    inverse, _ = ghosh(spark, sf)
    return E.impact_table(cut_lineage(sk), inverse, ["scenario", "confidence"])


@query("I08", f"WITH {IO} SELECT scenario, confidence, sector, round(direct_shock, 4) AS direct_shock, round(total_impact, 4) AS total_impact, round(multiplier_effect, 4) AS multiplier_effect FROM io")
def io_shocks(spark, sf):
    return io_run(spark, sf).select("scenario", "confidence", "sector", *[F.round(k, 4).alias(k) for k in ("direct_shock", "total_impact", "multiplier_effect")])


SHARE = "(VALUES ('p10', 'MANUF', 0.1e0), ('p10', 'INFO', 0.05e0), ('p50', 'FIRE', 0.5e0), ('p50', 'AGR', 0.2e0))"


@query(
    "I09",
    f"""WITH {GHO}, va AS (SELECT sector, CASE WHEN sector = 'AGR' THEN 0.45e0 * x ELSE 0.3e0 * x END AS va FROM xo),
        sk AS (SELECT s.run, s.sector, -share * va AS shock FROM {SHARE} s(run, sector, share) JOIN va USING (sector)),
        t AS (SELECT run, c AS sector, sum(shock * a) AS t FROM sk JOIN gho ON r = sector GROUP BY 1, 2)
        SELECT run, sector, round(t, 3) AS total_impact, round(t / (sum(t) OVER (PARTITION BY run)) * 100, 6) AS pct FROM t QUALIFY t / (sum(t) OVER (PARTITION BY run)) * 100 > 1""",
)
def failure_share_impact(spark, sf):
    inverse, x = ghosh(spark, sf)
    shares = spark.createDataFrame(
        [("p10", "MANUF", 0.1), ("p10", "INFO", 0.05), ("p50", "FIRE", 0.5), ("p50", "AGR", 0.2)], "run string, sector string, share double"
    )
    va = x.filter("sector <> 'AGR'").select("sector", (F.col("x") * 0.3).alias("va"))
    out = E.shock_outputs(E.failure_share_shocks(shares, va, x), inverse, ["run"])
    return E.contributions(out, ["run"]).select("run", "sector", F.round("total_impact", 3).alias("total_impact"), F.round("pct", 6).alias("pct"))


@query(
    "I10",
    f"""WITH {IO}, a AS (SELECT sector, -total_impact AS x FROM io WHERE scenario = 'A-year' AND confidence = 'mean' AND sector <> 'G'),
        b AS (SELECT sector, -total_impact AS y FROM io WHERE scenario = 'R-year' AND confidence = 'mean' AND sector <> 'AGR'),
        j AS (SELECT coalesce(a.sector, b.sector) AS sector, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM a FULL OUTER JOIN b ON a.sector = b.sector)
        SELECT sector, round(x, 4) AS first, round(y, 4) AS second, round(x / sum(x) OVER () * 100, 5) AS first_share, round(y / sum(y) OVER () * 100, 5) AS second_share,
          round(y - x, 4) AS diff, round(CASE WHEN x = 0 THEN 0 ELSE (y - x) / x * 100 END, 5) AS diff_pct FROM j""",
)
def model_compare(spark, sf):
    io = io_run(spark, sf).filter("confidence = 'mean'").withColumn("x", -F.col("total_impact"))
    a, b = io.filter("scenario = 'A-year' AND sector <> 'G'"), io.filter("scenario = 'R-year' AND sector <> 'AGR'")
    c = E.compared(a, b, "sector", "x")
    return c.select("sector", *[F.round(k, 4).alias(k) for k in ("first", "second", "diff")], *[F.round(k, 5).alias(k) for k in ("first_share", "second_share", "diff_pct")])


@query(
    "I11",
    f"""WITH {IO}, b AS (SELECT confidence, sector, total_impact AS b FROM io WHERE scenario = 'N-year')
        SELECT scenario, confidence, sector, round((total_impact - b) / nullif(b, 0) * 100, 5) AS change_pct FROM io JOIN b USING (confidence, sector) WHERE scenario <> 'N-year'""",
)
def change_from_baseline(spark, sf):
    io = io_run(spark, sf)
    d = E.change_from(io.filter("scenario <> 'N-year'"), io.filter("scenario = 'N-year'"), ["confidence", "sector"], "total_impact")
    return d.select("scenario", "confidence", "sector", F.round("change_pct", 5).alias("change_pct"))


# ---------------------------------------------------------------- reporting


@query(
    "V01",
    f"""WITH {IO}, s AS (SELECT scenario, confidence, abs(sum(direct_shock)) / 10 AS d, abs(sum(total_impact)) / 10 AS t FROM io WHERE scenario <> 'N-year' GROUP BY 1, 2),
        w AS (SELECT scenario, {', '.join(f"max(CASE WHEN confidence = '{c}' THEN {k} END) AS {k}_{c}" for k in 'dt' for c in ('mean', 'p5', 'p95'))} FROM s GROUP BY 1)
        SELECT scenario, round(d_mean, 5) AS direct, round(d_mean - least(d_p5, d_p95), 5) AS direct_minus, round(greatest(d_p5, d_p95) - d_mean, 5) AS direct_plus,
          round(t_mean, 5) AS total, round(t_mean - least(t_p5, t_p95), 5) AS total_minus, round(greatest(t_p5, t_p95) - t_mean, 5) AS total_plus FROM w""",
)
def impact_by_confidence(spark, sf):
    d = V.impact_by_confidence(io_run(spark, sf), 10.0, ("N-year",))
    return d.select("scenario", *[F.round(c, 5).alias(c) for c in d.columns if c != "scenario"])


@query(
    "V03",
    f"""WITH {IO}, w AS (SELECT sector, {', '.join(f"max(CASE WHEN confidence = '{c}' THEN total_impact END) AS {c}" for c in ('mean', 'p5', 'p95'))} FROM io WHERE scenario = 'R-year' GROUP BY 1)
        SELECT row_number() OVER (ORDER BY abs(mean) DESC) AS rank, sector, round(mean, 4) AS total, round(abs(mean - least(p5, p95)), 4) AS err_low, round(abs(greatest(p5, p95) - mean), 4) AS err_high FROM w""",
)
def sector_ranking(spark, sf):
    from gridhazard.operators.ordered import dense_position

    d = V.sector_ranking(io_run(spark, sf), "R-year").withColumn("o", -F.abs("total"))
    d = dense_position(d.withColumn("b", F.floor("o")), [], ["b"], ["o"], "rank")
    return d.select("rank", "sector", *[F.round(c, 4).alias(c) for c in ("total", "err_low", "err_high")])


@query(
    "V04",
    f"""WITH {IO}, s AS (SELECT scenario, confidence, sum(direct_shock) AS d, sum(multiplier_effect) AS i, sum(total_impact) AS t FROM io GROUP BY 1, 2)
        SELECT scenario, {', '.join(f"round(max(CASE WHEN confidence = 'mean' THEN {k} END), 4) AS {n}, round(abs(max(CASE WHEN confidence = 'p95' THEN {k} END) - max(CASE WHEN confidence = 'p5' THEN {k} END)) / 2, 4) AS {n}_err" for k, n in (('d', 'direct'), ('i', 'indirect'), ('t', 'total')))} FROM s GROUP BY 1""",
)
def scenario_totals(spark, sf):
    d = V.scenario_totals(io_run(spark, sf))
    return d.select("scenario", *[F.round(c, 4).alias(c) for c in d.columns if c != "scenario"])
