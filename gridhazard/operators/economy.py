"""Allocation of economic data to service areas, and input-output impacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridhazard.functions.fixed_values import NAICS_SECTOR
from gridhazard.operators.topology import lookup
from gridhazard.session import cut_lineage

MASK_CLASSES = (21, 22, 23, 24)


# -------------------------------------------------------------- NAICS tables


def clean_population(rows) -> DataFrame:
    """Trim and cast census rows ``(zcta, pop20)``; blank codes go."""
    d = rows.select(F.trim("zcta").alias("zcta"), F.trim("pop20").alias("pop20")).filter(F.col("zcta") != "")
    return d.select(F.col("zcta").cast("bigint").alias("zcta"), F.col("pop20").try_cast("bigint").alias("pop20"))


def establishments(detail) -> DataFrame:
    """Establishments per (zip, naics) for two-digit sectors, plus the unclassified rest.

    The rest is the all-industries row minus the sum of the sectors.
    """
    sector = detail.filter(F.col("naics").rlike(r"^\d{2}----$")).groupBy("zip", "naics").agg(F.sum("est").alias("est"))
    sums = sector.groupBy("zip").agg(F.sum("est").alias("_s"))
    totals = detail.filter(F.col("naics") == "------").groupBy("zip").agg(F.sum("est").alias("_t"))
    rest = totals.join(sums, "zip", "full_outer").select(
        "zip", F.lit("UNCLFD").alias("naics"), (F.coalesce("_t", F.lit(0)) - F.coalesce("_s", F.lit(0))).alias("est")
    )
    return sector.withColumn("naics", F.regexp_replace("naics", "-", "")).unionByName(rest)


def by_zcta(est, crosswalk) -> DataFrame:
    """Regroup zip rows by (zcta, naics, state); rows without a zcta go."""
    d = est.join(crosswalk.filter(F.col("zcta").isNotNull()), "zip", "left")
    return d.filter(F.col("zcta").isNotNull() & F.col("state").isNotNull()).groupBy("zcta", "naics", "state").agg(
        F.sum("est").alias("est")
    )


def state_industries(rows) -> DataFrame:
    """Rows of plain industry codes (``dd`` or ``dd-dd``) by first code, and the total row ``--``."""
    plain = rows.filter(F.col("industry").rlike(r"^\d{2}(-\d{2})?$"))
    coded = plain.withColumn("naics", F.split("industry", "-")[0].cast("int").cast("string"))
    sums = coded.groupBy("state", "naics").agg(F.sum("gdp").alias("gdp"))
    total = coded.groupBy("state").agg(F.lit("--").alias("naics"), F.sum("gdp").alias("gdp"))
    return sums.unionByName(total)


def allocated_output(est, gdp, leave_out=("99",)) -> DataFrame:
    """Split a state's sector output over its areas by establishments.

    Totals come from their own partial aggregation and meet the rows in an
    equality join, so a dominant state is not one window.
    """
    d = est.filter(~F.col("naics").isin(list(leave_out)))
    share = d.groupBy("state", "naics").agg(F.sum("est").alias("_all"))
    key = F.when(F.col("naics") == "UNCLFD", "92").otherwise(F.col("naics"))
    g = gdp.select("state", F.col("naics").alias("_k"), "gdp")
    d = d.join(share, ["state", "naics"]).withColumn("_k", key).join(g, ["state", "_k"], "left")
    return d.select(
        "zcta", "naics", "state", "est", F.round(F.try_divide(F.col("est"), F.col("_all")) * F.col("gdp"), 2).alias("gdp")
    )


def sector_of(naics):
    return lookup(naics, NAICS_SECTOR)


def sector_table(allocated, key, sectors, codes) -> DataFrame:
    """Wide table per area: daily output and establishments by sector.

    Duplicates of an (area, code) are averaged first, as a pivot does by default.
    """
    mean = allocated.filter(F.col("naics").isin(list(codes))).groupBy(key, "naics").agg(
        F.avg(F.col("gdp") / 365).alias("g"), F.avg("est").alias("e")
    )
    d = mean.withColumn("sector", sector_of(F.col("naics")))
    wide = d.groupBy(key).pivot("sector", list(sectors)).agg(F.sum("g").alias("g"), F.sum("e").alias("e"))
    return wide.select(
        key, *[F.coalesce(f"{s}_g", F.lit(0.0)).alias(f"gdp_{s}") for s in sectors],
        *[F.coalesce(f"{s}_e", F.lit(0.0)).alias(f"est_{s}") for s in sectors],
    )


# ------------------------------------------------------------------- raster


def block_mode(pixels, scale=4, keys=()) -> DataFrame:
    """Most frequent class of each scale x scale block (ties to the smallest)."""
    keys = list(keys)
    counts = pixels.groupBy(
        *keys, F.floor(F.col("row") / scale).alias("row"), F.floor(F.col("col") / scale).alias("col"), "class"
    ).agg(F.count(F.lit(1)).alias("_c"))
    best = F.min(F.struct((-F.col("_c")).alias("c"), F.col("class").alias("v")))
    return counts.groupBy(*keys, "row", "col").agg(best.alias("_b")).select(*keys, "row", "col", F.col("_b.v").alias("class"))


def masked(pixels, tile="tile", classes=MASK_CLASSES, nodata=0) -> DataFrame:
    """Developed pixels; a tile without any falls back to all pixels that hold data."""
    d = pixels.withColumn("_m", F.col("class").isin(list(classes)).cast("int"))
    has = d.groupBy(tile).agg(F.max("_m").alias("_any"))
    return d.join(has, tile).filter(
        F.when(F.col("_any") == 1, F.col("_m") == 1).otherwise(F.col("class") != nodata)
    ).drop("_m", "_any")


def tile_of(row, col, height, width, n=8):
    """Tile number of an n x n division, the remainder going to the last row and column."""
    step = lambda size: F.greatest(F.floor(size / n), F.lit(1))
    r = F.least(F.floor(row / step(height)), F.lit(n - 1))
    c = F.least(F.floor(col / step(width)), F.lit(n - 1))
    return (r * n + c).cast("bigint")


def dasymetric(pixels, source, target, amounts, metrics) -> DataFrame:
    """Spread source-zone amounts over target zones by masked pixel counts, keeping totals."""
    n = pixels.groupBy(source, target).agg(F.count(F.lit(1)).alias("_n"))
    total = n.groupBy(source).agg(F.sum("_n").alias("_all"))
    d = n.join(total, source).join(amounts, source)
    share = F.col("_n") / F.col("_all")
    return d.groupBy(target).agg(*[F.sum(share * F.col(m)).alias(m) for m in metrics])


def tile_aggregate(partial, key, metrics, how="sum") -> DataFrame:
    """Combine per-tile amounts of a zone: ``sum`` keeps totals, ``mean`` averages tiles."""
    f = F.sum if how == "sum" else F.avg
    return partial.groupBy(key).agg(*[f(m).alias(m) for m in metrics])


# ------------------------------------------------------------ input-output


def transactions(use, groups) -> DataFrame:
    """Aggregate a long Use table ``(code, column_code, value)`` to sector by sector."""
    r, c = lookup(F.col("code"), groups), lookup(F.col("column_code"), groups)
    d = use.withColumns({"row": r, "col": c}).filter(F.col("row").isNotNull() & F.col("col").isNotNull())
    return d.groupBy("row", "col").agg(F.sum("value").alias("u"))


def requirements(flows, output) -> DataFrame:
    """Direct requirements u / x of the column sector, half-even to 6 digits."""
    return flows.join(output.select(F.col("sector").alias("col"), "x"), "col").select(
        "row", "col", F.bround(F.try_divide(F.col("u"), F.col("x")), 6).alias("a")
    )


def allocation_coefficients(a, output) -> DataFrame:
    """Output coefficients b = a_ij x_j / x_i of the supply-driven model."""
    xi, xj = output.select(F.col("sector").alias("row"), F.col("x").alias("xi")), output.select(F.col("sector").alias("col"), F.col("x").alias("xj"))
    return a.join(xi, "row").join(xj, "col").select("row", "col", F.try_divide(F.col("a") * F.col("xj"), F.col("xi")).alias("a"))


def _product(left, right):
    l, r = left.select("row", F.col("col").alias("k"), F.col("a").alias("la")), right.select(F.col("row").alias("k"), "col", F.col("a").alias("ra"))
    return l.join(r, "k").groupBy("row", "col").agg(F.sum(F.col("la") * F.col("ra")).alias("a"))


def sector_inverse(coefficients, tol=1e-12, doublings=40) -> DataFrame:
    """(I - A)^-1 = (I + A)(I + A^2)(I + A^4)... as joins and sums over the entries.

    Doubles until what is added is at most ``tol`` of what is there, and raises if
    that is not so after ``doublings`` rounds, as for a matrix without a convergent series.
    """
    sectors = coefficients.select("row").union(coefficients.select(F.col("col").alias("row"))).distinct()
    eye = sectors.select("row", F.col("row").alias("col"), F.lit(1.0).alias("a"))
    power = cut_lineage(coefficients.groupBy("row", "col").agg(F.sum("a").alias("a")))
    total = last = cut_lineage(eye.unionByName(power).groupBy("row", "col").agg(F.sum("a").alias("a")))
    for _ in range(doublings):
        power = cut_lineage(_product(power, power), replaces=power)
        more = _product(total, power).select("row", "col", "a", F.col("a").alias("new"))
        grown = cut_lineage(
            total.withColumn("new", F.lit(0.0)).unionByName(more).groupBy("row", "col").agg(F.sum("a").alias("a"), F.sum("new").alias("new")),
            replaces=last,
        )
        size = grown.agg(F.max(F.abs("new")).alias("new"), F.max(F.abs("a")).alias("all")).first()
        total, last = grown.select("row", "col", "a"), grown
        if (size["new"] or 0.0) <= tol * (size["all"] or 1.0):
            return total
    raise RuntimeError(f"the series of the sector matrix did not settle in {doublings} doublings")


def shock_outputs(shocks, inverse, keys) -> DataFrame:
    """Row shocks times an inverse: output change per (keys, sector). Works for any number of shocks."""
    d = shocks.join(inverse.select(F.col("row").alias("sector"), F.col("col").alias("_to"), "a"), "sector")
    return d.groupBy(*keys, F.col("_to").alias("sector")).agg(F.sum(F.col("shock") * F.col("a")).alias("total_impact"))


def impact_table(shocks, inverse, keys) -> DataFrame:
    """Direct shock, total impact and their difference per (keys, sector)."""
    out = shock_outputs(shocks, inverse, keys)
    direct = shocks.select(*keys, "sector", F.col("shock").alias("direct_shock"))
    d = out.join(direct, list(keys) + ["sector"], "full_outer").na.fill(0.0, ["total_impact", "direct_shock"])
    return d.withColumn("multiplier_effect", F.col("total_impact") - F.col("direct_shock"))


def demand_outputs(coefficients, demand, keys, tol=1e-12, steps=6, max_rounds=200) -> DataFrame:
    """Output per (keys, sector) that a change in final demand ``(keys, sector, shock)`` calls for: x = Ax + f.

    No inverse is formed. All shocks go through x <- Ax + f together, ``steps`` products a
    round; a shock leaves once the largest term of its last product is at most ``tol`` of its
    largest output, so late rounds carry only the slow ones. A series that has not settled
    after ``max_rounds`` rounds raises, as for coefficients without a convergent series.
    """
    keys = list(keys)
    entries = coefficients.filter(F.col("a") != 0).select(F.col("col").alias("sector"), F.col("row").alias("_to"), F.col("a").alias("_a"), F.lit(0.0).alias("_same"))
    # A sector's own output so far travels through the same join as one more entry.
    same = coefficients.select(F.col("row").alias("sector")).union(coefficients.select("col")).distinct().select(
        "sector", F.col("sector").alias("_to"), F.lit(0.0).alias("_a"), F.lit(1.0).alias("_same")
    )
    a = cut_lineage(entries.unionByName(same).groupBy("sector", "_to").agg(F.sum("_a").alias("_a"), F.max("_same").alias("_same")))
    f = demand.groupBy(*keys, "sector").agg(F.sum("shock").alias("x"))
    # x: output so far; d: the newest term A^n f, which the next product starts from.
    state = cut_lineage(f.select(*keys, "sector", "x", F.col("x").alias("d"), F.lit(True).alias("_open")))
    shock = Window.partitionBy(*keys)
    done = []
    for _ in range(max_rounds):
        # Spread by shock, at most one row a sector: the products below need no further exchange.
        step = state.filter("_open").drop("_open").repartition(*keys)
        for _ in range(steps):
            moved = step.join(a, "sector", "left").select(
                *keys, F.coalesce("_to", "sector").alias("sector"), (F.coalesce("_same", F.lit(1.0)) * F.col("x")).alias("x"),
                (F.coalesce("_a", F.lit(0.0)) * F.col("d")).alias("d"),
            )
            step = moved.groupBy(*keys, "sector").agg(F.sum("x").alias("x"), F.sum("d").alias("d")).withColumn("x", F.col("x") + F.col("d"))
        moving = F.max(F.abs("d")).over(shock) > tol * F.max(F.abs("x")).over(shock)
        state = cut_lineage(step.withColumn("_open", moving))
        done.append(state.filter(~F.col("_open")).select(*keys, "sector", "x"))
        if state.filter("_open").isEmpty():
            return reduce(DataFrame.unionByName, done)
    raise RuntimeError(f"output from final demand did not settle in {max_rounds} rounds")


def use_accounts(use, groups, value_added, final_demand, output_row) -> DataFrame:
    """Sector accounts of a long Use table ``(code, column_code, value)`` and their margins, in one aggregation.

    Rows ``(account, row, col, value)``: ``flow`` sector by sector, ``value_added`` code by
    sector, ``final_demand`` sector by code, ``output`` of the column's sector. Each is
    followed by its totals: a null ``row`` sums a column over all rows, a null ``col`` a row
    over all columns. Cells of any other code or column take no part, and no more does a
    missing code; a missing value adds nothing.
    """
    code, column = F.col("code"), F.col("column_code")
    r, c = lookup(code, groups), lookup(column, groups)
    account = (
        F.when(r.isNotNull() & c.isNotNull(), "flow")
        .when(code.isin(*value_added) & c.isNotNull(), "value_added")
        .when(r.isNotNull() & column.isin(*final_demand), "final_demand")
        .when((code == output_row) & c.isNotNull(), "output")
    )
    d = use.select(account.alias("account"), F.coalesce(r, code).alias("row"), F.coalesce(c, column).alias("col"), "value")
    a, i, j = F.col("account"), F.col("row"), F.col("col")
    sums = d.filter(a.isNotNull()).groupingSets([[a, i, j], [a, j], [a, i]], a, i, j).agg(F.sum("value").alias("value"))
    return sums.select("account", "row", "col", F.coalesce("value", F.lit(0.0)).alias("value"))


def account_cells(accounts, account) -> DataFrame:
    """Cells of one account, without its totals."""
    return accounts.filter((F.col("account") == account) & F.col("row").isNotNull() & F.col("col").isNotNull()).drop("account")


def account_totals(accounts, account, by="col") -> DataFrame:
    """Totals of one account per sector of its columns (``by="col"``) or rows (``by="row"``)."""
    other = "row" if by == "col" else "col"
    d = accounts.filter((F.col("account") == account) & F.col(by).isNotNull() & F.col(other).isNull())
    return d.select(F.col(by).alias("sector"), "value")


def plain_scenario(s):
    """'e_100-year-hazard A/ph' -> '100-year'."""
    return F.replace(F.replace(s, F.lit("e_"), F.lit("")), F.lit("-hazard A/ph"), F.lit(""))


def with_interval(stats) -> DataFrame:
    """Width and relative width of (mean, p5, p95), rounded half-even to 2 digits at the end."""
    w = F.col("p95") - F.col("p5")
    d = stats.withColumns({"ci_width": w, "uncertainty_pct": F.try_divide(w, F.col("mean")) * 100})
    return d.withColumns({c: F.bround(c, 2) for c in ("mean", "p5", "p95", "ci_width", "uncertainty_pct")})


def impact_variables(summary, metrics) -> DataFrame:
    """Wide realization summaries -> long variables: each GDP metric, EST_TOTAL and POP_AFFECTED."""
    gdp = [m for m in metrics if m.startswith("gdp_")]
    est = sum((F.col(m) for m in metrics if m.startswith("est_")), F.lit(0.0))
    pack = [F.struct(F.lit("GDP_" + m[4:]).alias("variable"), F.col(m).alias("value")) for m in gdp]
    pack += [F.struct(F.lit("EST_TOTAL").alias("variable"), est.alias("value")), F.struct(F.lit("POP_AFFECTED").alias("variable"), F.col("pop").alias("value"))]
    return summary.select("realization", "scenario", F.explode(F.array(*pack)).alias("p")).select("realization", "scenario", "p.*")


def confidence_table(variables) -> DataFrame:
    """Mean and 5 and 95 percent points over realizations per (scenario, variable)."""
    from gridhazard.operators.quantiles import exact_quantiles

    key = ["scenario", "variable"]
    mean = variables.groupBy(*key).agg(F.avg("value").alias("mean"))
    return mean.join(exact_quantiles(variables, key, "value", [0.05, 0.95], ["p5", "p95"], bounded=True), key)


def level_table(variables) -> DataFrame:
    """Scenario levels lower/mean/upper become p5/mean/p95 of their return period; missing levels take the mean."""
    period = F.regexp_extract("scenario", r"^(gic_\d+yr)_", 1)
    level = F.regexp_extract("scenario", r"^gic_\d+yr_(.*)$", 1)
    d = variables.select(period.alias("scenario"), "variable", level.alias("level"), "value")
    wide = d.groupBy("scenario", "variable").pivot(
        "level", ["conf_68_lower", "mean_prediction", "conf_68_upper"]
    ).agg(F.avg("value")).filter(F.col("mean_prediction").isNotNull())
    m = F.col("mean_prediction")
    return wide.select("scenario", "variable", m.alias("mean"), F.coalesce("conf_68_lower", m).alias("p5"), F.coalesce("conf_68_upper", m).alias("p95"))


def failure_share_shocks(shares, value_added, output, fallback=0.45) -> DataFrame:
    """Shock = -share * value added (or a share of gross output where value added is missing)."""
    va = output.join(value_added, "sector", "left").select(
        "sector", F.coalesce("va", F.lit(fallback) * F.col("x")).alias("va")
    )
    return shares.join(va, "sector").withColumn("shock", -F.col("share") * F.col("va")).drop("va")


def contributions(impacts, keys, minimum_pct=1.0) -> DataFrame:
    """Sectors with more than ``minimum_pct`` percent of the total of their key."""
    total = impacts.groupBy(*keys).agg(F.sum("total_impact").alias("_t"))
    d = impacts.join(total, list(keys)).withColumn("pct", F.try_divide(F.col("total_impact"), F.col("_t")) * 100)
    return d.filter(F.col("pct") > minimum_pct).drop("_t")


def compared(first, second, key, value) -> DataFrame:
    """Two result tables side by side: shares, difference, percent difference; missing values are 0."""
    a, b = first.select(key, F.col(value).alias("first")), second.select(key, F.col(value).alias("second"))
    d = a.join(b, key, "full_outer").na.fill(0.0, ["first", "second"])
    # Sector tables: a handful of rows, totals over the whole table.
    w = Window.partitionBy(F.lit(1))
    pct = lambda c: F.try_divide(F.col(c), F.sum(c).over(w)) * 100
    return d.select(
        key, "first", "second", pct("first").alias("first_share"), pct("second").alias("second_share"),
        (F.col("second") - F.col("first")).alias("diff"),
        F.coalesce(F.try_divide(F.col("second") - F.col("first"), F.col("first")) * 100, F.lit(0.0)).alias("diff_pct"),
    )


def change_from(runs, baseline, keys, value) -> DataFrame:
    """Percent change of each run against the baseline run; null where the baseline is 0."""
    b = baseline.select(*keys, F.col(value).alias("_b"))
    return runs.join(b, list(keys)).withColumn("change_pct", F.try_divide(F.col(value) - F.col("_b"), F.col("_b")) * 100).drop("_b")
