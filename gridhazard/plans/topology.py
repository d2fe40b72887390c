"""Topology and spatial queries.

Points and polylines come from ``embeddings`` (consecutive components are x, y);
lines, stations and voltages from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridhazard.functions.fixed_values import OHM_PER_KM, SUBSTATION_CATEGORY, VOLTAGE_CLASS
from gridhazard.functions.scalar import haversine_km
from gridhazard.operators import geo as G
from gridhazard.operators import topology as T
from gridhazard.plans import sqltext as X
from gridhazard.plans.registry import query, table

KV = (69, 138, 161, 200, 220, 230, 287, 345, 400, 450, 500, 765, 999)
KVSQL = f"[{', '.join(map(str, KV))}][CAST(l_quantity AS BIGINT) % 13 + 1]"
CLS = "CASE {v} " + " ".join(f"WHEN {k} THEN {v}" for k, v in VOLTAGE_CLASS.items()) + " END"


def kv():
    return F.element_at(F.array(*[F.lit(k) for k in KV]), (F.col("l_quantity").cast("int") % 13 + 1))


@query(
    "G01 G02",
    f"""WITH d AS (SELECT {KVSQL} AS v FROM lineitem), f AS (SELECT v, {CLS.format(v='v')} AS c FROM d WHERE v >= 160)
        SELECT CAST(coalesce(c, v) AS BIGINT) AS voltage, count(*) AS n, count(c) AS strict_n FROM f GROUP BY 1""",
)
def voltage_classes(spark, sf):
    d = table(spark, sf, "lineitem").select(kv().alias("v")).filter("v >= 160")
    return d.groupBy(T.standard_voltage(F.col("v")).cast("bigint").alias("voltage")).agg(
        F.count(F.lit(1)).alias("n"), F.count(T.standard_voltage(F.col("v"), keep_unmapped=False)).alias("strict_n")
    )


# ------------------------------------------------------------------ spatial


def points(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


def diamonds(spark, sf):
    """One diamond region per label: centre at the mean, reaching 1.5 deviations along each axis."""
    m = points(spark, sf).groupBy("label").agg(
        F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.stddev_pop("x") * (0.7 + F.col("label") / 10)).alias("sx"), (F.stddev_pop("y") * 1.5).alias("sy")
    )
    v = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    mx, my, sx, sy = (F.col(c) for c in ("mx", "my", "sx", "sy"))
    return m.select(F.col("label").alias("region"), F.array(v(mx - sx, my), v(mx, my + sy), v(mx + sx, my), v(mx, my - sy)).alias("ring"))


PTS = """
p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
dm AS (SELECT label AS region, avg(x) AS mx, avg(y) AS my, stddev_pop(x) * (0.7e0 + label / 10e0) AS sx, stddev_pop(y) * 1.5e0 AS sy FROM p GROUP BY label)"""


@query("G03 E06 S11", f"WITH {PTS} SELECT vec_id, region FROM p JOIN dm ON abs(x - mx) / sx + abs(y - my) / sy < 1")
def point_in_polygon(spark, sf):
    return G.points_in_rings(points(spark, sf).select("vec_id", "x", "y"), diamonds(spark, sf), 0.1).select("vec_id", "region")


def short_lines(spark, sf):
    """A line of four vertices around each point."""
    e = table(spark, sf, "embeddings")
    at = lambda k: F.col("embedding")[k].cast("double")
    vertex = lambda k: F.struct((at(0) + 0.3 * at(2 * k)).alias("x"), (at(1) + 0.3 * at(2 * k + 1)).alias("y"))
    return e.select(F.col("vec_id").alias("line"), F.array(*[vertex(k) for k in range(1, 5)]).alias("vertices"))


@query(
    "G03",
    f"""WITH {PTS},
        v AS (SELECT vec_id AS line, k, embedding[1]::DOUBLE + 0.3e0 * embedding[2 * k + 1]::DOUBLE AS x, embedding[2]::DOUBLE + 0.3e0 * embedding[2 * k + 2]::DOUBLE AS y
              FROM embeddings, range(1, 5) r(k)),
        sg AS (SELECT a.line, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON a.line = b.line AND b.k = a.k + 1),
        ed AS (SELECT region, unnest([{{'a': mx - sx, 'b': my, 'c': mx, 'd': my + sy}}, {{'a': mx, 'b': my + sy, 'c': mx + sx, 'd': my}},
                 {{'a': mx + sx, 'b': my, 'c': mx, 'd': my - sy}}, {{'a': mx, 'b': my - sy, 'c': mx - sx, 'd': my}}]) AS e FROM dm),
        o AS (SELECT line, region, (x2 - x1) * (e.b - y1) - (y2 - y1) * (e.a - x1) AS o1, (x2 - x1) * (e.d - y1) - (y2 - y1) * (e.c - x1) AS o2,
                (e.c - e.a) * (y1 - e.b) - (e.d - e.b) * (x1 - e.a) AS o3, (e.c - e.a) * (y2 - e.b) - (e.d - e.b) * (x2 - e.a) AS o4 FROM sg, ed)
        SELECT DISTINCT line, region FROM o WHERE sign(o1) * sign(o2) <= 0 AND sign(o3) * sign(o4) <= 0
        UNION SELECT line, region FROM v JOIN dm ON k = 1 AND abs(x - mx) / sx + abs(y - my) / sy < 1""",
)
def lines_in_regions(spark, sf):
    return G.lines_meeting_rings(short_lines(spark, sf), diamonds(spark, sf), "line", "region", 0.1)


@query(
    "E05",
    f"""WITH {PTS} SELECT vec_id, arg_min(region, {{'a': 2 * sx * sy, 'r': region}}) AS region FROM p JOIN dm ON abs(x - mx) / sx + abs(y - my) / sy < 1 GROUP BY 1""",
)
def innermost_region(spark, sf):
    return G.smallest_containing(points(spark, sf).select("vec_id", "x", "y"), diamonds(spark, sf), "vec_id", "region", 0.1)


@query(
    "G04",
    """WITH r AS (SELECT vec_id, [1 + abs(embedding[k]::DOUBLE) FOR k IN [1, 2, 3, 4]] AS r FROM embeddings),
       s AS (SELECT vec_id, unnest([{'x1': r[1], 'y1': 0, 'x2': 0, 'y2': r[2]}, {'x1': 0, 'y1': r[2], 'x2': -r[3], 'y2': 0},
           {'x1': -r[3], 'y1': 0, 'x2': 0, 'y2': -r[4]}, {'x1': 0, 'y1': -r[4], 'x2': r[1], 'y2': 0}]) AS s FROM r),
       c AS (SELECT vec_id, s.x1 * s.y2 - s.x2 * s.y1 AS c, s FROM s)
       SELECT vec_id, round(sum(c) / 2, 6) AS area, round(sum((s.x1 + s.x2) * c) / (3 * sum(c)), 6) AS cx, round(sum((s.y1 + s.y2) * c) / (3 * sum(c)), 6) AS cy FROM c GROUP BY 1""",
)
def ring_centroid(spark, sf):
    r = [1 + F.abs(F.col("embedding")[k].cast("double")) for k in range(4)]
    zero = F.lit(0.0)
    v = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(v(r[0], zero), v(zero, r[1]), v(-r[2], zero), v(zero, -r[3]))
    d = table(spark, sf, "embeddings").select("vec_id", ring.alias("ring")).select("vec_id", G.shoelace(F.col("ring")).alias("s"))
    return d.select("vec_id", F.round("s.area", 6).alias("area"), F.round("s.cx", 6).alias("cx"), F.round("s.cy", 6).alias("cy"))


_n, _c, _rho0 = G.albers_constants()
_QS = f"({X.num(1 - G._E2)} * (s / (1 - {X.num(G._E2)} * s * s) - ln((1 - {X.num(G._E)} * s) / (1 + {X.num(G._E)} * s)) / {X.num(2 * G._E)}))"


@query(
    "G07",
    f"""WITH d AS (SELECT vec_id, -96 + embedding[1]::DOUBLE * 60 AS lon, sin(radians(38 + embedding[2]::DOUBLE * 25)) AS s FROM embeddings),
        r AS (SELECT vec_id, {X.num(G._A)} * sqrt({X.num(_c)} - {X.num(_n)} * {_QS}) / {X.num(_n)} AS rho, {X.num(_n)} * radians(lon + 96) AS th FROM d)
        SELECT vec_id, round(rho * sin(th), 3) AS x, round({X.num(_rho0)} - rho * cos(th), 3) AS y FROM r""",
)
def albers_projection(spark, sf):
    e = table(spark, sf, "embeddings")
    x, y = G.albers(-96 + F.col("embedding")[0].cast("double") * 60, 38 + F.col("embedding")[1].cast("double") * 25)
    return e.select("vec_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def polylines(spark, sf):
    e = table(spark, sf, "embeddings")
    vertex = lambda k: F.struct(F.col("embedding")[2 * k].cast("double").alias("x"), F.col("embedding")[2 * k + 1].cast("double").alias("y"))
    return e.select(F.col("vec_id").alias("line"), F.array(*[vertex(k) for k in range(32)]).alias("vertices"))


def spots(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey").cast("double")
    return s.select(F.col("s_suppkey").alias("sub"), (F.pmod(k * 0.137, F.lit(0.7)) - 0.35).alias("x"), (F.pmod(k * 0.0731, F.lit(0.7)) - 0.35).alias("y"))


RADIUS = 0.004
NEAR = f"""
v AS (SELECT vec_id AS line, k AS seg, embedding[2 * k + 1]::DOUBLE AS x1, embedding[2 * k + 2]::DOUBLE AS y1, embedding[2 * k + 3]::DOUBLE AS x2, embedding[2 * k + 4]::DOUBLE AS y2
  FROM embeddings, range(31) r(k)),
sg AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len FROM v),
bf AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY line ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM sg),
sp AS (SELECT s_suppkey AS sub, (s_suppkey * 0.137e0) % 0.7e0 - 0.35e0 AS px, (s_suppkey * 0.0731e0) % 0.7e0 - 0.35e0 AS py FROM supplier),
ft AS (SELECT line, sub, seg, bef, len, px, py, x1, y1, x2, y2, least(greatest(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / (len * len), 0), 1) AS t FROM bf, sp),
ds AS (SELECT line, sub, seg, bef + t * len AS pos, sqrt(pow(x1 + t * (x2 - x1) - px, 2) + pow(y1 + t * (y2 - y1) - py, 2)) AS d FROM ft),
nr AS (SELECT line, sub, min(d) AS dist, arg_min(pos, {{'d': d, 's': seg}}) AS pos FROM ds WHERE d <= {RADIUS} GROUP BY 1, 2)"""


def near(spark, sf):
    return G.near_lines(G.line_segments(polylines(spark, sf), "line"), spots(spark, sf), "line", "sub", RADIUS, 0.1)


@query("G08 G10 S10", f"WITH {NEAR} SELECT line, sub, round(dist, 7) AS dist, round(pos, 6) AS pos FROM nr")
def substations_on_lines(spark, sf):
    return near(spark, sf).select("line", "sub", F.round("dist", 7).alias("dist"), F.round("pos", 6).alias("pos"))


PAIRS = f"""{NEAR},
ps AS (SELECT * FROM (SELECT line, sub AS a, lead(sub) OVER (PARTITION BY line ORDER BY pos, sub) AS b FROM nr) WHERE b IS NOT NULL)"""


def line_pairs(spark, sf):
    return T.along(near(spark, sf), "line", ["pos", "sub"], "sub").select("line", "a", "b")


PIECES = f"""{NEAR},
pp AS (SELECT * FROM (SELECT line, sub AS a, pos AS pos_a, lead(sub) OVER w AS b, lead(pos) OVER w AS pos_b FROM nr WINDOW w AS (PARTITION BY line ORDER BY pos, sub)) WHERE b IS NOT NULL),
al AS (SELECT line, seg, x1 + (p - bef) / len * (x2 - x1) AS x, y1 + (p - bef) / len * (y2 - y1) AS y, p FROM bf JOIN (SELECT DISTINCT line, unnest([pos_a, pos_b]) AS p FROM pp) USING (line)
  WHERE p >= bef AND p <= bef + len QUALIFY row_number() OVER (PARTITION BY line, p ORDER BY seg) = 1),
pv AS (SELECT line, a, b, pos_a AS place, x, y FROM pp JOIN al USING (line) WHERE p = pos_a UNION ALL SELECT line, a, b, pos_b, x, y FROM pp JOIN al USING (line) WHERE p = pos_b
  UNION ALL SELECT line, a, b, bef, x1, y1 FROM pp JOIN bf USING (line) WHERE bef > pos_a + 1e-9 AND bef < pos_b - 1e-9),
ln AS (SELECT line, a, b, place, x, y, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d FROM pv WINDOW w AS (PARTITION BY line, a, b ORDER BY place))"""


@query(
    "G12",
    f"""WITH {PIECES} SELECT line, a, b, CASE WHEN count(*) OVER (PARTITION BY line) > 1 THEN line || '_' || a || '_' || b ELSE CAST(line AS VARCHAR) END AS line_id,
          vertices, length, x_sum, y_sum FROM (SELECT line, a, b, count(*) AS vertices, round(coalesce(sum(d), 0), 6) AS length, round(sum(x), 5) AS x_sum, round(sum(y), 5) AS y_sum FROM ln GROUP BY 1, 2, 3)""",
)
def line_geometry(spark, sf):
    """Pieces of lines between neighbouring substations: their vertices, in number, length and sums."""
    stops = near(spark, sf).withColumn("node", F.struct("sub", "pos", "seg"))
    of = lambda c: [F.col(f"{e}.{c}").alias(f"{c}_{e}") for e in "ab"]
    pairs = T.along(stops, "line", ["pos", "sub"], "node").select("line", F.col("a.sub").alias("a"), F.col("b.sub").alias("b"), *of("pos"), *of("seg"))
    pieces = G.line_pieces(polylines(spark, sf), T.segment_ids(pairs, "line"), "line")
    straight = lambda x1, y1, x2, y2: F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))
    total = lambda k: F.round(F.aggregate("vertices", F.lit(0.0), lambda n, v: n + v[k]), 5)
    return pieces.select(
        "line", "a", "b", "line_id", F.size("vertices").cast("bigint").alias("vertices"), F.round(G.length_of(F.col("vertices"), straight), 6).alias("length"),
        total("x").alias("x_sum"), total("y").alias("y_sum"))


@query(
    "G11 G12",
    f"""WITH {PAIRS} SELECT line, a, b, CASE WHEN count(*) OVER (PARTITION BY line) > 1 THEN line || '_' || a || '_' || b ELSE CAST(line AS VARCHAR) END AS line_id FROM ps""",
)
def split_lines(spark, sf):
    return T.segment_ids(line_pairs(spark, sf), "line").select("line", "a", "b", "line_id")


@query("G11 G18", f"WITH {PAIRS}, ad AS (SELECT a, b FROM ps UNION SELECT b, a FROM ps) SELECT a AS sub, count(*) AS neighbours, min(b) AS lowest FROM ad GROUP BY 1")
def adjacency(spark, sf):
    return T.adjacency(line_pairs(spark, sf)).groupBy(F.col("a").alias("sub")).agg(F.count(F.lit(1)).alias("neighbours"), F.min("b").alias("lowest"))


_HV = X.haversine("28 + v.y1 * 10", "-96 + v.x1 * 10", "28 + v.y2 * 10", "-96 + v.x2 * 10")


@query("G19", f"WITH {NEAR.split('sg AS')[0].rstrip().rstrip(',')} SELECT line, round(sum({_HV}), 4) AS km FROM v GROUP BY 1")
def line_length(spark, sf):
    km = lambda x1, y1, x2, y2: haversine_km(28 + y1 * 10, -96 + x1 * 10, 28 + y2 * 10, -96 + x2 * 10)
    return polylines(spark, sf).select("line", F.round(G.length_of(F.col("vertices"), km), 4).alias("km"))


BOXES = [(round(-0.4 + 0.07 * k, 2), round(-0.4 + 0.05 * k, 2), round(-0.4 + 0.07 * k + 0.15, 2), round(-0.4 + 0.05 * k + 0.3, 2)) for k in range(10)]


@query(
    "G06 G05",
    f"""WITH {PTS}, b(k, x0, y0, x1, y1) AS (VALUES {', '.join(str((k, *b)) for k, b in enumerate(BOXES))})
        SELECT vec_id, CAST(min(k) AS BIGINT) AS first_box FROM p JOIN b ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1""",
)
def bbox_union(spark, sf):
    inside = F.array_compact(F.array(*[
        F.when(F.col("x").between(a, c) & F.col("y").between(b, d), F.lit(k)) for k, (a, b, c, d) in enumerate(BOXES)
    ]))
    d = points(spark, sf).select("vec_id", F.explode(inside).alias("k"))
    return d.groupBy("vec_id").agg(F.min("k").cast("bigint").alias("first_box"))


@query(
    "G05",
    "SELECT page_id, list_max(list_transform(regexp_extract_all(html, '[0-9]+'), lambda x: x::DOUBLE)) / 1000 AS top FROM pages",
)
def max_number_in_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", (T.highest_number(F.col("html")) / 1000).alias("top"))


@query("E11", """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
       sp AS (SELECT s_suppkey AS sub, (s_suppkey * 0.137e0) % 0.7e0 - 0.35e0 AS px, (s_suppkey * 0.0731e0) % 0.7e0 - 0.35e0 AS py FROM supplier),
       d AS (SELECT vec_id, sub, (x - px) * (x - px) + (y - py) * (y - py) AS d2 FROM p, sp)
       SELECT vec_id, arg_min(sub, {'d': d2, 's': sub}) AS sub, round(sqrt(min(d2)), 8) AS dist FROM d GROUP BY 1""")
def nearest_centre(spark, sf):
    pts = points(spark, sf).select("vec_id", "x", "y")
    return G.nearest_centres(pts, spots(spark, sf), "vec_id", "sub", 0.02).select("vec_id", "sub", F.round("dist", 8).alias("dist"))


@query(
    "V08",
    f"""WITH {PTS}, g AS (SELECT iy * 40 + ix AS cell_id, -0.35e0 + ix * {X.num(0.7 / 39)} AS gx, -0.35e0 + iy * {X.num(0.7 / 19)} AS gy FROM range(40) a(ix), range(20) b(iy)),
        w AS (SELECT cell_id, x, 1 / greatest((gx - p.x) * (gx - p.x) + (gy - p.y) * (gy - p.y), 1e-12) AS w, label FROM g, p WHERE (gx - p.x) * (gx - p.x) + (gy - p.y) * (gy - p.y) <= 0.01),
        i AS (SELECT cell_id, sum(w * label) / sum(w) AS value, count(*) AS n FROM w GROUP BY 1),
        k AS (SELECT DISTINCT cell_id FROM g JOIN dm ON abs(gx - mx) / sx + abs(gy - my) / sy < 1),
        f AS (SELECT cell_id, min(struct_pack(d := (gx - p.x) * (gx - p.x) + (gy - p.y) * (gy - p.y), l := label)).l AS value, 0 AS n
              FROM g, p WHERE cell_id NOT IN (SELECT cell_id FROM i) GROUP BY 1)
        SELECT CAST(cell_id AS BIGINT) AS cell_id, round(CAST(value AS DOUBLE), 6) AS value, n FROM (SELECT * FROM i UNION ALL SELECT * FROM f) WHERE cell_id IN (SELECT cell_id FROM k)""",
)
def idw_grid(spark, sf):
    cells = G.lattice(spark, -0.35, 0.35, 40, -0.35, 0.35, 20)
    masked = G.points_in_rings(cells, diamonds(spark, sf), 0.1).select("cell_id").distinct()
    inside = cells.join(masked, "cell_id", "left_semi")
    sites = points(spark, sf).select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("label").cast("double").alias("val"))
    return G.inverse_distance(inside, sites, "cell_id", "val", 0.1).select("cell_id", F.round("value", 6).alias("value"), "n")


# ----------------------------------------------------------- grid tables


@query(
    "G09",
    f"SELECT l_suppkey AS sub, l_partkey AS line, min(l_orderkey) AS first_seen, count(DISTINCT {KVSQL}) AS volts FROM lineitem GROUP BY 1, 2",
)
def sub_line_map(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sub"), F.col("l_partkey").alias("line"), "l_orderkey", kv().alias("v"))
    return li.groupBy("sub", "line").agg(F.min("l_orderkey").alias("first_seen"), F.count_distinct("v").alias("volts"))


def stops(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("seq")).agg(F.min("l_suppkey").alias("sub"))


EDGES = f"""
sq AS (SELECT l_orderkey AS line, l_linenumber AS seq, min(l_suppkey) AS sub FROM lineitem GROUP BY 1, 2),
ed AS (SELECT * FROM (SELECT line, sub AS a, lead(sub) OVER (PARTITION BY line ORDER BY seq) AS b FROM sq) WHERE b IS NOT NULL),
pr AS (SELECT l_orderkey AS line, CAST(max({KVSQL}) AS DOUBLE) AS volt, sum(l_quantity) AS length FROM lineitem GROUP BY 1),
ss AS (SELECT s_suppkey AS sub_id FROM supplier WHERE s_acctbal > 0),
ae AS (SELECT DISTINCT line, a, b, {CLS.format(v='CAST(volt AS BIGINT)')} AS voltage, length, a || '_' || CAST(volt AS BIGINT) AS from_bus, b || '_' || CAST(volt AS BIGINT) AS to_bus
  FROM ed JOIN pr USING (line) WHERE a IN (SELECT sub_id FROM ss) AND b IN (SELECT sub_id FROM ss) AND volt >= 160 AND {CLS.format(v='CAST(volt AS BIGINT)')} IS NOT NULL)"""


@query("G11", f"WITH {EDGES} SELECT line, a, b FROM ed")
def consecutive_edges(spark, sf):
    return T.consecutive(stops(spark, sf), "line", ["seq"], ["sub"], "sub").select("line", "a", "b")


def edges(spark, sf):
    ed = T.consecutive(stops(spark, sf), "line", ["seq"], ["sub"], "sub").select("line", "a", "b")
    props = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("line")).agg(
        F.max(kv()).cast("double").alias("volt"), F.sum("l_quantity").alias("length")
    )
    known = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("sub_id"))
    return T.assembled_edges(ed, props, known)


@query("G14 G15 G16", f"WITH {EDGES} SELECT line, a, b, CAST(voltage AS BIGINT) AS voltage, length, from_bus, to_bus FROM ae")
def assembled_edges(spark, sf):
    return edges(spark, sf).withColumn("voltage", F.col("voltage").cast("bigint"))


BUSES = f"{EDGES},\nbu AS (SELECT a AS sub_id, voltage, from_bus AS bus FROM ae UNION SELECT b, voltage, to_bus FROM ae)"


@query("G13 G17", f"WITH {BUSES} SELECT sub_id, s_name, s_nationkey AS region_id, CAST(voltage AS BIGINT) AS voltage, bus FROM bu LEFT JOIN supplier ON s_suppkey = sub_id")
def station_buses(spark, sf):
    attr = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sub_id"), "s_name", F.col("s_nationkey").alias("region_id")).dropDuplicates(["sub_id"])
    return T.station_buses(edges(spark, sf)).join(attr, "sub_id", "left").select(
        "sub_id", "s_name", "region_id", F.col("voltage").cast("bigint").alias("voltage"), "bus"
    )


def _arch_sql(src, sub, volt):
    return f"""
vv AS (SELECT {sub} AS sub_id, list_sort(list_distinct(list({volt})), 'DESC') AS vs FROM {src} GROUP BY 1),
ar AS (SELECT sub_id, sub_id || '_' || vs[1] AS hv_bus, CASE WHEN len(vs) = 1 THEN sub_id || '_' || vs[1] || 'lv' ELSE sub_id || '_' || vs[2] END AS lv_bus,
  vs[1] AS hv, coalesce(vs[2], 0) AS lv, CASE len(vs) WHEN 1 THEN 'GY-D' WHEN 2 THEN CASE WHEN vs[1] / vs[-1]::DOUBLE > 2 THEN 'GY-GY' ELSE 'Auto' END WHEN 3 THEN 'GY-GY-D'
   ELSE CASE len(list_filter(vs, lambda v: v >= 200)) WHEN 1 THEN 'GY-GY' WHEN 2 THEN CASE WHEN vs[1] / vs[-1]::DOUBLE > 2 THEN 'GY-GY' ELSE 'Auto' END WHEN 3 THEN 'GY-GY-D' ELSE 'Unknown' END END AS type FROM vv)"""


@query("G21", f"WITH {_arch_sql('lineitem', 'l_orderkey', KVSQL)} SELECT sub_id, hv_bus, lv_bus, CAST(hv AS BIGINT) AS hv, CAST(lv AS BIGINT) AS lv, type FROM ar")
def bus_archetypes(spark, sf):
    v = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sub_id"), kv().alias("volt"))
    return T.bus_archetypes(v).withColumns({"hv": F.col("hv").cast("bigint"), "lv": F.col("lv").cast("bigint")})


EXT = f"""{BUSES},{_arch_sql('(SELECT sub_id, split_part(bus, chr(95), 2)::BIGINT AS v FROM bu)', 'sub_id', 'v')},
bo AS (SELECT from_bus AS bus, to_bus AS ext, line FROM ae UNION ALL SELECT to_bus, from_bus, line FROM ae),
si AS (SELECT sub_id, hv_bus AS bus, 'hv' AS side FROM ar UNION ALL SELECT sub_id, lv_bus, 'lv' FROM ar WHERE lv >= 150 AND type NOT IN ('GY-D', 'Tee', 'GSU')),
ex AS (SELECT DISTINCT sub_id, side, bus, ext, line FROM si JOIN bo USING (bus))"""


def external(spark, sf):
    ed = edges(spark, sf)
    buses = T.station_buses(ed)
    volts = buses.select("sub_id", F.element_at(F.split("bus", "_"), -1).cast("int").alias("volt"))
    return T.external_buses(T.bus_archetypes(volts), ed), buses


@query("G22", f"WITH {EXT} SELECT sub_id, side, bus, ext, line FROM ex")
def neighbours(spark, sf):
    ext, _ = external(spark, sf)
    return ext.select("sub_id", "side", "bus", "ext", "line")


@query("G23", f"WITH {EXT} SELECT bus, ext, 'line' AS kind, line FROM ex WHERE bus IN (SELECT bus FROM bu) AND ext IN (SELECT bus FROM bu)")
def line_records(spark, sf):
    return T.line_records(*external(spark, sf))


@query(
    "G20 S12",
    """WITH m AS (SELECT user_id AS sub, event_type AS role, json_extract(props, '$.k')::BIGINT % 3 AS kind FROM events WHERE json_extract(props, '$.k')::BIGINT > 20)
       SELECT sub, count(*) AS transformers, count(DISTINCT role) AS roles, min(kind) AS kind FROM m GROUP BY 1""",
)
def transformer_counts(spark, sf):
    from gridhazard.sources.grid_files import mapping_attributes

    ev = table(spark, sf, "events")
    # The mapping file writes its attributes as single-quoted dictionary text.
    text = F.concat(F.lit("{'role': '"), "event_type", F.lit("', 'type': '"), F.get_json_object("props", "$.k"), F.lit("'}"))
    m = mapping_attributes(ev.select(F.col("user_id").alias("sub"), text.alias("attributes")), "attributes")
    m = m.withColumn("k", F.col("type").cast("bigint")).filter("k > 20")
    return m.groupBy("sub").agg(
        F.count(F.lit(1)).alias("transformers"), F.count_distinct("role").alias("roles"), F.min(F.col("k") % 3).alias("kind")
    )


_OHM = "CASE volt " + " ".join(f"WHEN {k} THEN {X.num(v)}" for k, v in OHM_PER_KM.items()) + " END"


@query(
    "G24",
    f"""WITH f AS (SELECT l_orderkey AS line, arg_min({{'l': l_quantity, 'v': {KVSQL}}}, {{'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey}}) AS f FROM lineitem GROUP BY 1),
        d AS (SELECT line, f.l * 1.03e0 AS length, f.v AS volt FROM f)
        SELECT line, round(length, 6) AS length, CAST(volt AS BIGINT) AS volt, {_OHM} AS r_per_km, round(length * {_OHM}, 7) AS r FROM d""",
)
def line_resistance(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("line"), F.col("l_quantity").alias("length"), kv().alias("volt"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq")
    )
    r = T.line_resistance(li, "seq")
    return r.select("line", F.round("length", 6).alias("length"), F.col("volt").cast("bigint").alias("volt"), "r_per_km", F.round("r", 7).alias("r"))


def station_table(spark, sf):
    """Stations in key order, one or two buses each (the artificial one by balance)."""
    s = table(spark, sf, "supplier")
    b = F.when(F.col("s_acctbal") > 3000, F.array(F.concat("s_suppkey", F.lit("_161")), F.concat("s_suppkey", F.lit("_345")))).otherwise(
        F.array(F.concat("s_suppkey", F.lit("_345")))
    )
    return s.select(F.col("s_suppkey").alias("pos"), F.col("s_suppkey").alias("sub_id"), b.alias("buses"))


NODES = """
bs AS (SELECT 0 AS kind, s_suppkey AS sub_id, unnest(CASE WHEN s_acctbal > 3000 THEN [s_suppkey || '_161', s_suppkey || '_345'] ELSE [s_suppkey || '_345'] END) AS bus FROM supplier),
al AS (SELECT * FROM bs UNION ALL SELECT 1, s_suppkey, NULL FROM supplier)"""


@query("G25", f"WITH {NODES} SELECT row_number() OVER (ORDER BY kind, sub_id, bus) - 1 AS node_id, CAST(kind AS BIGINT) AS kind, sub_id, bus FROM al")
def node_index(spark, sf):
    return T.node_index(station_table(spark, sf)).select("node_id", F.col("kind").cast("bigint").alias("kind"), "sub_id", "bus")


@query("G26", f"WITH {BUSES}, {NODES} SELECT bu.bus, bs.sub_id FROM bu JOIN bs ON bu.bus = bs.bus")
def bus_lookup(spark, sf):
    return T.station_buses(edges(spark, sf)).select("bus").join(T.bus_stations(station_table(spark, sf)), "bus").select("bus", "sub_id")


_KINDS = tuple(SUBSTATION_CATEGORY) + ("odd",)


@query(
    "G27",
    f"""WITH k AS (SELECT CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE [{', '.join(repr(k) for k in _KINDS)}][o_custkey % {len(_KINDS)} + 1] END AS kind FROM orders)
        SELECT CASE WHEN kind IS NULL THEN 'unknown' ELSE CASE kind {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SUBSTATION_CATEGORY.items())} END END AS category, count(*) AS n FROM k GROUP BY 1""",
)
def station_categories(spark, sf):
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    kind = F.when(F.col("o_orderkey") % 23 != 0, F.element_at(kinds, (F.col("o_custkey") % len(_KINDS) + 1).cast("int")))
    return table(spark, sf, "orders").groupBy(T.category(kind).alias("category")).agg(F.count(F.lit(1)).alias("n"))
