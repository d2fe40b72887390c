"""Grid topology tables: edges, buses, transformer archetypes, node index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridhazard.functions.fixed_values import OHM_PER_KM, SUBSTATION_CATEGORY, VOLTAGE_CLASS
from gridhazard.operators.ordered import dense_position, shifted


def lookup(column, mapping):
    """Value of a constant mapping, null when absent."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return m[column]


def standard_voltage(v, keep_unmapped=True):
    """Standard voltage class; other values stay, or turn null for the strict pass."""
    mapped = lookup(v.cast("int"), VOLTAGE_CLASS)
    return F.coalesce(mapped, v.cast("int")) if keep_unmapped else mapped


def highest_number(text):
    """Largest number written in a text, e.g. '345000;138000'."""
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)"), 1), lambda x: x.cast("double")))


def first_seen(df, keys, order) -> DataFrame:
    """Distinct keys with the order value at which they first occur."""
    return df.groupBy(*keys).agg(F.min(order).alias("first_seen"))


def consecutive(stops, line, buckets, order, node) -> DataFrame:
    """Neighbouring nodes along each line: (line, a, b, seq)."""
    d = shifted(stops, [line], buckets, order, node, "b", -1)
    return d.filter(F.col("b").isNotNull()).withColumnRenamed(node, "a")


def along(stops, line, order, node) -> DataFrame:
    """Neighbouring nodes along each line, like :func:`consecutive`, in one sort of the stops.

    For stops that are dealt by line already, as those that ``geo.near_lines`` finds: a second pass over them, as bordering
    buckets need, would find them anew. A line has a stop per point near it at most, and long ones go to disk.
    """
    d = stops.withColumn("b", F.lead(node).over(Window.partitionBy(line).orderBy(*order)))
    return d.filter(F.col("b").isNotNull()).withColumnRenamed(node, "a")


def adjacency(edges) -> DataFrame:
    """Both directions of every edge, distinct."""
    once = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    there, back = F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    both = F.when(F.col("a") == F.col("b"), F.array(there)).otherwise(F.array(there, back))
    return once.select(F.explode(both).alias("e")).select("e.a", "e.b")


def segment_ids(edges, line) -> DataFrame:
    """Lines with several pairs get one id per piece, others keep theirs. One pass: edges are not read a second time to count them."""
    n = F.count(F.lit(1)).over(Window.partitionBy(line))
    piece = F.when(F.col("_n") > 1, F.concat_ws("_", line, "a", "b")).otherwise(F.col(line).cast("string"))
    return edges.withColumn("_n", n).withColumn("line_id", piece).drop("_n")


def assembled_edges(edges, properties, stations, cutoff=160, sentinel=-999999.0) -> DataFrame:
    """Edges with known end stations and a usable voltage, with bus names on both ends."""
    props = properties.filter((F.col("volt") != sentinel) & F.col("volt").isNotNull() & (F.col("length") > 0))
    known = stations.select("sub_id").distinct()
    d = (
        edges.join(known.withColumnRenamed("sub_id", "a"), "a", "left_semi")
        .join(known.withColumnRenamed("sub_id", "b"), "b", "left_semi")
        .join(props, "line").filter(F.col("volt") >= cutoff)
        .withColumn("kv", F.col("volt").cast("int"))
        .withColumn("voltage", standard_voltage(F.col("kv"), keep_unmapped=False))
        .filter(F.col("voltage").isNotNull())
    )
    return d.select(
        "line", "a", "b", "voltage", "length",
        F.concat_ws("_", "a", "kv").alias("from_bus"), F.concat_ws("_", "b", "kv").alias("to_bus"),
    ).distinct()


def station_buses(edges) -> DataFrame:
    """Distinct (substation, voltage, bus) over both ends."""
    a = edges.select(F.col("a").alias("sub_id"), "voltage", F.col("from_bus").alias("bus"))
    return a.union(edges.select("b", "voltage", "to_bus")).distinct()


def bus_archetypes(voltages, sub="sub_id", volt="volt") -> DataFrame:
    """High- and low-voltage bus and transformer archetype from a station's line voltages.

    A station has at most as many distinct voltages as there are classes.
    """
    vs = F.col("vs")
    d = voltages.groupBy(sub).agg(F.sort_array(F.collect_set(F.col(volt).cast("int")), asc=False).alias("vs"))
    n, high, low = F.size(vs), F.element_at(vs, 1), F.element_at(vs, -1)
    wide = F.when(high.cast("double") / low > 2, "GY-GY").otherwise("Auto")
    strong = F.size(F.filter(vs, lambda v: v >= 200))
    many = F.when(strong == 1, "GY-GY").when(strong == 2, wide).when(strong == 3, "GY-GY-D").otherwise("Unknown")
    hv = F.concat_ws("_", sub, high)
    return d.select(
        sub,
        hv.alias("hv_bus"),
        F.when(n == 1, F.concat(hv, F.lit("lv"))).otherwise(F.concat_ws("_", sub, F.try_element_at(vs, F.lit(2)))).alias("lv_bus"),
        high.alias("hv"), F.coalesce(F.try_element_at(vs, F.lit(2)), F.lit(0)).alias("lv"),
        F.when(n == 1, "GY-D").when(n == 2, wide).when(n == 3, "GY-GY-D").otherwise(many).alias("type"),
    )


def external_buses(archetypes, edges, lv_cutoff=150) -> DataFrame:
    """Buses across a line from a station's high bus, and from its low bus where that counts."""
    both = edges.select(F.col("from_bus").alias("bus"), F.col("to_bus").alias("ext"), "line").union(
        edges.select("to_bus", "from_bus", "line")
    )
    high = archetypes.select("sub_id", F.col("hv_bus").alias("bus"), F.lit("hv").alias("side"))
    low_ok = (F.col("lv") >= lv_cutoff) & ~F.col("type").isin("GY-D", "Tee", "GSU")
    low = archetypes.filter(low_ok).select("sub_id", F.col("lv_bus").alias("bus"), F.lit("lv").alias("side"))
    return high.union(low).join(both, "bus").select("sub_id", "side", "bus", "ext", "line").distinct()


def line_records(external, known_buses) -> DataFrame:
    """(bus, ext, 'line', line) where both buses are known."""
    known = known_buses.select("bus").distinct()
    d = external.join(known, "bus", "left_semi").join(known.withColumnRenamed("bus", "ext"), "ext", "left_semi")
    return d.select("bus", "ext", F.lit("line").alias("kind"), "line")


def line_resistance(lines, order) -> DataFrame:
    """First record per line; length stretched by 3 percent; R = length * ohm per km of the voltage."""
    first = lines.groupBy("line").agg(F.min_by(F.struct("length", "volt"), order).alias("f"))
    km = F.col("f.length") * 1.03
    ohm = lookup(F.col("f.volt").cast("int"), OHM_PER_KM)
    return first.select("line", km.alias("length"), F.col("f.volt").alias("volt"), ohm.alias("r_per_km"), (km * ohm).alias("r"))


def node_index(stations, width=1000) -> DataFrame:
    """Dense node numbers: buses in station order, then one neutral per station.

    ``stations(pos, sub_id, buses)``; positions are numbered inside slices of
    ``pos``, so the numbering is not one task's work.
    """
    bus = stations.select(F.lit(0).alias("kind"), "pos", F.explode("buses").alias("bus"), "sub_id")
    neutral = stations.select(F.lit(1).alias("kind"), "pos", F.lit(None).cast("string").alias("bus"), "sub_id")
    d = bus.unionByName(neutral).withColumn("_s", F.floor(F.col("pos") / width))
    d = dense_position(d, [], ["kind", "_s"], ["pos", "bus"], "_n")
    return d.select((F.col("_n") - 1).alias("node_id"), "kind", "sub_id", "bus")


def bus_stations(stations) -> DataFrame:
    """Bus -> station, one row per bus."""
    return stations.select(F.explode("buses").alias("bus"), "sub_id")


def category(kind):
    """Station category; unlisted or missing types: null and 'unknown'."""
    return F.when(kind.isNull(), "unknown").otherwise(lookup(kind, SUBSTATION_CATEGORY))
