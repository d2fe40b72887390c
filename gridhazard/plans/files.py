"""File-format queries: each writes a table's rows in the text form of a source file
and runs the reader's parsing on it; and the streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridhazard.plans import sqltext as X
from gridhazard.operators import events as E
from gridhazard.plans.catalogue import INDEX_SQL, NAMED_SQL, SESSIONS_SQL, index_series, named_events, sessions
from gridhazard.plans.registry import epoch_hour, query, stamp, table
from gridhazard.session import cut_lineage, scratch_path
from gridhazard.sources import em_files, grid_files, index_files, magnetometer, realizations, sinks
from gridhazard.streaming.moments import running_moment_stream
from gridhazard.streaming.run import drain
from gridhazard.streaming.sessions import open_sessions, storm_session_stream

FMT = "yyyy-MM-dd HH:mm:ss"


@query(
    "S01",
    f"""WITH {INDEX_SQL} SELECT {X.stamp('t')} AS ts, round(kp, 2) AS kp, CAST(round_even(round(kp, 2) * 3, 0) AS BIGINT) AS kp_0to9, CAST(floor(ap) AS BIGINT) AS ap
        FROM ix WHERE kp IS NOT NULL""",
)
def kp_text(spark, sf):
    ts = F.timestamp_seconds(F.col("t") * 3600)
    # Year, month, day, hour, fractional hour and two decimal dates precede Kp, ap and the flag.
    line = F.concat_ws(" ", F.date_format(ts, "yyyy MM dd HH"), F.lit("1.5  100.000 100.062"), F.format_string("%.2f", "kp"), F.floor("ap").cast("string"), F.lit("1"))
    lines = index_series(spark, sf).filter(F.col("kp").isNotNull()).select(line.alias("value"))
    return index_files.parse_kp_lines(lines).select(
        F.date_format("ts", FMT).alias("ts"), "kp", F.col("kp_0to9").cast("bigint").alias("kp_0to9"), F.col("ap").cast("bigint").alias("ap")
    )


@query("S02", f"WITH {INDEX_SQL} SELECT {X.stamp('t')} AS ts, round(dst, 2) AS dst FROM ix WHERE dst IS NOT NULL AND t % 11 <> 0 AND t % 13 <> 0")
def dst_text(spark, sf):
    ts = F.timestamp_seconds(F.col("t") * 3600)
    value = F.when(F.col("t") % 13 == 0, "99999.99").otherwise(F.format_string("%.2f", "dst"))
    row = F.concat_ws("  ", F.date_format(ts, FMT + ".SSS"), F.date_format(ts, "D"), value)
    line = F.when(F.col("t") % 11 == 0, F.concat(row, F.lit(" |"))).otherwise(row)
    lines = index_series(spark, sf).filter(F.col("dst").isNotNull()).select(line.alias("value"))
    return index_files.parse_dst_lines(lines).select(F.date_format("ts", FMT).alias("ts"), "dst")


@query(
    "S04 S06 TS03",
    f"""SELECT 'U' || user_id AS site, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN value < 1 THEN NULL ELSE value END AS x, CAST(event_id AS DOUBLE) AS y,
        round(user_id * 0.25, 2) AS latitude, CAST(200 + user_id - 360 AS DOUBLE) AS longitude FROM events WHERE event_type <> 'signup' AND user_id NOT IN (7, 11)""",
)
def iaga_text(spark, sf):
    ev = table(spark, sf, "events").filter("event_type <> 'signup'")
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    head = lambda k, v: F.rpad(F.concat(F.rpad(F.lit(" " + k), 24, " "), v), 69, " ")
    sites = ev.select("user_id").distinct()
    header = sites.select(
        name.alias("file"),
        F.explode(F.array(
            F.concat(head("IAGA CODE", F.concat(F.lit("U"), F.col("user_id").cast("string"))), F.lit("|")),
            F.concat(head("Geodetic Latitude", F.format_string("%.2f", F.col("user_id") * 0.25)), F.lit("|")),
            F.concat(head("Geodetic Longitude", (F.col("user_id") + 200).cast("string")), F.lit("|")),
            F.lit("DATE       TIME         DOY     X      Y      Z      F   |"),
        )).alias("value"),
    )
    x = F.when(F.col("value") < 1, F.lit("99999.00")).otherwise(F.format_string("%.2f", "value"))
    data = ev.select(
        name.alias("file"),
        F.concat_ws("  ", F.date_format("ts", FMT + ".000"), F.date_format("ts", "D"), x, F.col("event_id").cast("string"), F.lit("1.00"), F.lit("88888.00")).alias("value"),
    )
    d = magnetometer.parse_iaga_lines(header.unionByName(data))
    allowed = d.filter(~F.col("site").isin("U7", "U11"))
    return allowed.select("site", F.date_format("ts", FMT).alias("ts"), "x", "y", "latitude", "longitude")


@query(
    "S07",
    """SELECT s_suppkey AS site, l_linenumber AS rating, CAST(l_partkey AS DOUBLE) AS period, e.e AS element, CASE WHEN e.e = 'xx' THEN l_discount ELSE l_tax END AS z_re, l_quantity AS z_im,
         CASE WHEN e.e = 'xx' THEN 0.5 ELSE 0.25 END AS z_var
       FROM lineitem JOIN supplier ON s_suppkey = l_suppkey, (VALUES ('xx'), ('xy')) e(e) WHERE l_returnflag = 'A'""",
)
def impedance_xml(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_returnflag = 'A'")
    s = lambda c: F.col(c).cast("string")
    xml = F.concat(
        F.lit("<EM_TF><SiteId>"), s("l_suppkey"), F.lit("</SiteId><Latitude>40</Latitude><Longitude>-100</Longitude><Rating>"), s("l_linenumber"),
        F.lit('</Rating><Data><Period value="'), s("l_partkey"), F.lit('"><Z><value name="Zxx">'), s("l_discount"), F.lit(" "), s("l_quantity"),
        F.lit('</value><value name="Zxy">'), s("l_tax"), F.lit(" "), s("l_quantity"),
        F.lit('</value></Z><Z.VAR><value name="Zxx">0.5</value><value name="Zxy">0.25</value></Z.VAR></Period></Data></EM_TF>'),
    )
    d = em_files.parse_em_xml(li.select(xml.alias("xml")), "xml")
    return d.select(F.col("site").cast("bigint").alias("site"), F.col("rating").cast("int").alias("rating"), "period", "element", "z_re", "z_im", "z_var")


@query(
    "S09",
    """WITH e AS (SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'node' WHEN 3 THEN 'relation' ELSE 'way' END AS t, vec_id % 4 = 1 AS closed, label FROM embeddings)
       SELECT vec_id AS osmid, t AS element_type, CASE WHEN t = 'node' THEN 'point' WHEN closed THEN 'ring' ELSE 'line' END AS kind,
         CASE WHEN t = 'node' THEN 1 WHEN closed THEN 5 ELSE 4 END AS vertices, 'L' || label AS name, 2 AS tags FROM e WHERE t <> 'relation'""",
)
def map_features(spark, sf):
    e = table(spark, sf, "embeddings")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("node", "way", "way", "relation")]), (F.col("vec_id") % 4 + 1).cast("int"))
    pt = lambda k: F.struct(F.col("embedding")[2 * k].cast("double").alias("lat"), F.col("embedding")[2 * k + 1].cast("double").alias("lon"))
    path = F.array(*[pt(k) for k in range(4)])
    geometry = F.when(F.col("vec_id") % 4 == 1, F.concat(path, F.array(pt(0)))).when(F.col("vec_id") % 4 == 2, path)
    tags = F.create_map(F.lit("name"), F.concat(F.lit("L"), F.col("label").cast("string")), F.lit("power"), F.lit("substation"), F.lit("note"), F.lit("x"))
    element = F.struct(kind.alias("type"), F.col("vec_id").alias("id"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), geometry.alias("geometry"), tags.alias("tags"))
    text = e.select(F.to_json(F.struct(F.array(element).alias("elements"))).alias("value"))
    raw = text.select(F.from_json("value", grid_files.FEATURE_SCHEMA).alias("r")).select("r.elements")
    d = grid_files.map_features(raw)
    return d.select("osmid", "element_type", "kind", F.size("vertices").alias("vertices"), F.col("tags")["name"].alias("name"), F.size("tags").alias("tags"))


@query(
    "S10 S24",
    """WITH p AS (SELECT o_orderkey AS id, unnest(range(o_custkey % 3 + 1)) AS pos, o_totalprice FROM orders)
       SELECT CASE WHEN pos = 0 THEN CAST(id AS VARCHAR) ELSE id || '_' || pos END AS line_id, 2 AS vertices, CAST(pos AS DOUBLE) AS first_x, CAST(o_totalprice AS DOUBLE) AS last_y FROM p""",
)
def multipart_lines(spark, sf):
    o = table(spark, sf, "orders")
    wkt = F.transform(
        F.sequence(F.lit(0), (F.col("o_custkey") % 3).cast("int")),
        lambda k: F.concat(F.lit("LINESTRING ("), k.cast("string"), F.lit(" 0.5, 3 "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(")")),
    )
    parts = F.transform(wkt, grid_files.wkt_line)
    d = grid_files.exploded_parts(o.select(F.col("o_orderkey").alias("line_id"), parts.alias("parts")), "line_id", "parts")
    return d.select("line_id", F.size("vertices").alias("vertices"), F.col("vertices")[0]["x"].alias("first_x"), F.element_at("vertices", -1)["y"].alias("last_y"))


@query(
    "S11 SF12",
    "SELECT CASE WHEN n_name = 'NATION_3' THEN 'North' WHEN n_name = 'NATION_4' THEN 'West' ELSE n_name END AS region, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_name <> 'NATION_5' GROUP BY 1",
)
def region_names(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", F.when(F.col("n_name") == "NATION_5", "NotOrder1000").otherwise(F.col("n_name")).alias("region"))
    named = grid_files.renamed_regions(n, {"NATION_3": "North", "NATION_4": "West"})
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    return c.join(named, "n_nationkey").groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query(
    "S13",
    "SELECT CAST(l_orderkey % 500 AS BIGINT) AS realization, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1",
)
def realization_files(spark, sf):
    li = table(spark, sf, "lineitem")
    name = F.concat(F.lit("winding_gic_rand_"), (F.col("l_orderkey") % 500).cast("string"), F.lit(".csv"))
    d = li.select(name.alias("file"), "l_extendedprice")
    return d.groupBy(realizations.realization_number(F.col("file")).cast("bigint").alias("realization")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total")
    )


@query(
    "S21",
    """WITH lv AS (SELECT 'V' AS q, l_suppkey AS e, 'V_' || (l_linenumber * 25) AS s, max(l_extendedprice) AS v FROM lineitem GROUP BY 2, 3),
       ev AS (SELECT CASE WHEN event_type = 'click' THEN 'E' ELSE 'B' END AS q, user_id AS e, event_type AS s, max(value) AS v FROM events GROUP BY 1, 2, 3)
       SELECT q AS quantity, e AS entity_id, s AS scenario, round(v, 6) AS value FROM lv UNION ALL SELECT q, e, s, round(CASE WHEN q = 'E' THEN v / 1000 ELSE v END, 6) FROM ev""",
)
def return_level_store(spark, sf):
    levels = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("entity_id"), (F.col("l_linenumber") * 25).alias("period")).agg(
        F.max("l_extendedprice").alias("value")
    ).withColumn("quantity", F.lit("V"))
    q = F.when(F.col("event_type") == "click", "E").otherwise("B")
    events = table(spark, sf, "events").groupBy(q.alias("quantity"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("event")).agg(F.max("value").alias("value"))
    return realizations.return_level_store(levels, events).select("quantity", "entity_id", "scenario", F.round("value", 6).alias("value"))


@query(
    "S22",
    "SELECT s_suppkey AS ss_id, s_name AS ss_name, 'Unknown' AS ss_operator, CASE WHEN s_acctbal > 0 THEN 'transmission' ELSE 'Unknown' END AS ss_type FROM supplier",
)
def aliased_columns(spark, sf):
    s = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("osmid"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 0, "transmission").alias("substation")
    )
    d = grid_files.normalize_columns(
        s, {"ss_id": ("osmid", "SS_ID"), "ss_name": ("name",), "ss_operator": ("operator",), "ss_type": ("substation", "type")},
        {"ss_name": "Unknown", "ss_operator": "Unknown", "ss_type": "Unknown"},
    )
    return d.select("ss_id", "ss_name", "ss_operator", "ss_type")


@query(
    "SF09 SF08",
    r"""SELECT doc_id, upper(trim(lang)) AS lang, CAST(length(regexp_replace(text, '[^a-z]', '', 'g')) AS BIGINT) AS letters,
          CAST(len(regexp_extract_all(text, '[0-9]+')) AS BIGINT) AS numbers, contains(text, 'license') AS has_license, starts_with(text, 'The') AS starts_the,
          split_part(replace(source, '_', '-'), '-', 1) AS source FROM documents""",
)
def clean_codes(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id", F.upper(F.trim("lang")).alias("lang"), F.length(F.regexp_replace("text", "[^a-z]", "")).cast("bigint").alias("letters"),
        F.size(F.regexp_extract_all("text", F.lit("([0-9]+)"), 1)).cast("bigint").alias("numbers"),
        F.col("text").contains("license").alias("has_license"), F.col("text").startswith("The").alias("starts_the"),
        F.split(F.replace("source", F.lit("_"), F.lit("-")), "-")[0].alias("source"),
    )


# --------------------------------------------------------------- streaming


def stream_of(spark, sf, name):
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query(
    "ST11",
    """WITH e AS (SELECT user_id, ts FROM events WHERE value > 60),
       m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 48 HOURS THEN 0 ELSE 1 END AS s FROM e),
       n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m)
       SELECT user_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM n GROUP BY user_id, k""",
)
def session_stream(spark, sf):
    """All sessions of the stream: those put out, and at its end those that were still open."""
    ev = stream_of(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).filter("value > 60")
    folder = scratch_path(spark, "sessions")
    d = drain(storm_session_stream(ev.select("user_id", "ts"), "user_id", "ts", 48), "sessions", mode="append", folder=folder)
    d = d.unionByName(open_sessions(spark, f"{folder}/state", "user_id"))
    return d.select("user_id", "n", F.date_format("first_ts", FMT).alias("first_ts"), F.date_format("last_ts", FMT).alias("last_ts"))


@query(
    "PP05",
    """SELECT l_suppkey AS sub_id, l_partkey % 24 AS minute, count(*) AS n, round(avg(l_extendedprice / 733), 5) AS mean, round(stddev_pop(l_extendedprice / 733), 5) AS std FROM lineitem GROUP BY 1, 2""",
)
def moment_stream(spark, sf):
    li = stream_of(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("sub_id"), (F.col("l_partkey") % 24).alias("minute"), (F.col("l_extendedprice") / 733).alias("x")
    )
    d = drain(running_moment_stream(li, ["sub_id", "minute"], "x"), "moments")
    return d.select("sub_id", "minute", "n", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


@query(
    "FV14",
    f"""WITH {SESSIONS_SQL}, {NAMED_SQL},
        sp AS (SELECT start_t, end_t, min(name) AS storm FROM storms JOIN named ON start_t <= event_end AND end_t >= event_start GROUP BY 1, 2),
        s AS (SELECT {X.hour('ts')} AS t, user_id AS entity, max(value) AS v FROM events GROUP BY 1, 2)
        SELECT storm, {X.stamp('t')} AS ts, entity, v FROM s JOIN sp ON t BETWEEN start_t AND end_t""",
)
def special_storm_series(spark, sf):
    """Full series of the named storms, stored by storm, written a second time for one of them, and read back."""
    s = sessions(spark, sf)
    special = cut_lineage(E.overlapping(s, named_events(spark)).groupBy("start_t", "end_t").agg(F.min("name").alias("storm")))
    series = table(spark, sf, "events").groupBy(epoch_hour("ts").alias("t"), F.col("user_id").alias("entity")).agg(F.max("value").alias("v"))
    path = scratch_path(spark, "storms")
    sinks.write_storm_series(series, special, path, 24)
    sinks.write_storm_series(series, special.join(special.agg(F.min("storm").alias("storm")), "storm"), path, 24)
    return sinks.read_storm_series(spark, path).select("storm", stamp("t").alias("ts"), "entity", "v")


@query(
    "K05",
    """WITH c AS (SELECT l_suppkey AS site, l_linenumber * 25 AS period, max(l_extendedprice) / 1000 AS level, count(*) AS n FROM lineitem GROUP BY 1, 2)
       SELECT site, period, 'level' AS name, round(level, 6) AS value, 'V/km' AS units, 'site,period' AS dims FROM c
       UNION ALL SELECT site, period, 'events', CAST(n AS DOUBLE), '1', 'site,period' FROM c""",
)
def result_cube(spark, sf):
    """Return levels as a cube: written, read back, and unpivoted by the metadata that came back with it."""
    li = table(spark, sf, "lineitem")
    levels = li.groupBy(F.col("l_suppkey").alias("site"), (F.col("l_linenumber") * 25).alias("period")).agg(
        (F.max("l_extendedprice") / 1000).alias("level"), F.count(F.lit(1)).cast("double").alias("events")
    )
    path = scratch_path(spark, "cube")
    sinks.as_cube(levels, ["site", "period"], {"period": "years", "level": "V/km", "events": "1"}).write.parquet(path)
    cube = spark.read.parquet(path)
    dims, meta = sinks.cube_dimensions(cube), sinks.cube_attributes(cube)
    values = [c for c in cube.columns if meta[c]["role"] == "value"]
    pack = F.array(*[F.struct(F.lit(c).alias("name"), F.round(c, 6).alias("value"), F.lit(meta[c]["units"]).alias("units")) for c in values])
    return cube.select(*dims, F.explode(pack).alias("p"), F.lit(",".join(dims)).alias("dims")).select(*dims, "p.*", "dims")
