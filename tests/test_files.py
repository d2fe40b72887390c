import json

import pytest
from pyspark.sql import functions as F

from gridhazard.sources import econ_files, em_files, grid_files, index_files, magnetometer, realizations, sinks
from gridhazard.streaming.moments import running_moment_stream
from gridhazard.streaming.run import drain
from gridhazard.streaming.sessions import storm_session_stream


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_index_files(spark, tmp_path):
    kp = write(tmp_path / "kp.txt", "1932 01 01 00.0 01.50 1.0 1.1 3.333  18 1\n1932 01 01 03.0 04.50 1.0 1.1 2.667 12 1\nbad line\n")
    got = index_files.read_kp(spark, kp).orderBy("ts").collect()
    assert [r.kp_0to9 for r in got] == [10, 8] and str(got[1].ts) == "1932-01-01 03:00:00"
    dst = write(tmp_path / "dst.txt", "DATE TIME DOY DST |\n1985-01-01 00:00:00.000 001 -12.00\n1985-01-01 01:00:00.000 001 99999.99\nx y\n")
    assert [(r.doy, r.dst) for r in index_files.read_dst(spark, dst).collect()] == [(1, -12.0)]
    st = write(tmp_path / "storms.csv", "Start,End\n1985-01-05 00:00:00,1985-01-08 00:00:00\n2024-05-09 14:00:00,2024-05-13 00:00:00\n")
    d = index_files.read_storms(spark, st, 2000, 2025).collect()
    assert len(d) == 1 and d[0].duration.total_seconds() == 82 * 3600


def test_iaga_file(spark, tmp_path):
    head = lambda k, v: (f" {k:<23}{v:<45}" + "|\n")
    text = head("IAGA CODE", "BOU") + head("Geodetic Latitude", "40.137") + head("Geodetic Longitude", "254.763")
    text += "DATE       TIME         DOY     BOUX      BOUY      BOUZ      BOUF   |\n"
    text += "2003-10-29 00:00:00.000 302     20836.57   3500.10  99999.00  88888.00\n"
    write(tmp_path / "bou" / "a.min", text)
    r = magnetometer.read_iaga(spark, str(tmp_path / "bou")).collect()[0]
    assert (r.site, r.latitude, round(r.longitude, 3), r.x, r.z, r.f) == ("BOU", 40.137, -105.237, 20836.57, None, None)
    write(tmp_path / "proc" / "frd" / "f.csv", "ts,X,Y,Z,Latitude,Longitude\n2003-10-29 00:00:00,1,2,3,38.2,-77.3\n")
    write(tmp_path / "proc" / "gua" / "f.csv", "ts,X,Y,Z,Latitude,Longitude\n2003-10-29 00:00:00,1,2,3,13.5,144.8\n")
    assert [r.site for r in magnetometer.read_processed(spark, str(tmp_path / "proc"), ["FRD"]).collect()] == ["frd"]


def test_impedance_xml_and_accepted_sites(spark, tmp_path):
    period = '<Period value="{p}"><Z><value name="Zxx">1.0 2.0</value><value name="Zxy">3 -4</value></Z><Z.VAR><value name="Zxx">0.1</value><value name="Zxy">0.2</value></Z.VAR></Period>'
    for s, r in (("AB01", 5), ("CD02", 2)):
        write(tmp_path / "em" / f"{s}.xml", f"<EM_TF><SiteId>{s}</SiteId><Latitude>40</Latitude><Longitude>-100</Longitude><Rating>{r}</Rating><Data>{period.format(p=10)}{period.format(p=20)}</Data></EM_TF>")
    d = em_files.read_em_sites(spark, str(tmp_path / "em"))
    assert d.count() == 8
    r = d.filter("site = 'AB01' and period = 20 and element = 'xy'").first()
    assert (r.z_re, r.z_im, r.z_var) == (3.0, -4.0, 0.2)
    sites = d.select(F.col("site").alias("name"), "rating").distinct()
    none = spark.createDataFrame([], "name string")
    assert [x.name for x in em_files.accepted(sites, none).collect()] == ["AB01"]
    assert [x.name for x in em_files.accepted(sites, spark.createDataFrame([("cd02",)], "name string")).collect()] == ["CD02"]


def test_map_features_and_layers(spark, tmp_path):
    ring = [{"lat": 0, "lon": 0}, {"lat": 0, "lon": 1}, {"lat": 1, "lon": 1}, {"lat": 0, "lon": 0}]
    doc = {"elements": [
        {"type": "node", "id": 1, "lat": 5.0, "lon": 6.0, "tags": {"name": "a", "junk": "x"}},
        {"type": "way", "id": 2, "geometry": ring, "tags": {"voltage": "345000;138000"}},
        {"type": "way", "id": 3, "geometry": ring[:3]}, {"type": "relation", "id": 4},
    ]}
    d = {r.osmid: r for r in grid_files.read_map_features(spark, write(tmp_path / "o.json", json.dumps(doc))).collect()}
    assert set(d) == {1, 2, 3} and [d[k].kind for k in (1, 2, 3)] == ["point", "ring", "line"]
    assert d[1].tags == {"name": "a"} and (d[1].vertices[0].x, d[1].vertices[0].y) == (6.0, 5.0)
    lines = {"features": [
        {"properties": {"ID": "7"}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}},
        {"properties": {"ID": "8"}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3], [4, 4]]]}},
    ]}
    got = {r.line_id: len(r.vertices) for r in grid_files.read_line_layer(spark, write(tmp_path / "l.json", json.dumps(lines))).collect()}
    assert got == {"7": 2, "8": 2, "8_1": 3}
    poly = lambda n: {"properties": {"N": n}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}
    reg = grid_files.read_region_layer(spark, write(tmp_path / "r.json", json.dumps({"features": [poly("A"), poly("NotOrder1000")]})), "N", {"A": "Alpha"})
    assert [(r.region, len(r.ring)) for r in reg.collect()] == [("Alpha", 4)]


def test_network_tables_and_mapping(spark, tmp_path):
    lines = write(tmp_path / "lines.csv", 'name,from_bus,to_bus,length,V,geometry,R_per_km,R\nL1,1_345,2_345,10.0,345,"LINESTRING (-100 40, -99.5 41.25)",0.0283,0.283\n')
    subs = write(tmp_path / "subs.csv", "name,buses,latitude,longitude,grounding_resistance\n1,[],40,-100,inf\n")
    ln, st = grid_files.read_network(spark, lines, subs)
    r = ln.first()
    assert [(v.x, v.y) for v in r.vertices] == [(-100.0, 40.0), (-99.5, 41.25)] and r.V == 345
    m = grid_files.mapping_attributes(spark.createDataFrame([("{'role': 'Transmission', 'type': 'Auto'}",)], "a string"), "a").first()
    assert (m.role, m.type) == ("Transmission", "Auto")


def test_econ_files(spark, tmp_path):
    u = write(tmp_path / "use.csv", 'Unnamed: 0,Unnamed: 1,11,21\n 11 ,Farms,"1,200",---\n21,Mining, 5 ,x\n')
    got = {(r.code, r.column_code): r.value for r in econ_files.read_use_table(spark, u, 10).collect()}
    assert got == {("11", "11"): 120.0, ("11", "21"): 0.0, ("21", "11"): 0.5, ("21", "21"): 0.0}
    write(tmp_path / "g" / "SAGDP9N_AL_1.csv", "code,v\n11,5\n")
    write(tmp_path / "g" / "SAGDP2N_AL_1.csv", "code,v\n11,6\n")
    assert [(r.state, r.v) for r in econ_files.read_state_output(spark, str(tmp_path / "g")).collect()] == [("AL", "5")]
    z = write(tmp_path / "z.csv", "ZIP_CODE,ZCTA,STATE\n001,1,AL\n002,,AL\n")
    assert [r.zip for r in econ_files.read_crosswalk(spark, z).collect()] == ["001"]
    c = econ_files.read_upper_csv(spark, write(tmp_path / "n.txt", "zip,Naics\n1,11----\n"))
    assert c.columns == ["ZIP", "NAICS"]
    ab = {"features": [{"properties": {"name": "s", "gic_75yr_mean_prediction": "-9"}, "geometry": {"type": "Point", "coordinates": [-90.0, 30.0]}}]}
    r = econ_files.read_alpha_beta(spark, write(tmp_path / "ab.json", json.dumps(ab)), ["gic_75yr_mean_prediction"]).first()
    assert (r.gic, r.longitude, r.latitude) == (3.0, -90.0, 30.0)


def test_realization_files(spark, tmp_path):
    for k in (3, 12):
        write(tmp_path / "w" / f"winding_gic_rand_{k}.csv", f"t,gic\na,{k}\n")
    d = realizations.read_realizations(spark, str(tmp_path / "w" / "*.csv"), "t string, gic double")
    assert sorted((r.realization, r.gic) for r in d.collect()) == [(3, 3.0), (12, 12.0)]


def test_sinks_and_resume(spark, tmp_path):
    df = spark.range(40).select((F.col("id") % 2).cast("string").alias("scenario"), F.col("id").alias("gic_realization"))
    sinks.write_by_scenario(df, str(tmp_path / "p"), rows_per_file=5)
    assert spark.read.parquet(str(tmp_path / "p")).filter("scenario = '1'").count() == 20
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 40
    planned = spark.range(20).withColumnRenamed("id", "realization")
    seen = []
    work = lambda p: (seen.append(p.count()), p.withColumn("v", F.col("realization") * 2))[1]
    first = sinks.run_resumable(spark, planned.filter("realization < 8"), str(tmp_path / "r"), work, batches=3)
    assert first.count() == 8 and sum(seen) == 8
    seen.clear()
    full = sinks.run_resumable(spark, planned, str(tmp_path / "r"), work, batches=3)
    assert full.count() == 20 and full.select("realization").distinct().count() == 20 and sum(seen) == 12
    assert sinks.with_metadata(df, source="x").columns[-1] == "meta_source"


def test_streams_equal_batch(spark, tmp_path):
    rows = [(k, i, float(i * k % 7)) for k in (1, 2) for i in range(30)]
    d = spark.createDataFrame(rows, "sub int, i int, x double")
    d.repartition(5).write.parquet(str(tmp_path / "s"))
    st = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    got = {r.sub: (r.n, round(r.mean, 9), round(r.std, 9)) for r in drain(running_moment_stream(st, ["sub"], "x"), "m").collect()}
    want = d.groupBy("sub").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    assert got == {r.sub: (r.n, round(r.mean, 9), round(r.std, 9)) for r in want.collect()}


def hours(spark, rows, folder):
    """Adds a file of (key, hour) rows to a folder and gives the stream of the folder."""
    d = spark.createDataFrame(rows, "k string, h double").select("k", F.timestamp_seconds(F.col("h") * 3600).alias("ts"))
    d.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def ended(out):
    return sorted((r.k, r.first_ts.timestamp() / 3600, r.last_ts.timestamp() / 3600, r.n) for r in out.collect())


def test_sessions_close_by_the_watermark_and_go_on_after_a_restart(spark, tmp_path):
    files, work = str(tmp_path / "t"), str(tmp_path / "w")
    run = lambda st: ended(drain(storm_session_stream(st, "k", "ts", 6), "s", mode="append", folder=work))
    first = run(hours(spark, [("a", 0.0), ("a", 6.0), ("a", 13.0), ("a", 13.0), (None, 1.0), ("b", 100.0)], files))
    assert first == [("a", 0.0, 6.0, 2), ("a", 13.0, 13.0, 2)]  # exactly six hours apart still joins; b may still grow
    # a new query on the same folder: hour 9.5 would join a's sessions but is behind the watermark, hour 94 is on time and out of order
    again = run(hours(spark, [("a", 9.5), ("b", 106.0), ("b", 94.0), ("c", 300.0)], files))
    assert again == first + [("b", 94.0, 106.0, 3)]
    st = hours(spark, [("c", 305.0), ("d", 305.0), ("d", 311.1)], files)
    assert run(st) == again and run(st) == again  # nothing new is ended, and a run without input repeats nothing
    left = spark.read.format("statestore").option("stateVarName", "open").load(f"{work}/state")
    assert {r.key[0] for r in left.select("key").collect()} == {"c", "d"}  # ended sessions are forgotten
    assert run(hours(spark, [("e", 1000.0)], files)) == again + [("c", 300.0, 305.0, 2), ("d", 305.0, 305.0, 1), ("d", 311.1, 311.1, 1)]


def test_repeated_batches_replace_themselves(spark, tmp_path):
    from pyspark.sql.streaming import DataStreamWriter

    writes = []
    each = DataStreamWriter.foreachBatch
    try:
        DataStreamWriter.foreachBatch = lambda self, f: each(
            self, lambda batch, number: (kept := batch.persist(), f(kept, number), f(kept, number), kept.unpersist(), writes.append(number)) and None)
        st = hours(spark, [("a", 1.0), ("b", 100.0)], str(tmp_path / "t"))
        assert ended(drain(storm_session_stream(st, "k", "ts", 6), "s", mode="append", folder=str(tmp_path / "w"))) == [("a", 1.0, 1.0, 1)]
    finally:
        DataStreamWriter.foreachBatch = each
    assert writes


def test_storm_series_replaces_only_its_own_storms(spark, tmp_path):
    path = str(tmp_path / "storms")
    series = spark.createDataFrame([(t, e, float(t + 100 * e)) for t in range(0, 60) for e in (1, 2)], "t bigint, entity bigint, v double")
    storms = spark.createDataFrame([("may 2024", 5, 9), ("quiet", 40, 40), ("long", 8, 31), ("backwards", 9, 5), ("outside", 500, 600)], "storm string, start_t bigint, end_t bigint")
    sinks.write_storm_series(series, storms, path, 4)
    rows = lambda d: sorted((r.storm, r.t, r.entity, r.v) for r in d.collect())
    first = rows(sinks.read_storm_series(spark, path))
    assert first == sorted((s, t, e, float(t + 100 * e)) for s, a, b in (("may 2024", 5, 9), ("quiet", 40, 40), ("long", 8, 31)) for t in range(a, b + 1) for e in (1, 2))
    sinks.write_storm_series(series.withColumn("v", -F.col("v")), storms.filter("storm = 'may 2024'"), path, 4)
    again = rows(sinks.read_storm_series(spark, path))
    assert [r for r in again if r[0] != "may 2024"] == [r for r in first if r[0] != "may 2024"]
    assert [(*r[:3], -r[3]) for r in again if r[0] == "may 2024"] == [r for r in first if r[0] == "may 2024"]
    one = sinks.read_storm_series(spark, path, ["may 2024"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "may 2024" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert {r.storm for r in one.collect()} == {"may 2024"}


def test_cube_metadata_survives_parquet(spark, tmp_path):
    path = str(tmp_path / "cube")
    d = spark.createDataFrame([(1, 75, 2.5, "x")], "site int, period int, level double, source string")
    sinks.as_cube(d, ["period", "site"], {"level": "V/km"}, {"level": "68 percent"}).write.parquet(path)
    back = spark.read.parquet(path)
    assert back.collect() == d.collect() and sinks.cube_dimensions(back) == ["period", "site"]
    assert sinks.cube_attributes(back)["level"] == {"role": "value", "units": "V/km", "note": "68 percent"}
    with pytest.raises(ValueError, match="pressure"):
        sinks.as_cube(d, ["site"], {"pressure": "Pa"})


def test_sessions_open_at_the_end_of_the_stream_are_in_the_result(spark, tmp_path):
    import pandas as pd

    import gridhazard.plans.files as plans

    d = pd.DataFrame({"user_id": [1, 1, 1, 2], "ts": pd.to_datetime([0, 40, 500, 510], unit="h", utc=True).as_unit("us"), "value": 99.0})
    d.to_parquet(tmp_path / "events.parquet")
    got = plans.session_stream(spark, str(tmp_path)).select("user_id", "n").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 2), (2, 1)]
