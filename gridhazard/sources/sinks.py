"""Writers: CSV, scenario-partitioned Parquet, resumable batches, prefix snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_by_scenario(df: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """Parquet partitioned by scenario. Rows are spread over writers inside a scenario
    by realization, or by a hash of the row where it has none, so a scenario with most
    of the rows is not one task's work."""
    named = [c for c in ("gic_realization", "realization") if c in df.columns]
    spread = [F.col(c) for c in named[:1]] or [F.pmod(F.xxhash64(*df.columns), F.lit(32))]
    writer = df.repartition("scenario", *spread)
    out = writer.write.mode("overwrite").partitionBy("scenario").option("compression", "snappy")
    if rows_per_file:
        out = out.option("maxRecordsPerFile", rows_per_file)
    out.parquet(path)


def still_to_do(planned: DataFrame, written: DataFrame, keys) -> DataFrame:
    """Planned work without a finished counterpart."""
    return planned.join(written.select(*keys).distinct(), list(keys), "left_anti")


def run_resumable(spark: SparkSession, planned: DataFrame, path: str, compute, keys=("realization",), batches=8):
    """Compute and append the missing part of ``planned`` batch by batch; returns the whole table.

    Every batch is one write, so a stopped run continues after its last finished
    batch. ``compute`` maps a DataFrame of keys to result rows carrying the keys.
    """
    keys = list(keys)
    todo = planned
    try:
        todo = still_to_do(planned, spark.read.parquet(path), keys)
    except Exception as err:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(err):
            raise
    slot = F.pmod(F.xxhash64(*keys), F.lit(batches))
    for b in range(batches):
        part = todo.filter(slot == b)
        compute(part).withColumn("batch", F.lit(b)).write.mode("append").partitionBy("batch").parquet(path)
    return spark.read.parquet(path)


def with_metadata(df: DataFrame, **meta) -> DataFrame:
    """Attach constant description columns, as attributes of a result cube would."""
    return df.withColumns({f"meta_{k}": F.lit(v) for k, v in meta.items()})


def write_storm_series(series: DataFrame, storms: DataFrame, path: str, day: int, spread: int = 32) -> None:
    """Full series ``(t, entity, ...)`` of the storms ``(storm, start_t, end_t)`` and of no other time.

    One partition folder a storm; a rerun replaces the folders of its own storms and leaves
    the others. A time inside two storms goes to both. Storms meet the series on the slices of
    ``day`` they touch, then exactly; a storm's rows are spread over ``spread`` writers.
    """
    slices = F.sequence(F.floor(F.col("start_t") / day), F.floor(F.col("end_t") / day))
    spans = storms.filter("start_t <= end_t").select("storm", "start_t", "end_t", F.explode(slices).alias("_slice"))
    inside = (
        series.withColumn("_slice", F.floor(F.col("t") / day)).join(spans, "_slice")
        .filter("t BETWEEN start_t AND end_t").drop("_slice", "start_t", "end_t")
    )
    laid = inside.repartition("storm", F.pmod(F.xxhash64("entity", F.floor(F.col("t") / day)), F.lit(spread)))
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("storm").parquet(path)


def read_storm_series(spark: SparkSession, path: str, storms=None) -> DataFrame:
    """Stored series, of the named storms only; folders of others are not listed into the scan."""
    d = spark.read.option("basePath", path).parquet(path).withColumn("storm", F.col("storm").cast("string"))
    return d if storms is None else d.filter(F.col("storm").isin(list(storms)))


def as_cube(df: DataFrame, dims, units=None, notes=None) -> DataFrame:
    """Mark a long table as a result cube: dimensions, units and notes as column metadata.

    The metadata is part of the schema, so it is stored once in each Parquet file and read
    back with it, and no row grows.
    """
    units, notes = units or {}, notes or {}
    unknown = (set(dims) | set(units) | set(notes)) - set(df.columns)
    if unknown:
        raise ValueError(f"no such column: {', '.join(sorted(unknown))}")

    def marked(c):
        meta = dict(df.schema[c].metadata, role="dimension" if c in dims else "value")
        if c in dims:
            meta["axis"] = list(dims).index(c)
        if c in units:
            meta["units"] = units[c]
        if c in notes:
            meta["note"] = notes[c]
        return F.col(c).alias(c, metadata=meta)

    return df.select(*[marked(c) for c in df.columns])


def cube_attributes(df: DataFrame) -> dict[str, dict]:
    """Column metadata of a cube, by column name."""
    return {f.name: dict(f.metadata) for f in df.schema.fields}


def cube_dimensions(df: DataFrame) -> list[str]:
    """Dimension columns of a cube in their order."""
    meta = cube_attributes(df)
    return sorted((c for c in meta if meta[c].get("role") == "dimension"), key=lambda c: meta[c]["axis"])


def prefix_snapshots(df: DataFrame, realization: str, keys, value, sizes) -> DataFrame:
    """Mean and population deviation over the first n realizations, for every n of ``sizes``.

    One pass: each row adds to partial sums per size, no row is copied per size.
    """
    aggs = []
    for n in sizes:
        v = F.when(F.col(realization) < n, F.col(value))
        aggs += [F.avg(v).alias(f"mean_{n}"), F.stddev_pop(v).alias(f"std_{n}"), F.count(v).alias(f"n_{n}")]
    wide = df.groupBy(*keys).agg(*aggs)
    pack = F.array(*[
        F.struct(F.lit(n).alias("snapshot"), F.col(f"mean_{n}").alias("mean"),
                 F.col(f"std_{n}").alias("std"), F.col(f"n_{n}").alias("n"))
        for n in sizes
    ])
    return wide.select(*keys, F.explode(pack).alias("s")).select(*keys, "s.*").filter("n > 0")
