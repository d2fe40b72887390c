"""Registry of the runnable queries: name -> callable, equivalent SQL, survey rows."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridhazard.session import configure


@dataclass(frozen=True)
class Query:
    name: str
    rows: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: Optional[str]


REGISTRY: dict[str, Query] = {}


def query(rows: str, sql: str | None = None):
    """Register a function ``(spark, sf_dir) -> DataFrame`` under its own name."""

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        REGISTRY[fn.__name__] = Query(fn.__name__, rows, run, sql)
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; timestamps as session (UTC) timestamps."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    casts = {f: F.col(f).cast("timestamp") for f, t in df.dtypes if t == "timestamp_ntz"}
    return df.withColumns(casts) if casts else df


def epoch_hour(ts: str):
    return F.expr(f"unix_timestamp({ts}) div 3600")


def stamp(hour_col) -> "F.Column":
    """Epoch hours -> 'yyyy-MM-dd HH:mm:ss' text (UTC)."""
    c = F.col(hour_col) if isinstance(hour_col, str) else hour_col
    return F.date_format(F.timestamp_seconds(c * 3600), "yyyy-MM-dd HH:mm:ss")
