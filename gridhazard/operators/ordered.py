"""Ordered operators (fill, lag, islands) that never sort one key in one task.

A key may hold a large share of all rows, so a plain ``partitionBy(key)`` window
is avoided. Each function takes ``buckets``: columns that are a prefix of the
ordering (for example the day of a timestamp). Windows run inside
``(keys, buckets)``; what has to cross a bucket border travels through a
summary with one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_UP, _UF = Window.unboundedPreceding, Window.unboundedFollowing


def _cols(order) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def _join_back(df: DataFrame, ends: DataFrame, on: list[str]) -> DataFrame:
    return df.join(ends, on=on, how="left")


def neighbours_known(df, keys, buckets, order, value, prefix="") -> DataFrame:
    """Nearest non-null value at or before, and at or after, every row.

    Adds ``{prefix}prev`` and ``{prefix}next``: structs (o, v) with the order
    value and the value found, or null.
    """
    keys, buckets, order = list(keys), _cols(buckets), _cols(order)
    p, n = f"{prefix}prev", f"{prefix}next"
    known = F.when(
        F.col(value).isNotNull(),
        F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(value).alias("v")),
    )
    d = df.withColumn("_known", known)
    w = Window.partitionBy(*keys, *buckets).orderBy(*order)
    # Looking ahead is looking back in reverse order: a growing frame is summed once,
    # a shrinking one is summed anew for every row.
    back = Window.partitionBy(*keys, *buckets).orderBy(*[F.desc(o) for o in order])
    inner = d.withColumns(
        {
            "_pi": F.last("_known", ignorenulls=True).over(w.rowsBetween(_UP, 0)),
            "_ni": F.last("_known", ignorenulls=True).over(back.rowsBetween(_UP, 0)),
        }
    )
    kw = Window.partitionBy(*keys).orderBy(*buckets)
    kback = Window.partitionBy(*keys).orderBy(*[F.desc(b) for b in buckets])
    ends = (
        d.groupBy(*keys, *buckets)
        .agg(F.max("_known").alias("_l"), F.min("_known").alias("_f"))
        .withColumns(
            {
                "_pc": F.last("_l", ignorenulls=True).over(kw.rowsBetween(_UP, -1)),
                "_nc": F.last("_f", ignorenulls=True).over(kback.rowsBetween(_UP, -1)),
            }
        )
        .drop("_l", "_f")
    )
    return (
        _join_back(inner, ends, keys + buckets)
        .withColumns({p: F.coalesce("_pi", "_pc"), n: F.coalesce("_ni", "_nc")})
        .drop("_known", "_pi", "_ni", "_pc", "_nc")
    )


def shifted(df, keys, buckets, order, value, out, step=1) -> DataFrame:
    """``lag`` (step 1) or ``lead`` (step -1) of ``value`` across bucket borders."""
    keys, buckets, order = list(keys), _cols(buckets), _cols(order)
    w = Window.partitionBy(*keys, *buckets).orderBy(*order)
    kw = Window.partitionBy(*keys).orderBy(*buckets)
    item = F.struct(*order, F.col(value).alias("_v"))
    edge = (F.max if step > 0 else F.min)(item)
    move = F.lag if step > 0 else F.lead
    ends = (
        df.groupBy(*keys, *buckets)
        .agg(edge.alias("_xe"))
        .withColumn("_xc", move("_xe").over(kw))
        .drop("_xe")
    )
    inner = df.withColumn("_xi", move(item).over(w))
    return (
        _join_back(inner, ends, keys + buckets)
        .withColumn(out, F.coalesce("_xi", "_xc")["_v"])
        .drop("_xi", "_xc")
    )


def islands(df, keys, bucket, t, gap, out="island") -> DataFrame:
    """Label runs of points: neighbours at most ``gap`` apart share a run.

    The label is the position of the first point of the run.
    """
    d = shifted(df, keys, bucket, t, t, "_prev", 1)
    d = d.withColumn(
        "_start", F.when(F.col("_prev").isNull() | (F.col(t) - F.col("_prev") > gap), F.col(t))
    )
    d = neighbours_known(d, keys, bucket, t, "_start", prefix="_s")
    return d.withColumn(out, F.col("_sprev")["v"]).drop("_prev", "_start", "_sprev", "_snext")


def running_sum(df, keys, buckets, order, value, out) -> DataFrame:
    """Inclusive running sum of ``value`` across bucket borders."""
    keys, buckets, order = list(keys), _cols(buckets), _cols(order)
    w = Window.partitionBy(*keys, *buckets).orderBy(*order).rowsBetween(_UP, 0)
    kw = Window.partitionBy(*keys).orderBy(*buckets).rowsBetween(_UP, -1)
    ends = (
        df.groupBy(*keys, *buckets)
        .agg(F.sum(value).alias("_xt"))
        .withColumn("_xc", F.sum("_xt").over(kw))
        .drop("_xt")
    )
    inner = df.withColumn("_xi", F.sum(value).over(w))
    return (
        _join_back(inner, ends, keys + buckets)
        .withColumn(out, F.col("_xi") + F.coalesce("_xc", F.lit(0)))
        .drop("_xi", "_xc")
    )


def dense_position(df, keys, buckets, order, out) -> DataFrame:
    """1-based row number per key over a total order."""
    d = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_sum(d, keys, buckets, order, "_one", out).drop("_one")


def top_per_key(df, keys, order, n) -> DataFrame:
    """First ``n`` rows per key.

    Catalyst plans the rank filter as a WindowGroupLimit before the shuffle, so
    every task ships at most ``n`` rows of a key, however hot the key is.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
