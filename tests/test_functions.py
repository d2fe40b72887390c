import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridhazard.functions import rng
from gridhazard.functions import scalar as S


def test_norm_cdf_and_probit(spark):
    xs = [-40.0, -8.0, -3.3, -1.0, -1e-9, 0.0, 0.5, 2.0, 7.5, 40.0]
    d = spark.createDataFrame([(x,) for x in xs], "x double").select("x", S.norm_cdf(F.col("x")).alias("p"))
    for r in d.collect():
        assert r.p == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), abs=1e-15)
    ps = [1e-10, 0.001, 0.07, 0.3, 0.5, 0.9, 0.999999]
    d = S.with_probit(spark.createDataFrame([(p,) for p in ps], "p double"), F.col("p"), "z")
    for r in d.collect():
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-12, abs=1e-12)


def test_probit_outside_is_null(spark):
    d = spark.createDataFrame([(0.0,), (1.0,), (-1.0,)], "p double").select(S.probit(F.col("p")).alias("z"))
    assert [r.z for r in d.collect()] == [None] * 3


def test_truncated_quantile_inverts_the_tail(spark):
    rows = [(t, 1.0, 0.5, 2.0) for t in (0.01, 0.3, 0.99)]
    d = spark.createDataFrame(rows, "t double, mu double, s double, xmin double")
    n = NormalDist(1.0, 0.5)
    for r in S.with_truncated_lognormal_quantile(d, F.col("t"), "mu", "s", "xmin", "q").collect():
        tail = (1 - n.cdf(math.log(r.q))) / (1 - n.cdf(math.log(2.0)))
        assert tail == pytest.approx(r.t, rel=1e-8)


def test_uniform_does_not_depend_on_partitioning(spark):
    d = spark.range(20000)
    a = d.select("id", rng.uniform(1, "id").alias("u"))
    b = d.repartition(7).select("id", rng.uniform(1, "id").alias("u"))
    assert a.exceptAll(b).isEmpty()
    u = np.sort([r.u for r in a.select("u").collect()])
    assert np.abs(u - (np.arange(len(u)) + 0.5) / len(u)).max() < 1.36 / math.sqrt(len(u))


def test_finite_guards(spark):
    vals = [1.0, float("nan"), float("inf"), None]
    d = spark.createDataFrame([(v,) for v in vals], "x double").select(S.finite_or(F.col("x"), 0.0).alias("y"))
    assert [r.y for r in d.collect()] == [1.0, 0.0, 0.0, 0.0]


def test_bytes_of_a_task_are_bounded_and_never_raised(spark):
    from gridhazard.session import TASK_BYTES, configure

    for key, most in TASK_BYTES.items():
        spark.conf.set(key, "64m")
        configure(spark)
        assert int(spark.conf.get(key)) == most
        spark.conf.set(key, "8m")
        configure(spark)
        assert int(spark.conf.get(key)) == 8 << 20
        spark.conf.unset(key)
    configure(spark)
