"""Scalar functions as native Column expressions (no UDF)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SQRT2 = math.sqrt(2.0)

# Normal CDF, double precision (West 2005, after Hart 1968).
PHI_NUM = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
PHI_DEN = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
PHI_SPLIT = 7.07106781186547
PHI_TAIL = 2.506628274631

# Inverse normal CDF (Wichura 1988, algorithm AS 241), highest power first.
PROBIT_A = (
    2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4,
    4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3,
    1.3314166789178437745e2, 3.3871328727963666080e0,
)
PROBIT_B = (
    5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4,
    2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2,
    4.2313330701600911252e1, 1.0,
)
PROBIT_C = (
    7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1,
    1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0,
    4.63033784615654529590e0, 1.42343711074968357734e0,
)
PROBIT_D = (
    1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2,
    1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0,
    2.05319162663775882187e0, 1.0,
)
PROBIT_E = (
    2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3,
    2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0,
    5.46378491116411436990e0, 6.65790464350110377720e0,
)
PROBIT_F = (
    2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5,
    7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1,
    5.99832206555887937690e-1, 1.0,
)


def _horner(x: Column, coeffs) -> Column:
    out = F.lit(coeffs[0])
    for c in coeffs[1:]:
        out = out * x + F.lit(c)
    return out


def norm_cdf_parts(x: Column, a: Column, e: Column) -> Column:
    core = e * _horner(a, PHI_NUM) / _horner(a, PHI_DEN)
    frac = a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))
    tail = e / frac / F.lit(PHI_TAIL)
    lower = F.when(a > 37.0, F.lit(0.0)).when(a < PHI_SPLIT, core).otherwise(tail)
    return F.when(x > 0.0, 1.0 - lower).otherwise(lower)


def norm_cdf(x: Column) -> Column:
    """Standard normal CDF of a plain column (see :func:`with_norm_cdf` for expressions)."""
    return norm_cdf_parts(x, F.abs(x), F.exp(-x * x / 2.0))


def erf(x: Column) -> Column:
    return 2.0 * norm_cdf(x * SQRT2) - 1.0


def _probit_parts(p: Column, q: Column, r0: Column, r: Column) -> Column:
    centre = q * _horner(r0, PROBIT_A) / _horner(r0, PROBIT_B)
    near = _horner(r - 1.6, PROBIT_C) / _horner(r - 1.6, PROBIT_D)
    far = _horner(r - 5.0, PROBIT_E) / _horner(r - 5.0, PROBIT_F)
    tail = F.signum(q) * F.when(r <= 5.0, near).otherwise(far)
    value = F.when(F.abs(q) <= 0.425, centre).otherwise(tail)
    return F.when((p > 0.0) & (p < 1.0), value)


def probit(p: Column) -> Column:
    """Inverse normal CDF of a plain column for 0 < p < 1; null outside."""
    q = p - 0.5
    return _probit_parts(p, q, 0.180625 - q * q, F.sqrt(-F.ln(F.least(p, 1.0 - p))))


def erfinv(y: Column) -> Column:
    return probit((y + 1.0) / 2.0) / SQRT2


def with_norm_cdf(df: DataFrame, x: Column, out: str) -> DataFrame:
    """Add the normal CDF of an expression, its parts as columns of their own.

    A polynomial repeats its argument a dozen times; naming the argument first
    keeps the generated code small enough to compile.
    """
    return (
        df.withColumn("_x", x)
        .withColumns({"_a": F.abs("_x"), "_e": F.exp(-F.col("_x") * F.col("_x") / 2.0)})
        .withColumn(out, norm_cdf_parts(F.col("_x"), F.col("_a"), F.col("_e")))
        .drop("_x", "_a", "_e")
    )


def with_probit(df: DataFrame, p: Column, out: str) -> DataFrame:
    """Add the inverse normal CDF of an expression (staged like :func:`with_norm_cdf`)."""
    return (
        df.withColumn("_p", p)
        .withColumns({"_q": F.col("_p") - 0.5, "_r": F.sqrt(-F.ln(F.least(F.col("_p"), 1.0 - F.col("_p"))))})
        .withColumn("_r0", 0.180625 - F.col("_q") * F.col("_q"))
        .withColumn(out, _probit_parts(F.col("_p"), F.col("_q"), F.col("_r0"), F.col("_r")))
        .drop("_p", "_q", "_r", "_r0")
    )


def weibull_cdf(x: Column, shape: Column, scale: Column) -> Column:
    return 1.0 - F.exp(-F.pow(F.greatest(x / scale, F.lit(1e-12)), shape))


def weibull_hazard(x: Column, shape: Column, scale: Column) -> Column:
    return (shape / scale) * F.pow(F.greatest(x / scale, F.lit(1e-12)), shape - 1.0)


def weibull_pdf(x: Column, shape: Column, scale: Column) -> Column:
    return weibull_hazard(x, shape, scale) * (1.0 - weibull_cdf(x, shape, scale))


def lognormal_pdf(x: Column, mu: Column, sigma: Column) -> Column:
    z = (F.ln(x) - mu) / sigma
    return F.exp(-z * z / 2.0) / (x * sigma * math.sqrt(2.0 * math.pi))


def lognormal_cdf(x: Column, mu: Column, sigma: Column) -> Column:
    return norm_cdf((F.ln(x) - mu) / sigma)


def with_truncated_lognormal_quantile(df, tail, mu, sigma, xmin, out) -> DataFrame:
    """Add the value exceeded with probability ``tail`` under a lognormal cut off below ``xmin``."""
    eps = 1e-12
    m, s = F.col(mu), F.col(sigma)
    d = df.withColumn("_y", clip(tail, eps, 1.0 - eps))
    d = with_norm_cdf(d, (F.ln(F.greatest(F.col(xmin), F.lit(eps))) - m) / s, "_phi")
    d = d.withColumn("_big", clip(2.0 * F.col("_phi") - 1.0, -1.0 + eps, 1.0 - eps))
    a = clip(F.col("_big") * F.col("_y") - F.col("_y") + 1.0, -1.0 + eps, 1.0 - eps)
    d = with_probit(d, (a + 1.0) / 2.0, "_z")
    value = F.exp(clip(m + s * F.col("_z"), math.log(eps), 700.0))
    usable = finite(m) & finite(s) & (s > 0.0)
    return d.withColumn(out, F.when(usable, value)).drop("_y", "_phi", "_big", "_z")


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def finite(x: Column) -> Column:
    """True for an ordinary number; false for NaN, infinities and null."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def finite_or(x: Column, default: float) -> Column:
    return F.when(finite(x), x).otherwise(F.lit(default))


def round_half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def magnitude(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat = F.radians(lat2) - F.radians(lat1)
    dlon = F.radians(lon2) - F.radians(lon1)
    a = F.pow(F.sin(dlat / 2.0), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(dlon / 2.0), 2
    )
    return 6371.0 * 2.0 * F.atan2(F.sqrt(a), F.sqrt(1.0 - a))


def east_north_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column):
    """Eastward and northward parts of the way from point 1 to point 2."""
    east = 6371.0 * F.cos(F.radians(lat1)) * (F.radians(lon2) - F.radians(lon1))
    north = 6371.0 * (F.radians(lat2) - F.radians(lat1))
    return east, north


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often the expression names it."""
    return F.get(F.transform(F.array(value), then), 0)
