"""Counter-based uniforms: a pure function of (seed, keys).

The same key always gives the same number, whatever the partitioning, so a
task that is run again after an executor loss repeats its draws exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_52 = float(1 << 52)


def _digest(seed: int, keys) -> Column:
    parts = [F.lit(str(seed))] + [
        (F.col(k) if isinstance(k, str) else k).cast("string") for k in keys
    ]
    return F.md5(F.concat_ws("|", *parts))


def uniform(seed: int, *keys, part: int = 0) -> Column:
    """Uniform in [0, 1). ``part`` 0 or 1 reads a separate half of one digest."""
    hexes = F.substring(_digest(seed, keys), 1 + 13 * part, 13)
    return F.conv(hexes, 16, 10).cast("bigint") / F.lit(_TWO_52)


def uniform_between(low: float, high: float, u: Column) -> Column:
    return F.lit(float(low)) + F.lit(float(high - low)) * u


def pick(options, u: Column) -> Column:
    """One of ``options`` with equal chances."""
    arr = F.array(*[F.lit(o) for o in options])
    return F.element_at(arr, (F.floor(u * len(options)) + 1).cast("int"))


def weighted_pick(options, weights, u: Column) -> Column:
    """One of ``options`` by comparing ``u`` with the cumulative weights."""
    total = float(sum(weights))
    bounds, acc = [], 0.0
    for w in weights:
        acc += w / total
        bounds.append(acc)
    ladder = list(zip(options, bounds))
    return reduce(
        lambda tail, ob: F.when(u < F.lit(ob[1]), F.lit(ob[0])).otherwise(tail),
        reversed(ladder[:-1]),
        F.lit(ladder[-1][0]),
    )
