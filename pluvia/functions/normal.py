"""The complementary error function in built-in expressions, since Spark has none."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS, LEVELS, CUT = 60, 60, 2.5


def erfc(x: Column) -> Column:
    """erfc of a number >= 0: a series below CUT, a continued fraction from there. Null for null."""
    x = x.cast("double")
    x2 = x * x
    # series: 2/sqrt(pi) exp(-x^2) sum of x (2 x^2)^n / (1 3 5 ... (2n+1))
    one = F.struct(x.alias("t"), x.alias("s"))
    step = lambda a, n: F.struct((a["t"] * 2 * x2 / (2 * n + 1)).alias("t"), (a["s"] + a["t"] * 2 * x2 / (2 * n + 1)).alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), one, step, lambda a: a["s"])
    near = F.lit(1.0) - F.lit(2 / math.sqrt(math.pi)) * F.exp(-x2) * series
    # continued fraction: exp(-x^2)/sqrt(pi) / (x + (1/2)/(x + (2/2)/(x + ...)))
    tail = F.aggregate(F.sequence(F.lit(LEVELS), F.lit(1), F.lit(-1)), x, lambda a, n: x + n / 2 / a)
    far = F.exp(-x2) / F.lit(math.sqrt(math.pi)) / tail
    return F.when(x < CUT, near).otherwise(far)


def two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) of a standard normal."""
    return erfc(F.abs(z) / F.lit(math.sqrt(2)))
