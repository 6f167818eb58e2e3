"""Rounding as stored files have it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column, digits: int) -> Column:
    """The nearest number of so many decimals to a double's exact value; a true half goes to the even one.

    ``round`` and ``bround`` judge the shortest decimal form instead, so 2.675 would be a
    half, which its double is a little below. Here the product with the power of ten is
    rounded by itself where that is clear; where it looks like a half, its rounding error
    (the product of halved mantissas) decides. Null and non-finite values pass.
    """
    value, ten = value.cast("double"), 10.0**digits
    y = value * ten
    big = value * 134217729.0  # 2**27 + 1 halves a mantissa
    high = big - (big - value)
    low = value - high
    error = (high * ten - y) + low * ten
    tie = F.abs(y - F.floor(y).cast("double") - 0.5) == 0
    down = F.floor(y).cast("double")
    r = F.when(~tie | (error == 0), F.rint(y)).when(error > 0, down + 1).otherwise(down)
    return F.when(F.abs(y) < 2.0**52, r / ten).otherwise(value)
