"""Column expressions: missing values, thresholds, score arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_missing(x: Column) -> Column:
    """SQL null and NaN are one class of missing values."""
    return x.isNull() | F.isnan(x)


def number(name: str) -> Column:
    """A column as double; text that is no number counts as missing."""
    return F.col(name).try_cast("double")


def missing_as_nan(x: Column) -> Column:
    return F.coalesce(x, F.lit(math.nan))


def imputed(x: Column, value: float = 0.0) -> Column:
    return F.when(is_missing(x), F.lit(value)).otherwise(x)


def bin_of(x: Column, cuts: list[float]) -> Column:
    """Half-open bins [lo, hi): the number of cuts at or below x; the missing bin comes after the regular ones.

    The cuts become a balanced tree of comparisons, so a row takes log2 of their number.
    """

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(is_missing(x), F.lit(len(cuts) + 1)).otherwise(tree(0, len(cuts))).cast("int")


def rate(total: Column, count: Column) -> Column:
    """Response rate; null for an empty arm."""
    return F.when(count > 0, total / count)


def array_sum(a: Column) -> Column:
    """Sum of an array's elements in order; null elements count as 0, a null array as 0."""
    return F.coalesce(F.aggregate(F.transform(a, lambda x: F.coalesce(x, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))


def l1_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


#: Bits of a limb of an exact sum; four limbs hold multiples of 2^-48 below 2^47.
LIMB = 24
LIMBS = 4
_STEP = float(1 << LIMB)


def limbs(x: Column) -> list[Column]:
    """``x`` as four whole numbers of LIMB bits and its sign, the highest first: their sums do not depend on an order.

    Values are multiples of 2^-48 (smaller bits are rounded, each value by itself); 2^47 or more is an error.
    """
    size, sign = F.abs(x), F.signum(x).cast("bigint")
    size = F.when(size < 2.0**47, size).otherwise(F.raise_error(F.lit("an outcome of 2^47 or more has no exact sum")).cast("double"))
    out, rest = [], size * F.lit(1 / _STEP)
    for k in range(LIMBS):
        whole = F.floor(rest) if k < LIMBS - 1 else F.rint(rest).cast("bigint")
        out.append(whole * sign)
        rest = (rest - whole) * F.lit(_STEP)
    return out


def limbs_total(sums: list[Column]) -> Column:
    """The double next to an exact sum, from the sums of its limbs; an integer part past 2^63 is an error."""
    carried, carry = [], F.lit(0).cast("bigint")
    for s in reversed(sums):
        now = s + carry
        carry = F.shiftright(now, LIMB)
        carried.append(now - F.shiftleft(carry, LIMB))
    low, high = carried[1] * (1 << LIMB) + carried[0], (carry * (1 << LIMB) + carried[3]) * (1 << LIMB) + carried[2]
    return high.cast("double") + low.cast("double") * F.lit(2.0 ** (-2 * LIMB))
