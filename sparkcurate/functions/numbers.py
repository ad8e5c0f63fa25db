"""Rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkcurate.functions.binding import once


def rounded(value: Column, digits: int = 1, ties_up: bool = False) -> Column:
    """Round the exact value of a double to ``digits`` decimals, ties to even.

    ``bround`` looks at the shortest decimal text of the double, so 5.35 (which is a little
    less than its text) would count as a tie. Here the error of ``value * 10**digits`` is
    computed without loss (by splitting the value into two halves of its bits) and settles
    such cases.
    """
    scale = F.lit(float(10**digits))
    return _whole(value.cast("double"), scale, ties_up) / scale


def _whole(x: Column, scale: Column, ties_up: bool = False) -> Column:
    """The exact product of ``x`` and ``scale``, a power of ten without loss, rounded to a whole number."""
    product = x * scale
    spread = x * F.lit(134217729.0)  # 2**27 + 1
    high = spread - (spread - x)
    error = (high * scale - product) + (x - high) * scale
    whole = F.floor(product)
    part = product - whole
    tie_goes_up = F.lit(True) if ties_up else whole % 2 != 0
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & tie_goes_up)))
    return whole + F.when(up, 1).otherwise(0)


def scientific(value: Column, digits: int = 2) -> Column:
    """The double as ``1.23e-05``, its exact value rounded, ties to even.

    The engine's own format rounds the shortest text of the double, up on ties. It is used where the power of ten is
    too large to be exact, beyond ``10 ** digits`` and below ``10 ** (digits - 22)``.
    """
    x = F.abs(value.cast("double"))

    def shown(exponent: Column, whole: Column) -> Column:
        over = whole >= 10 ** (digits + 1)
        power = exponent + F.when(over, 1).otherwise(0)
        text = F.when(over, (whole / 10).cast("bigint")).otherwise(whole.cast("bigint")).cast("string")
        return F.concat(
            F.when(value < 0, "-").otherwise(""), F.substring(text, 1, 1), F.lit("."), F.substring(text, 2, digits),
            F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"),
        )

    def exact(exponent: Column) -> Column:
        scale = F.pow(F.lit(10.0), (digits - exponent).cast("double"))
        inside = (x > 0) & (exponent <= digits) & (exponent >= digits - 22)
        return F.when(inside, once(scale, lambda s: once(_whole(x, s), lambda whole: shown(exponent, whole))))

    exponent = F.regexp_extract(F.format_string("%.17e", x), "e(.+)$", 1).cast("int")
    return F.coalesce(once(exponent, exact), F.format_string(f"%.{digits}e", value))
