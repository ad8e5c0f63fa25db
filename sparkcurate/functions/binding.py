"""Using a costly Column more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time per row.

    A Column that stands in several places of an expression is evaluated in each of them when
    the places are conditional. A lambda variable is not.
    """
    return F.transform(F.array(value), use)[0]
