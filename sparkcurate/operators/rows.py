"""Small helpers for rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace costly columns so that they are computed once per row.

    A filter on a plain computed column is moved below it together with the whole expression,
    which is then evaluated again above; with columns built on columns the copies multiply.
    Predicates are not moved below a generator, so the columns come from a one-row ``inline``.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*others, F.inline(F.array(F.struct(*[v.alias(n) for n, v in columns.items()]))))
