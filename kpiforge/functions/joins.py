"""Attaching scalar results to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_one_row(df: DataFrame, one_row: DataFrame, *, may_be_empty: bool = False) -> DataFrame:
    """Append the columns of ``one_row`` to every row of ``df``.

    ``one_row`` is a global aggregate, hence exactly one row: the DataFrame form of a
    scalar subquery.  The right side is broadcast (its size is one row by construction)
    and no pairs are formed between two data sets.  A right side that a filter may have
    emptied needs ``may_be_empty``: the rows of ``df`` stay, with NULLs.
    """
    if may_be_empty:
        return df.join(F.broadcast(one_row), F.lit(True), "left")
    return df.crossJoin(F.broadcast(one_row))
