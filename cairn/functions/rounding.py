"""Rounding of doubles by their exact binary value, ties to even."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_round(x: Column, places: int) -> Column:
    """x rounded to places decimals; never a negative zero."""
    return F.call_function("format_number", x, F.lit("0." + "0" * places)).cast("double") + F.lit(0.0)


def total(*parts: Column) -> Column:
    """Sum of parts that have two decimals, exactly, to one decimal."""
    whole = parts[0].cast("decimal(12,2)")
    for p in parts[1:]:
        whole = whole + p.cast("decimal(12,2)")
    return py_round(whole.cast("double"), 1)
