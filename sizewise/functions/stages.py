"""Keeping very wide expressions out of fused stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unfused(condition: Column) -> Column:
    """The same condition, written with an array function.

    Spark fuses the projections of a stage into one method, and the JVM does not optimize a method beyond 8000 bytes,
    which makes wide expressions ten times slower. A projection with an array function is compiled on its own, in
    small methods. Only this cheap condition goes through the array function; the rest of the projection does not.
    """
    return F.exists(F.array(condition), lambda v: v)
