"""Evaluate a column once and use it many times inside array lambdas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    The optimizer merges a projection into the one above it when it is referenced once, even if that
    reference sits inside a lambda that runs for each array element.  Binding the value to a lambda
    variable keeps it outside the loop.
    """
    return F.get(F.transform(F.array(value), body), 0)
