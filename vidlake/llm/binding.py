"""Naming a value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value made once for each row, also where a filter on the result is moved below the projection."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
