"""Binding a value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once, however often then uses it."""
    return F.transform(F.array(value), lambda x: then(x))[0]
