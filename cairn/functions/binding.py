"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once.

    A Column put into the lambda of a higher-order function is evaluated again for every element; a lambda's variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
