"""A value that an expression uses several times, made once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``.  Inside of functions of arrays Spark makes a value anew at each use; the
    argument of a lambda is made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
