"""Evaluate once, use many times: an expression bound to a lambda's variable.

Inside a lambda of a higher-order function an outer expression is evaluated for every element, as common subexpressions aren't shared there.
A variable is evaluated when it is bound.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(expression: Column, use: Callable[[Column], Column]) -> Column:
    """``use(expression)``, with the expression evaluated once for each row."""
    return F.get(F.transform(F.array(expression), use), F.lit(0))
