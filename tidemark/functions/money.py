"""Money arithmetic that gives the same answer for every row order and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
#: Wide enough to hold fractions of a cent until the sum is rounded.
EXACT = "decimal(28,8)"


def money_total(column: str) -> Column:
    """Exact sum of a double money column, rounded once, to two digits.

    Values that are not numbers (NaN, infinite) count as missing, like NULL.
    """
    return F.round(F.sum(F.expr(f"try_cast(`{column}` AS {EXACT})")), 2)
