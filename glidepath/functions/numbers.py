"""Number helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def settled(value, digits: int = 0) -> Column:
    """Rounds half up in two steps. Partial sums reach a mean in any order, which moves its last
    bits; the first, finer step removes that noise so a value at a half always rounds alike."""
    c = F.col(value) if isinstance(value, str) else value
    return F.round(F.round(c, digits + 4), digits)


def share_pct(part, whole, digits: int = 2) -> Column:
    return settled(F.try_divide(part, whole) * 100, digits)
