"""Joins against small sides whose size is checked, not assumed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 100_000


def checked_broadcast_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner",
                           max_rows: int = SMALL_ROWS) -> DataFrame:
    """Join ``big`` with ``small`` broadcast when a count proves ``small`` has
    at most ``max_rows`` rows; otherwise a shuffle join (adaptive execution
    splits skewed keys). Used where the join key can be hot (a class holding
    a third of all rows), so the big side must not be shuffled by it."""
    n = small.limit(max_rows + 1).count()
    if n <= max_rows:
        return big.join(F.broadcast(small), list(on), how)
    return big.join(small, list(on), how)
