"""Array expressions for sequences (pad, truncate, prefix windows)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def last_n(c, n: int) -> Column:
    """Keep the last ``n`` elements (front truncation)."""
    size = F.size(_c(c))
    return F.slice(_c(c), F.greatest(size - F.lit(n) + 1, F.lit(1)), F.lit(n))


def pad_left(c, n: int, pad: int = 0) -> Column:
    """Left-truncate to ``n`` then left-pad with ``pad`` to exactly ``n``."""
    size = F.size(_c(c))
    fill = F.array_repeat(F.lit(pad).cast("int"), F.greatest(F.lit(n) - size, F.lit(0)))
    return F.concat(fill, last_n(_c(c).cast("array<int>"), n))


def seq_string(c) -> Column:
    """Space-joined string form of an array (stable for hashing/comparison)."""
    return F.array_join(_c(c).cast("array<string>"), " ")
