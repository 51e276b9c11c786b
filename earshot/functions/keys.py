"""Reproducible randomness (SM-1): keys that depend on the seed and the row id only.

``rand(seed)`` depends on the partitioning, so a retried or re-planned job would
draw other rows. A hash of ``seed:id`` gives the same order on every cluster.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def order_key(seed, id_col) -> Column:
    """Shuffle key, 32 hex digits; break ties by the id."""
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(s.cast("string"), F.lit(":"), _c(id_col).cast("string")))


def key_int(key: Column, digits: int = 15) -> Column:
    """The first hex digits of a key as a non-negative BIGINT (15 digits = 60 bits)."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("bigint")


def uniform(seed, id_col) -> Column:
    """A number in (0, 1): 32 bits of the key, centred so that 0 and 1 cannot occur."""
    return (key_int(order_key(seed, id_col), 8).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def gumbel(u: Column, eps: float = 1e-10) -> Column:
    """Gumbel noise from a uniform number."""
    e = F.lit(eps)
    return -F.log(-F.log(u + e) + e)
