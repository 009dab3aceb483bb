"""Tables of one row per scan, tile or image, joined to the many rows of each."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups that are broadcast at most: with a few numbers each, some 20 MB.
BROADCAST_GROUPS = 200_000


def same(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """Whether all pairs are equal; nulls equal each other."""
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in pairs])


def attach(rows: DataFrame, groups: DataFrame, by: Sequence[str], most: int = BROADCAST_GROUPS) -> DataFrame:
    """``rows`` with the columns that ``groups`` has for their group, which may be null.

    The groups are computed once, here, and kept: their number decides whether they are broadcast, so that the many rows stay
    where they are, or joined by a shuffle; and steps that follow each other do not compute each other's input anew.
    """
    kept = groups.persist(StorageLevel.MEMORY_AND_DISK)
    few = kept.count() <= most
    keys = {c: f"_of_{c}" for c in by}
    own = kept.withColumnsRenamed(keys)
    joined = rows.join(F.broadcast(own) if few else own, same([(F.col(c), F.col(k)) for c, k in keys.items()]))
    return joined.drop(*keys.values())
