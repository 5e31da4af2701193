"""Set functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_set(arr: Column) -> Column:
    """Null-safe distinct array (null → empty)."""
    return F.array_distinct(F.coalesce(arr, F.array().cast("array<string>")))


def jaccard(a: Column, b: Column) -> Column:
    """|A ∩ B| / |A ∪ B| of two string arrays; duplicates collapse,
    null counts as empty, both empty → 0.0."""
    sa, sb = as_set(a), as_set(b)
    inter = F.size(F.array_intersect(sa, sb))
    union = F.size(F.array_union(sa, sb))
    return F.when(union == 0, F.lit(0.0)).otherwise(inter / union)
