"""Ordered gathering: what a loop appends in order is a collected array sorted by an explicit key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_order(value: Column | str, *keys: str) -> Column:
    """Aggregate: the group's values as an array in the order of `keys`; nulls stay out."""
    value = F.col(value) if isinstance(value, str) else value
    kept = F.filter(F.sort_array(F.collect_list(F.struct(*keys, value.alias("v")))), lambda x: x["v"].isNotNull())
    return F.transform(kept, lambda x: x["v"])


def so_far(value: Column | str, window) -> Column:
    """The same over a window that is already ordered and framed."""
    return F.collect_list(value).over(window)
