"""Aggregate builders. All are sums, counts, minima or maxima, or sort a group's values only where a quantile needs it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column, undefined: float | None = None) -> Column:
    """top / bottom; `undefined` (null) where bottom is 0."""
    return F.coalesce(top / F.when(bottom != 0, bottom), F.lit(undefined).cast("double"))


def upper_median(x: Column) -> Column:
    """The value at place n // 2 (from 0) of the sorted group: of an even number, the upper of the middle two. For groups of bounded size (a site's day)."""
    s = F.sort_array(F.collect_list(x))
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))
