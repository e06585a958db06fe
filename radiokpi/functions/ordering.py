"""Ordering helpers. NULL placement is always spelled out, since engines differ in the default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def sort_keys(*names: str) -> list[Column]:
    """``"a"`` sorts ascending with NULLs last, ``"-a"`` descending with NULLs first."""
    return [F.desc_nulls_first(n[1:]) if n.startswith("-") else F.asc_nulls_last(n) for n in names]


def page(frame: DataFrame, *order: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows ``offset … offset+limit`` in the given total order.

    Without a limit or offset the frame is returned unsorted: a full sort of a
    distributed result is paid for only where a page is asked for. With a limit
    Spark plans a per-partition top-k instead of a global sort. An offset alone would
    put all rows behind it into one task and is refused.
    """
    if limit is None:
        if offset:
            raise ValueError("an offset needs a limit")
        return frame
    ordered = frame.orderBy(*sort_keys(*order))
    if offset:
        ordered = ordered.offset(offset)
    return ordered.limit(limit)


def first_per(frame: DataFrame, keys: list[str], *, smallest: list[Column] | None = None,
              largest: list[Column] | None = None) -> DataFrame:
    """One row per key: the one with the smallest (or largest) order value.

    Written as an aggregate, not a window: it combines on the map side, so a key
    that holds a large share of all rows never lands in one task as raw rows.
    """
    rest = [c for c in frame.columns if c not in keys]
    order = F.struct(*(smallest or largest))
    pick = F.min_by if smallest else F.max_by
    chosen = frame.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_row"))
    return chosen.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*frame.columns)
