"""Metadata predicates with two-valued logic: a missing field fails every test but the negative ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(True))


LEAVES = {
    "eq": lambda c, v: _no(c == v), "ne": lambda c, v: _yes(c != v), "gt": lambda c, v: _no(c > v), "ge": lambda c, v: _no(c >= v), "lt": lambda c, v: _no(c < v), "le": lambda c, v: _no(c <= v),
    "in": lambda c, v: _no(c.isin(*v)), "not_in": lambda c, v: _yes(~c.isin(*v)), "contains": lambda c, v: _no(c.contains(v)), "starts_with": lambda c, v: _no(c.startswith(v)), "ends_with": lambda c, v: _no(c.endswith(v)),
    "regex": lambda c, v: _no(c.rlike(v)), "between": lambda c, v: _no(c.between(*v)), "exists": lambda c, v: c.isNotNull(), "not_exists": lambda c, v: c.isNull(), "time_range": lambda c, v: _no((c >= v[0]) & (c < v[1])), "array_contains": lambda c, v: _no(F.array_contains(c, v)),
}


def leaf(kind: str, column: str, value=None) -> Column:
    return LEAVES[kind](F.col(column), value)


def all_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
