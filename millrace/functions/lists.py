"""Verbs over a list held in one row (an array column), as higher-order functions inside code generation.

An empty or NULL list gives the neutral element for sum, product and fold, and NULL for reduce, min and max.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Step = Callable[[Column, Column], Column]


def list_fold_left(items: Column, zero: Column, step: Step) -> Column:
    """Strictly left to right; ``step`` need not be associative."""
    return F.aggregate(F.coalesce(items, F.array()), zero, step)


def list_fold(items: Column, zero: Column, op: Step) -> Column:
    return list_fold_left(items, zero, op)


def list_aggregate(items: Column, zero: Column, *, combine: Step, step: Step) -> Column:
    """Two-level fold. A row's list is never split, so ``combine`` meets only ``zero`` and the fold's result."""
    return F.aggregate(F.coalesce(items, F.array()), zero, step, lambda acc: combine(zero, acc))


def list_reduce(items: Column, op: Step) -> Column:
    rest = F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0)))
    return F.when(F.size(items) > 0, F.aggregate(rest, F.get(items, F.lit(0)), op))


def list_sum(items: Column, zero: Column | None = None) -> Column:
    start = F.lit(0).cast("bigint") if zero is None else zero
    return list_fold_left(items, start, lambda a, x: a + x)


def list_product(items: Column, one: Column | None = None) -> Column:
    start = F.lit(1).cast("bigint") if one is None else one
    return list_fold_left(items, start, lambda a, x: a * x)


def list_min(items: Column) -> Column:
    return F.array_min(items)


def list_max(items: Column) -> Column:
    return F.array_max(items)


def list_count(items: Column, predicate: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(F.coalesce(items, F.array()), predicate)).cast("bigint")
