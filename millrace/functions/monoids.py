"""Monoids: an associative operator, its neutral element and the Spark aggregate that evaluates it.

A fold needs a neutral start value: Spark, like any partition-parallel engine, applies the start value once for
each partial result. ``Monoid.check_zero`` refuses a start value that is not neutral.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Monoid:
    """``zero`` None means that the operator has no neutral element (the result over nothing is NULL)."""

    name: str
    aggregate: Callable[[Column], Column]
    zero: Any = None

    def over(self, value: Column) -> Column:
        """The aggregate, with the neutral element over nothing."""
        result = self.aggregate(value)
        return result if self.zero is None else F.coalesce(result, F.lit(self.zero))

    def check_zero(self, zero: Any) -> None:
        if self.zero is None or zero != self.zero:
            raise ValueError(f"{zero!r} is not neutral for {self.name}; partial results would each apply it")


INT_MAX, INT_MIN = 2147483647, -2147483648

SUM = Monoid("sum", F.sum, 0)
PRODUCT = Monoid("product", F.product, 1.0)
MIN = Monoid("min", F.min)
MAX = Monoid("max", F.max)
MIN_INT = Monoid("min_int", F.min, INT_MAX)
MAX_INT = Monoid("max_int", F.max, INT_MIN)
COUNT = Monoid("count", F.count, 0)
ALL = Monoid("all", F.bool_and, True)
ANY = Monoid("any", F.bool_or, False)
BIT_AND = Monoid("bit_and", F.bit_and, -1)
BIT_OR = Monoid("bit_or", F.bit_or, 0)
BIT_XOR = Monoid("bit_xor", F.bit_xor, 0)

REGISTRY = {m.name: m for m in (SUM, PRODUCT, MIN, MAX, MIN_INT, MAX_INT, COUNT, ALL, ANY, BIT_AND, BIT_OR, BIT_XOR)}


def resolve(op: str | Monoid) -> Monoid:
    if isinstance(op, Monoid):
        return op
    if op not in REGISTRY:
        raise KeyError(f"no monoid {op!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[op]


def int32_wrap(total: Column) -> Column:
    """A bigint brought into 32-bit two's complement, as fixed-width machine arithmetic would leave it."""
    return (F.pmod(total + F.lit(2147483648), F.lit(4294967296)) - F.lit(2147483648)).cast("int")
