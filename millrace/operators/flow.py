"""Flow: a DataFrame with the verbs of a parallel collection.

Collection-valued verbs return a Flow and are lazy; scalar verbs are lazy one-row DataFrames (``*_df``) with an
eager form beside them. Order is never implied: verbs that need it use the Flow's ordinal columns.

NULL elements follow SQL: aggregates skip them and predicates that give NULL don't hold. Over nothing, sum, product,
count and fold give their neutral element; reduce, map_reduce, min and max give NULL, or raise ``EmptyFlowError`` from
their eager forms with ``on_empty="error"``.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.monoids import COUNT, PRODUCT, SUM, Monoid, resolve
from millrace.operators.accumulate import Accumulator, ExactProduct, accumulate
from millrace.operators.materialize import materialize
from millrace.operators.sequence import Bound, ordered_slice


class EmptyFlowError(ValueError):
    """A reduction without a neutral element over nothing."""


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


class Flow:
    def __init__(self, df: DataFrame, ordinal: Sequence[str] = ()) -> None:
        missing = [c for c in ordinal if c not in df.columns]
        if missing:
            raise ValueError(f"no such ordinal columns: {missing}")
        self.df, self.ordinal = df, tuple(ordinal)

    # -- collection to collection

    def map(self, *columns: Column | str, mode: str = "bag", keys: Sequence[str] = ()) -> Flow:
        """Project each row; set and map modes give the collection the building rule of its container."""
        chosen = self.df.select(*[_column(c) for c in columns]).columns
        carried = [c for c in self.ordinal if c not in chosen and mode != "set"]
        out = self.df.select(*[_column(c) for c in columns], *carried)
        kept = [c for c in self.ordinal if c in out.columns]
        return Flow(materialize(out, mode, keys=keys, ordinal=self.ordinal), kept)

    def filter(self, predicate: Column, mode: str = "bag", keys: Sequence[str] = ()) -> Flow:
        return Flow(materialize(self.df.where(predicate), mode, keys=keys, ordinal=self.ordinal), self.ordinal)

    def flat_map(self, items: Column, name: str = "value", *, keep: Sequence[str] = (), mode: str = "bag") -> Flow:
        """0 to n rows from each row: ``items`` is an array of results (NULL counts as empty).

        With an ordinal and a mode that keeps order, ``pos`` numbers the results of one row and joins the ordinal.
        """
        if mode == "ordered":
            out = self.df.select(*self.ordinal, *keep, F.posexplode(items).alias("pos", name))
            order = (*self.ordinal, "pos")
            return Flow(materialize(out, mode, ordinal=order), order)
        return Flow(materialize(self.df.select(*keep, F.explode(items).alias(name)), mode, ordinal=self.ordinal))

    def map_batches(self, fn, schema: str) -> Flow:
        """An opaque function over Arrow record batches (an iterator in, an iterator out): the escape from Catalyst."""
        return Flow(self.df.mapInArrow(fn, schema))

    def group_map_aggregate(self, key: Column, value: Column, op: str | Monoid, name: str = "value") -> Flow:
        """Key to combined value: a hash aggregate with partial results before the shuffle."""
        grouped = self.df.groupBy(key.alias("key")).agg(resolve(op).over(value).alias(name))
        return Flow(grouped, ("key",))

    def group_by(self, key: Column, value: Column, mode: str = "bag", name: str = "members") -> Flow:
        """Key to its members, sorted. A group is one row by definition; prefer ``group_map_aggregate`` for large ones."""
        gather = {"bag": F.collect_list, "set": F.collect_set}[mode]
        return Flow(self.df.groupBy(key.alias("key")).agg(F.sort_array(gather(value)).alias(name)), ("key",))

    def slice(self, start: Bound, length: Bound) -> Flow:
        """Rows number ``start`` to ``start + length - 1`` in ordinal order, as (slot, columns); bounds may be functions of
        the number of rows."""
        return Flow(ordered_slice(self.df, self.ordinal, start, length), ("slot",))

    def ordered(self) -> Flow:
        return Flow(materialize(self.df, "ordered", ordinal=self.ordinal), self.ordinal)

    def as_set(self) -> Flow:
        return Flow(self.df.distinct())

    # -- collection to value

    def reduce_df(self, op: str | Monoid, value: Column, name: str = "value") -> DataFrame:
        monoid = resolve(op)
        return self.df.agg(monoid.aggregate(value).alias(name))

    def map_reduce_df(self, value: Column, op: str | Monoid, name: str = "value") -> DataFrame:
        return self.reduce_df(op, value, name)

    def fold_df(self, zero: Any, op: str | Monoid, value: Column, name: str = "value") -> DataFrame:
        monoid = resolve(op)
        monoid.check_zero(zero)
        return self.df.agg(monoid.over(value).alias(name))

    def sum_df(self, value: Column, name: str = "value") -> DataFrame:
        return self.df.agg(SUM.over(value).alias(name))

    def product_df(self, value: Column, name: str = "value") -> DataFrame:
        """As double; ``product_exact_df`` for integers beyond 2^53."""
        return self.df.agg(PRODUCT.over(value).alias(name))

    def product_exact_df(self, value: Column, name: str = "value", wrap: bool = False) -> DataFrame:
        """Of integers: decimal(38, 0), or with ``wrap`` a bigint in 64-bit two's complement."""
        kind = "bigint" if wrap else "decimal(38,0)"
        return accumulate(self.df.select(value.alias("_value")), ExactProduct(64 if wrap else None), ["_value"], f"`{name}` {kind}")

    def count_df(self, predicate: Column, name: str = "value") -> DataFrame:
        return self.df.agg(F.count_if(predicate).alias(name))

    def min_df(self, value: Column, by: Column | None = None, name: str = "value") -> DataFrame:
        """``by``: the sort key of another ordering; make it unique, or ties fall to any of the tied rows."""
        return self.df.agg((F.min(value) if by is None else F.min_by(value, by)).alias(name))

    def max_df(self, value: Column, by: Column | None = None, name: str = "value") -> DataFrame:
        return self.df.agg((F.max(value) if by is None else F.max_by(value, by)).alias(name))

    def exists_df(self, predicate: Column, name: str = "value") -> DataFrame:
        return self.df.agg(F.coalesce(F.bool_or(predicate), F.lit(False)).alias(name))

    def forall_df(self, predicate: Column, name: str = "value") -> DataFrame:
        held = F.coalesce(predicate, F.lit(False))
        return self.df.agg(F.coalesce(F.bool_and(held), F.lit(True)).alias(name))

    def find(self, predicate: Column) -> DataFrame:
        """0 or 1 row: the first match by ordinal, so that reruns agree. One aggregate, no sort."""
        if not self.ordinal:
            return self.find_any(predicate)
        matches = self.df.where(predicate)
        row = F.min(F.struct(F.struct(*self.ordinal).alias("at"), F.struct(*self.df.columns).alias("row")))
        picked = matches.agg(row.alias("m")).where("m is not null")
        return picked.select(*[F.col(f"m.row.`{c}`").alias(c) for c in self.df.columns])

    def find_any(self, predicate: Column) -> DataFrame:
        """0 or 1 row: whichever match is met first; stops scanning then."""
        return self.df.where(predicate).limit(1)

    def aggregate_df(self, aggregates: dict[str, Column]) -> DataFrame:
        """Several typed folds in one pass: partial results in each task, combined after one exchange."""
        return self.df.agg(*[c.alias(n) for n, c in aggregates.items()])

    def accumulate(self, accumulator: Accumulator, columns: Sequence[str], result_schema: str, keys: Sequence[str] = ()) -> DataFrame:
        return accumulate(self.df, accumulator, columns, result_schema, keys)

    # -- eager forms

    def value(self, one_row: DataFrame, on_empty: str = "null") -> Any:
        got = one_row.first()
        if (got is None or got[0] is None) and on_empty == "error":
            raise EmptyFlowError("reduction of an empty flow")
        return None if got is None else got[0]

    def reduce(self, op: str | Monoid, value: Column, on_empty: str = "null") -> Any:
        return self.value(self.reduce_df(op, value), on_empty)

    def exists(self, predicate: Column) -> bool:
        """Stops at the first match, unlike ``exists_df``, which fits inside a larger plan."""
        return bool(self.find_any(predicate).take(1))

    def forall(self, predicate: Column) -> bool:
        return not self.exists(~F.coalesce(predicate, F.lit(False)))

    def foreach(self, fn) -> None:
        """For side effects only; ``fn`` gets an iterator of the rows of a partition."""
        self.df.foreachPartition(fn)

    def size(self) -> int:
        return self.df.agg(COUNT.over(F.lit(1))).first()[0]

    def copy_to_list(self, start: int, length: int) -> list:
        """An ordered slice on the driver; ``length`` bounds it."""
        return [tuple(r)[1:] for r in self.slice(start, length).df.orderBy("slot").collect()]

    def stages(self) -> str:
        """The physical plan; a chain of map, filter and flat_map shows as one generated stage."""
        return self.df._jdf.queryExecution().explainString(self.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
