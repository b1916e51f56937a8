"""User-defined aggregation: zero, add, merge and finish, run as partial results and merges.

Built-in aggregates are the first choice. An ``Accumulator`` is for the rest: each task folds its rows into one state
for each key (so a hot key costs a task one row), states are merged pairwise in a bounded number of tasks, and the last
merge gives the result. States travel as pickled bytes; one task's states of all keys it meets must fit in its memory,
which ``spill_keys`` bounds by sending partial states on early.

An accumulator that has ``add_batch(state, columns)`` gets Arrow arrays, a batch or a key's part of one, instead of rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from decimal import Decimal
from math import prod
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Accumulator(Protocol):
    def zero(self) -> Any: ...

    def add(self, state: Any, row: tuple) -> Any: ...

    def merge(self, left: Any, right: Any) -> Any: ...

    def finish(self, state: Any) -> tuple: ...


class ExactProduct:
    """The product of integers: exact, as decimal(38, 0) (a longer one fails), or, with ``bits``, in two's complement of
    that width, as fixed-width machine arithmetic leaves it. NULLs are skipped; over nothing it is 1."""

    def __init__(self, bits: int | None = None) -> None:
        self.bits = bits

    def zero(self) -> int:
        return 1

    def _cut(self, n: int) -> int:
        return n if self.bits is None else (n + (1 << self.bits - 1)) % (1 << self.bits) - (1 << self.bits - 1)

    def add(self, state: int, row: tuple) -> int:
        return state if row[0] is None else self._cut(state * int(row[0]))

    def add_batch(self, state: int, columns: list[pa.Array]) -> int:
        values = columns[0].drop_null()
        if self.bits == 64 and pa.types.is_integer(values.type):
            return self._cut(state * int(np.multiply.reduce(values.to_numpy().astype(np.int64))))
        return self._cut(state * prod(map(int, values.to_pylist())))

    def merge(self, left: int, right: int) -> int:
        return self._cut(left * right)

    def finish(self, state: int) -> tuple:
        return (Decimal(state) if self.bits is None else state,)


def accumulate(df: DataFrame, acc: Accumulator, columns: Sequence[str], result_schema: str, keys: Sequence[str] = (), spill_keys: int = 100_000) -> DataFrame:
    """One row for each key (one in all without keys, over nothing too): the keys and the finished state's fields.

    ``merge`` must be associative and commutative and ``zero()`` neutral: partial states come in any order.
    """
    keys = list(keys)
    schema = df.select(*keys).schema
    key_ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema.fields)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict = {}
        n, batched = len(keys), hasattr(acc, "add_batch")
        for batch in batches:
            if batched:
                for k, arrays in _parts(batch, n):
                    states[k] = acc.add_batch(states[k] if k in states else acc.zero(), arrays)
            for row in () if batched else zip(*(batch.column(i).to_pylist() for i in range(n + len(columns))), strict=True):
                k = row[:n]
                states[k] = acc.add(states[k] if k in states else acc.zero(), row[n:])
            if len(states) > spill_keys:
                yield _pack(states)
                states = {}
        if states:
            yield _pack(states)

    arrow_keys = pa.schema([pa.field(f.name, t) for f, t in zip(schema.fields, _arrow_types(schema), strict=True)])

    def _pack(states: dict) -> pa.RecordBatch:
        cols = [pa.array([k[i] for k in states], arrow_keys.field(i).type) for i in range(len(keys))]
        cols.append(pa.array([pickle.dumps(s) for s in states.values()], pa.binary()))
        return pa.RecordBatch.from_arrays(cols, names=[*keys, "_state"])

    def merged(group: pa.Table) -> Any:
        state = acc.zero()
        for blob in group.column("_state").to_pylist():
            state = acc.merge(state, pickle.loads(blob))
        return state

    partials = df.select(*keys, *columns).mapInArrow(partial, f"{key_ddl}_state binary")
    if not keys:
        start = df.sparkSession.createDataFrame([(pickle.dumps(acc.zero()),)], "_state binary")
        partials = partials.unionByName(start)

    result = T.StructType.fromDDL(result_schema)
    kinds = _arrow_types(result)

    def last(key: tuple, group: pa.Table) -> pa.Table:
        out = acc.finish(merged(group))
        cols = [pa.array([k.as_py()], arrow_keys.field(i).type) for i, k in enumerate(key[: len(keys)])]
        return pa.table([*cols, *[pa.array([v], t) for v, t in zip(out, kinds, strict=True)]], names=[*keys, *result.names])

    def halfway(key: tuple, group: pa.Table) -> pa.Table:
        cols = [pa.array([k.as_py()], arrow_keys.field(i).type) for i, k in enumerate(key[: len(keys)])]
        return pa.table([*cols, pa.array([pickle.dumps(merged(group))], pa.binary())], names=[*keys, "_state"])

    # a key's states meet first in up to 32 salted groups, then in one of at most 32 rows
    salted = partials.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    half = salted.groupBy(*keys, "_salt").applyInArrow(halfway, f"{key_ddl}_state binary")
    if not keys:
        half = half.withColumn("_one", F.lit(1))
    return half.groupBy(*(keys or ["_one"])).applyInArrow(last, f"{key_ddl}{result_schema}")


def _parts(batch: pa.RecordBatch, n: int) -> Iterator[tuple[tuple, list[pa.Array]]]:
    """The columns after the first ``n``, which are keys, for each distinct key."""
    if not batch.num_rows:
        return
    if not n:
        yield (), batch.columns
        return
    names = [f"k{i}" for i in range(n)]
    rows = pa.table([*batch.columns[:n], pa.array(np.arange(batch.num_rows))], names=[*names, "row"])
    groups = rows.group_by(names).aggregate([("row", "list")])
    keys = list(zip(*(groups.column(c).to_pylist() for c in names), strict=True))
    for key, at in zip(keys, groups.column("row_list").combine_chunks(), strict=True):
        yield key, [c.take(at.values) for c in batch.columns[n:]]


def _arrow_types(schema) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]
