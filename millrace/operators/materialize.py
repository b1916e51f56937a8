"""How the result of map, flat_map or filter is built: as a bag, a set, a key-unique map or in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = ("bag", "set", "map_first", "map_last", "ordered")


def materialize(df: DataFrame, mode: str, *, keys: Sequence[str] = (), ordinal: Sequence[str] = ()) -> DataFrame:
    """bag: as is. set: distinct rows. map_first and map_last: of each key the row first or last by ordinal.
    ordered: sorted by ordinal.

    The map modes are an aggregate (least or greatest ordinal with its row), so equal keys combine before the
    shuffle and a hot key costs one row for each task. NULL keys are one key; an ordinal must be unique within a key.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    if mode == "bag":
        return df
    if mode == "set":
        return df.distinct()
    if not ordinal:
        raise ValueError(f"{mode} needs an ordinal")
    if mode == "ordered":
        return df.orderBy(*ordinal)
    if not keys:
        raise ValueError(f"{mode} needs keys")
    # the key and the ordinal are not carried twice
    carried = [c for c in df.columns if c not in keys and c not in ordinal]
    fields = [*[F.col(c).alias(f"o{i}") for i, c in enumerate(ordinal)], *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)]]
    pick = F.min if mode == "map_first" else F.max
    picked = df.groupBy(*keys).agg(pick(F.struct(*fields)).alias("_picked"))
    place = {c: F.col(f"_picked.o{i}") for i, c in enumerate(ordinal)} | {c: F.col(f"_picked.c{i}") for i, c in enumerate(carried)} | {k: F.col(f"`{k}`") for k in keys}
    return picked.select(*[place[c].alias(c) for c in df.columns])
