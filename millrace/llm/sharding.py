"""Sharding by minimax contiguous partition.

Atomic groups (equal texts) stand in one order; K contiguous runs of groups become the shards, such that the largest
shard is as small as it can be. The smallest feasible capacity is found by binary search, each capacity checked greedily.
All groups never meet in one place: the search works on a histogram of the groups over the order, whose bins are refined
only where a cut can fall, until each such bin is a single group. A bin that may still be split is bounded from both
sides: taken whole it gives capacities that are surely feasible, taken as a fluid it gives those that surely are not.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.prefix import running_sums
from millrace.operators.shared import settle

TOP_BITS, STEP_BITS = 16, 8


@dataclass
class Bins:
    """In order: the key's high bits (``prefix`` at ``shift``), bytes and number of groups. Front bins have shift -1."""

    prefix: np.ndarray
    shift: np.ndarray
    size: np.ndarray
    groups: np.ndarray

    def cut_key(self, i: int) -> int:
        """The largest key in bin i."""
        s = int(self.shift[i])
        return (int(self.prefix[i]) << s) + (1 << s) - 1


def whole_cuts(ends: np.ndarray, capacity: int, shards: int) -> tuple[list[int], bool]:
    """Greedy cuts (bins before each cut) with bins taken whole, and whether all bins found room."""
    cuts, done, used = [], 0, 0
    for _ in range(shards):
        upto = int(np.searchsorted(ends, used + capacity, "right"))
        if upto == done:
            break
        cuts.append(upto)
        done, used = upto, int(ends[upto - 1])
    return cuts, done == len(ends)


def fluid_cuts(ends: np.ndarray, splits: np.ndarray, capacity: int, shards: int) -> tuple[list[int], bool]:
    """As above with bins that hold several groups taken as a fluid; a cut's index is the bin in which it falls."""
    cuts, used, total = [], 0, int(ends[-1]) if len(ends) else 0
    for _ in range(shards):
        if used >= total:
            break
        upto = int(np.searchsorted(ends, used + capacity, "right"))
        if upto == len(ends):
            used = total
        elif splits[upto]:
            used += capacity
        else:
            reached = int(ends[upto - 1]) if upto else 0
            if reached <= used:
                break
            used = reached
        cuts.append(upto)
    return cuts, used >= total


def smallest(low: int, high: int, feasible: Callable[[int], bool]) -> int:
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid + 1, high)
    return low


def search(bins: Bins, shards: int, refine: Callable[[Bins, np.ndarray], Bins]) -> tuple[Bins, int, list[int]]:
    """The refined bins, the minimax capacity and its greedy cuts."""
    while True:
        ends, splits = np.cumsum(bins.size), bins.groups > 1
        total = int(ends[-1]) if len(ends) else 0
        if total == 0:
            return bins, 0, []
        high = smallest(-(-total // shards), total, lambda c: whole_cuts(ends, c, shards)[1])
        low = smallest(-(-total // shards), high, lambda c: fluid_cuts(ends, splits, c, shards)[1])
        least, _ = whole_cuts(ends, low, shards)
        most, _ = fluid_cuts(ends, splits, high, shards)
        window = np.zeros(len(ends) + 1, bool)
        for k, upper in enumerate(most):
            lower = least[k] if k < len(least) else (least[-1] if least else 0)
            window[lower : upper + 1] = True
            if k >= len(least):
                break  # the bin that stopped the greedy pass comes first
        split = np.flatnonzero(window[:-1] & splits)
        if not len(split):
            return bins, high, whole_cuts(ends, high, shards)[0]
        bins = refine(bins, split)


def even_cuts(bins: Bins, shards: int, capacity: int, greedy: list[int]) -> list[int]:
    """Cuts under ``capacity`` that also spread what a large group leaves over: each at the bin's end next to an equal
    share of the rest, as long as the rest still fits. Where that finds no place, the greedy cuts."""
    ends = np.cumsum(bins.size)
    n, total = len(ends), int(ends[-1]) if len(ends) else 0
    need = [n]  # from the right: where cut k must at least stand
    for _ in range(shards - 1):
        upper = int(ends[need[-1] - 1]) if need[-1] else 0
        need.append(int(np.searchsorted(ends, upper - capacity, "left")) + 1 if upper > capacity else 0)
    need = need[::-1]  # need[k - 1]: for the cut after k shards
    cuts, done, used = [], 0, 0
    for k in range(1, shards):
        least, most = max(need[k - 1], done), int(np.searchsorted(ends, used + capacity, "right"))
        if least > most:
            return greedy
        want = used + (total - used) / (shards - k + 1)
        i = int(np.searchsorted(ends, want, "left"))
        near = min((j for j in (i, i + 1) if j <= n), key=lambda j: abs((int(ends[j - 1]) if j else 0) - want))
        done = min(max(near, least, min(done + 1, n)), most)  # a shard takes one group at least, if there is one
        used = int(ends[done - 1]) if done else 0
        cuts.append(done)
    return [*cuts, n] if total - used <= capacity else greedy


def plan_shards(groups: DataFrame, shards: int) -> tuple[list[int], list[tuple[int, int]], int]:
    """From (``_key`` bigint unique, ``_bytes``): the front groups' keys with their shards, the cut after each shard as
    a key or None, and the capacity.

    Groups above an equal share (fewer than ``shards``) stand in front of the order, the largest first, so that they
    don't tear the others apart.
    """
    shift = 64 - TOP_BITS

    def histogram(rows: DataFrame, by: int) -> np.ndarray:
        got = rows.groupBy(F.shiftright("_key", by).alias("p")).agg(F.sum("_bytes").alias("s"), F.count(F.lit(1)).alias("n"))
        t = got.toArrow()  # at most 2^TOP_BITS rows, or shards^2 * 2^STEP_BITS of a refinement
        m = np.stack([t.column(i).to_numpy() for i in range(3)], 1).astype(np.int64).reshape(-1, 3)
        return m[np.argsort(m[:, 0])]

    first = histogram(groups, shift)
    share = int(first[:, 1].sum()) / shards
    large = [] if not len(first) else groups.where(F.col("_bytes") > share).orderBy(F.desc("_bytes"), "_key").collect()
    front = [int(r["_key"]) for r in large]
    rest = groups.where(~F.col("_key").isin(front)) if front else groups
    for r in large:
        i = int(np.searchsorted(first[:, 0], int(r["_key"]) >> shift))
        first[i, 1:] -= (int(r["_bytes"]), 1)
    first = first[first[:, 2] > 0]
    n = len(front)
    bins = Bins(
        np.r_[np.array(front, np.int64), first[:, 0]], np.r_[np.full(n, -1), np.full(len(first), shift)],
        np.r_[np.array([int(r["_bytes"]) for r in large], np.int64), first[:, 1]], np.r_[np.ones(n, np.int64), first[:, 2]],
    )

    def refine(bins: Bins, split: np.ndarray) -> Bins:
        parts, done = [], np.zeros(len(bins.size), bool)
        done[split] = True
        for s in np.unique(bins.shift[split]):
            at = split[bins.shift[split] == s]
            finer = max(0, int(s) - STEP_BITS)
            got = histogram(rest.where(F.shiftright("_key", int(s)).isin([int(p) for p in bins.prefix[at]])), finer)
            where = at[np.searchsorted(bins.prefix[at], got[:, 0] >> (int(s) - finer))]
            parts.append((where, got, finer))
        keep = np.flatnonzero(~done)
        order = np.concatenate([keep, *[w for w, _, _ in parts]])
        cols = [np.concatenate([old[keep], *[new(g, f) for _, g, f in parts]]) for old, new in (
            (bins.prefix, lambda g, f: g[:, 0]), (bins.shift, lambda g, f: np.full(len(g), f)), (bins.size, lambda g, f: g[:, 1]), (bins.groups, lambda g, f: g[:, 2]))]
        sort = np.lexsort((cols[0], order))
        return Bins(*[c[sort] for c in cols])

    bins, capacity, greedy = search(bins, shards, refine)
    cuts = even_cuts(bins, shards, capacity, greedy)
    placed = [(k, int(np.searchsorted(cuts, i, "right"))) for i, k in enumerate(front)]
    keys = [None if c <= n else bins.cut_key(c - 1) for c in cuts[: shards - 1]]
    return keys, placed, capacity


def shard_of(key: Column, keys: list[int | None], placed: list[tuple[int, int]]) -> Column:
    """The shard of a group: NULL cut keys stand before all groups that aren't in front."""
    after = F.lit(0)
    for k in keys:
        after = after + (F.lit(1) if k is None else (key > F.lit(k)).cast("int"))
    out = None
    for k, s in placed:
        out = F.when(key == k, s) if out is None else out.when(key == k, s)
    return (after if out is None else out.otherwise(after)).cast("int")


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot) for every row of ``docs``; other columns are ignored, whatever their names.

    size: UTF-8 bytes of the text plus 1. Equal texts form one atomic group and share a shard; so do the few texts whose
    64-bit hashes are equal, which costs nothing but a coarser group. The order is that of the hashes. slot numbers a
    shard's rows from 0 by (hash, key), through distributed prefix sums.

    NULL and empty texts count as one group of size 1 a row, crc 0. NULL and repeated keys are ordinary rows. An empty
    table gives an empty result. With fewer groups than shards the last shards stay empty. A group above an equal share
    fills a shard of its own, and the others share the rest.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    body = F.coalesce(F.col(text), F.lit(""))
    thin = settle(
        docs.select(
            F.col(key).alias(key),
            (F.octet_length(body) + 1).cast("bigint").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.xxhash64(body).alias("_key"),
        ),
        "sizes",
    )
    groups = settle(thin.groupBy("_key").agg(F.sum("size").alias("_bytes")), "groups")
    keys, placed, _ = plan_shards(groups, shards)
    dealt = thin.withColumn("shard", shard_of(F.col("_key"), keys, placed)).withColumn("_one", F.lit(1).cast("bigint"))
    out = running_sums(dealt, "shard", ["_key", key, "size"], "_one", "slot")
    return out.select(key, "size", "text_crc32", "shard", "slot")
