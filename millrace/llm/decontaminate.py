"""Benchmark decontamination by suffix arrays.

Documents come in shards (the record batches of a task, cut at a byte bound). Of a shard's words only runs of words that
the test set knows can take part in a match; over those a suffix array is built by prefix doubling, and every test suffix
is binary-searched in it: the range of suffixes that begin with the test window gives all its locations. At each location
the longest verbatim match is found by a binary search the other way, in the suffix array of the test set.

Words are compared by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from millrace.llm.worker import trimmed

SHARD_BYTES, SLICE_BYTES = 1 << 20, 16 << 20

# words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower case: digits, letters and all bytes of other code points
_FOLD = np.zeros(256, np.uint8)
for _b in range(256):
    _c = _b + 32 if 65 <= _b <= 90 else _b
    _FOLD[_b] = _c if 48 <= _c <= 57 or 97 <= _c <= 122 or _c >= 128 else 0
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(data: np.ndarray, offsets: np.ndarray, piece: int = SHARD_BYTES, fold: np.ndarray = _FOLD) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts that lie on end in ``data`` (text k in offsets[k]..offsets[k+1]): their hashes and texts.

    ``fold`` gives each byte's value, 0 for bytes between words. Works in pieces cut between words, so that a huge text needs no more memory than its words.
    """
    hashes, owners, at, end = [], [], int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(end, at + piece)
        while stop < end:  # back to the last byte that is in no word; on to the next one if there is none
            gap = np.flatnonzero(fold[data[at:stop]] == 0)
            if len(gap) and gap[-1] > 0:
                stop = at + int(gap[-1])
                break
            stop = min(end, stop + piece)
        folded = fold[data[at:stop]]
        inside = folded != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        lo, hi = np.searchsorted(offsets, [at, stop], "left")
        edges = offsets[lo:hi] - at
        edges = edges[edges < stop - at]
        first[edges] |= inside[edges]
        starts = np.flatnonzero(first)
        if len(starts):
            place = np.arange(len(folded), dtype=np.int32)
            place[starts[0] :] -= np.repeat(starts.astype(np.int32), np.diff(np.r_[starts, len(folded)]))
            powers = np.ones(int(place[starts[0] :].max()) + 1, np.uint64)
            powers[1:] = _BASE
            powers = np.multiply.accumulate(powers)
            hashes.append(_mix(np.add.reduceat(folded * powers[place], starts)))
            owners.append(np.searchsorted(offsets, starts + at, "right") - 1)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; NULL is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def suffix_ranks(s: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of ``s`` by their first ``depth`` symbols at least, by prefix doubling (0 past the end)."""
    rank, width = np.unique(s, return_inverse=True)[1].astype(np.int64), 1
    while width < depth:
        ahead = np.zeros_like(rank)
        ahead[:-width] = rank[width:] + 1
        keys = rank * (len(s) + 2) + ahead
        rank, width = np.unique(keys, return_inverse=True)[1].astype(np.int64), width * 2
        if len(rank) and rank.max() == len(rank) - 1:
            break
    return rank


def search(text: np.ndarray, sa: np.ndarray, query: np.ndarray, starts: np.ndarray, limits: np.ndarray, after: bool) -> np.ndarray:
    """For each query suffix (at ``starts``, of ``limits`` symbols) the number of suffixes in ``sa`` that are less than
    it (``after``: or begin with it). ``text`` and ``query`` end in a 0, which no query symbol equals."""
    lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(sa), np.int64)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) >> 1
        same = matching(text, sa[mid], query, starts[open_], limits[open_])
        whole = same >= limits[open_]
        a = text[np.minimum(sa[mid] + same, len(text) - 1)]
        b = query[np.minimum(starts[open_] + same, len(query) - 1)]
        right = np.where(whole, after, a < b)
        lo[open_[right]] = mid[right] + 1
        hi[open_[~right]] = mid[~right]


def matching(text: np.ndarray, at: np.ndarray, query: np.ndarray, start: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Symbols in common from both places on, up to ``limit``; a 0 ends both."""
    n, live, k = np.zeros(len(at), np.int64), np.arange(len(at)), 0
    while len(live):
        live = live[k < limit[live]]
        a, b = text[np.minimum(at[live] + k, len(text) - 1)], query[np.minimum(start[live] + k, len(query) - 1)]
        live = live[(a == b) & (a != 0)]
        k += 1
        n[live] = k
    return n


@dataclass
class TestSet:
    """The test items' words as symbols 1.., each item followed by a 0, with its suffix array and windows."""

    vocabulary: np.ndarray  # sorted hashes; symbol = place + 1
    sieve: np.ndarray
    symbols: np.ndarray
    order: np.ndarray  # suffix array
    left: np.ndarray  # symbols from here to the item's end
    window_at: np.ndarray  # a place of each distinct window
    window_size: np.ndarray
    item_of: np.ndarray  # window to items: pairs sorted by window
    item_from: np.ndarray
    items: list[str]

    @classmethod
    def build(cls, rows: list[tuple[str, str | None]], width: int) -> TestSet:
        names = sorted({n for n, _ in rows})
        number = {n: i for i, n in enumerate(names)}
        column = pa.array([t or "" for _, t in rows], pa.string())
        data, offsets = text_buffers(column)
        hashes, owner = word_hashes(data, offsets)
        vocabulary = np.unique(hashes)
        counts = np.bincount(owner, minlength=len(rows))
        ends = np.cumsum(counts + 1)  # a 0 after each item
        symbols = np.zeros(int(ends[-1]) if len(rows) else 1, np.int64)
        symbols[np.arange(len(hashes)) + owner] = np.searchsorted(vocabulary, hashes) + 1
        left = np.repeat(ends - 1, counts + 1) - np.arange(len(symbols)) if len(rows) else np.zeros(1, np.int64)
        own = np.repeat([number[n] for n, _ in rows], counts + 1).astype(np.int64) if len(rows) else np.zeros(1, np.int64)
        length = np.repeat(counts, counts + 1) if len(rows) else np.zeros(1, np.int64)
        rank = suffix_ranks(symbols, len(symbols))
        order = np.argsort(rank, kind="stable")
        order = order[symbols[order] > 0]
        size = np.minimum(length, width)
        starts = np.flatnonzero((symbols > 0) & ((left >= width) | (left == length)))
        content: dict[tuple, int] = {}
        pairs = set()
        places, sizes = [], []
        for p in starts.tolist():
            w = tuple(symbols[p : p + int(size[p])].tolist())
            if w not in content:
                content[w] = len(places)
                places.append(p)
                sizes.append(len(w))
            pairs.add((content[w], int(own[p])))
        pair = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        sieve = np.zeros(1 << 20, bool)
        sieve[(vocabulary >> np.uint64(44)).astype(np.int64)] = True
        return cls(vocabulary, sieve, symbols, order, left, np.array(places, np.int64), np.array(sizes, np.int64), pair[:, 1], np.searchsorted(pair[:, 0], np.arange(len(places) + 1)), names)

    def symbols_of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        if len(self.vocabulary):
            maybe = np.flatnonzero(self.sieve[(hashes >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at + 1, 0)
        return out

    def scan(self, column: pa.Array) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int]], list[str], int]]]:
        """Words of each text, and for the texts with matches: the word spans hit (merged), the items, and the longest match."""
        data, offsets = text_buffers(column)
        hashes, owner = word_hashes(data, offsets)
        count = np.bincount(owner, minlength=len(column))
        if not len(hashes) or not len(self.window_at):
            return count, {}
        known = self.symbols_of(hashes)
        # runs of known words within a text, those of at least the shortest window
        edge = np.flatnonzero(np.r_[True, (known[1:] > 0) != (known[:-1] > 0)] | np.r_[True, owner[1:] != owner[:-1]])
        size = np.diff(np.r_[edge, len(known)])
        keep = (known[edge] > 0) & (size >= self.window_size.min())
        edge, size = edge[keep], size[keep]
        if not len(edge):
            return count, {}
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        word = np.repeat(edge, size) + inner  # place in the shard of each word that takes part
        place = np.arange(len(word)) + np.repeat(np.arange(len(edge)), size)
        shard = np.zeros(len(word) + len(edge) + 1, np.int64)
        shard[place] = known[word]
        back = np.zeros(len(shard), np.int64)
        back[place] = word
        rank = suffix_ranks(shard, int(self.window_size.max()))
        sa = np.argsort(rank, kind="stable")
        sa = sa[shard[sa] > 0]
        low = search(shard, sa, self.symbols, self.window_at, self.window_size, False)
        high = search(shard, sa, self.symbols, self.window_at, self.window_size, True)
        n = high - low
        found = np.flatnonzero(n)
        if not len(found):
            return count, {}
        window = np.repeat(found, n[found])
        place = sa[np.repeat(low[found], n[found]) + np.arange(int(n[found].sum())) - np.repeat(np.cumsum(n[found]) - n[found], n[found])]
        at = back[place]
        cover = np.zeros(len(known) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + self.window_size[window], -1)
        hit = np.r_[0, (np.cumsum(cover)[:-1] > 0).astype(np.int8), 0]
        # spans end at a text's end too: windows never cross it, but two spans may touch there
        new_text = np.r_[True, owner[1:] != owner[:-1]]
        begins = np.flatnonzero((hit[1:-1] == 1) & ((hit[:-2] == 0) | new_text))
        stops = np.flatnonzero((hit[1:-1] == 1) & ((hit[2:] == 0) | np.r_[new_text[1:], True])) + 1
        first_word = np.cumsum(count) - count
        longest = self._longest(shard, np.unique(place))
        best = np.zeros(len(column), np.int64)
        np.maximum.at(best, owner[back[np.unique(place)]], longest)
        # (text, item) pairs
        pair = np.unique(owner[at] * len(self.window_at) + window)
        text, win = pair // len(self.window_at), pair % len(self.window_at)
        m = (self.item_from[1:] - self.item_from[:-1])[win]
        item = self.item_of[np.repeat(self.item_from[win], m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)]
        both = np.unique(np.repeat(text, m) * len(self.items) + item)
        out: dict[int, tuple[list[tuple[int, int]], list[str], int]] = {}
        for t, i in zip((both // len(self.items)).tolist(), (both % len(self.items)).tolist(), strict=True):
            out.setdefault(t, ([], [], int(best[t])))[1].append(self.items[i])
        for b, e in zip(begins.tolist(), stops.tolist(), strict=True):
            t = int(owner[b])
            out[t][0].append((b - int(first_word[t]), e - int(first_word[t])))
        return count, out

    def _longest(self, shard: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The longest match with any test suffix at each place: with a neighbour in the order of test suffixes."""
        endless = np.full(len(places), 1 << 40)
        i = search(self.symbols, self.order, shard, places, endless, False)
        best = np.zeros(len(places), np.int64)
        for j in (i - 1, i):
            near = self.order[np.clip(j, 0, len(self.order) - 1)]
            best = np.maximum(best, matching(self.symbols, near, shard, places, endless))
        return best


def pieces_of(column: pa.Array, most: int = SHARD_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Slices of whole texts of about ``most`` bytes, of at most ``rows`` texts."""
    size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        stop = min(at + rows, max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right"))))
        yield at, column.slice(at, stop - at)
        at = stop


def find_contamination(docs: DataFrame, tests: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 8, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, ``keep`` columns, n_words, spans, items, longest) for every row of ``docs``.

    A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one window. spans: the
    word spans [from, until) of the text that lie in occurrences of windows, merged; items: ids, as strings in order, of
    the items with such windows; longest: words of the longest verbatim match with an item (0: no window occurs).

    NULL texts and items have no words. Rows of one item id are one item; a NULL id is the item "null". NULL and repeated
    keys are ordinary rows. Empty tables give no matches. ``keep`` names must differ from the result's.

    The test set is broadcast in slices of at most ``SLICE_BYTES`` of text (a slice of one item may be larger); with more
    than one slice the documents pass through one search after the other in the same task.
    """
    name = F.coalesce(F.col(item).cast("string"), F.lit("null"))
    rows = tests.select(name.alias("n"), F.col(item_text).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    slices = max(1, -(-total // SLICE_BYTES))
    kept = [f for f in docs.schema.fields if f.name in keep]
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    kind = docs.schema[key].dataType.simpleString()
    found = "n_words bigint, spans array<struct<begin: bigint, until: bigint>>, items array<string>, longest bigint"
    span = pa.list_(pa.struct([("begin", pa.int64()), ("until", pa.int64())]))
    frame = docs.select(F.col(text).alias("_text"), F.col(key).alias("_key"), *[F.col(f.name) for f in kept])
    for k in range(slices):
        part = rows if slices == 1 else rows.where(F.pmod(F.xxhash64("n"), F.lit(slices)) == k)
        index = TestSet.build([(r["n"], r["t"]) for r in part.collect()], width)
        shared, first = docs.sparkSession.sparkContext.broadcast(index), k == 0
        n_before = 2 + len(kept)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, first=first) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                counts, hits = [], {}
                for at, piece in pieces_of(batch.column(0)):
                    count, got = index.scan(piece)
                    counts.append(count)
                    hits |= {at + t: v for t, v in got.items()}
                n = batch.num_rows
                spans, items, longest = [[] for _ in range(n)], [[] for _ in range(n)], np.zeros(n, np.int64)
                if not first:
                    spans = [[(s["begin"], s["until"]) for s in v] for v in batch.column(n_before + 1).to_pylist()]
                    items = batch.column(n_before + 2).to_pylist()
                    longest = batch.column(n_before + 3).to_numpy(zero_copy_only=False).copy()
                for t, (where, which, most) in hits.items():
                    spans[t] = merge(spans[t] + where)
                    items[t] = sorted({*items[t], *which})
                    longest[t] = max(longest[t], most)
                flat = [{"begin": b, "until": e} for s in spans for b, e in s]
                cuts = pa.array(np.cumsum([0, *map(len, spans)]), pa.int32())
                cols = [*batch.columns[:n_before], pa.array(np.concatenate(counts), pa.int64()), pa.ListArray.from_arrays(cuts, pa.array(flat, span.value_type)), pa.array(items, pa.list_(pa.string())), pa.array(longest)]
                yield pa.RecordBatch.from_arrays(cols, names=["_text", "_key", *[f.name for f in kept], "n_words", "spans", "items", "longest"])

        frame = frame.mapInArrow(trimmed(scan), f"_text string, _key {kind}, {ddl}{found}")
    return frame.select(F.col("_key").alias(key), *[F.col(f.name) for f in kept], "n_words", "spans", "items", "longest")


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def hit_words(spans: Column | str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, s: a + s["until"] - s["begin"])


def decontaminate(docs: DataFrame, tests: DataFrame, least_items: int = 1, **how) -> DataFrame:
    """The rows of ``docs`` (all columns) in which windows of fewer than ``least_items`` items occur."""
    columns = docs.columns
    key = how.get("key", "doc_id")
    others = tuple(c for c in columns if c != key)
    renamed = docs.select(F.col(key).alias(key), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(others)])
    how["text"] = f"_{others.index(how.get('text', 'text'))}"
    found = find_contamination(renamed, tests, keep=tuple(f"_{i}" for i in range(len(others))), **how)
    clean = found.where(F.size("items") < least_items)
    named = {key: F.col(key)} | {c: F.col(f"_{i}") for i, c in enumerate(others)}
    return clean.select(*[named[c].alias(c) for c in columns])


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
