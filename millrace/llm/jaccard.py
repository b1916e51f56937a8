"""n-gram Jaccard join: documents whose sets of word shingles overlap to a given share, and their connected groups.

Rows with one set are one class, so copies never meet. Shingles are ordered rare-first, by the counts of a sketch over
all documents and then by hash; two sets of similarity t share a shingle among the first n - ceil(t n) + 1 of each, and
only those prefixes are joined, under the length, positional and suffix filters: by the sizes, by the places of the common
shingle in both orders, and by a lower bound of the Hamming distance. For the last, a set's signature holds for each of
512 hash classes whether an odd number of its shingles fall there; two signatures differ in at most as many bits as the
sets differ in shingles, so that most candidates are refused before their texts are fetched.

Since groups, not pairs, are asked for, candidates are taken in two steps that together lose no link. First each prefix
shingle's documents are verified against one of them, the most central (so a thousand near copies need a thousand
verifications). Then, exactly, every candidate pair that the links found so far do not connect is verified, once. Pairs
inside a component cannot change it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.decontaminate import pieces_of, text_buffers, word_hashes
from millrace.llm.sieve import Sieve
from millrace.llm.worker import trimmed
from millrace.operators.shared import settle, settle_alone

# words are [^\x20\x09-\x0D]+ with A-Z as a-z; values from 1 so that the byte 0 counts
_WORD = np.arange(1, 257, dtype=np.uint16)
_WORD[65:91] += 32
_WORD[[32, 9, 10, 11, 12, 13]] = 0
KEY_BITS = 52  # of a shingle's hash; the rest numbers the texts of a piece
PIECE_ROWS = (1 << (64 - KEY_BITS)) - 1
SIGNATURE = 512  # hash classes of the suffix filter, a bit each
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _B
    h = (h ^ (h >> np.uint64(29))) * _C
    return h ^ (h >> np.uint64(32))


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle hash) of every text's distinct shingles, sorted by both."""
    data, off = text_buffers(column)
    h, own = word_hashes(data, off, fold=_WORD)
    n = np.bincount(own, minlength=len(column))
    at = np.flatnonzero(own[width - 1 :] == own[: len(own) - width + 1]) if len(own) >= width else np.zeros(0, np.int64)
    s = np.zeros(len(at), np.uint64)
    for k in range(width):
        s = (s ^ h[at + k]) * _A + np.uint64(k + 1)
    text = own[at]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        first = np.cumsum(n) - n
        whole = np.array([int(np.bitwise_xor.reduce(_stir(h[first[t] : first[t] + n[t]] + np.arange(1, n[t] + 1, dtype=np.uint64) * _A))) for t in short], np.uint64)
        s, text = np.r_[s, whole + np.uint64(77)], np.r_[text, short]
    key = (text.astype(np.uint64) << np.uint64(KEY_BITS)) | (_stir(s) >> np.uint64(64 - KEY_BITS))
    key.sort()
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return (key >> np.uint64(KEY_BITS)).astype(np.int64), (key & np.uint64((1 << KEY_BITS) - 1)).astype(np.int64)


def set_classes(text: np.ndarray, key: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set size and class: a 64-bit hash of the set and its size."""
    n = np.bincount(text, minlength=rows)
    total = np.zeros(rows, np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        total[full] = np.add.reduceat(_stir(key.astype(np.uint64) + _A), (np.cumsum(n) - n)[full])
    return n, _stir(total + n.astype(np.uint64) * _C).astype(np.int64)


def least_common(n: Column, m: Column, percent: int) -> Column:
    """The least overlap of two sets of these sizes that are similar enough."""
    return F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent) - F.lit(1e-9))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def rarity(counts: np.ndarray) -> np.ndarray:
    """A byte for each counter, ascending with the count."""
    return np.minimum(6 * np.log2(1.0 + counts), 255).astype(np.uint8)


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """(key, n_shingles, component_id, class_id, root) for every row of ``docs``.

    A document's set: its distinct ``width``-word shingles (words [^\\x20\\x09-\\x0D]+, A-Z as a-z); with fewer words the
    whole sequence as one; without words, or NULL, empty and linked with nothing. Two documents link when
    100 * intersection >= ``percent`` * union. component_id: the smallest key reachable over links, the own one included
    (NULL keys count only where there is no other). class_id is the same for equal sets (NULL: empty). root tells
    components apart where keys repeat or are NULL: the class_id of one of its sets (NULL: empty).

    Repeated keys are ordinary rows. An empty table gives an empty result. Sets are compared by 52-bit hashes of their
    shingles.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    total = docs.select(F.sum(F.octet_length(text)).alias("s")).first()["s"] or 0
    bits = min(26, max(16, int(total // 256).bit_length()))
    thin, order = _first_pass(rows, kind, bits, width)
    post, signs = _postings(rows, order, width, percent)
    links, tagged = _star_links(rows, thin, post, signs, width, percent)
    more = _cross_links(rows, thin, tagged, signs, links, width, percent)
    roots = components(more)
    named = thin.where("_n > 0").groupBy("_c").agg(F.min("_id").alias("_least"))
    named = named.join(roots.select(F.col("node").alias("_c"), "root"), "_c", "left").withColumn("root", F.coalesce("root", "_c"))
    named = settle(named, "classes")
    least = named.groupBy("root").agg(F.min("_least").alias("component"))
    named = named.join(least, "root").select("_c", "component", "root")
    out = thin.join(named, "_c", "left")
    empty = F.col("_n") == 0
    return out.select(
        F.col("_id").alias(key),
        F.col("_n").alias("n_shingles"),
        F.when(empty, F.col("_id")).otherwise(F.col("component")).alias("component_id"),
        F.when(~empty, F.col("_c")).alias("class_id"),
        F.when(~empty, F.col("root")).alias("root"),
    )


def _first_pass(rows: DataFrame, kind: str, bits: int, width: int) -> tuple[DataFrame, np.ndarray]:
    """(_id, _n, _c) of every row, and the order byte of every counter of the sketch (2^bits counters)."""
    chunk = 1 << min(bits, 16)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, part = np.zeros(1 << bits, np.int32), TaskContext.get().partitionId()
        names = ["_id", "_n", "_c", "_chunk", "_part", "_low", "_high"]
        seen, id_type = False, pa.int64()
        for b in batches:
            id_type = b.schema.field(0).type
            for at, piece in pieces_of(b.column(1), rows=PIECE_ROWS):
                seen = True
                t, s = shingle_sets(piece, width)
                n, c = set_classes(t, s, len(piece))
                np.add.at(counts, s & ((1 << bits) - 1), 1)
                none = [pa.nulls(len(piece), x) for x in (pa.int32(), pa.int32(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(piece)), pa.array(n), pa.array(c), *none], names=names)
        if seen:
            for i in range(0, 1 << bits, chunk):
                c = counts[i : i + chunk]
                if c.any():
                    over = np.flatnonzero(c > 255)
                    high = np.stack([over, c[over] - 255]).astype(np.int64).tobytes()
                    values = [pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([i // chunk], pa.int32()), pa.array([part], pa.int32()), pa.array([np.minimum(c, 255).astype(np.uint8).tobytes()], pa.binary()), pa.array([high], pa.binary())]
                    yield pa.RecordBatch.from_arrays(values, names=names)

    both = settle(rows.mapInArrow(trimmed(measure), f"_id {kind}, _n bigint, _c bigint, _chunk int, _part int, _low binary, _high binary"), "sets")
    thin = both.where("_chunk is null").select("_id", "_n", "_c")

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(chunk, np.int64)
        for low, high, wide in zip(*(group.column(n).to_pylist() for n in ("_low", "_high", "_wide")), strict=True):
            if wide is not None:
                total += np.frombuffer(wide, np.int64)
                continue
            total += np.frombuffer(low, np.uint8)
            at, n = np.frombuffer(high, np.int64).reshape(2, -1)
            total[at] += n
        return pa.table([group.column("_chunk")[:1], pa.array([total.tobytes()], pa.binary())], names=["_chunk", "_wide"])

    parts = both.where("_chunk is not null").select("_chunk", "_part", "_low", "_high", F.lit(None).cast("binary").alias("_wide"))
    if (parts.agg(F.max("_part")).first()[0] or 0) > 255:  # many tasks: sums of 1 in 64 of them first
        parts = parts.groupBy("_chunk", F.pmod("_part", F.lit(64))).applyInArrow(lambda g: add(g), "_chunk int, _wide binary")
        parts = parts.select("_chunk", F.lit(0).alias("_part"), F.lit(None).cast("binary").alias("_low"), F.lit(None).cast("binary").alias("_high"), "_wide")

    def last(group: pa.Table) -> pa.Table:
        done = add(group)
        order = rarity(np.frombuffer(done.column(1)[0].as_py(), np.int64))
        return pa.table([done.column(0), pa.array([order.tobytes()], pa.binary())], names=["_chunk", "_order"])

    order = np.zeros(1 << bits, np.uint8)
    for r in parts.groupBy("_chunk").applyInArrow(last, "_chunk int, _order binary").collect():  # 2^bits bytes in all
        order[r["_chunk"] * chunk : (r["_chunk"] + 1) * chunk] = np.frombuffer(r["_order"], np.uint8)
    return thin, order


def _postings(rows: DataFrame, order: np.ndarray, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(k, c, n, i, q): prefix shingle, class, set size, place in the order and centrality, of prefix shingles that at
    least two classes have; and (c, f): the signature of each class."""
    shared = rows.sparkSession.sparkContext.broadcast(order)  # 2^26 bytes at most

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = shared.value, np.zeros(0, np.int64)
        mask = len(order) - 1
        for b in batches:
            for _, piece in pieces_of(b.column(0), rows=PIECE_ROWS):
                t, s = shingle_sets(piece, width)
                n, c = set_classes(t, s, len(piece))
                _, first = np.unique(c, return_index=True)
                fresh = np.zeros(len(piece), bool)
                fresh[first] = True
                fresh &= (n > 0) & ~np.isin(c, seen)
                seen = np.union1d(seen, c[fresh])
                keep = fresh[t]
                t, s = t[keep], s[keep]
                if not len(t):
                    continue
                rank = order[s & mask].astype(np.int64)
                n = np.where(fresh, n, 0)
                q = np.bincount(t, rank, len(piece)) * 1000 / np.maximum(n, 1)
                # unsigned: a piece's texts take all 12 bits above the rest
                sort = np.argsort((t.astype(np.uint64) << np.uint64(KEY_BITS)) | ((rank << 44) | (s >> 8)).astype(np.uint64), kind="stable")
                t, s = t[sort], s[sort]
                start = np.cumsum(n) - n
                i = np.arange(len(t)) - start[t]
                head = i < prefix_length(n, percent)[t]
                h = np.flatnonzero(head)
                odd = np.bincount(t * SIGNATURE + (s >> 3) % SIGNATURE, minlength=len(piece) * SIGNATURE) & 1
                bits = np.packbits(odd.astype(bool)).reshape(-1, SIGNATURE // 8)
                lead = i[h] == 0  # the first posting of a class carries its signature
                ends = np.r_[0, np.cumsum(lead * (SIGNATURE // 8))].astype(np.int32)
                f = pa.BinaryArray.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(bits[t[h[lead]]].tobytes())])
                cols = [pa.array(s[h]), pa.array(c[t[h]]), pa.array(n[t[h]].astype(np.int32)), pa.array(i[h].astype(np.int32)), pa.array(q[t[h]].astype(np.int32)), f]
                yield pa.RecordBatch.from_arrays(cols, names=["k", "c", "n", "i", "q", "f"])

    post = settle(rows.select("_text").mapInArrow(trimmed(emit), "k bigint, c bigint, n int, i int, q int, f binary"), "postings")
    spread = post.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("k")
    spread = settle(spread, "common")
    sifted = Sieve(spread, "k").passing(post.drop("f"), "k")
    shared_keys = settle(sifted.join(spread, "k", "left_semi").dropDuplicates(["k", "c"]), "candidates")
    return shared_keys, settle(post.where("i = 0").select("c", "f").dropDuplicates(["c"]), "signatures")


def _may_link(a: str, b: str, percent: int) -> Column:
    """The length filter and the positional filter: the places that a common shingle leaves after it."""
    n, m = F.col(f"{a}n").cast("bigint"), F.col(f"{b}n").cast("bigint")
    fits = F.greatest(n, m) * percent <= F.least(n, m) * 100
    rest = F.least(n - F.col(f"{a}i") - 1, m - F.col(f"{b}i") - 1)
    return fits & (rest + 1 >= least_common(n, m, percent))


def _suffix_filter(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Of (a, b, an, bn): the distinct pairs (a, b), a < b, whose signatures differ in no more bits than similar sets
    differ in shingles."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            both = x.column(2).to_numpy().astype(np.int64) + x.column(3).to_numpy()
            f, g = (np.frombuffer(b"".join(x.column(k).to_pylist()), np.uint64).reshape(-1, SIGNATURE // 64) for k in (4, 5))
            apart = np.bitwise_count(f ^ g).sum(1, dtype=np.int64)
            most = both - 2 * -(-percent * both // (100 + percent))
            yield pa.RecordBatch.from_arrays(x.columns[:2], names=["a", "b"]).filter(pa.array(apart <= most))

    swap = F.col("a") > F.col("b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("bn")).otherwise(F.col("an")).alias("an"), F.when(swap, F.col("an")).otherwise(F.col("bn")).alias("bn")).distinct()
    pairs = pairs.join(signs.withColumnsRenamed({"c": "a", "f": "af"}), "a").join(signs.withColumnsRenamed({"c": "b", "f": "bf"}), "b")
    return pairs.select("a", "b", "an", "bn", "af", "bf").mapInArrow(sift, "a bigint, b bigint")


def _star_links(rows: DataFrame, thin: DataFrame, post: DataFrame, signs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Verified links of every posting with its shingle's most central one; and the postings with their components."""
    centre = post.groupBy("k").agg(F.max(F.struct("q", "c", "n", "i")).alias("p"))
    near = post.join(centre, "k").where("c <> p.c")
    pairs = near.select(F.col("c").alias("a"), F.col("p.c").alias("b"), F.col("n").alias("an"), F.col("p.n").alias("bn"), F.col("i").alias("ai"), F.col("p.i").alias("bi"))
    pairs = _suffix_filter(pairs.where(_may_link("a", "b", percent)), signs, percent)
    links = _verify(rows, thin, settle(pairs, "pairs"), width, percent)
    roots = components(links)
    tagged = post.join(roots.select(F.col("node").alias("c"), "root"), "c", "left")
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")), settle(tagged.withColumn("root", F.coalesce("root", "c")), "tagged")


def _cross_links(rows: DataFrame, thin: DataFrame, tagged: DataFrame, signs: DataFrame, links: DataFrame, width: int, percent: int) -> DataFrame:
    """``links`` and those of all candidate pairs that lie in two components.

    Of such a pair at least one side is outside the component of its shingle's most central posting; those sides are
    joined with all postings of the shingle whose sizes lie in the same or the next band of equal ratio.
    """
    base = np.log(100 / percent)
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(base)) + F.lit(1e-9)).cast("int")
    main = tagged.groupBy("k").agg(F.max(F.struct("q", "c", "root")).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    rest = settle(tagged.join(main.select("k", F.col("m.root").alias("main")), "k").withColumn("band", band), "open")
    fields = ("c", "n", "i", "root")
    side = rest.where("root <> main").select("k", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), *[F.col(x).alias(f"a{x}") for x in fields])
    other = rest.select("k", "band", "main", *[F.col(x).alias(f"b{x}") for x in fields])
    apart = (F.col("aroot") != F.col("broot")) & ((F.col("broot") == F.col("main")) | (F.col("ac") < F.col("bc")))
    pairs = side.join(other, ["k", "band"]).where(apart & _may_link("a", "b", percent))
    pairs = _suffix_filter(pairs.withColumnsRenamed({"ac": "a", "bc": "b"}), signs, percent)
    found = _verify(rows, thin, settle(pairs, "pairs"), width, percent)
    return links.union(found)


def _verify(rows: DataFrame, thin: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough, from the whole texts of one row of each class."""
    wanted = settle(pairs.select(F.col("a").alias("_c")).union(pairs.select("b")).distinct(), "wanted")
    # a class's texts are found by its rows' ids, then told apart by the class itself
    spoken = thin.where("_n > 0").join(wanted, "_c").groupBy("_c").agg(F.min(F.struct(F.col("_id").isNotNull().alias("x"), F.col("_id").alias("id"))).alias("m"))
    ids = settle(spoken.select("_c", F.coalesce(F.hash("m.id"), F.lit(0)).cast("bigint").alias("h"), F.col("m.id").alias("_i")), "speakers")
    sieve, hashed = Sieve(ids, "h"), F.xxhash64(F.hash("_id").cast("bigint")).alias("_h")

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(sieve.test(b.column(2))))
            for at, piece in pieces_of(b.column(1), rows=PIECE_ROWS):
                _, c = set_classes(*shingle_sets(piece, width), len(piece))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(piece)), piece, pa.array(c)], names=["_id", "_text", "_k"])

    kind = rows.schema["_id"].dataType.simpleString()
    spelt = rows.select("_id", "_text", hashed).mapInArrow(trimmed(classify), f"_id {kind}, _text string, _k bigint")
    spelt = spelt.join(ids, (F.col("_k") == F.col("_c")) & F.col("_id").eqNullSafe(F.col("_i"))).select("_c", "_text")
    # rows that repeat an id with one set have the same class: one of them speaks
    texts = settle(spelt.dropDuplicates(["_c"]), "texts")
    with_b = pairs.join(texts.select(F.col("_c").alias("b"), F.col("_text").alias("tb")), "b")
    with_both = with_b.join(texts.select(F.col("_c").alias("a"), F.col("_text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for at, piece in pieces_of(x.column(2), rows=PIECE_ROWS // 2):
                m = len(piece)
                pair = x.slice(at, m)
                t, s = shingle_sets(pair.column(2), width)
                u, v = shingle_sets(pair.column(3), width)
                n = np.bincount(t, minlength=m) + np.bincount(u, minlength=m)
                both = np.intersect1d((t << 52) | s, (u << 52) | v, assume_unique=True) >> 52
                common = np.bincount(both, minlength=m)
                yield pa.RecordBatch.from_arrays(pair.columns[:2], names=["a", "b"]).filter(pa.array(100 * common >= percent * (n - common)))

    return settle(with_both.mapInArrow(trimmed(compare), "a bigint, b bigint"), "links")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """``docs`` (all columns) with one row of each component: one with its smallest key; rows without words all stay.

    Rows that surely have no partner pass straight through; only the others meet the table of decisions.
    """

    def partners() -> DataFrame:
        found = settle(jaccard_components(docs, key, text, width, percent), "components")
        worded = found.where("n_shingles > 0").select(F.col(key).alias("_k"), F.col("class_id").alias("_of"), F.col("component_id").alias("_g"), F.col("root").alias("_r"))
        groups = worded.groupBy("_r").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
        return worded.join(groups, "_r", "left_semi")

    grouped = settle_alone(docs.sparkSession, partners, "grouped")
    hashes = grouped.select(F.coalesce(F.hash("_k"), F.lit(0)).cast("bigint").alias("h"))
    sieve, columns = Sieve(hashes, "h"), docs.columns
    numbered = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)], F.coalesce(F.hash(key), F.lit(0)).cast("bigint").alias("h"))
    at, body = f"_{columns.index(key)}", f"_{columns.index(text)}"
    back = [F.col(f"_{i}").alias(c) for i, c in enumerate(columns)]
    alone = sieve.passing(numbered, "h", keep=False).select(*back)
    unsure, place = numbered.withColumn("_s", F.xxhash64("h")), numbered.columns.index(body)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(sieve.test(b.column(len(b.columns) - 1))))
            for start, piece in pieces_of(b.column(place), rows=PIECE_ROWS):
                n, c = set_classes(*shingle_sets(piece, width), len(piece))
                part = b.slice(start, len(piece))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(c, mask=n == 0)], names=[*part.schema.names, "_class"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in unsure.schema.fields)
    unsure = unsure.mapInArrow(trimmed(classify), f"{ddl}, _class bigint")
    keys = grouped.select("_k", "_of", "_g", "_r", F.lit(True).alias("_in")).distinct()
    met = unsure.join(keys, F.col(at).eqNullSafe(F.col("_k")) & (F.col("_class") == F.col("_of")), "left")
    single = met.where("_in is null").select(*back)
    first = met.where(F.col("_in") & F.col(at).eqNullSafe(F.col("_g"))).dropDuplicates(["_r"])
    return alone.unionByName(single).unionByName(first.select(*back))
