"""Mixing sources to target weights.

Rows get hash-random keys, are range-sorted within their source, distributed prefix sums of their sizes are taken, and
each source is cut at its budget; a source whose target exceeds its size is passed over again (epochs).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.prefix import checked, running_sums
from millrace.llm.worker import trimmed
from millrace.operators.sequence import number_rows
from millrace.operators.shared import settle

WORD = r"[^\x20\x09-\x0D]+"


def word_counts(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with ``text`` replaced by its number of words (NULL: 0)."""
    at, columns = df.columns.index(text), df.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pc.fill_null(pc.count_substring_regex(b.column(at), WORD), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([n if i == at else b.column(i) for i in range(len(columns))], names=[name if c == text else c for c in columns])

    ddl = ", ".join(f"`{name}` bigint" if f.name == text else f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(trimmed(count), ddl)


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(_source, source_size, target) from (_source, source_size), a row for each source: ``share`` of all sizes, dealt by
    weight (sources by code point, NULL last, weights repeating); none above ``most`` times its size, what is above dealt
    again by weight among the others. The driver sees sums only, however many sources there are."""
    last = sizes.withColumn("_null", F.col("_source").isNull())
    ranked = number_rows(last, ["_null", "_source"], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    plan = settle(ranked.select("_source", "source_size", weight.alias("_weight")), "sources")
    cap = most * F.col("source_size")
    left = share * (plan.agg(F.sum("source_size")).first()[0] or 0)
    level, fixed = None, F.lit(False)
    while True:  # a source that was above its cap stays there: the others' level only rises
        open_, spent = plan.agg(F.sum(F.when(~fixed, F.col("_weight"))), F.sum(F.when(fixed, cap))).first()
        if not open_:
            break
        rest = max(0.0, left - (spent or 0.0))
        over = rest * F.col("_weight") / open_ > cap
        if not plan.where(~fixed & over).take(1):
            level = (rest, open_)
            break
        fixed = F.lit(rest) * F.col("_weight") / F.lit(open_) > cap
    given = cap if level is None else F.when(fixed, cap).otherwise(F.lit(level[0]) * F.col("_weight") / F.lit(level[1]))
    return plan.select("_source", "source_size", given.cast("double").alias("target"))


def _taken(docs: DataFrame, key: str, text: str, source: str, weights: Sequence[float], share: float, most: float, seed: int, whole: bool) -> DataFrame:
    """(_id, _source, _order, _size, source_size, target, _epochs, _taken) of every row."""
    thin = docs.select(F.col(key).alias("_id"), F.col(source).cast("string").alias("_source"), F.xxhash64(F.lit(seed), F.col(key)).alias("_order"), F.col(text).alias("_text"))
    # settled before the range exchange, which reads its input twice
    counted = settle(word_counts(thin, "_text", "_size"), "counted")
    rows = running_sums(counted, "_source", ["_order", "_id", "_size"], "_size", "_before")
    plan = targets(counted.groupBy("_source").agg(F.sum("_size").alias("source_size")), weights, share, most)
    goal, size = F.floor("target"), F.col("source_size")
    plan = plan.select(F.col("_source").alias("_s"), "source_size", "target", F.when(size > 0, F.floor(goal / size)).otherwise(0).alias("_epochs"), F.when(size > 0, goal % size).otherwise(0).alias("_rest"))
    joined = rows.join(checked(settle(plan, "plan")), F.col("_source").eqNullSafe(F.col("_s")))
    fits = F.greatest(F.least(F.col("_rest") - F.col("_before"), F.col("_size")), F.lit(0))
    last: Column = F.when(2 * fits >= F.col("_size"), F.col("_size")).otherwise(F.lit(0)) if whole else fits
    return joined.withColumn("_taken", F.col("_epochs") * F.col("_size") + last)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42, whole: bool = False, carry: bool = False) -> DataFrame:
    """(key, size, source_size, target, taken) for every row of ``docs``; other columns are ignored.

    size counts the words of the text. ``taken``: the words that the mix takes of the row, over all epochs. A source's
    words taken are its target rounded down, exactly: of the last epoch a row gives what still fits, the row at the cut
    perhaps a part. With ``whole`` rows are never cut: the row at the cut is taken if at least half of it fits, so that
    the words taken differ from the target by at most half of one row.

    Rows stand in the order of hash-random keys of (seed, key); reruns agree. Rows of one key stand together, those of
    one key and size in any order, which the written table fixes. Sources are a table of their own; it is broadcast where
    it has few rows. NULL sources are one source. Rows without words, NULL texts among them, are of size 0 and taken 0.
    NULL and repeated keys are ordinary rows, very long texts are counted whole. An empty table gives an empty result.
    With ``carry`` the columns ``source`` and ``_order`` stay.
    """
    extra = [F.col("_source").alias(source), "_order"] if carry else []
    taken = _taken(docs, key, text, source, weights, share, most, seed, whole)
    return taken.select(F.col("_id").alias(key), F.col("_size").alias("size"), "source_size", "target", F.col("_taken").alias("taken"), *extra)


def mix_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """The mix itself: rows of ``docs`` (all columns, whatever their names), each as often as the mix takes it whole; rows
    without words are out.

    What the prefix sums give is a cut for each source: the last row, in the source's hash-random order, that the last
    epoch takes. Rows are then compared with their source's cut where they are read, so that no text is shuffled while
    sources are few. Rows of one key stand at one place of the order and are taken or left together, beyond what the cut
    counted. NULL keys, sources and texts are as in ``mix``; an empty table gives an empty result.
    """
    taken = settle(_taken(docs, key, text, source, weights, share, most, seed, True), "mix")
    last = (F.col("_size") > 0) & (F.col("_taken") > F.col("_epochs") * F.col("_size"))
    cut = F.max(F.when(last, F.struct(F.col("_order").alias("o"), F.col("_id").alias("k"))))
    plan = taken.groupBy(F.col("_source").alias("s")).agg(F.max("_epochs").cast("int").alias("epochs"), cut.alias("cut"))
    # columns by their places, so that no name of the rows meets one of the plan's
    names = docs.columns
    place = {c: F.col(f"_{i}") for i, c in enumerate(names)}
    rows = docs.toDF(*[f"_{i}" for i in range(len(names))])
    order = F.xxhash64(F.lit(seed), place[key])
    before = (order < F.col("cut.o")) | ((order == F.col("cut.o")) & (place[key].isNull() | (place[key] <= F.col("cut.k"))))
    copies = F.col("epochs") + F.when(F.coalesce(before, F.lit(False)), 1).otherwise(0)
    worded = rows.where(place[text].rlike(r"[^\x20\x09-\x0D]"))
    joined = worded.join(checked(settle(plan, "cuts")), place[source].cast("string").eqNullSafe(F.col("s")))
    out = joined.where(copies > 0).select(*place.values(), F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
    return out.drop("copy").toDF(*names)
