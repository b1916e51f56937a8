"""Not-modified revisits resolved against the latest earlier full response of the same canonical URL (an as-of join).

The as-of join is one range sort: records by URL and time, the last response carried along within a task and from the
tasks before, so that no pairs are made and a hot URL spreads over as many tasks as its records need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.worker import trimmed
from millrace.operators.shared import settle

# Headers that a not-modified answer may renew.
PERMITTED = ("cache-control", "date", "etag", "expires", "last-modified", "vary")
_EMPTY = "map<string,string>"


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, without the scheme's usual port and the fragment; an empty path is "/". User and
    password, path and query stay as they are; NULL stays NULL."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rooted = F.regexp_replace(bare, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)(?=[?]|$)", "$1/")
    part = lambda k: F.regexp_extract(rooted, "(?s)^([A-Za-z][A-Za-z0-9+.-]*://)([^/?]*@)?([^/?]*)(.*)$", k)
    low = F.when(part(1) != "", F.concat(F.lower(part(1)), part(2), F.lower(part(3)), part(4))).otherwise(bare)
    without = F.regexp_replace(low, "^(http://(?:[^/?]*@)?[^/?@]*):80(?=/)", "$1")
    return F.regexp_replace(without, "^(https://(?:[^/?]*@)?[^/?@]*):443(?=/)", "$1")


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (u, t, r, full, e, m, n, h) with their task's number and, for revisits, the last response of the same
    URL before the row (xr, xe, xm, xh and whether there is one)."""
    part, last = TaskContext.get().partitionId(), None
    for b in batches:
        if not b.num_rows:
            continue
        skip = 0 if last is None else 1
        if skip:
            b = pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
        n, u = b.num_rows, b.column(0)
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(u[1:], u[:-1]).to_numpy(zero_copy_only=False)
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        full = b.column(3).to_numpy(zero_copy_only=False)
        at = np.maximum.accumulate(np.where(full, np.arange(n), -1))
        before = np.r_[-1, at[:-1]]
        there = (before >= start) & ~full
        take = pa.array(np.where(there, before, 0), mask=~there)
        cols = [*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(there), *[b.column(k).take(take) for k in (2, 4, 5, 7)]]
        yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "part", "there", "xr", "xe", "xm", "xh"]).slice(skip)
        last = b.slice(int(at[-1]), 1) if at[-1] >= start[-1] else None


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(record_id, response_id, resolved, checked, headers) of every revisit in ``records`` (record_id, url, ts, kind, etag,
    last_modified, headers map of lower-case names; other columns are ignored).

    response_id: the latest full response (kind "response") of the same canonical URL strictly earlier in (ts, record_id):
    a response that ties with the revisit in both isn't earlier. Of responses that tie among themselves it is that with
    the greatest validators and then the most headers; NULL if there is none. checked: both records have an etag, or, where
    one of them has none, both have a last_modified. resolved: checked, and the validators so compared agree; an etag
    decides alone. headers: the response's, with the permitted ones of the revisit in their place; NULL if not resolved.

    A NULL URL or time resolves nothing, a NULL record_id stands first in its time. Repeated rows are rows of their own.
    An empty table gives an empty result. Records of other kinds are ignored.
    """
    spark = records.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = records.where(F.col("kind").isin("response", "revisit"))
    fields = [F.col("record_id").alias("r"), (F.col("kind") == "response").alias("full"), F.col("etag").alias("e"), F.col("last_modified").alias("m"), F.coalesce("headers", F.create_map().cast(_EMPTY)).alias("h")]
    # at one (t, r) revisits stand before responses; all of the order is the exchange's too, so that a hot URL is split
    order = ["u", "t", "r", "full", "e", "m", "n"]
    # conditions on the columns as they come, so that none repeats the canonical form
    timed = rows.where("url is not null and ts is not null").select(canonical(F.col("url")).alias("u"), F.col("ts").alias("t"), *fields)
    timed = timed.select("u", "t", "r", "full", "e", "m", F.size("h").alias("n"), "h")
    kinds = {f.name: f.dataType.simpleString() for f in timed.schema.fields}
    ddl = ", ".join(f"{c} {k}" for c, k in kinds.items()) + f", part int, there boolean, xr {kinds['r']}, xe {kinds['e']}, xm {kinds['m']}, xh {_EMPTY}"
    carried = settle(timed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(trimmed(_carry), ddl), "carried")
    # URLs that several tasks hold stand at the edges of each: two a task at most, in every table below
    edges = carried.groupBy("part").agg(F.min("u").alias("lo"), F.max("u").alias("hi"))
    edges = edges.select("part", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("u"))
    split = edges.groupBy("u").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("u")
    halves = settle(edges.join(split, "u"), "halves")
    whole = F.struct("t", "r", "e", "m", "n", F.map_entries("h").alias("h"))
    last = carried.where("full").join(F.broadcast(halves), ["u", "part"], "left_semi").groupBy("u", "part").agg(F.max(whole).alias("z"))
    before = Window.partitionBy("u").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    handed = halves.join(last, ["u", "part"], "left").select("u", "part", F.last("z", ignorenulls=True).over(before).alias("z")).where("z is not null")
    own = F.when(F.col("there"), F.struct(F.col("xr").alias("r"), F.col("xe").alias("e"), F.col("xm").alias("m"), F.col("xh").alias("h")))
    other = F.when(F.col("z").isNotNull(), F.struct("z.r", "z.e", "z.m", F.map_from_entries("z.h").alias("h")))
    joined = carried.where("not full").join(F.broadcast(handed), ["u", "part"], "left").select("r", "e", "m", "h", F.coalesce(own, other).alias("x"))
    lost = rows.where("kind = 'revisit' and (url is null or ts is null)").select(*fields).select("r", "e", "m", "h", F.lit(None).cast(joined.schema["x"].dataType).alias("x"))
    by_etag, by_time = F.col("e") == F.col("x.e"), F.col("m") == F.col("x.m")
    agree = F.coalesce(by_etag, by_time)
    ok = F.coalesce(agree, F.lit(False))
    renewed = F.map_filter("h", lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(F.col("x.h"), lambda k, _: ~F.array_contains(F.map_keys(renewed), k))
    out = joined.unionByName(lost)
    return out.select(F.col("r").alias("record_id"), F.col("x.r").alias("response_id"), ok.alias("resolved"), agree.isNotNull().alias("checked"), F.when(ok, F.map_concat(kept, renewed)).alias("headers"))
