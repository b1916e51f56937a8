"""The contract queries of the collection verbs, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import lists
from millrace.functions.monoids import Monoid, int32_wrap
from millrace.operators import sequence
from millrace.operators.flow import Flow
from millrace.plans import bodies, images, pagerank, pipelines
from millrace.sources.ranges import Range
from millrace.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = " ".join(sql.split())
        return fn

    return register


def c(name: str) -> Column:
    return F.col(name)


def lines(spark: SparkSession, d: str) -> Flow:
    return Flow(table(spark, d, "lineitem"), LINE)


# -- reductions


@query("reduce_sum", "select cast(sum(l_linenumber) as bigint) as total from lineitem")
def _(spark, d):
    return lines(spark, d).reduce_df("sum", c("l_linenumber"), "total")


@query("reduce_bit_xor", "select bit_xor(l_partkey) as bits from lineitem")
def _(spark, d):
    return lines(spark, d).reduce_df("bit_xor", c("l_partkey"), "bits")


@query("reduce_empty", "select max(l_partkey) as top from lineitem where l_quantity < 0")
def _(spark, d):
    return lines(spark, d).filter(c("l_quantity") < 0).reduce_df("max", c("l_partkey"), "top")


@query("map_reduce", "select cast(sum(l_linenumber + 1) as bigint) as total from lineitem")
def _(spark, d):
    return lines(spark, d).map_reduce_df(c("l_linenumber") + 1, "sum", "total")


@query("fold", "select cast(sum(l_partkey) as bigint) as total from lineitem")
def _(spark, d):
    return lines(spark, d).fold_df(0, "sum", c("l_partkey"), "total")


@query("fold_empty", "select cast(coalesce(sum(l_linenumber), 0) as bigint) as total from lineitem where l_quantity < 0")
def _(spark, d):
    return lines(spark, d).filter(c("l_quantity") < 0).fold_df(0, "sum", c("l_linenumber"), "total")


@query(
    "aggregate_length",
    "select cast(sum(length(p_name)) as bigint) as letters, count(*) as names, max(length(p_name)) as longest from (select distinct p_name from part)",
)
def _(spark, d):
    names = Flow(table(spark, d, "part").select("p_name")).as_set()
    size = F.length("p_name")
    return names.aggregate_df({"letters": F.sum(size), "names": F.count(F.lit(1)), "longest": F.max(size).cast("bigint")})


@query("sum_wrapped", "select cast((((sum(l_partkey * 100003) + 2147483648) % 4294967296 + 4294967296) % 4294967296) - 2147483648 as int) as total from lineitem")
def _(spark, d):
    return lines(spark, d).df.agg(int32_wrap(F.sum(c("l_partkey") * 100003)).alias("total"))


@query("sum_pairs", "select cast(sum(l_orderkey % 1000) as bigint) as keys, cast(sum(l_partkey) as bigint) as vals from lineitem")
def _(spark, d):
    return lines(spark, d).aggregate_df({"keys": F.sum(c("l_orderkey") % 1000), "vals": F.sum("l_partkey")})


@query("sum_custom_numeric", "select min(l_partkey) as low, max(l_partkey) as high from lineitem")
def _(spark, d):
    low = Monoid("low", F.min, 2147483647)
    high = Monoid("high", F.max, -2147483648)
    return lines(spark, d).aggregate_df({"low": low.over(c("l_partkey")), "high": high.over(c("l_partkey"))})


@query("product_by_key", "select l_orderkey as key, product(l_linenumber) as value from lineitem group by l_orderkey")
def _(spark, d):
    return lines(spark, d).group_map_aggregate(c("l_orderkey"), c("l_linenumber"), "product").df


@query("product_small", "select product(r_regionkey + 1) as value from region")
def _(spark, d):
    return Flow(table(spark, d, "region")).product_df(c("r_regionkey") + 1)


@query("count_even", "select count(*) filter (where l_linenumber % 2 = 0) as n from lineitem")
def _(spark, d):
    return lines(spark, d).count_df(c("l_linenumber") % 2 == 0, "n")


@query("foreach_count", "select count(*) as n from lineitem where l_partkey % 7 = 3")
def _(spark, d):
    """The side effect: an accumulator, to which each task adds its rows."""
    met = spark.sparkContext.accumulator(0)
    lines(spark, d).filter(c("l_partkey") % 7 == 3).map("l_partkey").foreach(lambda rows: met.add(sum(1 for _ in rows)))
    return spark.range(1).select(F.lit(met.value).cast("bigint").alias("n"))


@query("product_exact", "select cast(list_reduce(list(cast(n_nationkey + 1 as hugeint)), lambda a, x: a * x) as varchar) as value from nation")
def _(spark, d):
    exact = Flow(table(spark, d, "nation")).product_exact_df(c("n_nationkey") + 1)
    return exact.select(c("value").cast("string").alias("value"))


@query(
    "product_wrapped",
    """with p as (select list_reduce(list(cast(2 * l_linenumber + 1 as hugeint)), lambda a, x: (a * x) % 18446744073709551616) as v from lineitem)
    select cast(if(v >= 9223372036854775808, v - 18446744073709551616, v) as bigint) as value from p""",
)
def _(spark, d):
    return lines(spark, d).product_exact_df(2 * c("l_linenumber") + 1, wrap=True)


@query("min_max", "select min(l_extendedprice) as low, max(l_extendedprice) as high from lineitem")
def _(spark, d):
    return lines(spark, d).aggregate_df({"low": F.min("l_extendedprice"), "high": F.max("l_extendedprice")})


@query("min_custom_order", "select o_orderkey as dearest from orders order by o_totalprice desc, o_orderkey limit 1")
def _(spark, d):
    return Flow(table(spark, d, "orders")).min_df(c("o_orderkey"), F.struct(-c("o_totalprice"), c("o_orderkey")), "dearest")


@query("max_custom_order", "select o_orderkey as last from orders order by o_orderpriority desc, o_orderkey desc limit 1")
def _(spark, d):
    return Flow(table(spark, d, "orders")).max_df(c("o_orderkey"), F.struct("o_orderpriority", "o_orderkey"), "last")


@query(
    "min_max_tuple",
    """select a.l_partkey as low_part, a.l_suppkey as low_supp, b.l_partkey as high_part, b.l_suppkey as high_supp
    from (select l_partkey, l_suppkey from lineitem order by 1, 2 limit 1) a, (select l_partkey, l_suppkey from lineitem order by 1 desc, 2 desc limit 1) b""",
)
def _(spark, d):
    pair = F.struct("l_partkey", "l_suppkey")
    got = lines(spark, d).aggregate_df({"low": F.min(pair), "high": F.max(pair)})
    return got.select(c("low.l_partkey").alias("low_part"), c("low.l_suppkey").alias("low_supp"), c("high.l_partkey").alias("high_part"), c("high.l_suppkey").alias("high_supp"))


# -- search


@query("find_first", "select o_orderkey, o_custkey from orders where o_totalprice > 100000 order by o_orderkey limit 1")
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return Flow(orders, ["o_orderkey"]).find(c("o_totalprice") > 100000).select("o_orderkey", "o_custkey")


@query("find_none", "select o_orderkey, o_custkey from orders where o_totalprice < 0 limit 1")
def _(spark, d):
    return Flow(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")).find(c("o_totalprice") < 0).select("o_orderkey", "o_custkey")


@query("exists_gt", "select coalesce(bool_or(l_quantity > 49), false) as held from lineitem")
def _(spark, d):
    return lines(spark, d).exists_df(c("l_quantity") > 49, "held")


@query("exists_empty", "select coalesce(bool_or(l_quantity > 49), false) as held from lineitem where l_quantity < 0")
def _(spark, d):
    return lines(spark, d).filter(c("l_quantity") < 0).exists_df(c("l_quantity") > 49, "held")


@query("forall_lt", "select coalesce(bool_and(l_quantity < 51), true) as held from lineitem")
def _(spark, d):
    return lines(spark, d).forall_df(c("l_quantity") < 51, "held")


@query("forall_empty", "select coalesce(bool_and(l_quantity > 49), true) as held from lineitem where l_quantity < 0")
def _(spark, d):
    return lines(spark, d).filter(c("l_quantity") < 0).forall_df(c("l_quantity") > 49, "held")


# -- map, flat_map, filter


@query("map_sqrt_int", "select o_orderkey, cast(trunc(sqrt(o_orderkey)) as int) as root from orders")
def _(spark, d):
    return Flow(table(spark, d, "orders")).map("o_orderkey", F.sqrt("o_orderkey").cast("int").alias("root")).df


@query("map_opaque", "select o_orderkey as value, cast(trunc(sqrt(o_orderkey)) as bigint) as root from orders")
def _(spark, d):
    def roots(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            root = pc.trunc(pc.sqrt(pc.cast(b.column(0), pa.float64())))
            yield pa.RecordBatch.from_arrays([b.column(0), pc.cast(root, pa.int64())], names=["value", "root"])

    return Flow(table(spark, d, "orders").select("o_orderkey")).map_batches(roots, "value bigint, root bigint").df


@query("flat_map", "select l_orderkey, l_linenumber * f as value from lineitem, (values (2), (3)) as t(f)")
def _(spark, d):
    return lines(spark, d).flat_map(F.array(c("l_linenumber") * 2, c("l_linenumber") * 3), keep=["l_orderkey"]).df


@query("for3", "select l_orderkey + a * b as value, count(*) as n from lineitem, (values (2), (3)) as t(a), (values (5), (7)) as u(b) group by 1")
def _(spark, d):
    step = lines(spark, d).flat_map(F.array(F.lit(2), F.lit(3)), "a", keep=["l_orderkey"])
    step = step.flat_map(F.array(F.lit(5), F.lit(7)), "b", keep=["l_orderkey", "a"])
    return step.map((c("l_orderkey") + c("a") * c("b")).alias("value")).df.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("filter_mod3", "select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey % 3 = 0")
def _(spark, d):
    return lines(spark, d).filter(c("l_partkey") % 3 == 0).df.select("l_orderkey", "l_linenumber", "l_partkey")


@query("filter_cos", "select l_orderkey, l_linenumber, l_partkey from lineitem where cos(l_partkey) > 0")
def _(spark, d):
    return lines(spark, d).filter(F.cos("l_partkey") > 0).df.select("l_orderkey", "l_linenumber", "l_partkey")


@query("set_map", "select distinct l_partkey * 2 as value from lineitem")
def _(spark, d):
    return lines(spark, d).map((c("l_partkey") * 2).alias("value"), mode="set").df


@query("set_flat_map", "select distinct l_partkey * f as value from lineitem, (values (2), (3)) as t(f)")
def _(spark, d):
    return lines(spark, d).flat_map(F.array(c("l_partkey") * 2, c("l_partkey") * 3), mode="set").df


@query("set_filter", "select distinct l_suppkey as value from lineitem where l_suppkey % 2 = 1")
def _(spark, d):
    return lines(spark, d).filter(c("l_suppkey") % 2 == 1).map(c("l_suppkey").alias("value"), mode="set").df


def _first_or_last(which: str) -> str:
    return f"""select k, v from (select l_orderkey % 1000 as k, l_partkey as v, row_number() over (partition by l_orderkey % 1000
    order by l_orderkey {which}, l_linenumber {which}, l_partkey {which}, l_suppkey {which}) as r from lineitem) where r = 1"""


@query("map_first", _first_or_last("asc"))
def _(spark, d):
    return lines(spark, d).map((c("l_orderkey") % 1000).alias("k"), c("l_partkey").alias("v"), mode="map_first", keys=["k"]).df.select("k", "v")


@query("map_last", _first_or_last("desc"))
def _(spark, d):
    return lines(spark, d).map((c("l_orderkey") % 1000).alias("k"), c("l_partkey").alias("v"), mode="map_last", keys=["k"]).df.select("k", "v")


# -- keyed


@query("group_map_aggregate", "select l_partkey % 15 as key, cast(sum(l_linenumber) as bigint) as value from lineitem group by 1")
def group_map_aggregate(spark, d):
    return lines(spark, d).group_map_aggregate(c("l_partkey") % 15, c("l_linenumber"), "sum").df


@query("group_map_max", "select l_suppkey as key, max(l_extendedprice) as value from lineitem group by 1")
def _(spark, d):
    return lines(spark, d).group_map_aggregate(c("l_suppkey"), c("l_extendedprice"), "max").df


@query("group_by_bag", "select l_orderkey as key, list_sort(list(l_linenumber)) as members from lineitem group by 1")
def _(spark, d):
    return lines(spark, d).group_by(c("l_orderkey"), c("l_linenumber")).df


@query("group_by_set", "select l_suppkey as key, list_sort(list(distinct l_linenumber)) as members from lineitem group by 1")
def _(spark, d):
    return lines(spark, d).group_by(c("l_suppkey"), c("l_linenumber"), "set").df


# -- sequences


@query(
    "copy_to_array_slice",
    """select slot, o_orderkey from (select row_number() over (order by o_orderkey) - 1 as slot, o_orderkey, count(*) over () as n from orders)
    where slot >= n // 7 and slot < n // 7 + n // 2""",
)
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    return Flow(orders, ["o_orderkey"]).slice(lambda n: n // 7, lambda n: n // 2).df


@query("tree_set", "select cast(row_number() over (order by p_name) - 1 as bigint) as slot, p_name from (select distinct p_name from part)")
def _(spark, d):
    return sequence.number_rows(table(spark, d, "part").select("p_name").distinct(), ["p_name"])


@query(
    "conc_concat",
    """select c_custkey as idx, c_nationkey as value from customer union all
    select s_suppkey + (select max(c_custkey) + 1 from customer) as idx, s_nationkey as value from supplier""",
)
def _(spark, d):
    left = table(spark, d, "customer").select(c("c_custkey").alias("idx"), c("c_nationkey").alias("value"))
    right = table(spark, d, "supplier").select(c("s_suppkey").alias("idx"), c("s_nationkey").alias("value"))
    return sequence.concat(left, right)


@query(
    "conc_append_prepend",
    """select cast(0 as bigint) as idx, -1 as value union all select n_nationkey + 1, n_regionkey from nation
    union all select (select max(n_nationkey) from nation) + 2, -2""",
)
def _(spark, d):
    seq = table(spark, d, "nation").select(c("n_nationkey").cast("bigint").alias("idx"), c("n_regionkey").alias("value"))
    ends = [spark.range(1).select(F.lit(v).alias("value")) for v in (-1, -2)]
    return sequence.append(sequence.prepend(seq, ends[0]), ends[1])


@query("conc_reduce", "select cast(sum(value) as bigint) as total from (select c_nationkey as value from customer union all select s_nationkey from supplier)")
def _(spark, d):
    return Flow(QUERIES["conc_concat"](spark, d), ["idx"]).reduce_df("sum", c("value"), "total")


@query("zip_with", "select n_nationkey as idx, n_regionkey * 10 + r_regionkey as value from nation join region on n_nationkey = r_regionkey")
def _(spark, d):
    left = table(spark, d, "nation").select(c("n_nationkey").alias("idx"), "n_regionkey")
    right = table(spark, d, "region").select(c("r_regionkey").alias("idx"), "r_regionkey")
    return sequence.zip_with(left, right).select("idx", (c("n_regionkey") * 10 + c("r_regionkey")).alias("value"))


# -- accumulators


@query("accumulate_bounds", "select min(embedding[1]) as min_x, min(embedding[2]) as min_y, max(embedding[1]) as max_x, max(embedding[2]) as max_y from embeddings")
def _(spark, d):
    points = table(spark, d, "embeddings").select(c("embedding")[0].alias("x"), c("embedding")[1].alias("y"))
    return bodies.bounds(points)


@query(
    "accumulate_sectors",
    """with p as (select cast(embedding[1] as double) as x, cast(embedding[2] as double) as y from embeddings),
    b as (select min(x) as lx, max(x) as hx, min(y) as ly, max(y) as hy from p)
    select cast(least(floor((x - lx) / (hx - lx) * 16), 15) as int) as sx, cast(least(floor((y - ly) / (hy - ly) * 16), 15) as int) as sy, count(*) as n
    from p, b group by 1, 2""",
)
def _(spark, d):
    points = table(spark, d, "embeddings").select(c("embedding")[0].cast("double").alias("x"), c("embedding")[1].cast("double").alias("y"))
    return bodies.sectors(points).groupBy("sx", "sy").agg(F.count(F.lit(1)).alias("n"))


class _Spread:
    """Greatest and least value seen, as an accumulator whose state is a pair."""

    def zero(self):
        return None

    def add(self, state, row):
        return self.merge(state, (row[0], row[0]))

    def merge(self, left, right):
        if left is None or right is None:
            return left or right
        return min(left[0], right[0]), max(left[1], right[1])

    def finish(self, state):
        return (None,) if state is None else (state[1] - state[0],)


@query("accumulate_custom", "select l_suppkey, max(l_partkey) - min(l_partkey) as spread from lineitem group by 1")
def _(spark, d):
    return lines(spark, d).accumulate(_Spread(), ["l_partkey"], "spread bigint", ["l_suppkey"])


class _Balance:
    """Exact total of decimals in Arrow batches; NULL where a group has none."""

    def zero(self):
        return None

    def add_batch(self, state, columns):
        import pyarrow.compute as pc

        return self.merge(state, pc.sum(columns[0]).as_py())

    def merge(self, left, right):
        return right if left is None else left if right is None else left + right

    def finish(self, state):
        return (state,)


@query(
    "accumulate_decimal",
    """select l_suppkey % 7 as key, sum(if(l_suppkey % 7 = 3, null, cast(l_quantity as decimal(12,2)))) as total from lineitem group by 1""",
)
def _(spark, d):
    amount = F.when(c("l_suppkey") % 7 != 3, c("l_quantity").cast("decimal(12,2)"))
    flow = Flow(table(spark, d, "lineitem").select((c("l_suppkey") % 7).alias("key"), amount.alias("amount")))
    return flow.accumulate(_Balance(), ["amount"], "total decimal(38,2)", ["key"])


# -- lists in a row


def _per_order(spark, d) -> DataFrame:
    row = F.struct(*LINE[1:])
    items = F.transform(F.array_sort(F.collect_list(row)), lambda s: s["l_linenumber"].cast("bigint"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(items.alias("items"))


@query(
    "list_fold_left",
    """select l_orderkey, list_reduce(list_prepend(cast(0 as bigint), list(cast(l_linenumber as bigint) order by l_linenumber, l_partkey, l_suppkey)),
    lambda a, x: (a * 3 + x) % 1000003) as folded from lineitem group by 1""",
)
def _(spark, d):
    folded = lists.list_fold_left(c("items"), F.lit(0).cast("bigint"), lambda a, x: (a * 3 + x) % 1000003)
    return _per_order(spark, d).select("l_orderkey", folded.alias("folded"))


@query(
    "list_verbs",
    """select l_orderkey, cast(sum(l_linenumber) as bigint) as total, cast(product(l_linenumber) as bigint) as product, cast(min(l_linenumber) as bigint) as low,
    cast(max(l_linenumber) as bigint) as high, cast(max(l_linenumber) as bigint) as reduced, cast(sum(l_linenumber) as bigint) as aggregated,
    count(*) filter (where l_linenumber > 3) as n from lineitem group by 1""",
)
def _(spark, d):
    xs, zero = c("items"), F.lit(0).cast("bigint")
    return _per_order(spark, d).select(
        "l_orderkey",
        lists.list_sum(xs).alias("total"),
        lists.list_product(xs).alias("product"),
        lists.list_min(xs).alias("low"),
        lists.list_max(xs).alias("high"),
        lists.list_reduce(xs, lambda a, x: F.greatest(a, x)).alias("reduced"),
        lists.list_aggregate(xs, zero, combine=lambda a, b: a + b, step=lambda a, x: a + x).alias("aggregated"),
        lists.list_count(xs, lambda x: x > 3).alias("n"),
    )


# -- ranges and pipelines


@query("range_stride", "select i as idx, 100000 - 13 * i as value from range(7693) as t(i)")
def _(spark, d):
    return Range(100000, 0, -13).frame(spark)


@query("range_closed_forms", "select cast(sum(100000 - 13 * i) as bigint) as total, min(100000 - 13 * i) as low, max(100000 - 13 * i) as high from range(7693) as t(i)")
def _(spark, d):
    r = Range(100000, 0, -13)
    return spark.range(1).select(F.lit(r.sum()).cast("bigint").alias("total"), F.lit(r.min()).cast("bigint").alias("low"), F.lit(r.max()).cast("bigint").alias("high"))


@query("pipeline_euler1", "select cast(sum(range) as bigint) as total from range(3000000) where range % 3 = 0 or range % 5 = 0")
def _(spark, d):
    return pipelines.multiples_sum(spark, 3_000_000)


@query("pipeline_nested", "select cast(sum(y.range + 1) as bigint) as total from range(2000) x, range(200) y where (y.range + 1) % 2 = x.range % 2 and (y.range + 1) % 3 = 0")
def _(spark, d):
    return pipelines.nested_sum(spark, 2000, 200)


# -- programs


def _rank_sql(steps: int) -> str:
    ctes = ["e as (select l_partkey as src, l_suppkey + 1000000 as dst from lineitem)", "nodes as (select src as node from e union select dst from e)"]
    ctes += ["deg as (select src as node, count(*) as k from e group by 1)", "total as (select count(*) as n from nodes)", "r0 as (select node, 1.0::double / n as rank from nodes, total)"]
    for i in range(steps):
        ctes.append(
            f"r{i + 1} as (select a.node, 0.15 / n + 0.85 * (dangling / n + coalesce(received, 0)) as rank from nodes a cross join total "
            f"cross join (select coalesce(sum(rank), 0) as dangling from r{i} where node not in (select node from deg)) "
            f"left join (select dst, sum(rank / k) as received from e join r{i} on src = node join deg on deg.node = src group by 1) g on g.dst = a.node)"
        )
    return f"with {', '.join(ctes)} select node, round(rank, 10) as rank from r{steps}"


@query("pagerank", _rank_sql(3))
def _(spark, d):
    edges = table(spark, d, "lineitem").select(c("l_partkey").alias("src"), (c("l_suppkey") + 1000000).alias("dst"))
    return pagerank.pagerank(edges, iterations=3, tolerance=0).select("node", F.round("rank", 10).alias("rank"))


@query(
    "mandelbrot",
    """with recursive px as (select range as idx, -2.0::double + (range % 60) * (3.0::double / 60) as cx, -1.0::double + (range // 60) * (2.0::double / 40) as cy from range(2400)),
    z as (select idx, cx, cy, 0.0::double as x, 0.0::double as y, cast(0 as bigint) as n from px
    union all select idx, cx, cy, x * x - y * y + cx, 2.0 * x * y + cy, n + 1 from z where x * x + y * y < 2.0 and n < 60)
    select idx, max(n) as iterations from z group by 1""",
)
def _(spark, d):
    return images.mandelbrot(spark, 60, 40, 60)


@query(
    "ray_trace",
    """with s as (select * from (values (0, 0.0::double, 0.0::double, 4.0::double, 1.0::double), (1, 1.5, 0.5, 5.0, 1.0), (2, -1.5, -0.5, 3.0, 0.5)) as t(k, cx, cy, cz, r)),
    p as (select range as idx, (range % 80 + 0.5::double) / 80 * 2 - 1 as x, 1 - (range // 80 + 0.5::double) / 60 * 2 as y from range(4800)),
    v as (select idx, x / sqrt(x * x + y * y + 1) as x, y / sqrt(x * x + y * y + 1) as y, 1 / sqrt(x * x + y * y + 1) as z from p),
    h as (select idx, k, x, y, z, cx * x + cy * y + cz * z as b, r * r - (cx * cx + cy * cy + cz * cz - (cx * x + cy * y + cz * z) ** 2) as inside from v, s),
    n as (select idx, x, y, z, min(b - sqrt(inside)) as far, arg_min(k, b - sqrt(inside)) as k from h where inside > 0 and b - sqrt(inside) > 1e-6 group by all),
    q as (select idx, n.k, x * far as x, y * far as y, z * far as z, (x * far - cx) / r as nx, (y * far - cy) / r as ny, (z * far - cz) / r as nz from n join s on s.k = n.k),
    l as (select *, sqrt((5 - x) ** 2 + (5 - y) ** 2 + (-5 - z) ** 2) as away from q),
    m as (select idx, x, y, z, nx, ny, nz, away, (5 - x) / away as lx, (5 - y) / away as ly, (-5 - z) / away as lz from l),
    o as (select idx, away, (cx - x) * lx + (cy - y) * ly + (cz - z) * lz as b, r * r - ((cx - x) ** 2 + (cy - y) ** 2 + (cz - z) ** 2 - ((cx - x) * lx + (cy - y) * ly + (cz - z) * lz) ** 2) as inside from m, s),
    dark as (select distinct idx from o where inside > 0 and b - sqrt(inside) > 1e-6 and b - sqrt(inside) < away)
    select p.idx, round(case when m.idx is null then 0 when dark.idx is not null then 0.1 else 0.1 + 0.9 * greatest(nx * lx + ny * ly + nz * lz, 0) end, 9) as shade
    from p left join m using (idx) left join dark using (idx)""",
)
def _(spark, d):
    seen = images.ray_trace(spark, 80, 60, [(0, 0, 4, 1), (1.5, 0.5, 5, 1), (-1.5, -0.5, 3, 0.5)])
    return seen.select("idx", F.round("shade", 9).alias("shade"))


def _points(spark, d) -> DataFrame:
    e = c("embedding")
    return table(spark, d, "embeddings").select(c("vec_id").alias("id"), *[e[i].cast("double").alias(n) for i, n in enumerate(("x", "y", "vx", "vy"))], F.lit(1.0).alias("mass"))


def _rounded(moved: DataFrame) -> DataFrame:
    return moved.select("id", *[F.round(n, 8).alias(n) for n in ("x", "y", "vx", "vy")])


_POINTS = "p as (select vec_id as id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(embedding[3] as double) as vx, cast(embedding[4] as double) as vy from embeddings)"


@query(
    "barnes_hut_step",
    f"""with recursive {_POINTS}, b as (select min(x) as lx, min(y) as ly, greatest(max(x) - min(x), max(y) - min(y)) as side, count(*) as n from p),
    k as (select *, (select min(range) from range(1, 20) where 8 * 4 ** range >= n)::bigint as deep from b),
    c as (select p.*, side, deep, least(floor((x - lx) / side * 2 ** deep), 2 ** deep - 1)::bigint as sx, least(floor((y - ly) / side * 2 ** deep), 2 ** deep - 1)::bigint as sy from p, k),
    g as (select level, sx >> (deep - level) as cx, sy >> (deep - level) as cy, count(*) as n, sum(x) / count(*) as gx, sum(y) / count(*) as gy from c, range(1, 20) t(level) where level <= deep group by all),
    w as (select c.id, c.x, c.y, c.sx, c.sy, side, deep, level, cx, cy, n, gx, gy from c join g on level = 1
    union all select w.id, w.x, w.y, w.sx, w.sy, side, deep, g.level, g.cx, g.cy, g.n, g.gx, g.gy from w join g on g.level = w.level + 1 and g.cx >> 1 = w.cx and g.cy >> 1 = w.cy
    where w.n > 1 and ((w.sx >> (deep - w.level) = w.cx and w.sy >> (deep - w.level) = w.cy) or (side / 2 ** w.level) ** 2 >= 0.25 * ((w.gx - w.x) ** 2 + (w.gy - w.y) ** 2))),
    s as (select *, sx >> (deep - level) = cx and sy >> (deep - level) = cy as own from w),
    a as (select id, gx - x as dx, gy - y as dy, n as mass from s where not own and (n = 1 or (side / 2 ** level) ** 2 < 0.25 * ((gx - x) ** 2 + (gy - y) ** 2))
    union all select s.id, c.x - s.x, c.y - s.y, 1 from s join c on s.level = s.deep and s.cx = c.sx and s.cy = c.sy and s.id <> c.id
    where s.n > 1 and (own or (s.side / 2 ** level) ** 2 >= 0.25 * ((gx - s.x) ** 2 + (gy - s.y) ** 2))),
    f as (select id, sum(dx * mass / (dx * dx + dy * dy + 1) ** 1.5) as ax, sum(dy * mass / (dx * dx + dy * dy + 1) ** 1.5) as ay from a group by id)
    select id, round(x + (vx + coalesce(ax, 0) * 0.1) * 0.1, 8) as x, round(y + (vy + coalesce(ay, 0) * 0.1) * 0.1, 8) as y,
    round(vx + coalesce(ax, 0) * 0.1, 8) as vx, round(vy + coalesce(ay, 0) * 0.1, 8) as vy from p left join f using (id)""",
)
def _(spark, d):
    return _rounded(bodies.nbody_step(_points(spark, d)))


@query(
    "flock_step",
    f"""with {_POINTS}, b as (select min(x) as lx, max(x) as hx, min(y) as ly, max(y) as hy from p),
    c as (select p.*, least(floor((x - lx) / (hx - lx) * 32), 31)::int as sx, least(floor((y - ly) / (hy - ly) * 32), 31)::int as sy from p, b),
    m as (select u.id, avg(o.x) as x, avg(o.y) as y, avg(o.vx) as vx, avg(o.vy) as vy from c u join c o on abs(u.sx - o.sx) <= 1 and abs(u.sy - o.sy) <= 1 group by u.id),
    v as (select c.id, c.x, c.y, c.vx + 0.1 * (m.vx - c.vx) + 0.05 * (m.x - c.x) as vx, c.vy + 0.1 * (m.vy - c.vy) + 0.05 * (m.y - c.y) as vy from c join m using (id))
    select id, round(x + vx, 8) as x, round(y + vy, 8) as y, round(vx, 8) as vx, round(vy, 8) as vy from v""",
)
def _(spark, d):
    return _rounded(bodies.flock_step(_points(spark, d).drop("mass")))


@query(
    "windowed_group_aggregate",
    "select time_bucket(interval '1 hour', ts) as window_start, event_type as key, count(*) as value from events group by 1, 2",
)
def _(spark, d):
    from millrace.streaming.windowed import windowed_group_aggregate

    return windowed_group_aggregate(table(spark, d, "events"), "ts", c("event_type"), c("event_id"), "count", "1 hour")
