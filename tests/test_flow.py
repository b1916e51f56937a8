"""The verbs against plain Python on a ladder of sizes, and the decisions on empty input, order, ties and keys."""

import functools
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace import Flow
from millrace.functions import lists
from millrace.functions.monoids import PRODUCT, REGISTRY, SUM, Monoid, resolve
from millrace.operators import sequence
from millrace.operators.flow import EmptyFlowError
from millrace.operators.materialize import materialize
from millrace.sources import Range, empty_like, one_row
from millrace.sources.partitioned import partitioned

X = None


@pytest.fixture(autouse=True)
def value_column(spark):
    global X
    X = F.col("value")


LADDER = [range(0), range(1), range(7), range(100, 0, -1), range(0, 1000, 13), range(5, 6, 1000), range(1000, 1, -100000), range(0, 5000, 29)]


def flow(spark, r):
    return Flow(Range(r.start, r.stop, r.step).frame(spark), ["idx"])


@pytest.mark.parametrize("r", LADDER, ids=str)
def test_reductions(spark, r):
    f, xs = flow(spark, r), list(r)
    row = f.aggregate_df({
        "n": F.count(F.lit(1)), "sum": SUM.over(X), "min": F.min(X), "max": F.max(X), "even": F.count_if(X % 2 == 0),
        "any": REGISTRY["any"].over(X > 50), "all": REGISTRY["all"].over(X > 50), "xor": REGISTRY["bit_xor"].over(X),
    }).first()
    assert tuple(row) == (len(xs), sum(xs), min(xs, default=None), max(xs, default=None), sum(x % 2 == 0 for x in xs), any(x > 50 for x in xs), all(x > 50 for x in xs), functools.reduce(lambda a, b: a ^ b, xs, 0))
    source = Range(r.start, r.stop, r.step)
    assert (source.sum(), source.min(), source.max(), len(source)) == (row["sum"], row["min"], row["max"], len(xs))


@pytest.mark.parametrize("r", LADDER, ids=str)
def test_collections(spark, r):
    f, xs = flow(spark, r), list(r)
    values = lambda g: sorted(x[0] for x in g.df.select("value").collect())
    assert values(f.map((X * 2).alias("value"))) == sorted(x * 2 for x in xs)
    assert values(f.map((X % 5).alias("value"), mode="set")) == sorted({int(math.fmod(x, 5)) for x in xs})
    assert values(f.filter(X % 3 == 0)) == sorted(x for x in xs if x % 3 == 0)
    assert values(f.flat_map(F.array(X, X + 1))) == sorted(y for x in xs for y in (x, x + 1))
    n = len(xs)
    assert [x[1] for x in f.copy_to_list(n // 7, n // 2)] == xs[n // 7 : n // 7 + n // 2]
    ordered = f.flat_map(F.array(X, -X), mode="ordered")
    assert [x.value for x in ordered.df.collect()] == [y for x in xs for y in (x, -x)]
    groups = {x.key: list(x.members) for x in f.group_by(X % 3, X).df.collect()}
    want = {}
    for x in xs:
        want.setdefault(int(math.fmod(x, 3)), []).append(x)
    assert groups == {k: sorted(v) for k, v in want.items()}
    sums = {x.key: x.value for x in f.group_map_aggregate(X % 3, X, "sum").df.collect()}
    assert sums == {k: sum(v) for k, v in want.items()}


def test_search(spark):
    f = flow(spark, range(100, 0, -1))
    assert f.find(X < 50).first().value == 49
    assert f.find(X > 1000).count() == 0
    assert f.exists(X == 7) and not f.exists(X == 700) and f.forall(X > 0) and not f.forall(X > 1)
    nothing = flow(spark, range(0))
    assert not nothing.exists(X == 7) and nothing.forall(X > 1) and nothing.find(X == 7).count() == 0
    nulls = Flow(spark.createDataFrame([(1,), (None,)], "value int"))
    assert not nulls.forall(X > 0) and nulls.forall_df(X > 0).first()[0] is False
    assert nulls.exists(X > 0) and not nulls.exists(X > 1)


def test_empty_policy_and_zero(spark):
    nothing = flow(spark, range(0))
    assert nothing.reduce("max", X) is None and nothing.value(nothing.fold_df(0, "sum", X)) == 0
    assert nothing.value(nothing.product_df(X)) == 1.0
    with pytest.raises(EmptyFlowError):
        nothing.reduce("min", X, on_empty="error")
    with pytest.raises(ValueError):
        nothing.fold_df(1, "sum", X)
    with pytest.raises(KeyError):
        resolve("median")
    low = Monoid("low", F.min, 2147483647)
    assert nothing.fold_df(2147483647, low, X).first()[0] == 2147483647 and resolve(PRODUCT) is PRODUCT


def test_map_keeps_first_or_last(spark):
    f = flow(spark, range(50))
    for mode, want in (("map_first", {k: k for k in range(7)}), ("map_last", {x % 7: x for x in range(50)})):
        got = f.map((X % 7).alias("k"), X.alias("v"), mode=mode, keys=["k"]).df.collect()
        assert {x.k: x.v for x in got} == want
    with pytest.raises(ValueError):
        materialize(f.df, "heap")
    with pytest.raises(ValueError):
        materialize(f.df, "map_first", keys=["value"])
    with pytest.raises(ValueError):
        Flow(f.df, ["nowhere"])


def test_sequences(spark):
    def seq(values):
        return spark.createDataFrame(list(enumerate(values)), "idx bigint, value string")

    def read(df):
        return [r.value for r in df.orderBy("idx").collect()]

    a, b, none = seq("abc"), seq("de"), empty_like(seq("a"))
    assert read(sequence.concat(a, b)) == list("abcde")
    assert read(sequence.concat(none, b)) == list("de") and read(sequence.concat(a, none)) == list("abc")
    z = one_row(spark, "value string", ["z"])
    assert read(sequence.append(a, z)) == list("abcz") and read(sequence.prepend(a, z)) == list("zabc")
    assert read(sequence.append(none, z)) == ["z"]
    assert Flow(sequence.zip_with(a, b.withColumnRenamed("value", "w"))).size() == 2
    row = one_row(spark, "a array<int>, b array<int>", [[1, 2, 3], [4]])
    left, right = sequence.array_split(F.col("a"), F.lit(2))
    assert row.select(sequence.array_concat("a", "b"), left, right).first()[:] == ([1, 2, 3, 4], [1, 2], [3])


def test_accumulator_and_partitioned_source(spark):
    class Longest:
        def zero(self):
            return ""

        def add(self, state, row):
            return self.merge(state, row[0] or "")

        def merge(self, a, b):
            return max(a, b, key=lambda s: (len(s), s))

        def finish(self, state):
            return (state,)

    def rows(split, splits):
        for i in range(split, 30, splits):
            yield (i % 4 if i % 5 else None, "x" * i)

    df = partitioned(spark, rows, "k int, s string", 4)
    assert df.count() == 30
    got = {r.k: r.best for r in Flow(df).accumulate(Longest(), ["s"], "best string", ["k"]).collect()}
    want = {}
    for i in range(30):
        k = i % 4 if i % 5 else None
        want[k] = max(want.get(k, ""), "x" * i)
    assert got == want
    assert Flow(df).accumulate(Longest(), ["s"], "best string").first().best == "x" * 29
    assert Flow(df.where("k > 9")).accumulate(Longest(), ["s"], "best string").first().best == ""
    assert Flow(df.where("k > 9")).accumulate(Longest(), ["s"], "best string", ["k"]).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(-1000, 1000), max_size=12), min_size=1, max_size=20))
def test_lists(spark, rows):
    df = spark.createDataFrame([(i, xs) for i, xs in enumerate(rows)], "i int, xs array<bigint>")
    xs, zero = F.col("xs"), F.lit(0).cast("bigint")
    got = df.orderBy("i").select(
        lists.list_sum(xs), lists.list_min(xs), lists.list_max(xs), lists.list_reduce(xs, lambda a, b: a - b),
        lists.list_fold_left(xs, zero, lambda a, b: (a * 3 + b) % 1003), lists.list_count(xs, lambda x: x > 0), lists.list_fold(xs, zero, lambda a, b: a + b),
    ).collect()
    for r, v in zip(got, rows, strict=True):
        fold = functools.reduce(lambda a, b: int(math.fmod(a * 3 + b, 1003)), v, 0)
        assert tuple(r) == (sum(v), min(v, default=None), max(v, default=None), functools.reduce(lambda a, b: a - b, v) if v else None, fold, sum(x > 0 for x in v), sum(v))


def test_product_of_lists(spark):
    df = spark.createDataFrame([([2, 3, 4],), ([],), (None,)], "xs array<bigint>")
    assert sorted(r[0] for r in df.select(lists.list_product(F.col("xs"))).collect()) == [1, 1, 24]


def test_fused_pipeline_is_one_stage(spark):
    f = flow(spark, range(1000)).map((X + 1).alias("value")).map((X * 2).alias("value")).filter(X % 3 == 0)
    plan = f.stages()
    assert plan.count("Exchange") == 0 and plan.count("Project (") + plan.count("Filter (") >= 1
    seen = spark.sparkContext.accumulator(0)
    f.foreach(lambda rows: seen.add(sum(1 for _ in rows)))
    assert seen.value == f.size()


def test_accumulator_results_may_be_null_or_decimal(spark):
    from decimal import Decimal

    from millrace.operators.accumulate import ExactProduct, accumulate

    class Top:
        def zero(self):
            return None

        def add(self, state, row):
            return self.merge(state, row[0])

        def merge(self, left, right):
            return max((x for x in (left, right) if x is not None), default=None)

        def finish(self, state):
            return state, None if state is None else state * 2

    rows = [("a", Decimal("1.50")), ("a", Decimal("-2.25")), ("b", None), (None, Decimal("7.00"))]
    frame = spark.createDataFrame(rows, "k string, v decimal(10,2)").repartition(3)
    got = {r.k: (r.top, r.twice) for r in accumulate(frame, Top(), ["v"], "top decimal(10,2), twice decimal(12,2)", ["k"]).collect()}
    assert got == {"a": (Decimal("1.50"), Decimal("3.00")), "b": (None, None), None: (Decimal("7.00"), Decimal("14.00"))}
    assert accumulate(frame.where("k = 'z'"), Top(), ["v"], "top decimal(10,2), twice decimal(12,2)").collect()[0].top is None
    numbers = spark.createDataFrame([(k, v) for k in (1, 2) for v in (3, None, -(2**40) + 1, 2**33 + 5)], "k int, v bigint").repartition(4)
    exact = 3 * (-(2**40) + 1) * (2**33 + 5)
    assert {r.p for r in accumulate(numbers, ExactProduct(), ["v"], "p decimal(38,0)", ["k"]).collect()} == {Decimal(exact)}
    wrapped = (exact * exact + 2**63) % 2**64 - 2**63
    assert Flow(numbers).product_exact_df(F.col("v"), wrap=True).first()[0] == wrapped
    assert Flow(numbers.where("k > 9")).product_exact_df(F.col("v")).first()[0] == 1


def test_slice_bounds_of_the_size(spark):
    flow = Flow(spark.range(1000).selectExpr("id * 7 % 1000 as v"), ["v"])
    got = sorted(tuple(r) for r in flow.slice(lambda n: n // 4, lambda n: n // 2).df.collect())
    assert got == [(i, i) for i in range(250, 750)]
    assert flow.slice(1000, 5).df.count() == 0 and flow.slice(990, 50).df.count() == 10 and flow.slice(0, -1).df.count() == 0
