import random

from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.prefix import running_sums
from millrace.llm.sieve import Sieve


def test_components_of_chains_stars_and_loops(spark):
    rnd = random.Random(1)
    names = rnd.sample(range(-(1 << 60), 1 << 60), 400)
    links = [(names[i], names[i + 1]) for i in range(150)]  # one long chain
    links += [(names[200], names[i]) for i in range(201, 280)] + [(names[300], names[300]), (names[301], names[302]), (names[302], names[301])]
    rnd.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint").repartition(3)).collect()}
    groups = {}
    for n, r in got.items():
        groups.setdefault(r, set()).add(n)
    want = [set(names[:151]), set(names[200:280]), {names[301], names[302]}]
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want))
    assert all(r in g for r, g in groups.items())
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_sieve_never_loses_a_key(spark):
    keys = spark.range(0, 3000, 3).select(F.col("id").alias("k"))
    rows = spark.range(3000).select(F.when(F.col("id") % 500 != 7, F.col("id")).alias("k"), F.lit("x").alias("v"))
    sieve = Sieve(keys, "k")
    passed = {r.k for r in sieve.passing(rows, "k").collect()}
    out = [r.k for r in sieve.passing(rows, "k", keep=False).collect()]
    assert {k for k in range(0, 3000, 3) if k % 500 != 7} <= passed and len(passed) < 1400
    assert len(passed) + len(out) == 3000 and not passed & set(out)
    assert Sieve(keys.where("k < 0"), "k").passing(rows, "k").count() == 0


def test_running_sums(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", None, "hot", "hot", "hot"]), i, rnd.randrange(5)) for i in range(2000)]
    frame = spark.createDataFrame(rows, "g string, o bigint, v bigint").repartition(7)
    total, want = {}, {}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        want[o] = total.get(g, 0)
        total[g] = total.get(g, 0) + v
    assert {r.o: r.before for r in running_sums(frame, "g", ["o"], "v").collect()} == want
    assert running_sums(frame.where("o < 0"), "g", ["o"], "v").count() == 0
