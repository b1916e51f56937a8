import math
import random

from pyspark.sql import functions as F

from millrace.plans import bodies, images
from millrace.plans.pagerank import pagerank
from millrace.streaming.windowed import windowed_group_aggregate


def test_pagerank_converges(spark):
    rnd = random.Random(3)
    edges = [(a, rnd.randrange(30)) for a in range(25) for _ in range(3)]
    nodes = sorted({x for e in edges for x in e})
    rank = {n: 1 / len(nodes) for n in nodes}
    out = {n: [d for s, d in edges if s == n] for n in nodes}
    for _ in range(30):
        got = {n: 0.0 for n in nodes}
        dangling = sum(rank[n] for n in nodes if not out[n])
        for n in nodes:
            for d in out[n]:
                got[d] += rank[n] / len(out[n])
        rank = {n: 0.15 / len(nodes) + 0.85 * (dangling / len(nodes) + got[n]) for n in nodes}
    frame = spark.createDataFrame(edges, "src bigint, dst bigint")
    result = {r.node: r["rank"] for r in pagerank(frame, iterations=30, tolerance=0).collect()}
    assert result.keys() == rank.keys() and all(abs(result[n] - rank[n]) < 1e-9 for n in nodes)
    assert abs(sum(result.values()) - 1) < 1e-9
    assert pagerank(frame.where("src < 0")).count() == 0


def test_pagerank_of_a_hot_source(spark):
    """A node with most of the edges and a sink: against the same sums in plain words."""
    edges = [(0, i) for i in range(1, 200)] + [(i, 0) for i in range(1, 50)] + [(3, 4), (3, 4)]
    rank = dict.fromkeys(range(200), 1 / 200)
    for _ in range(5):
        lost = sum(v for k, v in rank.items() if k >= 50)
        got = dict.fromkeys(range(200), 0.0)
        for a, b in edges:
            got[b] += rank[a] / sum(x == a for x, _ in edges)
        rank = {k: 0.15 / 200 + 0.85 * (lost / 200 + got[k]) for k in rank}
    result = {r.node: r["rank"] for r in pagerank(spark.createDataFrame(edges, "src bigint, dst bigint"), iterations=5).collect()}
    assert result.keys() == rank.keys() and all(abs(result[k] - rank[k]) < 1e-12 for k in rank)


def test_nbody_step_without_far_cells_is_exact(spark):
    """No cell is small enough for theta 0; 0.5 is near that."""
    rnd = random.Random(5)
    rows = [(i, rnd.random(), rnd.random(), 0.0, 0.0, 1.0 + rnd.random()) for i in range(40)]
    frame = spark.createDataFrame(rows, "id bigint, x double, y double, vx double, vy double, mass double")
    got = {r.id: r for r in bodies.nbody_step(frame, theta=0).collect()}
    for i, x, y, *_ in rows:
        ax = ay = 0.0
        for j, u, v, _, _, m in rows:
            if i != j:
                d2 = (u - x) ** 2 + (v - y) ** 2 + 1.0
                ax, ay = ax + m * (u - x) / (d2 * math.sqrt(d2)), ay + m * (v - y) / (d2 * math.sqrt(d2))
        assert abs(got[i].vx - 0.1 * ax) < 1e-9 and abs(got[i].y - (y + 0.01 * ay)) < 1e-9
    near = {r.id: r for r in bodies.nbody_step(frame, leaf=1).collect()}
    assert 0 < max(abs(near[i].vx - got[i].vx) for i in near) < 0.2


def test_one_body_and_flock(spark):
    one = spark.createDataFrame([(1, 2.0, 3.0, 0.5, 0.0, 1.0)], "id bigint, x double, y double, vx double, vy double, mass double")
    r = bodies.nbody_step(one).first()
    assert (round(r.x, 9), r.y, r.vx) == (2.05, 3.0, 0.5)
    assert bodies.flock_step(one.drop("mass")).first().x == 2.5
    assert bodies.bounds(one.where("id > 1")).first().min_x is None


def test_images(spark):
    got = {r.idx: r.iterations for r in images.mandelbrot(spark, 6, 4, 50).collect()}
    for idx in range(24):
        c = complex(-2 + (idx % 6) * 0.5, -1 + (idx // 6) * 0.5)
        z, n = 0j, 0
        while abs(z) ** 2 < 2 and n < 50:
            z, n = z * z + c, n + 1
        assert got[idx] == n
    shade = [r.shade for r in images.ray_trace(spark, 20, 20, [(0, 0, 4, 1)]).orderBy("idx").collect()]
    assert shade[0] == 0 and shade[210] > 0 and max(shade) <= 1
    assert {r.shade for r in images.ray_trace(spark, 4, 4, []).collect()} == {0.0}


def test_stream_and_batch_agree(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 37 + 1_700_000_000).alias("ts"), (F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = windowed_group_aggregate(rows, "ts", F.col("k"), F.col("v"), "sum", "10 minutes")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = windowed_group_aggregate(stream, "ts", F.col("k"), F.col("v"), "sum", "10 minutes", "1 hour")
    query = out.writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("windowed").collect())) == sorted(map(tuple, batch.collect()))
