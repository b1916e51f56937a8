"""Many-body steps: bounds and sector grids as aggregates, forces and flocking through cell summaries.

Forces come from a quadtree whose levels are tables of cells (mass and centre of mass), built upwards by sums. Each body
walks down: a cell that looks small from the body counts as one mass, any other is replaced by its four children, so a
level costs a body a bounded number of rows. Cells meet bodies in equi-joins on the cell, never in a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.shared import settle


def bounds(bodies: DataFrame) -> DataFrame:
    """One row: min_x, min_y, max_x, max_y (NULL over nothing)."""
    return bodies.agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


def cell_of(value: Column, low: Column, high: Column, cells: int) -> Column:
    """0-based cell of ``value`` in [low, high]; the upper edge belongs to the last cell, no extent to cell 0."""
    width = high - low
    at = F.when(width > 0, F.floor((value - low) / width * cells)).otherwise(F.lit(0))
    return F.least(at, F.lit(cells - 1)).cast("int")


def sectors(bodies: DataFrame, cells: int = 16) -> DataFrame:
    """Bodies with their grid cell (sx, sy)."""
    box = F.broadcast(bounds(bodies))  # one row
    out = bodies.crossJoin(box)
    return out.select(
        *bodies.columns,
        cell_of(F.col("x"), F.col("min_x"), F.col("max_x"), cells).alias("sx"),
        cell_of(F.col("y"), F.col("min_y"), F.col("max_y"), cells).alias("sy"),
    )


def sector_summary(placed: DataFrame) -> DataFrame:
    """(sx, sy, n, mass, cx, cy): the cell's bodies, total mass and centre of mass."""
    return placed.groupBy("sx", "sy").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("mass").alias("mass"),
        (F.sum(F.col("x") * F.col("mass")) / F.sum("mass")).alias("cx"),
        (F.sum(F.col("y") * F.col("mass")) / F.sum("mass")).alias("cy"),
    )


def _neighbour_cells() -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))


def nbody_step(bodies: DataFrame, theta: float = 0.5, leaf: int = 8, delta: float = 0.1, softening: float = 1.0, gravity: float = 1.0) -> DataFrame:
    """(id, x, y, vx, vy) after one step of ``delta``; input (id, x, y, vx, vy, mass).

    A cell counts as one mass for a body if its width is less than ``theta`` times the distance to its centre of mass, or
    if it holds one body (the own one is left out). Cells are halved until a cell of an even spread would hold about
    ``leaf`` bodies, at most 20 times; pairs that the last level leaves open are summed body by body.
    """
    box = F.broadcast(bounds(bodies))  # one row
    n = bodies.count()
    levels = next((k for k in range(1, 20) if leaf * 4**k >= n), 20)
    side = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    spot = lambda v, low: F.when(side > 0, F.least(F.floor((F.col(v) - F.col(low)) / side * 2**levels), F.lit(2**levels - 1))).otherwise(0).cast("bigint")
    placed = bodies.crossJoin(box).select(*bodies.columns, spot("x", "min_x").alias("sx"), spot("y", "min_y").alias("sy"), side.alias("side"))
    placed = settle(placed, "placed")
    cells = {levels: settle(placed.groupBy("sx", "sy").agg(F.count(F.lit(1)).alias("n"), F.sum("mass").alias("mass"), F.sum(F.col("x") * F.col("mass")).alias("mx"), F.sum(F.col("y") * F.col("mass")).alias("my")), "cells")}
    for k in range(levels - 1, 0, -1):
        up = cells[k + 1].groupBy(F.shiftright("sx", 1).alias("sx"), F.shiftright("sy", 1).alias("sy"))
        cells[k] = settle(up.agg(*[F.sum(c).alias(c) for c in ("n", "mass", "mx", "my")]), "cells")

    def pull(dx: Column, dy: Column, mass: Column) -> tuple[Column, Column]:
        d2 = dx * dx + dy * dy + F.lit(softening)
        scale = F.lit(gravity) * mass / (d2 * F.sqrt(d2))
        return F.sum(dx * scale).alias("ax"), F.sum(dy * scale).alias("ay")

    quarter = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    down = lambda f: f.withColumn("q", quarter).withColumn("cx", 2 * F.col("cx") + F.col("q.i")).withColumn("cy", 2 * F.col("cy") + F.col("q.j")).drop("q")
    zero = F.lit(0).cast("bigint")
    open_ = down(placed.select("id", "x", "y", "sx", "sy", "side", zero.alias("cx"), zero.alias("cy")))
    forces = []
    for k in range(1, levels + 1):
        cell = cells[k].select(F.col("sx").alias("cx"), F.col("sy").alias("cy"), "n", "mass", (F.col("mx") / F.col("mass")).alias("gx"), (F.col("my") / F.col("mass")).alias("gy"))
        dx, dy = F.col("gx") - F.col("x"), F.col("gy") - F.col("y")
        width = F.col("side") / 2**k
        own = (F.shiftright("sx", levels - k) == F.col("cx")) & (F.shiftright("sy", levels - k) == F.col("cy"))
        # massless cells pull nothing and have no centre
        seen = open_.join(cell.where("mass > 0"), ["cx", "cy"]).where(~((F.col("n") == 1) & own))
        seen = settle(seen.withColumn("far", (F.col("n") == 1) | (~own & (width * width < theta * theta * (dx * dx + dy * dy)))), "seen")
        forces.append(seen.where("far").groupBy("id").agg(*pull(dx, dy, F.col("mass"))))
        open_ = seen.where("not far").select("id", "x", "y", "sx", "sy", "side", "cx", "cy")
        open_ = down(open_) if k < levels else open_
    other = placed.select(F.col("id").alias("oid"), F.col("x").alias("ox"), F.col("y").alias("oy"), "mass", F.col("sx").alias("cx"), F.col("sy").alias("cy"))
    forces.append(open_.join(other, ["cx", "cy"]).where("id <> oid").groupBy("id").agg(*pull(F.col("ox") - F.col("x"), F.col("oy") - F.col("y"), F.col("mass"))))
    force = forces[0]
    for f in forces[1:]:
        force = force.unionByName(f)
    force = force.groupBy("id").agg(F.sum("ax").alias("ax"), F.sum("ay").alias("ay"))
    moved = placed.join(force, "id", "left").select(
        "id", "x", "y",
        (F.col("vx") + F.coalesce("ax", F.lit(0.0)) * delta).alias("vx"),
        (F.col("vy") + F.coalesce("ay", F.lit(0.0)) * delta).alias("vy"),
    )
    return moved.select("id", (F.col("x") + F.col("vx") * delta).alias("x"), (F.col("y") + F.col("vy") * delta).alias("y"), "vx", "vy")


def flock_step(birds: DataFrame, cells: int = 32, align: float = 0.1, cohere: float = 0.05) -> DataFrame:
    """(id, x, y, vx, vy) after one step in which each bird steers to the mean course and centre of the birds in its
    own and the eight cells around; input (id, x, y, vx, vy). Without randomness, so that reruns agree."""
    placed = settle(sectors(birds, cells), "flock")
    cell = placed.groupBy("sx", "sy").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("x", "y", "vx", "vy")])
    spread = cell.select("*", _neighbour_cells().alias("d")).select((F.col("sx") + F.col("d.dx")).alias("sx"), (F.col("sy") + F.col("d.dy")).alias("sy"), "n", "x", "y", "vx", "vy")
    around = spread.groupBy("sx", "sy").agg(F.sum("n").alias("n"), *[(F.sum(c) / F.sum("n")).alias(f"m_{c}") for c in ("x", "y", "vx", "vy")])
    near = placed.join(F.broadcast(around.where(F.col("sx").between(0, cells - 1) & F.col("sy").between(0, cells - 1))), ["sx", "sy"])
    vx = F.col("vx") + align * (F.col("m_vx") - F.col("vx")) + cohere * (F.col("m_x") - F.col("x"))
    vy = F.col("vy") + align * (F.col("m_vy") - F.col("vy")) + cohere * (F.col("m_y") - F.col("y"))
    return near.select("id", (F.col("x") + vx).alias("x"), (F.col("y") + vy).alias("y"), vx.alias("vx"), vy.alias("vy"))
