"""Per-pixel programs: every pixel of a range is computed alone, in Arrow batches with vectorised arithmetic."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def mandelbrot(spark: SparkSession, width: int, height: int, threshold: int, bound: float = 2.0, box: tuple[float, float, float, float] = (-2.0, -1.0, 1.0, 1.0)) -> DataFrame:
    """(idx, iterations): steps of z*z + c until |z|^2 >= ``bound``, at most ``threshold``; row-major pixels."""
    x0, y0, x1, y1 = box

    def escape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx = batch.column(0).to_numpy()
            cx = x0 + (idx % width) * ((x1 - x0) / width)
            cy = y0 + (idx // width) * ((y1 - y0) / height)
            zx, zy, n, live = np.zeros(len(idx)), np.zeros(len(idx)), np.zeros(len(idx), np.int64), np.arange(len(idx))
            for _ in range(threshold):
                a, b = zx[live], zy[live]
                live = live[a * a + b * b < bound]
                if not len(live):
                    break
                a, b = zx[live], zy[live]
                zx[live], zy[live] = a * a - b * b + cx[live], 2.0 * a * b + cy[live]
                n[live] += 1
            yield pa.RecordBatch.from_arrays([pa.array(idx), pa.array(n)], names=["idx", "iterations"])

    return spark.range(width * height).mapInArrow(escape, "idx bigint, iterations bigint")


def ray_trace(spark: SparkSession, width: int, height: int, spheres: Sequence[tuple[float, float, float, float]], light: tuple[float, float, float] = (5.0, 5.0, -5.0)) -> DataFrame:
    """(idx, shade): brightness 0 to 1 of each pixel seen from the origin along +z; spheres are (x, y, z, radius).

    A pixel is lit by Lambert's law where no other sphere stands between the point and the light, else 0.1 of ambient
    light; where no sphere is hit it is 0. The scene is a literal of the plan and so must be small.
    """
    scene = np.array(spheres, dtype=float).reshape(-1, 4)
    lamp = np.array(light)

    def nearest(origin: np.ndarray, ray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, which = np.full(len(ray), np.inf), np.full(len(ray), -1)
        for k, (*centre, radius) in enumerate(scene):
            to = np.array(centre) - origin
            along = (to * ray).sum(1)
            inside = radius**2 - ((to * to).sum(1) - along**2)
            far = along - np.sqrt(np.maximum(inside, 0))
            hit = (inside > 0) & (far > 1e-6) & (far < best)
            best[hit], which[hit] = far[hit], k
        return best, which

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx = batch.column(0).to_numpy()
            ray = np.stack([(idx % width + 0.5) / width * 2 - 1, 1 - (idx // width + 0.5) / height * 2, np.ones(len(idx))], 1)
            ray /= np.linalg.norm(ray, axis=1, keepdims=True)
            far, which = nearest(np.zeros((len(idx), 3)), ray)
            shade, seen = np.zeros(len(idx)), which >= 0
            if seen.any():
                point = ray[seen] * far[seen, None]
                normal = (point - scene[which[seen], :3]) / scene[which[seen], 3:]
                to_lamp = lamp - point
                distance = np.linalg.norm(to_lamp, axis=1)
                to_lamp /= distance[:, None]
                blocked = nearest(point, to_lamp)[0] < distance
                shade[seen] = 0.1 + 0.9 * np.where(blocked, 0.0, np.maximum((normal * to_lamp).sum(1), 0.0))
            yield pa.RecordBatch.from_arrays([pa.array(idx), pa.array(shade)], names=["idx", "shade"])

    return spark.range(width * height).mapInArrow(draw, "idx bigint, shade double")
