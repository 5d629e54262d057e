"""Synthetic scene: a sloped plane with tilted cylinders, seen from the origin.

Every candidate point is a row of ``spark.range`` and draws from a hash of its number, so a scene
of any size is generated in parallel and is the same for any partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvaspark.functions.retention import mix


@dataclass(frozen=True)
class Stem:
    x: float
    y: float
    radius: float
    tilt_deg: float = 0.0
    azimuth_deg: float = 0.0


@dataclass(frozen=True)
class Scene:
    slope: tuple[float, float] = (0.2, 0.1)
    z0: float = -1.5
    half_size: float = 15.0
    ground_density: float = 4000.0
    stem_density: float = 20000.0
    d_ref: float = 3.0
    stem_height: float = 4.5
    sigma: float = 0.003
    seed: int = 42
    offset: tuple[float, float, float] = (0.0, 0.0, 0.0)
    stems: tuple[Stem, ...] = field(default=(Stem(4.0, 1.0, 0.15), Stem(-5.0, 3.0, 0.25), Stem(2.0, -6.0, 0.08), Stem(-3.0, -4.0, 0.20, 10.0, 30.0), Stem(7.0, 5.0, 0.30, 15.0, 200.0)))

    def ground(self, x, y):
        return self.z0 + self.slope[0] * x + self.slope[1] * y


def _draws(seed: int, ids: np.ndarray, n: int) -> list[np.ndarray]:
    """n uniforms in (0, 1) for each id."""
    h = mix(ids.astype(np.int64).view(np.uint64) ^ mix(np.full(1, seed, np.uint64)))
    out = []
    for _ in range(n):
        h = mix(h)
        out.append(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
    return out


def _normal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b)


def truth(spark: SparkSession, s: Scene = Scene()) -> DataFrame:
    """(stem, x, y, z, radius, tilt_deg): where each axis meets the ground."""
    rows = [(k, t.x + s.offset[0], t.y + s.offset[1], s.ground(t.x, t.y) + s.offset[2], t.radius, t.tilt_deg) for k, t in enumerate(s.stems)]
    return spark.createDataFrame(rows, "stem int, x double, y double, z double, radius double, tilt_deg double")


def make(spark: SparkSession, s: Scene = Scene()) -> DataFrame:
    """(pid, x, y, z, stem): ground points (stem -1) and points of the visible half of each stem, thinned
    by min(1, (d_ref / distance)^2), with Gaussian noise."""
    area = (2 * s.half_size) ** 2
    counts = [int(area * s.ground_density)] + [int(np.pi * t.radius * 2 * s.stem_height * s.stem_density) for t in s.stems]
    edges = np.cumsum([0, *counts])

    def run(batches):
        for pdf in batches:
            ids = pdf["id"].to_numpy()
            u = _draws(s.seed, ids, 6)
            part = np.searchsorted(edges, ids, side="right") - 1
            x, y = (2 * u[0] - 1) * s.half_size, (2 * u[1] - 1) * s.half_size
            z = s.ground(x, y) + s.sigma * _normal(u[3], u[4])
            seen = np.ones(len(ids), bool)
            for k, t in enumerate(s.stems):
                m = part == k + 1
                if not m.any():
                    continue
                az, tilt = np.radians(t.azimuth_deg), np.radians(t.tilt_deg)
                v = np.array([np.sin(tilt) * np.cos(az), np.sin(tilt) * np.sin(az), np.cos(tilt)])
                e1 = np.cross(v, [1.0, 0, 0])
                e1 /= np.linalg.norm(e1)
                e2 = np.cross(v, e1)
                turn, h = 2 * np.pi * u[0][m], (u[1][m] - 0.1) * s.stem_height
                out = np.outer(np.cos(turn), e1) + np.outer(np.sin(turn), e2)
                base = np.array([t.x, t.y, s.ground(t.x, t.y)])
                p = base + np.outer(h, v) + out * (t.radius + s.sigma * _normal(u[3][m], u[4][m]))[:, None]
                x[m], y[m], z[m] = p.T
                seen[m] = (out * p).sum(axis=1) < 0
                seen[m] &= p[:, 2] >= s.ground(p[:, 0], p[:, 1])
            d = np.sqrt(x * x + y * y + z * z)
            seen &= u[2] < np.minimum(1, (s.d_ref / np.maximum(d, 1e-9)) ** 2)
            yield pd.DataFrame({"pid": ids[seen], "x": x[seen] + s.offset[0], "y": y[seen] + s.offset[1], "z": z[seen] + s.offset[2], "stem": (part[seen] - 1).astype(np.int32)})

    return spark.range(int(edges[-1])).mapInPandas(run, "pid long, x double, y double, z double, stem int")


def write_xyz(points: DataFrame, path: str) -> None:
    """Text files of x y z with four decimals."""
    points.select(F.format_string("%.4f %.4f %.4f", "x", "y", "z").alias("value")).write.mode("overwrite").text(path)
