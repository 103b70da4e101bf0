"""Seeded point shapes for tests and benches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import from_arrays


def object_points(n: int, seed: int = 0, jitter: float = 0.004) -> np.ndarray:
    """An ellipsoid shell with filling and a lobe on one side, so that no turn maps it to itself."""
    r = np.random.default_rng(seed)
    axes = np.array([0.14, 0.09, 0.06])
    d = r.normal(size=(n, 3))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    shell = r.random(n) < 0.7
    size = np.where(shell, 1 + jitter / 0.1 * r.normal(size=n), 0.92 * np.cbrt(r.random(n)))
    p = d * axes * size[:, None]
    p[:, 0] += 0.03 * np.exp(-((p[:, 0] / axes[0] - 1) ** 2) / 0.2)
    return p + np.array([0.4, -0.2, 0.3])


def object_splat(spark: SparkSession, n: int, seed: int = 0, **more) -> DataFrame:
    """A splat table of such a shape."""
    p = object_points(n, seed)
    return from_arrays(spark, p, scales=np.full((n, 3), 0.004), opacities=np.ones(n), **more)


def jittered(df: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Places moved by normal noise of `share` of the bounding diagonal."""
    from ..operators.fuse import diagonal

    size = share * diagonal(df)
    return df.withColumns({c: F.col(c) + F.randn(seed + i) * size for i, c in enumerate("xyz")})


def cropped(df: DataFrame, share: float) -> DataFrame:
    """Without the given share of rows at the upper end of x."""
    cut = df.agg(F.expr(f"percentile_disc({1 - share}) within group (order by x)")).first()[0]
    return df.where(F.col("x") <= cut)


def cluttered(df: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """With additional rows, as many as the given share, spread evenly over the bounding box."""
    from ..operators.spatial import extent

    lo, hi, _ = extent(df)
    top = df.agg(F.max("gid")).first()[0] or 0
    more = df.sample(fraction=min(1.0, share), seed=seed)
    spread = {c: F.rand(seed + 7 + i) * float(hi[i] - lo[i]) + float(lo[i]) for i, c in enumerate("xyz")}
    return df.unionByName(more.withColumns(spread | {"gid": F.col("gid") + top + 1}))
