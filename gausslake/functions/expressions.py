"""Column expressions on splat tables; all of them stay inside generated code."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lie


def moved(t: np.ndarray, names=("x", "y", "z")) -> list[Column]:
    """The three coordinates after a transform, under their own names."""
    x, y, z = (F.col(n) for n in names)
    return [(F.lit(float(r[0])) * x + F.lit(float(r[1])) * y + F.lit(float(r[2])) * z + F.lit(float(r[3]))).alias(n) for r, n in zip(t[:3], names, strict=True)]


def turned(r: np.ndarray, names=("qw", "qx", "qy", "qz")) -> list[Column]:
    """The quaternions multiplied by that of r from the left, of length one."""
    a = [F.lit(float(v)) for v in lie.matrix_to_quat(r)]
    w, x, y, z = (F.col(n) for n in names)
    out = [a[0] * w - a[1] * x - a[2] * y - a[3] * z, a[0] * x + a[1] * w + a[2] * z - a[3] * y, a[0] * y - a[1] * z + a[2] * w + a[3] * x, a[0] * z + a[1] * y - a[2] * x + a[3] * w]
    length = F.greatest(F.sqrt(sum((c * c for c in out[1:]), out[0] * out[0])), F.lit(1e-12))
    return [(c / length).alias(n) for c, n in zip(out, names, strict=True)]


def rotation_columns(names=("qw", "qx", "qy", "qz")) -> list[list[Column]]:
    """The nine entries, row by row, of the rotation matrix of a quaternion of any length but zero."""
    w, x, y, z = (F.col(n) for n in names)
    length = F.greatest(F.sqrt(w * w + x * x + y * y + z * z), F.lit(1e-12))
    w, x, y, z = w / length, x / length, y / length, z / length
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def thin_normal() -> list[Column]:
    """nx, ny, nz: the axis of the smallest scale of a row (the first of equal ones), turned by its quaternion."""
    columns = list(zip(*rotation_columns(), strict=True))
    first = (F.col("sx") <= F.col("sy")) & (F.col("sx") <= F.col("sz"))
    second = F.col("sy") <= F.col("sz")
    return [F.when(first, a).when(second, b).otherwise(c).alias(n) for a, b, c, n in zip(*columns, ("nx", "ny", "nz"), strict=True)]


def robust_weight(residual: Column, scale: float, kind: str | None) -> Column:
    """Weight of a residual under Huber, Cauchy or no robust kernel."""
    r = F.abs(residual)
    if kind is None:
        return F.lit(1.0)
    if kind == "huber":
        return F.when(r <= scale, F.lit(1.0)).otherwise(scale / r)
    if kind == "cauchy":
        return 1 / (1 + (r / scale) * (r / scale))
    raise ValueError(f"unknown robust kernel {kind!r}")


class Kernel:
    """A robust kernel, the same on arrays (called with |r|) and on columns (`column`)."""

    def __init__(self, kind: str, scale: float):
        if kind not in ("huber", "cauchy"):
            raise ValueError(f"unknown robust kernel {kind!r}")
        self.kind, self.scale = kind, float(scale)

    def __call__(self, r: np.ndarray) -> np.ndarray:
        r = np.abs(r)
        if self.kind == "huber":
            return np.where(r <= self.scale, 1.0, self.scale / np.maximum(r, 1e-300))
        return 1 / (1 + (r / self.scale) ** 2)

    def column(self, r: Column) -> Column:
        """The weight of a residual column."""
        return robust_weight(r, self.scale, self.kind)


def kernel_column(robust, r: Column) -> Column:
    """The weight of a residual column under any kernel: a `Kernel` stays in generated code, another callable of |r|
    runs over Arrow batches."""
    if hasattr(robust, "column"):
        return robust.column(r)

    @F.pandas_udf("double")
    def weight(v: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(robust(np.abs(v.to_numpy(float))), float))

    return weight(r)


def projected(pose: np.ndarray, k: np.ndarray, names=("x", "y", "z")) -> list[Column]:
    """u, v, depth of points seen from a camera-to-world pose; depths are clamped at 1e-6 for the division."""
    x, y, z = moved(lie.inverse(pose), names)
    near = F.greatest(z, F.lit(1e-6))
    return [(float(k[0, 0]) * x / near + float(k[0, 2])).alias("u"), (float(k[1, 1]) * y / near + float(k[1, 2])).alias("v"), z.alias("depth")]


#: Fixed value: the zeroth spherical harmonic, which ties the first colour coefficient to RGB.
DC = 0.28209479177387814


def dc_to_rgb(c: Column) -> Column:
    """RGB value of a first colour coefficient."""
    return c * DC + 0.5


def rgb_to_dc(c: Column) -> Column:
    """First colour coefficient of an RGB value."""
    return (c - 0.5) / DC
