"""Rotation of spherical-harmonic colours.

The matrix of a degree is found from the definition: the basis at some directions, and at the same directions turned
back, are related by it, so it is the solution of a small linear system.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def basis(degree: int, directions: np.ndarray) -> np.ndarray:
    """Real spherical harmonics of one degree at unit directions; odd orders are negative, as splat colours have it."""
    x, y, z = directions.T
    legendre = {(0, 0): np.ones_like(z)}
    for m in range(degree + 1):
        if m:
            legendre[m, m] = legendre[m - 1, m - 1] * (2 * m - 1)
        for n in range(m + 1, degree + 1):
            below = legendre[n - 2, m] if n - 2 >= m else 0.0
            legendre[n, m] = ((2 * n - 1) * z * legendre[n - 1, m] - (n + m - 1) * below) / (n - m)
    around = (x + 1j * y) ** np.arange(degree + 1)[:, None]
    out = []
    for m in range(-degree, degree + 1):
        k = abs(m)
        ratio = 1.0
        for j in range(degree - k + 1, degree + k + 1):
            ratio /= j
        norm = np.sqrt((2 * degree + 1) / (4 * np.pi) * ratio) * (np.sqrt(2) if m else 1.0)
        out.append((-1) ** k * norm * legendre[degree, k] * (around[k].imag if m < 0 else around[k].real))
    return np.stack(out, 1)


def rotation_matrix(r: np.ndarray, coefficients: int) -> np.ndarray:
    """The K x K matrix that rotates K = (degree + 1)**2 coefficients."""
    degrees = int(round(np.sqrt(coefficients)))
    if degrees**2 != coefficients:
        raise ValueError(f"{coefficients} coefficients are no whole number of degrees")
    out = np.zeros((coefficients, coefficients))
    at = np.arange(4 * coefficients + 8) + 0.5
    height = 1 - 2 * at / len(at)
    turn = np.pi * (1 + 5**0.5) * at
    directions = np.stack((np.sqrt(1 - height**2) * np.cos(turn), np.sqrt(1 - height**2) * np.sin(turn), height), 1)
    for n in range(degrees):
        own = slice(n * n, (n + 1) ** 2)
        out[own, own] = np.linalg.lstsq(basis(n, directions), basis(n, directions @ r), rcond=None)[0]
    return out


def rotate(colors: np.ndarray, r: np.ndarray) -> np.ndarray:
    """(N, K, 3) coefficients of splats turned by r; one coefficient has no direction."""
    return colors if colors.shape[1] == 1 else np.einsum("kj,njc->nkc", rotation_matrix(r, colors.shape[1]), colors)


def rotate_column(df: DataFrame, r: np.ndarray, sizes: list[int]) -> DataFrame:
    """`df` with its `colors` turned by r; null, RGB and single colours stay. `sizes` lists the numbers of coefficients
    that rows have; each of them is one expression of constants, so nothing leaves generated code."""
    turned = F.col("colors")
    for k in sizes:
        matrix = rotation_matrix(r, k)
        rows = [[float(v) if abs(v) > 1e-15 else 0.0 for v in row] for row in matrix]
        new = F.array(*[F.array(*[sum((F.col("colors")[j][c] * v for j, v in enumerate(row) if v), F.lit(0.0)) for c in range(3)]) for row in rows])
        turned = F.when((F.size("colors") == k) & ~F.coalesce("is_rgb", F.lit(False)), new).otherwise(turned)
    return df.withColumn("colors", turned)
