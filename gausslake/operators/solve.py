"""Residuals and the damped Gauss-Newton loop.

A residual gives one row per observation: its value r, its derivative J by the 7 tangent components, and a weight. The
rows never meet in one place: one aggregation of the sums of J^T J, J^T r and r^2 reaches the driver, which solves the
6 x 6 or 7 x 7 system. Tables of bounded size take the same step on arrays instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions import lie
from ..model import drawn_rows, drawn_sample, even_rows, linear_scales, strided_rows, strided_sample
from .field import gaussian_sdf_grad, sdf_arrays, thin_normals
from .spatial import nearest_arrays, nearest_join, settled

DOF = {"se3": 6, "sim3": 7}


@dataclass
class Cloud:
    """Positions and normals of a splat as arrays, for tables of bounded size."""

    means: np.ndarray
    normals: np.ndarray
    scales: np.ndarray | None = None

    @classmethod
    def of(cls, df: DataFrame) -> Cloud:
        """The arrays of a splat table, in gid order."""
        t = thin_normals(df).select("gid", "x", "y", "z", "nx", "ny", "nz", *[c.alias(f"l{i}") for i, c in enumerate(linear_scales(df))]).orderBy("gid").toPandas()
        return cls(t[["x", "y", "z"]].to_numpy(float), t[["nx", "ny", "nz"]].to_numpy(float), t[["l0", "l1", "l2"]].to_numpy(float))

    def sample(self, most: int | None, seed: int | None = None) -> Cloud:
        """`most` points: evenly spread, or drawn with a seed and kept in order."""
        if most is None or len(self.means) <= most:
            return self
        n = len(self.means)
        at = even_rows(n, most) if seed is None else drawn_rows(n, most, seed)
        return Cloud(self.means[at], self.normals[at], None if self.scales is None else self.scales[at])


def jacobian(row: np.ndarray, t: np.ndarray, source: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """Derivatives of a residual whose gradient at the moved point is `row`, by the 7 tangent components."""
    turned = row @ t[:3, :3]
    return np.concatenate((turned, np.cross(source, turned), (row * (moved - t[:3, 3])).sum(1, keepdims=True)), 1)


class Residual(Protocol):
    """What the loop asks of a residual. `weight` multiplies the cost once; `robust` maps |r| to a further weight.

    Arrays and tables give the same rows: samples, caps and kernels hold on both.
    """

    weight: float
    robust: Callable[[np.ndarray], np.ndarray] | None

    def rows(self, t: np.ndarray, target: Cloud, source: Cloud) -> tuple[np.ndarray, np.ndarray]:
        """(r, J) for arrays."""

    def table(self, t: np.ndarray, target: DataFrame, source: DataFrame) -> DataFrame:
        """Columns r, j0 to j6, w for tables."""


def _table_jacobian(row: list[Column], t: np.ndarray, p: list[Column]) -> list[Column]:
    x = [F.col(c) for c in "xyz"]
    turned = [sum((row[i] * float(t[i, k]) for i in (1, 2)), row[0] * float(t[0, k])) for k in range(3)]
    cross = [x[1] * turned[2] - x[2] * turned[1], x[2] * turned[0] - x[0] * turned[2], x[0] * turned[1] - x[1] * turned[0]]
    along = sum((row[i] * (p[i] - float(t[i, 3])) for i in (1, 2)), row[0] * (p[0] - float(t[0, 3])))
    return [c.alias(f"j{k}") for k, c in enumerate([*turned, *cross, along])]


@dataclass
class ICP:
    """Distance to the nearest target point, or along the target's normal there, of `most` source rows (None: all)."""

    weight: float = 1.0
    point_to_plane: bool = False
    max_distance: float = 0.0
    most: int | None = None
    robust: Callable | None = None
    seed: int = 0

    def rows(self, t, target, source):
        s = source.means if self.most is None else source.means[strided_rows(len(source.means), self.most, self.seed)]
        p = lie.apply(t, s)
        d, at = nearest_arrays(p, target.means)
        if self.max_distance > 0:
            keep = d <= self.max_distance
            s, p, d, at = s[keep], p[keep], d[keep], at[keep]
        apart = p - target.means[at]
        if self.point_to_plane:
            n = target.normals[at]
            row = n * np.where((n * apart).sum(1) < 0, -1.0, 1.0)[:, None]
            r = (row * apart).sum(1)
        else:
            r, row = d, apart / np.maximum(d, 1e-12)[:, None]
        return r, jacobian(row, t, s, p)

    def table(self, t, target, source):
        source = source if self.most is None else strided_sample(source, self.most, self.seed)
        p = source.select("gid", *E.moved(t))
        pairs = nearest_join(p, target)
        if self.max_distance > 0:
            pairs = pairs.where(F.col("d") <= self.max_distance)
        own = thin_normals(target) if self.point_to_plane else target
        q = own.select(F.col("gid").alias("a"), *[F.col(c).alias(f"t{c}") for c in "xyz"], *([F.col(c) for c in ("nx", "ny", "nz")] if self.point_to_plane else []))
        rows = pairs.join(q, "a").join(source.select(F.col("gid").alias("q"), "x", "y", "z"), "q")
        m = E.moved(t)
        apart = [m[i] - F.col(f"t{c}") for i, c in enumerate("xyz")]
        if self.point_to_plane:
            n = [F.col(c) for c in ("nx", "ny", "nz")]
            side = F.when(sum((n[i] * apart[i] for i in (1, 2)), n[0] * apart[0]) < 0, -1.0).otherwise(1.0)
            row = [c * side for c in n]
            r = sum((row[i] * apart[i] for i in (1, 2)), row[0] * apart[0])
        else:
            r = F.col("d")
            row = [c / F.greatest(r, F.lit(1e-12)) for c in apart]
        return rows.select(r.alias("r"), *_table_jacobian(row, t, m), F.lit(float(self.weight)).alias("w"))


@dataclass
class SDF:
    """Signed distance of the moved source in the target's field."""

    sigma: float
    weight: float = 0.3
    samples: int | None = 2000
    knn: int | None = 50
    truncate: float = 3.0
    seed: int = 0
    robust: Callable | None = None

    def rows(self, t, target, source):
        s = source.sample(self.samples, self.seed).means
        p = lie.apply(t, s)
        d, g = sdf_arrays(p, target.means, target.normals, self.sigma, self.knn, self.truncate)
        return d, jacobian(g, t, s, p)

    def table(self, t, target, source):
        source = source if self.samples is None else drawn_sample(source, self.samples, self.seed)
        f = gaussian_sdf_grad(thin_normals(target), source.select("gid", *E.moved(t)), self.sigma, self.truncate, self.knn)
        rows = f.join(source.select(F.col("gid").alias("q"), "x", "y", "z"), "q")
        return rows.select(F.col("d").alias("r"), *_table_jacobian([F.col(c) for c in ("gx", "gy", "gz")], t, E.moved(t)), F.lit(float(self.weight)).alias("w"))


@dataclass
class Prior:
    """Distance of the pose to a given one."""

    pose: np.ndarray
    sigma: float = 1.0
    weight: float = 1.0
    robust: Callable | None = None

    def rows(self, t, target=None, source=None):
        rigid = t.copy()
        rigid[:3, :3] /= lie.scale_of(t)
        r = lie.se3_log(lie.inverse(self.pose) @ rigid) / self.sigma
        j = np.zeros((6, 7))
        j[:, :6] = np.eye(6) / self.sigma
        return r, j

    def table(self, t, target, source):
        r, j = self.rows(t)
        return source.sparkSession.createDataFrame([(float(a), *map(float, b), float(self.weight)) for a, b in zip(r, j, strict=True)], "r double, " + ", ".join(f"j{k} double" for k in range(7)) + ", w double")


def normal_equations(rows: DataFrame, dof: int = 7) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(H, b, cost, rows) of residual rows in one aggregation; `w` multiplies the squares."""
    j = [F.col(f"j{k}") for k in range(dof)]
    sums = [F.sum(F.col("w") * j[a] * j[b]) for a in range(dof) for b in range(a, dof)]
    sums += [F.sum(F.col("w") * j[a] * F.col("r")) for a in range(dof)]
    got = rows.agg(*sums, F.sum(F.col("w") * F.col("r") * F.col("r")), F.count("*")).first()
    values = [0.0 if v is None else float(v) for v in got]
    h = np.zeros((dof, dof))
    h[np.triu_indices(dof)] = values[: dof * (dof + 1) // 2]
    h = h + h.T - np.diag(np.diag(h))
    return h, np.array(values[dof * (dof + 1) // 2 : -2]), 0.5 * values[-2], int(values[-1])


class LevenbergMarquardt:
    """Solves (H with its diagonal times 1 + damping) step = -b. `rotation` multiplies the damping of rotations."""

    def __init__(self, damping: float = 1e-4, rotation: float = 1.0):
        self.damping, self.rotation = damping, rotation

    def step(self, h: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The step, or zeros where the system has no solution."""
        more = np.full(len(b), self.damping)
        more[3:6] *= self.rotation
        full = h + np.diag(more * np.maximum(np.diag(h), 1e-12)) + 1e-12 * np.eye(len(b))
        try:
            return -np.linalg.solve(full, b)
        except np.linalg.LinAlgError:
            return np.zeros(len(b))


@dataclass
class RegisterResult:
    """Pose that takes the source to the target, its scale, whether the loop converged, and facts about it."""

    T: np.ndarray
    scale: float = 1.0
    converged: bool = True
    info: dict = field(default_factory=dict)


def _system(t, residuals, target, source, dof):
    h, b, cost, n = np.zeros((dof, dof)), np.zeros(dof), 0.0, 0
    for res in residuals:
        if isinstance(source, DataFrame):
            rows = res.table(t, target, source)
            if res.robust is not None:
                k = E.kernel_column(res.robust, F.col("r"))
                rows = rows.withColumn("w", F.col("w") * k * k)
            dh, db, dc, dn = normal_equations(rows, dof)
        else:
            r, j = res.rows(t, target, source)
            w = np.full(len(r), float(res.weight))
            if res.robust is not None:
                w = w * res.robust(np.abs(r)) ** 2
            j = j[:, :dof]
            dh, db, dc, dn = (j * w[:, None]).T @ j, j.T @ (w * r), 0.5 * float(w @ (r * r)), len(r)
        h, b, cost, n = h + dh, b + db, cost + dc, n + dn
    return h, b, cost, n


def run_lm(t0: np.ndarray, residuals: list, target, source, transform: str = "se3", solver: LevenbergMarquardt | None = None, n_iters: int = 20, max_trans_step: float = 0.01, max_rot_step: float = 0.15, convergence_tol: float = 1e-5) -> RegisterResult:
    """Minimises the residuals from `t0`. Steps are clamped and never rejected; the last system gives the covariance.

    `target` and `source` are clouds (arrays) or splat tables; tables are settled once, and each iteration is then one
    job a residual.
    """
    if isinstance(source, DataFrame):
        target, source = settled(target), settled(source)
    dof, t, solver = DOF[transform], np.array(t0, float), solver or LevenbergMarquardt()
    history, converged = [], False
    h, b, cost, n = _system(t, residuals, target, source, dof)
    for _ in range(n_iters):
        history.append(cost)
        step = solver.step(h, b)
        for part, most in ((slice(0, 3), max_trans_step), (slice(3, 6), max_rot_step)):
            length = np.linalg.norm(step[part])
            if length > most:
                step[part] *= most / length
        if dof == 7:
            step[6] = np.clip(step[6], -0.1, 0.1)
        t = t @ (lie.sim3_exp(step) if dof == 7 else lie.se3_exp(step))
        converged = bool(np.linalg.norm(step) < convergence_tol)
        h, b, cost, n = _system(t, residuals, target, source, dof)
        if converged:
            break
    covariance = None
    if n > dof and np.isfinite(h).all() and np.linalg.matrix_rank(h, tol=1e-10 * max(np.abs(h).max(), 1e-300)) == dof:
        covariance = 2 * cost / max(n - dof, 1) * np.linalg.inv(h)
        if not np.isfinite(covariance).all():
            covariance = None
    info = {"cost_history": [*history, cost], "rmse": float(np.sqrt(2 * cost / max(n, 1))), "information": h, "covariance": covariance, "residuals": n}
    return RegisterResult(t, lie.scale_of(t), converged, info)


def numeric_jacobian(f: Callable[[np.ndarray], np.ndarray], t: np.ndarray, transform: str = "sim3", step: float = 1e-6) -> np.ndarray:
    """Central differences of f(pose) by the tangent components."""
    dof = DOF[transform]
    move = lie.sim3_exp if dof == 7 else lie.se3_exp
    return np.stack([(f(t @ move(step * e)) - f(t @ move(-step * e))) / (2 * step) for e in np.eye(dof)], 1)
