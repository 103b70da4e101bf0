"""Rigid and similarity transforms: 4x4 matrices on the driver.

Tangents are (translation, rotation[, log scale]); updates multiply from the right. The scale of a similarity sits in
the 3x3 block only; its translation uses the rigid exponential.
"""

from __future__ import annotations

import numpy as np


def skew(v: np.ndarray) -> np.ndarray:
    """The matrix of the cross product with v; works on stacks."""
    v = np.asarray(v, float)
    out = np.zeros((*v.shape[:-1], 3, 3))
    out[..., 0, 1], out[..., 0, 2], out[..., 1, 2] = -v[..., 2], v[..., 1], -v[..., 0]
    return out - np.swapaxes(out, -1, -2)


def so3_exp(w: np.ndarray) -> np.ndarray:
    """Rotation about w by |w|."""
    angle = np.linalg.norm(w)
    k = skew(w)
    a = np.sinc(angle / np.pi)
    b = 0.5 * np.sinc(angle / (2 * np.pi)) ** 2
    return np.eye(3) + a * k + b * k @ k


def _left(w: np.ndarray) -> np.ndarray:
    angle = np.linalg.norm(w)
    k = skew(w)
    b = 0.5 * np.sinc(angle / (2 * np.pi)) ** 2
    c = (1 - np.sinc(angle / np.pi)) / angle**2 if angle > 1e-4 else 1 / 6 - angle**2 / 120
    return np.eye(3) + b * k + c * k @ k


def se3_exp(xi: np.ndarray) -> np.ndarray:
    """Rigid transform of a tangent of 6 numbers (a seventh is ignored)."""
    xi = np.asarray(xi, float)
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = so3_exp(xi[3:6]), _left(xi[3:6]) @ xi[:3]
    return out


def so3_log(r: np.ndarray) -> np.ndarray:
    """Rotation vector of a rotation matrix, with an angle of up to pi."""
    axis = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]]) / 2
    sine, cosine = np.linalg.norm(axis), (np.trace(r) - 1) / 2
    angle = np.arctan2(sine, cosine)
    if cosine > -0.99 or sine > 0.1:
        return axis * (angle / sine if sine > 1e-9 else 1.0)
    # near a half turn the skew part vanishes: the axis is the dominant direction of (R + R^T) / 2
    _, vectors = np.linalg.eigh((r + r.T) / 2)
    v = vectors[:, -1]
    if v @ axis < 0:
        v = -v
    return v * angle


def se3_log(t: np.ndarray, dof: int = 6) -> np.ndarray:
    """Tangent of a rigid transform; padded with zeros to `dof` numbers."""
    w = so3_log(t[:3, :3])
    out = np.zeros(dof)
    out[:3], out[3:6] = np.linalg.solve(_left(w), t[:3, 3]), w
    return out


def sim3_exp(xi: np.ndarray) -> np.ndarray:
    """Similarity of a tangent of 7 numbers, the last being the logarithm of the scale."""
    out = se3_exp(xi[:6])
    out[:3, :3] *= np.exp(xi[6])
    return out


def scale_of(t: np.ndarray) -> float:
    """Cube root of the determinant of the 3x3 block."""
    return float(np.cbrt(np.linalg.det(t[:3, :3])))


def sim3_log(t: np.ndarray) -> np.ndarray:
    """Tangent of a similarity."""
    s = scale_of(t)
    rigid = t.copy()
    rigid[:3, :3] /= s
    return np.append(se3_log(rigid), np.log(s))


def inverse(t: np.ndarray) -> np.ndarray:
    """Inverse of a rigid or similarity transform."""
    return np.linalg.inv(t)


def so3_project(m: np.ndarray) -> np.ndarray:
    """The nearest rotation of a matrix or a stack of them."""
    u, _, v = np.linalg.svd(m)
    flip = np.ones((*np.shape(m)[:-2], 3))
    flip[..., 2] = np.sign(np.linalg.det(u @ v))
    return (u * flip[..., None, :]) @ v


def quat_to_matrix(q: np.ndarray) -> np.ndarray:
    """Rotation matrices of (w, x, y, z) quaternions of any length but zero."""
    q = np.asarray(q, float)
    w, x, y, z = np.moveaxis(q / np.maximum(np.linalg.norm(q, axis=-1, keepdims=True), 1e-12), -1, 0)
    rows = [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]
    return np.stack(rows, -1).reshape(*q.shape[:-1], 3, 3)


def matrix_to_quat(r: np.ndarray) -> np.ndarray:
    """(w, x, y, z) of a rotation matrix, w not negative."""
    # the quaternion is the dominant eigenvector of a symmetric matrix of the entries
    (a, b, c), (d, e, f), (g, h, i) = r
    k = np.array([[a + e + i, h - f, c - g, d - b], [h - f, a - e - i, b + d, c + g], [c - g, b + d, e - a - i, f + h], [d - b, c + g, f + h, i - a - e]]) / 3
    _, vectors = np.linalg.eigh(k)
    q = vectors[:, -1]
    return q if q[0] >= 0 else -q


def umeyama(source: np.ndarray, target: np.ndarray, weights: np.ndarray | None = None, with_scale: bool = True) -> np.ndarray:
    """The similarity (or rigid transform) that takes `source` to `target` with least weighted squares."""
    w = np.ones(len(source)) if weights is None else weights
    w = w / max(w.sum(), 1e-9)
    a, b = w @ source, w @ target
    x, y = source - a, target - b
    return from_moments(a, b, (w[:, None] * y).T @ x, float(w @ (x * x).sum(1)), with_scale)


def from_moments(mean_source: np.ndarray, mean_target: np.ndarray, covariance: np.ndarray, variance: float, with_scale: bool = True) -> np.ndarray:
    """Umeyama's solution from aggregated moments: covariance is E[(t - mt)(s - ms)^T], variance E|s - ms|^2."""
    u, d, v = np.linalg.svd(covariance)
    sign = np.array([1.0, 1.0, 1.0 if np.linalg.det(u) * np.linalg.det(v) >= 0 else -1.0])
    r = (u * sign) @ v
    s = float(d @ sign) / max(variance, 1e-12) if with_scale else 1.0
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = s * r, mean_target - s * r @ mean_source
    return out


def apply(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Points moved by a transform."""
    return p @ t[:3, :3].T + t[:3, 3]


def look_at(eye: np.ndarray, target: np.ndarray, up: np.ndarray = np.array([0.0, 0.0, 1.0])) -> np.ndarray:
    """Camera-to-world pose at `eye` looking to `target`: +z forward, +y down; another up where they are parallel."""
    z = (target - eye) / max(np.linalg.norm(target - eye), 1e-12)
    if abs(z @ up) >= 0.95:
        up = np.array([0.0, 1.0, 0.0]) if abs(z[1]) < 0.95 else np.array([1.0, 0.0, 0.0])
    x = np.cross(z, up)
    x /= np.linalg.norm(x)
    out = np.eye(4)
    out[:3, 0], out[:3, 1], out[:3, 2], out[:3, 3] = x, np.cross(z, x), z, eye
    return out


def super_fibonacci(n: int) -> np.ndarray:
    """n rotations spread over SO(3), as matrices; a spiral with the two published constants."""
    # fixed values: the constants of the super-Fibonacci spiral
    phi, psi = np.sqrt(2.0), 1.533751168755204
    s = np.arange(n) + 0.5
    r, q = np.sqrt(s / n), np.sqrt(1 - s / n)
    a, b = 2 * np.pi * s / phi, 2 * np.pi * s / psi
    return quat_to_matrix(np.stack((q * np.cos(b), r * np.sin(a), r * np.cos(a), q * np.sin(b)), 1))
