"""Transforms and harmonics against definitions and round trips."""

import numpy as np
import pytest

from gausslake.functions import harmonics, lie

R = np.random.default_rng(0)


def test_rigid_round_trip():
    for _ in range(500):
        x = R.normal(size=6)
        x[3:] *= min(1.0, 3.1 / np.linalg.norm(x[3:]))
        np.testing.assert_allclose(lie.se3_log(lie.se3_exp(x)), x, atol=1e-8)


@pytest.mark.parametrize("angle", [0, 1e-12, 1e-8, 1e-4, np.pi - 1e-3, np.pi - 1e-7, np.pi])
def test_special_angles(angle):
    w = R.normal(size=3)
    t = lie.se3_exp(np.append(R.normal(size=3), w / np.linalg.norm(w) * angle))
    np.testing.assert_allclose(lie.se3_exp(lie.se3_log(t)), t, atol=1e-7)


def test_similarity_keeps_rigid_translation():
    x = np.append(R.normal(size=6) * 0.3, 0.4)
    t = lie.sim3_exp(x)
    np.testing.assert_allclose(t[:3, 3], lie.se3_exp(x[:6])[:3, 3])
    np.testing.assert_allclose(lie.sim3_log(t), x, atol=1e-9)
    assert lie.scale_of(t) == pytest.approx(np.exp(0.4))


def test_quaternions_and_projection():
    for _ in range(50):
        r = lie.so3_exp(R.normal(size=3) * 2)
        np.testing.assert_allclose(lie.quat_to_matrix(lie.matrix_to_quat(r)), r, atol=1e-12)
        np.testing.assert_allclose(lie.so3_project(r + 1e-9), r, atol=1e-8)
    assert np.linalg.det(lie.so3_project(np.diag([1.0, 1.0, -1.0]))) == pytest.approx(1)


def test_umeyama_recovers_a_similarity():
    p, t = R.normal(size=(50, 3)), lie.sim3_exp(R.normal(size=7) * 0.5)
    np.testing.assert_allclose(lie.umeyama(p, lie.apply(t, p)), t, atol=1e-9)


def test_rotations_cover_and_are_rotations():
    m = lie.super_fibonacci(200)
    np.testing.assert_allclose(m @ np.swapaxes(m, 1, 2), np.tile(np.eye(3), (200, 1, 1)), atol=1e-12)


@pytest.mark.parametrize("k", [4, 9, 16])
def test_harmonics_turn_with_the_directions(k):
    r, f = lie.so3_exp([0.3, -1.0, 0.7]), R.normal(size=k)
    d = R.normal(size=(20, 3))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    m = harmonics.rotation_matrix(r, k)
    basis = lambda x: np.concatenate([harmonics.basis(n, x) for n in range(int(k**0.5))], 1)
    np.testing.assert_allclose(basis(d) @ (m @ f), basis(d @ r) @ f, atol=1e-10)
    np.testing.assert_allclose(m @ m.T, np.eye(k), atol=1e-10)


def test_first_harmonics_have_the_usual_signs():
    d = np.array([[0.6, 0.0, 0.8]])
    c = 0.4886025119029199
    np.testing.assert_allclose(harmonics.basis(1, d)[0], [0.0, c * 0.8, -c * 0.6], atol=1e-12)
    with pytest.raises(ValueError, match="whole number"):
        harmonics.rotation_matrix(np.eye(3), 5)
