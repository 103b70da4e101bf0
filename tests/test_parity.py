"""Residuals on arrays and on tables, and the searches for partial overlaps."""

import numpy as np
import pytest

from gausslake.functions import lie
from gausslake.functions.expressions import Kernel
from gausslake.model import from_arrays
from gausslake.operators import align, photometric, register, solve
from gausslake.operators.metrics import pose_error
from gausslake.operators.solve import ICP, SDF, Cloud, Prior
from gausslake.sources.synthetic import object_points

POSE = lie.sim3_exp(np.array([0.02, -0.01, 0.015, 0.1, -0.05, 0.08, 0.05]))


@pytest.fixture(scope="module")
def pair(spark):
    rng = np.random.default_rng(0)
    a, b = object_points(220), object_points(260, seed=1)
    made = [from_arrays(spark, p, quats=rng.normal(size=(len(p), 4)), scales=rng.random((len(p), 3)) * 0.01 + 0.001, gid_from=5) for p in (a, b)]
    return made, [Cloud.of(df) for df in made]


@pytest.mark.parametrize(
    "residual",
    [
        ICP(robust=Kernel("huber", 0.01)), ICP(robust=Kernel("cauchy", 0.02), point_to_plane=True), ICP(most=40, weight=2.0), ICP(max_distance=0.03, robust=lambda r: 1 / (1 + 30 * r)),
        SDF(0.02, robust=Kernel("huber", 0.005)), SDF(0.02, samples=60, knn=7), SDF(0.03, samples=None, knn=500), Prior(lie.se3_exp(np.full(6, 0.1)), robust=Kernel("cauchy", 0.1)),
    ],
)
def test_arrays_and_tables_give_the_same_system(pair, residual):
    (source, target), (a, b) = pair
    one, two = solve._system(POSE, [residual], target, source, 7), solve._system(POSE, [residual], b, a, 7)
    assert one[3] == two[3]
    for x, y in zip(one[:3], two[:3], strict=True):
        np.testing.assert_allclose(x, y, rtol=1e-9, atol=1e-9)


def test_kernels():
    r = np.array([0.0, 0.5, 2.0])
    np.testing.assert_allclose(Kernel("huber", 1.0)(r), [1, 1, 0.5])
    np.testing.assert_allclose(Kernel("cauchy", 1.0)(r), [1, 0.8, 0.2])
    with pytest.raises(ValueError, match="kernel"):
        Kernel("tukey", 1.0)


def test_large_tables_take_the_same_way(spark, monkeypatch):
    source = from_arrays(spark, object_points(150))
    truth = lie.se3_exp(np.array([0.01, 0, 0.01, 0, 0.1, 0]))
    target = from_arrays(spark, lie.apply(truth, object_points(150)))
    residuals = [ICP(robust=Kernel("huber", 0.02)), SDF(0.03, weight=0.3, knn=20, samples=90)]
    here = register.register(target, source, init="identity", max_iters=3, residuals=residuals)
    monkeypatch.setattr(register, "LOCAL", 100)
    there = register.register(target, source, init="identity", max_iters=3, residuals=residuals)
    np.testing.assert_allclose(there.T, here.T, atol=1e-8)
    moved = register.track(target, source, np.eye(4), sigma=0.02)
    monkeypatch.setattr(register, "LOCAL", 10_000)
    np.testing.assert_allclose(moved.T, register.track(target, source, np.eye(4), sigma=0.02).T, atol=1e-8)


def test_sweep_recovers_a_part(spark):
    """A target that shows six tenths of the source, turned far away."""
    rng = np.random.default_rng(6)
    bars = [rng.random((120, 3)) * size + corner for size, corner in (((0.03, 0.03, 0.3), (0.4, -0.2, 0.3)), ((0.2, 0.03, 0.03), (0.4, -0.2, 0.55)), ((0.03, 0.15, 0.03), (0.42, -0.2, 0.4)))]
    whole = np.concatenate([object_points(300), *bars])
    part = whole[np.argsort(whole @ np.array([1.0, 0.3, 0.2]))[-400:]]
    truth = np.eye(4)
    truth[:3, :3], truth[:3, 3] = lie.so3_exp(np.array([0.4, 2.0, -0.6])), (0.2, 0.1, -0.3)
    t = align.basin_sweep(whole, lie.apply(truth, part), spark, rotations=512, top=40, refine=60, most_source=330, most_target=200)
    assert pose_error(t, truth)["rotation_deg"] < 10
    assert align.overlap_inliers(whole, lie.apply(truth, part), truth, 1e-6) == 400
    assert align.two_way_residual(whole, lie.apply(truth, part), truth) < 0.02


def test_ambiguity():
    rng = np.random.default_rng(1)
    ball = rng.normal(size=(2500, 3))
    ball /= np.linalg.norm(ball, axis=1, keepdims=True)
    long = object_points(300)
    assert align.sensitivity(ball[500:], ball[:500], np.eye(4)) < 0.005 < align.sensitivity(long, long, np.eye(4))
    assert align.rotation_spread(np.array([np.eye(3), lie.so3_exp(np.array([0, 0, 0.5]))])) == pytest.approx(np.degrees(0.5))
    assert align.rotation_spread(np.eye(3)[None]) == 0.0
    assert align.near_best(np.array([1.0, 1.004, 1.1])).tolist() == [0, 1] and align.near_best(np.array([100.0, 100.4, 101])).tolist() == [0, 1]
    grid = np.stack(np.meshgrid(*[np.arange(8.0)] * 3), -1).reshape(-1, 3)
    assert align.cloud_voxel(grid) == pytest.approx(1.5) and align.cloud_voxel(grid[:2]) == 0.05


def painted(n=400):
    rng = np.random.default_rng(3)
    p = rng.normal(size=(n, 3))
    p *= 0.1 / np.linalg.norm(p, axis=1, keepdims=True)
    return {"means": p, "scales": np.full((n, 3), 0.012), "quats": np.tile([1.0, 0, 0, 0], (n, 1)), "opacities": np.ones(n), "colors": np.stack((np.sin(25 * p[:, 0]) / 2 + 0.5, p[:, 2] * 5 + 0.5, np.cos(20 * p[:, 1]) / 2 + 0.5), 1)}


def test_photometric_of_a_frame():
    """The residual vanishes at the truth, prefers it to turned poses, and its derivative leads back."""
    splat, k = painted(), np.array([[80.0, 0, 32], [0, 80.0, 32], [0, 0, 1]])
    camera = lie.look_at(np.array([0.5, 0.1, 0.05]), np.zeros(3))
    rgb = photometric.render_discs(splat["means"], splat["colors"], splat["scales"].mean(1), lie.inverse(camera), k, 64, 64)
    residual = photometric.Photometric(camera, most=300)
    r, j = residual.rows(np.eye(4), splat, {"rgb": np.moveaxis(rgb, 2, 0), "k": k})
    assert len(r) == 900 and j.shape == (900, 7) and np.abs(r).max() < 1e-9 and np.abs(j[:, :6]).sum() > 0
    turned = dict(splat, means=lie.apply(lie.se3_exp(np.array([0, 0, 0, 0, 0, 0.04])), splat["means"]))
    off, _ = residual.rows(np.eye(4), turned, {"rgb": rgb, "k": k})
    assert np.abs(off).mean() > 1e-3
    none, empty = photometric.Photometric(camera, rgb, k, mask=np.zeros((64, 64))).rows(np.eye(4), splat)
    assert len(none) == 0 and empty.shape == (0, 7)
    with pytest.raises(ValueError, match="needs rgb"):
        photometric.Photometric(camera).rows(np.eye(4), splat, {})


def test_images_and_weights():
    image = np.random.default_rng(0).random((4, 5, 3))
    for form in (image, image[None], np.moveaxis(image, 2, 0)):
        np.testing.assert_array_equal(photometric.as_image(form), image)
    with pytest.raises(ValueError, match="image"):
        photometric.as_image(np.zeros((4, 5)))
    np.testing.assert_allclose(photometric.huber(np.array([0.01, -0.1]), 0.05), [1, 0.5])
    gx, gy = photometric.sobel(np.arange(20.0).reshape(4, 5))
    assert gx[1:-1, 1:-1].tolist() == [[1.0] * 3] * 2 and gy[1:-1, 1:-1].tolist() == [[5.0] * 3] * 2
