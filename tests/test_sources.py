"""Files as tables, perturbations, recall, and the public names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import gausslake
from gausslake.functions import lie
from gausslake.model import from_arrays, to_arrays
from gausslake.operators import metrics
from gausslake.sources import ply, records, synthetic

R = np.random.default_rng(3)


def test_many_files(spark, tmp_path):
    for k, coefficients in (("a", None), ("b", 4)):
        colors = R.random((30, 3)) if coefficients is None else R.normal(size=(30, coefficients, 3))
        ply.save_ply(from_arrays(spark, R.normal(size=(30, 3)), colors=colors), str(tmp_path / f"{k}.ply"))
    both = ply.load_plys(spark, str(tmp_path / "*.ply"))
    assert both.groupBy("splat_id").count().count() == 2
    one = to_arrays(both.where("splat_id like '%b.ply'"))
    two = to_arrays(ply.load_ply(spark, str(tmp_path / "b.ply")))
    for k in ("means", "colors", "scales", "quats"):
        np.testing.assert_allclose(one[k], two[k])


def test_text_records(spark, tmp_path):
    pose, info = np.arange(16.0).reshape(4, 4), np.arange(36.0).reshape(6, 6)
    write = lambda name, m, n: (tmp_path / name).write_text("".join(f"{i}\t{i + 1}\t9\n" + "\n".join(" ".join(map(str, r)) for r in m + i) + "\n" for i in range(n)))
    write("gt.log", pose, 3)
    write("gt.info", info, 2)
    log = records.read_pose_log(spark, str(tmp_path / "gt.log")).orderBy("i").collect()
    assert [(r.i, r.j, r.n) for r in log] == [(0, 1, 9), (1, 2, 9), (2, 3, 9)] and log[2].m == (pose + 2).ravel().tolist()
    assert records.read_information(spark, str(tmp_path / "gt.info")).count() == 2
    (tmp_path / "m.obj").write_text("# c\nv 1 2 3\nvn 0 0 1\nv 4 5 6\nf 1 2 3\n")
    assert sorted(tuple(r)[1:] for r in records.read_vertices(spark, str(tmp_path / "m.obj")).collect()) == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]


def test_perturbations(spark):
    df = synthetic.object_splat(spark, 200)
    assert synthetic.cropped(df, 0.3).count() == pytest.approx(140, abs=2)
    assert 200 < synthetic.cluttered(df, 0.5).count() < 400
    moved = to_arrays(synthetic.jittered(df, 0.01))["means"] - synthetic.object_points(200)
    assert 0 < np.abs(moved).mean() < 0.02


def test_recall_and_pose_errors(spark):
    rows = [("a", 0.01), ("a", 0.5), ("b", None), ("b", 0.03), ("b", 0.04)]
    got = metrics.registration_recall(spark.createDataFrame(rows, "scene string, error double")).first()
    assert got.mean_of_scenes == pytest.approx((0.5 + 2 / 3) / 2) and got.pooled == pytest.approx(0.6)
    truth = lie.se3_exp(R.normal(size=6))
    estimate = truth @ lie.se3_exp(np.array([0, 0, 0, 0, 0, np.radians(10)]))
    estimate[:3, 3] += (0.3, 0, 0.4)
    pairs = spark.createDataFrame([(estimate.ravel().tolist(), truth.ravel().tolist())], "estimate array<double>, truth array<double>")
    row = metrics.rotation_translation_errors(pairs).first()
    assert row.rre == pytest.approx(10) and row.rte == pytest.approx(0.5)
    assert metrics.weighted_pose_error(truth, truth, np.eye(6)) == pytest.approx(0)


def test_public_names():
    for name in "register merge apply_transform Tracker track make_track_residuals estimate_object_pose ObjectPoseEstimator add_metric adds_metric add_auc localize_camera coarse_localize_camera CameraPhotometric bundle_register solve_pose_graph pairwise_consistency SpatialIndex build_index rotate_sh sh_rotation_matrix mac_pose mac_feature_align QualityConfig resolve_quality load_ply save_ply from_gsplat to_gsplat gaussian_sdf gaussian_sdf_grad estimate_anchor_normals voxel_dedupe voxel_dedupe_report knn_dedupe knn_dedupe_report auto_voxel_size auto_knn_radius Residual ICP SDF Prior Photometric SplatPhotometric camera_ring refine_photometric run_lm LevenbergMarquardt".split():
        assert hasattr(gausslake, name)


def test_ascii_files_with_other_elements(spark, tmp_path):
    """Vertices behind another element, in more lines than one chunk; each line is read once."""
    n = 70_000
    head = f"ply\nformat ascii 1.0\nelement camera 2\nproperty list uchar int v\nelement vertex {n}\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    path = tmp_path / "a.ply"
    path.write_text(head + "1 5\n2 5 6\n" + "".join(f"{i} {i % 7} 0.5\n" for i in range(n)))
    got = ply.load_points(spark, str(path)).agg(F.count("*"), F.sum("x"), F.sum("y"), F.max("gid")).first()
    assert tuple(got) == (n, n * (n - 1) / 2, sum(i % 7 for i in range(n)), n - 1)
    path.write_text(head + "1 5\n2 5 6\n0 0 0\n")
    with pytest.raises(Exception, match="ends before"):
        ply.load_points(spark, str(path)).count()


def test_parts_are_joined_in_order(spark, tmp_path):
    """A file of many tasks holds all rows by gid, and nothing else is left beside it."""
    df = from_arrays(spark, np.arange(3000.0).reshape(1000, 3)).repartition(7)
    path = str(tmp_path / "s.ply")
    for _ in range(2):
        assert ply.save_ply(df, path) == 1000
    assert sorted(p.name for p in tmp_path.iterdir()) == ["s.ply"]
    np.testing.assert_allclose(to_arrays(ply.load_ply(spark, "file://" + path))["means"], np.arange(3000.0).reshape(1000, 3))
    empty = str(tmp_path / "e.ply")
    assert ply.save_ply(df.where("gid < 0"), empty) == 0 and ply.load_ply(spark, empty).count() == 0
