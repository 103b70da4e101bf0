"""Poses end to end, graphs, cameras, files, streams and the command line."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gausslake import cli
from gausslake.functions import lie
from gausslake.model import from_arrays, to_arrays
from gausslake.operators import align, bundle, camera, features, photometric, register, rigidity
from gausslake.operators.metrics import pose_error
from gausslake.operators.solve import Cloud
from gausslake.operators.transform import apply_transform
from gausslake.plans.quality import QualityConfig, resolve_quality
from gausslake.sources import ply
from gausslake.sources.synthetic import object_points, object_splat
from gausslake.streaming.tracker import frames, track_stream, with_normals

R = np.random.default_rng(2)


def pose(degrees, scale=1.0):
    axis = np.array([0.3, 0.9, 0.25])
    t = np.eye(4)
    t[:3, :3], t[:3, 3] = scale * lie.so3_exp(np.radians(degrees) * axis / np.linalg.norm(axis)), (0.03, -0.02, 0.025)
    return t


@pytest.mark.parametrize(("degrees", "scale", "kind"), [(30, 1.0, "se3"), (90, 1.0, "se3"), (5, 1.0, "sim3"), (30, 1.3, "sim3"), (90, 0.8, "sim3")])
def test_recovery(spark, degrees, scale, kind):
    source = object_splat(spark, 300)
    truth = pose(degrees, scale)
    got = register.register(apply_transform(source, truth), source, transform=kind)
    e = pose_error(got.T, truth)
    assert e["rotation_deg"] < 2 and e["translation"] < 0.005 and e["scale"] < 0.02


def test_global_seeds_and_noise(spark):
    p, truth = object_points(400), pose(120)
    t, _ = align.global_align(p, lie.apply(truth, object_points(400, seed=0)) + R.normal(size=p.shape) * 5e-4, n_seeds=256)
    assert pose_error(t, truth)["rotation_deg"] < 2


def test_wrong_arguments(spark):
    s = object_splat(spark, 10)
    with pytest.raises(ValueError, match="transform"):
        register.register(s, s, transform="affine")
    with pytest.raises(NotImplementedError):
        register.register(s, s, backend="gtsam")
    with pytest.raises(ValueError, match="init"):
        register.register(s, s, init="nothing")
    with pytest.raises(ValueError, match="quality"):
        resolve_quality("best")
    assert resolve_quality(0.5).n_points == 8192 and resolve_quality(QualityConfig(7)).n_points == 7


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_cliques_stand_outliers(share):
    s = R.normal(size=(200, 3)) * 0.3
    truth = pose(70)
    t = lie.apply(truth, s) + R.normal(size=s.shape) * 0.003
    out = R.random(200) < share
    t[out] = R.normal(size=(out.sum(), 3)) * 0.3
    got = rigidity.mac_pose(s, t)
    assert got["success"] and pose_error(got["T"], truth)["rotation_deg"] < 2
    assert not rigidity.mac_pose(s, R.normal(size=s.shape) * 5, tolerance=1e-4)["success"]


def test_maximal_cliques_of_a_known_graph():
    graph = {0: {1, 2}, 1: {0, 2, 3}, 2: {0, 1, 3}, 3: {1, 2, 4}, 4: {3}}
    assert sorted(rigidity.enumerate_maximal_cliques(graph)) == [(0, 1, 2), (1, 2, 3)]
    assert len(list(rigidity.enumerate_maximal_cliques(graph, most=1))) == 1


def test_descriptors_on_tables_and_arrays(spark):
    p = object_points(120)
    got = {r.gid: r.descriptor for r in features.fpfh(from_arrays(spark, p), 10).collect()}
    np.testing.assert_allclose([got[i] for i in range(120)], features.fpfh_arrays(p, 10), atol=1e-6)


def test_merge_drops_repeats(spark):
    a = object_splat(spark, 400)
    truth = pose(40, 1.1)
    out, report = register.merge([a, apply_transform(a, lie.inverse(truth))], init="features", voxel=0.004)
    assert pose_error(report["results"][1].T, truth)["rotation_deg"] < 2
    assert out.count() <= 400 < register.merge([a, a], dedupe=False, poses=[np.eye(4), np.eye(4)])[0].count()


def test_pose_graph_rejects_a_bad_edge():
    poses = [np.eye(4), *(lie.se3_exp(R.normal(size=6) * 0.4) for _ in range(4))]
    rel = {(i, j): lie.inverse(poses[i]) @ poses[j] @ lie.se3_exp(R.normal(size=6) * 1e-3) for i in range(5) for j in range(i + 1, 5)}
    rel[1, 3] = rel[1, 3] @ lie.se3_exp(np.array([0.3, 0.2, 0.1, 0.5, 0.4, 0.3]))
    got = bundle.solve_pose_graph(5, rel)
    assert got.rejected_edges == [(1, 3)]
    assert max(np.abs(a - b).max() for a, b in zip(got.poses, poses, strict=True)) < 0.02


def test_joint_poses_beat_the_chain():
    poses = [pose(72 * k) for k in range(5)]
    poses = [lie.inverse(poses[0]) @ p for p in poses]
    pairs = [*bundle.auto_pairs(5), (0, 2), (1, 3)]
    rel = {(i, j): lie.inverse(poses[i]) @ poses[j] @ lie.se3_exp(R.normal(size=6) * 0.02) for i, j in pairs}
    chain = bundle.pairwise_consistency(bundle.sequential_poses(5, {e: rel[e] for e in pairs[:4]}), rel)["max"]
    assert bundle.solve_pose_graph(5, rel, robust=None).max_edge_err < chain


def test_tracking_follows(spark):
    source = object_splat(spark, 350)
    tracker = register.Tracker(source, init=pose(25))
    for degrees in (26, 28):
        r = tracker.track(apply_transform(source, pose(degrees)))
        assert pose_error(r.T, pose(degrees))["rotation_deg"] < 3
    tracker.reset()
    assert tracker.pose is None


@pytest.mark.parametrize("more", [{}, {"watermark": "1 minute", "forget_after": 60.0}])
def test_tracking_a_stream(spark, tmp_path, more):
    p = object_points(250)
    rows = [("a", k, datetime(2024, 1, 1, 0, 0, k), *map(float, q)) for k in range(3) for q in lie.apply(pose(1.0 * k), p)]
    table = spark.createDataFrame(rows, "obj_id string, frame_id long, ts timestamp, x double, y double, z double")
    frames(table).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames(table).schema).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="watermark"):
        track_stream(stream, with_normals(p), 0.01, forget_after=1.0)
    out = track_stream(stream, with_normals(p), 0.01, pose(0.0), **more)
    q = out.writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.frame_id: np.array(r.pose).reshape(4, 4) for r in spark.table("tracked").collect()}
    assert sorted(got) == [0, 1, 2]
    assert pose_error(got[2], pose(2.0))["rotation_deg"] < 2


def test_coarse_camera(spark):
    p = np.concatenate([np.stack((R.random(n) * w + x, R.random(n) * 0.02, R.random(n) * h + z), 1) for n, w, h, x, z in ((300, 0.05, 0.5, 0, 0), (150, 0.3, 0.05, 0, 0.45), (100, 0.2, 0.05, 0, 0.25))])
    splat = from_arrays(spark, p)
    k = np.array([[180.0, 0, 80], [0, 180.0, 80], [0, 0, 1]])
    poses = camera.candidate_poses(p.mean(0), 2.5 * np.linalg.norm(p - p.mean(0), axis=1).max())
    seen = camera.project(splat, poses[17], k).where("u >= 0 and u < 160 and v >= 0 and v < 160")
    got = camera.coarse_localize_camera(splat, seen.selectExpr("u", "v", "1.0 as mask"), k, 160, 160)
    assert got["index"] == 17 and got["iou"] == 1.0


def test_photometric_refinement_lowers_the_error(spark):
    p = R.normal(size=(200, 3))
    p *= 0.1 / np.linalg.norm(p, axis=1, keepdims=True)
    paint = np.stack((np.arctan2(p[:, 1], p[:, 0]) / (2 * np.pi) + 0.5, p[:, 2] * 5 + 0.5, np.full(200, 0.5)), 1)
    source = from_arrays(spark, p, scales=np.full((200, 3), 0.01), colors=paint)
    truth = lie.se3_exp(np.array([0.0, 0, 0, 0, 0, 0.1]))
    got = photometric.refine_photometric(apply_transform(source, truth), source, np.eye(4), iterations=6)
    assert pose_error(got.T, truth)["rotation_deg"] < pose_error(np.eye(4), truth)["rotation_deg"] / 2


def test_exposure(spark):
    rows = [(x, x, x, 0.9 * x + 0.05, 3 * x, x - 0.5) for x in np.linspace(0.1, 0.9, 40).tolist()]
    fit = camera.exposure_fit(spark.createDataFrame(rows, "pr double, pg double, pb double, tr double, tg double, tb double"))
    assert fit["r"] == pytest.approx((0.9, 0.05)) and fit["g"][0] == 2.0 and fit["b"][1] == -0.2
    assert camera.exposure_fit(spark.createDataFrame(rows[:3], "pr double, pg double, pb double, tr double, tg double, tb double"))["r"] == (1.0, 0.0)


@pytest.mark.parametrize("k", [None, 1, 4, 16])
def test_files_round_trip(spark, tmp_path, k):
    colors = None if k is None else R.random((64, 3)) if k == 1 else R.normal(size=(64, k, 3))
    df = from_arrays(spark, R.normal(size=(64, 3)), quats=R.normal(size=(64, 4)), scales=R.random((64, 3)) + 0.1, opacities=R.normal(size=64), colors=colors)
    path = str(tmp_path / "s.ply")
    assert ply.save_ply(df, path) == 64
    a, b = to_arrays(df), to_arrays(ply.load_ply(spark, path))
    np.testing.assert_allclose(b["means"], a["means"], atol=1e-6)
    np.testing.assert_allclose(np.exp(b["scales"]), a["scales"], atol=1e-6)
    np.testing.assert_allclose(b["colors"], np.full((64, 3), 0.5) if k is None else a["colors"], atol=1e-5)


def test_big_endian_splits_and_errors(spark, tmp_path):
    kind = np.dtype([("x", ">f4"), ("y", ">f4"), ("z", ">f4"), ("n", ">u4")])
    data = np.zeros(10, kind)
    data["x"], data["n"] = np.arange(10), 4_000_000_000
    head = b"ply\nformat binary_big_endian 1.0\ncomment c\nelement vertex 10\nproperty float x\nproperty float y\nproperty float z\nproperty uint n\nend_header\n"
    path = tmp_path / "b.ply"
    path.write_bytes(head + data.tobytes())
    ply.register_source(spark)
    df = spark.read.format("splat_ply").option("rowsPerPartition", 3).load(str(path))
    got = df.orderBy("gid").toPandas()
    assert got.x.tolist() == list(range(10)) and got.n.tolist() == [4_000_000_000] * 10
    with pytest.raises(ValueError, match="lacks"):
        ply.load_ply(spark, str(path))
    with pytest.raises(ValueError, match="list"):
        ply.parse_header(["ply", "format ascii 1.0", "element vertex 1", "property list uchar int v"])


def test_command_line(spark, tmp_path, capsys):
    a, b = str(tmp_path / "a.ply"), str(tmp_path / "b.ply")
    s = object_splat(spark, 300)
    ply.save_ply(s, a)
    ply.save_ply(apply_transform(s, lie.inverse(pose(20))), b)
    assert cli.main(["info", a], spark) == 0 and "n: 300" in capsys.readouterr().out
    assert cli.main(["align", a, b, "--output", str(tmp_path / "c.ply")], spark) == 0
    assert "converged" in capsys.readouterr().out and (tmp_path / "c.ply").exists()
    assert cli.main(["merge", a, b, "--init", "features", "--output", str(tmp_path / "m.ply")], spark) == 0
    assert cli.main(["info", str(tmp_path / "none.ply")], spark) == 2


def test_cloud_sampling():
    c = Cloud(np.arange(30.0).reshape(10, 3), np.zeros((10, 3)))
    assert len(c.sample(4).means) == 4 and c.sample(None) is c and len(c.sample(3, seed=1).means) == 3


def test_second_order_weights_both_ways(spark, monkeypatch):
    s = R.normal(size=(60, 3)) * 0.3
    t = lie.apply(pose(30), s) + R.normal(size=s.shape) * 0.02
    rows = [(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(s, t, strict=True))]
    c = spark.createDataFrame(rows, "cid long, sx double, sy double, sz double, tx double, ty double, tz double")
    edges = rigidity.compatibility_edges(c, 0.05)
    _, w2 = rigidity.compatibility_graph(s, t, 0.05)
    want = {(i, j): w2[i, j] for i in range(60) for j in range(i + 1, 60) if w2[i, j] > 0}
    for most in (3000, 0):
        monkeypatch.setattr(rigidity, "DENSE", most)
        got = {(r.i, r.j): r.w for r in rigidity.second_order(edges).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


def _matched(spark, n, copies=0):
    """Correspondences with ids of steps, a few of them copies of one and one without a place, and their edges by tables."""
    s = R.normal(size=(n, 3)) * 0.3
    t = lie.apply(pose(30), s) + R.normal(size=s.shape) * 0.02
    s[1 : 1 + copies], t[1 : 1 + copies] = s[0], t[0]
    rows = [(3 * i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(s, t, strict=True))]
    rows.append((3 * n, None, 0.0, 0.0, 0.0, 0.0, float("nan")))
    c = spark.createDataFrame(rows[::-1], "cid long, sx double, sy double, sz double, tx double, ty double, tz double")
    return c, rigidity.second_order(rigidity.compatibility_edges(c, 0.05)).cache()


def _weights(df):
    return {(r.i, r.j): r.w for r in df.collect()}


def test_second_order_weights_are_made_in_tiles(spark, monkeypatch):
    c, w = _matched(spark, 150)
    want = _weights(w)
    for tile, kept in ((1024, 1 << 30), (40, 1 << 30), (40, 0)):
        monkeypatch.setattr(rigidity, "TILE", tile)
        monkeypatch.setattr(rigidity, "KEPT", kept)
        made = rigidity.second_order_weights(c, 0.05)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        got = _weights(made)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
    twice = c.union(c.where("cid = 30"))
    assert sorted(_weights(rigidity.second_order_weights(twice, 0.05))) == sorted(_weights(rigidity.second_order(rigidity.compatibility_edges(twice, 0.05))))
    assert rigidity.second_order_weights(c.limit(0), 0.05).count() == 0


def test_capped_weights_rank_only_the_heaviest_of_each_tile(spark, monkeypatch):
    c, w = _matched(spark, 150, copies=20)
    want = _weights(rigidity.degree_cap(w.withColumn("w", F.round("w", 6)), 5))
    for tile in (1024, 40, 3):
        monkeypatch.setattr(rigidity, "TILE", tile)
        made = rigidity.capped_weights(c, 0.05, 5)
        got = _weights(made)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=2e-6) for k, v in want.items())
    assert rigidity.capped_weights(c.limit(0), 0.05).count() == 0


def test_capped_weights_of_copies_and_near_ties(spark, monkeypatch):
    c, _ = _matched(spark, 150, copies=20)
    noise = c.where("cid % 2 = 0").selectExpr("cid + 10000 as cid", "sx + cid * 1e-12 as sx", "sy", "sz", "tx", "ty", "tz")
    c = c.union(noise).union(c.where("cid % 5 < 2").selectExpr("cid + 20000 as cid", "sx", "sy", "sz", "tx", "ty", "tz")).cache()
    w = rigidity.second_order(rigidity.compatibility_edges(c, 0.05)).cache()
    want, all_of = _weights(rigidity.degree_cap(w.withColumn("w", F.round("w", 6)), 5)), _weights(w)
    places, tiles = [], rigidity._on_tiles
    monkeypatch.setattr(rigidity, "_on_tiles", lambda spark, p, *more: places.append(len(p)) or tiles(spark, p, *more))
    for tile in (8192, 100):
        monkeypatch.setattr(rigidity, "TILE", tile)
        got = _weights(rigidity.capped_weights(c, 0.05, 5))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=2e-6) for k, v in want.items())
        got = _weights(rigidity.second_order_weights(c, 0.05))
        assert got.keys() == all_of.keys() and all(got[k] == pytest.approx(v) for k, v in all_of.items())
    # copies are multiplied once
    assert set(places) == {c.where("sx is not null and not isnan(tz)").drop("cid").distinct().count()}


def test_second_order_weights_multiply_copies_once(spark, monkeypatch):
    s = R.normal(size=(40, 3)) * 0.3
    t = lie.apply(pose(30), s) + R.normal(size=s.shape) * 0.02
    s, t = np.tile(s, (10, 1)), np.tile(t, (10, 1))
    rows = [(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(s, t, strict=True))]
    c = spark.createDataFrame(rows, "cid long, sx double, sy double, sz double, tx double, ty double, tz double")
    places, tiles = [], rigidity._on_tiles
    monkeypatch.setattr(rigidity, "_on_tiles", lambda spark, p, *more: places.append(len(p)) or tiles(spark, p, *more))
    got = _weights(rigidity.second_order_weights(c, 0.05))
    _, w2 = rigidity.compatibility_graph(s, t, 0.05)
    want = {(i, j): w2[i, j] for i in range(400) for j in range(i + 1, 400) if w2[i, j] > 0}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
    assert places == [40]
