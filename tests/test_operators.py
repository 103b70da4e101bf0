"""Spatial joins, fusion, fields and solving against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gausslake.functions import lie
from gausslake.model import from_arrays, stride_sample, to_arrays, to_gsplat, with_scale_convention
from gausslake.operators import field, fuse, metrics, moments, solve, spatial, transform
from gausslake.sources.synthetic import object_points, object_splat

R = np.random.default_rng(1)


@pytest.fixture(scope="module")
def cloud(spark):
    p = R.random((600, 3))
    return p, from_arrays(spark, p, opacities=R.random(600)).cache()


def pairs_of(df):
    return {(r.q, r.a) for r in df.collect()}


def test_radius_joins_are_exact(spark, cloud):
    p, df = cloud
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    want = set(zip(*(x.tolist() for x in np.nonzero(d <= 0.1)), strict=True))
    assert pairs_of(spatial.radius_join(df, df, 0.1)) == want
    assert pairs_of(spatial.grid_radius_join(df, df, 0.1)) == want
    assert pairs_of(spatial.grid_radius_join(df, df, 0.1, other=True)) == {(a, b) for a, b in want if a != b}


def test_nearest_rows_are_exact_even_far_outside(spark, cloud):
    p, df = cloud
    q = np.concatenate((R.random((40, 3)), [[9.0, 9, 9], [-5, 0, 0]]))
    qs = from_arrays(spark, q)
    d = np.linalg.norm(q[:, None] - p[None], axis=2)
    want = {(i, int(a)) for i in range(len(q)) for a in np.argsort(d[i], kind="stable")[:7]}
    for join in (spatial.knn_join, spatial.grid_knn_join):
        got = join(qs, df, 7)
        assert pairs_of(got) == want
        assert got.groupBy("q").count().where("count <> 7").count() == 0


def test_nearest_rows_ties_few_and_none(spark):
    same = from_arrays(spark, np.zeros((5, 3)))
    for join in (spatial.knn_join, spatial.grid_knn_join):
        assert pairs_of(join(same, same, 2)) == {(q, a) for q in range(5) for a in (0, 1)}
        assert pairs_of(join(same, same, 9)) == {(q, a) for q in range(5) for a in range(5)}
        assert join(same, same.where("gid < 0"), 2).count() == 0
        assert join(same.where("gid < 0"), same, 2).count() == 0


def test_places_that_are_not_finite_take_no_part(spark):
    df = from_arrays(spark, [[0, 0, 0], [np.nan, 0, 0], [np.inf, 0, 0]])
    assert pairs_of(spatial.grid_radius_join(df, df, 1.0)) == {(0, 0)}
    assert fuse.voxel_dedupe(df, 1.0).count() == 1


def test_voxel_and_radius_dedupe(spark, cloud):
    p, df = cloud
    a = to_arrays(df)
    cells = np.floor(p / 0.2).astype(int)
    best = {}
    for i in np.lexsort((np.arange(600), -a["opacities"])):
        best.setdefault(tuple(cells[i]), int(i))
    assert {r.gid for r in fuse.voxel_dedupe(df, 0.2).collect()} == set(best.values())
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    o = a["opacities"]
    hidden = ((d <= 0.08) & (o[None] > o[:, None])).any(1)
    kept, report = fuse.knn_dedupe_report(df, 0.08)
    assert {r.gid for r in kept.collect()} == set(np.flatnonzero(~hidden).tolist())
    assert report["before"] == 600 and report["after"] == int((~hidden).sum())


def test_auto_sizes_of_small_tables(spark):
    assert fuse.auto_voxel_size(from_arrays(spark, np.zeros((1, 3)))) == 1.0
    assert fuse.auto_knn_radius(from_arrays(spark, np.zeros((0, 3)))) == 1e-12
    assert fuse.auto_voxel_size(from_arrays(spark, np.zeros((4, 3)), scales=np.full((4, 3), 0.2))) == pytest.approx(0.1)


def test_stride_sample_on_other_ids(spark):
    df = spark.range(50, 250, 2).select(F.col("id").alias("gid"), *[F.lit(0.0).alias(c) for c in "xyz"])
    want = {50 + 2 * int(i) for i in np.round(np.linspace(0, 99, 7))}
    assert {r.gid for r in stride_sample(df, 7).collect()} == want


def test_union_of_scale_conventions(spark):
    a = from_arrays(spark, np.zeros((3, 3)), scales=np.full((3, 3), 0.5))
    b = with_scale_convention(from_arrays(spark, np.ones((3, 3)), scales=np.full((3, 3), 0.25)), True)
    out = to_gsplat(transform.union_splats([a, b]))
    np.testing.assert_allclose(out["scales"][:, 0], [0.5] * 3 + [0.25] * 3)
    assert transform.union_splats([a, b]).select("gid").distinct().count() == 6


def test_moving_a_splat(spark):
    t = lie.sim3_exp(np.array([0.1, 0.2, 0.3, 0.4, -0.2, 0.1, 0.3]))
    df = from_arrays(spark, R.random((20, 3)), quats=R.normal(size=(20, 4)), scales=R.random((20, 3)), colors=R.normal(size=(20, 9, 3)))
    a, b = to_arrays(df), to_arrays(transform.apply_transform(transform.apply_transform(df, t), lie.inverse(t)))
    for k in ("means", "scales", "colors"):
        np.testing.assert_allclose(a[k], b[k], atol=1e-9)
    np.testing.assert_allclose(lie.quat_to_matrix(a["quats"]), lie.quat_to_matrix(b["quats"]), atol=1e-9)


def test_field_on_tables_and_arrays(spark):
    p = object_points(200)
    anchors = field.thin_normals(from_arrays(spark, p, quats=R.normal(size=(200, 4)), scales=R.random((200, 3))))
    q = p[:30] + 0.004
    queries = from_arrays(spark, np.concatenate((q, [[5.0, 5, 5]])))
    t = anchors.orderBy("gid").toPandas()
    d, g = field.sdf_arrays(q, p, t[["nx", "ny", "nz"]].to_numpy(), 0.03, 200)
    got = field.gaussian_sdf_grad(anchors, queries, 0.03).orderBy("q").toPandas()
    np.testing.assert_allclose(got.d[:30], d, atol=1e-9)
    np.testing.assert_allclose(got[["gx", "gy", "gz"]].to_numpy()[:30], g, atol=1e-7)
    assert got.d[30] == 0 and field.gaussian_sdf(anchors, queries, 0.03).where("q = 30").first()["d"] == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _wide(spark):
    """Anchors with normals and opacities, a few of them null or no number, and queries, one far away and one nowhere."""
    p = R.random((1500, 3)) * 3
    n, o = R.normal(size=(1500, 3)), R.random(1500)
    rows = [(i, *map(float, p[i]), *map(float, n[i]), float(o[i])) for i in range(1500)]
    rows[7] = (7, *rows[7][1:4], None, None, None, None)
    rows[8] = (8, *rows[8][1:4], float("nan"), 0.5, 0.5, 1.0)
    rows[9] = (9, None, 0.5, float("inf"), *rows[9][4:])
    anchors = spark.createDataFrame(rows, "gid long, x double, y double, z double, nx double, ny double, nz double, opacity double")
    asked = [(i, *map(float, x)) for i, x in enumerate(R.random((300, 3)) * 3)] + [(300, 50.0, 50.0, 50.0), (301, None, 1.0, 1.0)]
    return anchors, spark.createDataFrame(asked, "gid long, x double, y double, z double")


def test_values_of_a_field_take_no_table_of_pairs(spark, monkeypatch):
    anchors, queries = _wide(spark)
    made = field.gaussian_sdf(anchors, queries, 0.2, use_opacity=True)
    assert "Join" not in _plan(made) and "HashAggregate" not in _plan(made)
    got = made.orderBy("q").toPandas()
    monkeypatch.setattr(field, "SENT", 0)
    joined = field.gaussian_sdf(anchors, queries, 0.2, use_opacity=True)
    assert _plan(joined).count("SortMergeJoin") + _plan(joined).count("BroadcastHashJoin") == 2
    np.testing.assert_allclose(got, joined.orderBy("q").toPandas(), atol=1e-9)
    assert got.d[300] == got.d[301] == 0 and 0 < np.isnan(got.d).sum() < 50


def test_gradients_of_a_field_take_no_table_of_pairs(spark, monkeypatch):
    anchors, queries = _wide(spark)
    made = field.gaussian_sdf_grad(anchors, queries, 0.2, use_opacity=True)
    assert "Join" not in _plan(made) and "HashAggregate" not in _plan(made)
    got = made.orderBy("q").toPandas()
    monkeypatch.setattr(field, "SENT", 0)
    joined = field.gaussian_sdf_grad(anchors, queries, 0.2, use_opacity=True).orderBy("q").toPandas()
    np.testing.assert_allclose(got, joined, atol=1e-7)
    nearest = field.gaussian_sdf_grad(anchors, queries, 0.2, most=1500, use_opacity=True).orderBy("q").toPandas()
    np.testing.assert_allclose(got, nearest, atol=1e-7)


def _brute_sums(p, a, sigma, radius):
    d = np.sqrt(sum((p[:, i, None] - a[i]) ** 2 for i in range(3)))
    o, n = a[:3, None] - p.T[:, :, None], a[3:6, None]
    terms = [np.ones_like(d), *o, *(n + 0 * d), *[o[j] * o[k] for j in range(3) for k in range(j, 3)], *[n[j] * o[k] for j in range(3) for k in range(3)]]
    with np.errstate(invalid="ignore"):
        return np.stack([np.where(d <= radius, np.exp(-d * d / (2 * sigma * sigma)) * a[6] * t, 0).sum(1) for t in terms], 1)


@pytest.mark.parametrize(("spread", "radius"), [(1.0, 0.25), (40.0, 0.25), (40.0, 8.0)])
def test_sums_of_tiles_are_those_of_all_pairs(monkeypatch, spread, radius):
    """Pairs just at the radius, places far from the origin, sparse tiles, anchors that are no number."""
    rng = np.random.default_rng(4)
    a = np.concatenate((rng.random((3, 3000)) * spread + 1000, rng.normal(size=(3, 3000)), rng.random((1, 3000))))
    a[:3, 0] = 1000.5
    p = np.concatenate((rng.random((200, 3)) * spread + 1000, [[1000.75, 1000.5, 1000.5], [1000.5, 1000.25, 1000.5], [3000.0, 0, 0]]))
    odd = a[:, :3].copy()
    odd[3, 0], odd[6, 1] = np.nan, np.inf
    got, want = np.zeros((len(p), 22)), _brute_sums(p, np.concatenate((a, odd), 1), radius / 3, radius)
    monkeypatch.setattr(field, "BLOCK", 200)
    tiles = field._tiles(a[:3].T, 64)
    field._slice_sums(p, field._tiles(p, 50), a[:, np.concatenate(tiles)], np.cumsum([0, *map(len, tiles)]), odd, radius / 3, radius, True, got)
    assert np.isnan(want).any() and np.isfinite(want[:, 0]).sum() > 50
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)


def test_the_driver_holds_a_slice_of_the_anchors(spark, monkeypatch):
    anchors, queries = _wide(spark)
    whole = field.gaussian_sdf_grad(anchors, queries, 0.2, use_opacity=True).orderBy("q").toPandas()
    taken, take = [], type(anchors).toArrow

    def counted(df):
        taken.append((t := take(df)).num_rows)
        return t

    monkeypatch.setattr(type(anchors), "toArrow", counted)
    monkeypatch.setattr(field, "SLICE", 400, raising=False)
    sliced = field.gaussian_sdf_grad(anchors, queries, 0.2, use_opacity=True)
    assert sum(taken) == 1499 and max(taken) < 800
    np.testing.assert_allclose(sliced.orderBy("q").toPandas(), whole, atol=1e-9)


def test_crowded_cells_beyond_what_is_sent_are_not_joined(spark, monkeypatch):
    """Beyond `SENT` anchors a join makes pairs only where cells, counted, hold few of them."""
    anchors, queries = _wide(spark)
    monkeypatch.setattr(field, "SENT", 0)
    joined = field.gaussian_sdf_grad(anchors, queries, 0.2, use_opacity=True).orderBy("q").toPandas()
    monkeypatch.setattr(field, "PAIRS", 1000, raising=False)
    monkeypatch.setattr(field, "PAIRS_A_ROW", 10, raising=False)
    monkeypatch.setattr(field, "SLICE", 400, raising=False)
    made = field.gaussian_sdf_grad(anchors, queries, 0.2, use_opacity=True)
    assert "Join" not in _plan(made)
    np.testing.assert_allclose(made.orderBy("q").toPandas(), joined, atol=1e-7)
    sparse = field.gaussian_sdf_grad(anchors, queries, 0.005, use_opacity=True)
    assert "Join" in _plan(sparse)
    monkeypatch.setattr(field, "PAIRS_A_ROW", -1, raising=False)
    monkeypatch.setattr(field, "PAIRS", -1, raising=False)
    again = field.gaussian_sdf_grad(anchors, queries, 0.005, use_opacity=True)
    np.testing.assert_allclose(again.orderBy("q").toPandas(), sparse.orderBy("q").toPandas(), atol=1e-7)


def test_rows_of_a_field_residual_take_no_table_of_pairs(spark):
    """What joins is one row per source row: its field and its place."""
    anchors = from_arrays(spark, object_points(150), quats=R.normal(size=(150, 4)), scales=R.random((150, 3)))
    made = solve.SDF(0.03, samples=None, knn=None).table(np.eye(4), anchors, from_arrays(spark, object_points(40) + 0.002))
    assert _plan(made).count("Join") == 1 and made.count() == 40


@pytest.mark.parametrize("residual", [solve.ICP(), solve.ICP(point_to_plane=True), solve.SDF(0.03, samples=None, knn=400)])
def test_derivatives_and_both_strategies(spark, residual):
    p = object_points(150)
    target = from_arrays(spark, p, quats=R.normal(size=(150, 4)), scales=R.random((150, 3)))
    source = from_arrays(spark, p[::3] + 0.002)
    a, b, t = solve.Cloud.of(target), solve.Cloud.of(source), lie.sim3_exp(R.normal(size=7) * 0.01)
    r, j = residual.rows(t, a, b)
    n = solve.numeric_jacobian(lambda x: residual.rows(x, a, b)[0], t, step=1e-7)
    assert (np.abs(n - j).max(1) < 1e-4).mean() >= 0.98
    h, g, cost, rows = solve.normal_equations(residual.table(t, target, source))
    w = residual.weight
    np.testing.assert_allclose(h, w * j.T @ j, rtol=1e-6, atol=1e-8)
    np.testing.assert_allclose(g, w * j.T @ r, rtol=1e-6, atol=1e-8)
    assert rows == len(r) and cost == pytest.approx(0.5 * w * r @ r)


def test_table_loop_equals_array_loop(spark):
    p = object_points(120)
    target, source = from_arrays(spark, p), from_arrays(spark, p + 0.003)
    a = solve.run_lm(np.eye(4), [solve.ICP()], target, source, n_iters=3)
    b = solve.run_lm(np.eye(4), [solve.ICP()], solve.Cloud.of(target), solve.Cloud.of(source), n_iters=3)
    np.testing.assert_allclose(a.T, b.T, atol=1e-9)


def test_covariance_grows_with_noise_and_is_none_if_singular():
    p = R.normal(size=(300, 3)) * (0.3, 0.2, 0.1)
    trace = []
    for noise in (1e-3, 2e-3):
        q = p + R.normal(size=p.shape) * noise
        c = solve.Cloud(q, np.tile([0, 0, 1.0], (300, 1)))
        trace.append(np.trace(solve.run_lm(np.eye(4), [solve.ICP()], c, solve.Cloud(p, c.normals)).info["covariance"]))
    assert trace[1] > 2 * trace[0]
    flat = solve.Cloud(np.zeros((50, 3)), np.tile([0, 0, 1.0], (50, 1)))
    assert solve.run_lm(np.eye(4), [solve.ICP()], flat, flat).info["covariance"] is None


def test_metrics(spark):
    a, b = object_splat(spark, 300), object_splat(spark, 300, seed=3)
    p, q = object_points(300), object_points(300, seed=3)
    d = np.linalg.norm(p[:, None] - q[None], axis=2)
    assert metrics.chamfer(a, b) == pytest.approx(500 * (d.min(0).mean() + d.min(1).mean()))
    assert metrics.overlap_fraction(a, b, 0.01) == pytest.approx((d.min(0) <= 0.01).mean())
    nn = spatial.nearest_join(a, b)
    assert metrics.trimmed(nn, 0.8) == pytest.approx(np.sort(d.min(1))[:240].mean())
    e = spark.createDataFrame([(x,) for x in (0.0, 0.05, 0.5)], "error double")
    t = np.linspace(0, 0.1, 1001)
    recall = np.array([(np.array([0.0, 0.05, 0.5]) <= x + 1e-15).mean() for x in t])
    assert metrics.add_auc(e) == pytest.approx(np.trapezoid(recall, t) / 0.1)
    assert metrics.add_auc(e.where("error < 0")) == 0.0


def test_similarities_by_key(spark):
    truth = {k: lie.sim3_exp(R.normal(size=7) * 0.5) for k in (1, 2)}
    rows = [(k, *map(float, p), *map(float, lie.apply(t, p[None])[0]), float(w)) for k, t in truth.items() for p, w in zip(R.normal(size=(30, 3)), R.random(30) + 0.1, strict=True)]
    pairs = spark.createDataFrame([*rows, (3, *[None] * 7)], "k int, sx double, sy double, sz double, tx double, ty double, tz double, w double")
    for weight in (None, "w"):
        got = {r.k: np.array(r.pose).reshape(4, 4) for r in moments.fit(pairs, ["k"], weight=weight).collect()}
        assert got.keys() == truth.keys()
        for k, t in truth.items():
            np.testing.assert_allclose(got[k], t, atol=1e-8)
    assert moments.fit(pairs.where("k < 0")).first().pose == np.eye(4).ravel().tolist()
