"""More named queries, one or more for each operator that the first catalog leaves out, and their SQL.

Where an operator's answer cannot be written as SQL, the input is made from a known truth and the SQL states it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions import lie
from ..operators import bundle, camera, features, field, metrics, moments, photometric, solve, spatial, transform
from . import catalog as C
from .catalog import POSE, RIGID, SIGMA, SQL_AB, SQL_E, halves, query, r6, splats, sql_d, sql_moved, sql_nn, sql_r6
from .quality import resolve_quality

ENTRIES = [f"m{i}{j}" for i in range(3) for j in range(4)]


def _sixes(items) -> str:
    return ", ".join(sql_r6(x, n) for x, n in items)


# ---- colours, rotations, opacities --------------------------------------------------------------------------------


@query(f"with {SQL_E} select gid, {_sixes([('x * 0.28209479177387814 + 0.5', 'rgb'), ('(y - 0.5) / 0.28209479177387814', 'dc')])} from e")
def color_codecs(spark, sf_dir):
    """First coefficient to colour and back."""
    return splats(spark, sf_dir).select("gid", r6(E.dc_to_rgb(F.col("x")), "rgb"), r6(E.rgb_to_dc(F.col("y")), "dc"))


@query(f"with {SQL_E} select gid, {_sixes([('1 / (1 + exp(-opacity))', 'alpha'), ('opacity', 'plain')])} from e")
def opacity_weights(spark, sf_dir):
    """Opacities as logits and as they are."""
    from ..model import opacity_weight

    return splats(spark, sf_dir).select("gid", r6(opacity_weight(True), "alpha"), r6(opacity_weight(False), "plain"))


_UNIT = "u as (select gid, x, y, z, qw / n as w, qx / n as a, qy / n as b, qz / n as c from (select *, greatest(sqrt(qw * qw + qx * qx + qy * qy + qz * qz), 1e-12) as n from e))"
_ROTATION = [["1 - 2 * (b * b + c * c)", "2 * (a * b - w * c)", "2 * (a * c + w * b)"], ["2 * (a * b + w * c)", "1 - 2 * (a * a + c * c)", "2 * (b * c - w * a)"], ["2 * (a * c - w * b)", "2 * (b * c + w * a)", "1 - 2 * (a * a + b * b)"]]


@query(f"with {SQL_E}, {_UNIT} select gid, {_sixes((_ROTATION[i][j], f'r{i}{j}') for i in range(3) for j in range(3))} from u")
def rotation_matrices(spark, sf_dir):
    """The rotation of every splat as a matrix."""
    m = E.rotation_columns()
    return splats(spark, sf_dir).select("gid", *[r6(m[i][j], f"r{i}{j}") for i in range(3) for j in range(3)])


_HARMONIC = [["x", "y", "z"], ["sx", "sy", "sz"], ["qx", "qy", "qz"], ["qw", "opacity", "x"]]
_G = {c: [f"(-{_HARMONIC[3][c]})", f"(-{_HARMONIC[1][c]})", f"({_HARMONIC[2][c]})"] for c in range(3)}
_TURNED = {c: [" + ".join(f"({float(RIGID[i, k])!r}::double * {_G[c][k]})" for k in range(3)) for i in range(3)] for c in range(3)}


@query(f"with {SQL_E} select gid, {_sixes((x, f'c{k}{c}') for c in range(3) for k, x in enumerate([_HARMONIC[0][c], f'-({_TURNED[c][1]})', _TURNED[c][2], f'-({_TURNED[c][0]})']))} from e")
def sh_rotation(spark, sf_dir):
    """Four colour coefficients of every splat turned by a rotation: degree 1 turns like a vector."""
    e = splats(spark, sf_dir)
    colors = F.array(*[F.array(*row) for row in _HARMONIC])
    colored = e.withColumns({"colors": colors, "is_rgb": F.lit(False)})
    out = transform.apply_transform(colored, RIGID)
    return out.select("gid", *[r6(F.col("colors")[k][c], f"c{k}{c}") for c in range(3) for k in range(4)])


@query(f"with {SQL_E} select gid, {_sixes([*zip(sql_moved(RIGID), 'xyz', strict=True), ('sx', 'c00'), ('sz', 'c12')])} from e")
def transform_without_colors(spark, sf_dir):
    """A move that leaves colour coefficients as they are."""
    e = splats(spark, sf_dir)
    colored = e.withColumns({"colors": F.array(F.array("sx", "sy", "sz"), F.array("sx", "sy", "sz")), "is_rgb": F.lit(False)})
    out = transform.apply_transform(colored, RIGID, rotate_colors=False)
    return out.select("gid", *[r6(F.col(c), c) for c in "xyz"], r6(F.col("colors")[0][0], "c00"), r6(F.col("colors")[1][2], "c12"))


@query(f"with {SQL_E} select gid, {_sixes([*zip(sql_moved(POSE), 'xyz', strict=True), ('qw', 'qw'), (f'sx * {C._S!r}', 'sx'), (f'sz * {C._S!r}', 'sz')])} from e")
def baked_splats(spark, sf_dir):
    """A known move of places and scales only."""
    out = transform.bake(splats(spark, sf_dir), POSE)
    return out.select("gid", *[r6(F.col(c), c) for c in ("x", "y", "z", "qw", "sx", "sz")])


@query(f"with {SQL_E}, k as (select gid, row_number() over (order by gid) - 1 as r, count(*) over () as n from e), s as (select *, n // 70 as step, 5 % (n // 70) as off from k), p as (select *, r >= off and (r - off) % step = 0 and (r - off) // step < 70 as picked from s), c as (select count(*) filter (picked) as c from p) select gid from p, c where n <= 70 or picked or r >= n - (70 - c) order by gid limit 70")
def icp_source_rows(spark, sf_dir):
    """70 source rows by steps from an offset: the sampling of a residual."""
    from ..model import strided_sample

    return strided_sample(splats(spark, sf_dir), 70, seed=5).select("gid")


@query(f"with {SQL_AB}, m as (select max(gid) + 1 as m from a), b2 as (select gid + m as gid, x, y, z, opacity from b, m), t as (select gid, x, y, z, opacity from a union all select * from b2), v as (select *, {C.sql_cell(C.VOXEL)} from t) select gid, {_sixes(zip('xyz', 'xyz', strict=True))}, opacity from v qualify row_number() over (partition by cx, cy, cz order by opacity desc, gid) = 1")
def merge_splats(spark, sf_dir):
    """A and the moved B in one frame, without the rows that others hide."""
    a, b = halves(spark, sf_dir)
    out, _ = C.merge([a, transform.apply_transform(b, lie.inverse(POSE))], poses=[np.eye(4), POSE], voxel=C.VOXEL)
    return out.select("gid", *[r6(F.col(c), c) for c in "xyz"], "opacity")


# ---- Lie groups ---------------------------------------------------------------------------------------------------


def _tangents(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("gid"), *[(F.col("embedding")[i].cast("double") * 2).alias(f"v{i}") for i in range(7)])


def _by_row(rows: DataFrame, f, names: list[str]) -> DataFrame:
    """`gid` and the numbers that `f` makes of the other columns of a row, rounded; transforms are driver functions."""

    def work(batches):
        for b in batches:
            values = np.stack([b.column(i).to_numpy() for i in range(1, b.num_columns)], 1)
            made = np.array([np.asarray(f(v), float).ravel() for v in values]).reshape(len(values), len(names))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in made.T]], ["gid", *names])

    out = rows.mapInArrow(work, "gid long, " + ", ".join(f"{n} double" for n in names))
    return out.select("gid", *[r6(F.col(n), n) for n in names])


_XI = "x as (select vec_id as gid, " + ", ".join(f"embedding[{i + 1}]::double * 2 as v{i}" for i in range(7)) + " from embeddings), k as (select *, sqrt(v3 * v3 + v4 * v4 + v5 * v5) as th from x), s as (select *, sin(th) / th as ca, (1 - cos(th)) / (th * th) as cb, (th - sin(th)) / (th * th * th) as cc, exp(v6) as es from k)"
_SKEW = [["0", "-v5", "v4"], ["v5", "0", "-v3"], ["-v4", "v3", "0"]]


def _so3(i: int, j: int, first: str, second: str) -> str:
    """An entry of I + first * K + second * K K in SQL."""
    one = f"(1 - {second} * th * th)" if i == j else "0"
    return f"({one} + {second} * v{3 + i} * v{3 + j} + {first} * ({_SKEW[i][j]}))"


_EXP = {f"m{i}{j}": _so3(i, j, "ca", "cb") for i in range(3) for j in range(3)} | {f"m{i}3": " + ".join(f"{_so3(i, j, 'cb', 'cc')} * v{j}" for j in range(3)) for i in range(3)}
_T = f"t as (select gid, es, {', '.join(f'{v} as {k}' for k, v in _EXP.items())} from s)"


@query(f"with {_XI}, {_T} select gid, {_sixes((k, k) for k in ENTRIES)} from t")
def se3_exponential(spark, sf_dir):
    """Rigid transforms of tangents."""
    return _by_row(_tangents(spark, sf_dir), lambda v: lie.se3_exp(v[:6])[:3], ENTRIES)


@query(f"with {_XI}, {_T} select gid, {_sixes((k if k.endswith('3') else f'es * {k}', k) for k in ENTRIES)} from t")
def sim3_exponential(spark, sf_dir):
    """Similarities of tangents."""
    return _by_row(_tangents(spark, sf_dir), lambda v: lie.sim3_exp(v)[:3], ENTRIES)


@query(f"with {_XI} select gid, {_sixes((f'v{i}', f'v{i}') for i in range(7))} from x")
def sim3_logarithm(spark, sf_dir):
    """The logarithm undoes the exponential."""
    return _by_row(_tangents(spark, sf_dir), lambda v: lie.sim3_log(lie.sim3_exp(v)), [f"v{i}" for i in range(7)])


@query(f"with {_XI} select gid, {_sixes((f'v{i}', f'v{i}') for i in range(6))} from x")
def se3_logarithm(spark, sf_dir):
    """The same for rigid transforms."""
    return _by_row(_tangents(spark, sf_dir), lambda v: lie.se3_log(lie.se3_exp(v[:6])), [f"v{i}" for i in range(6)])


@query(f"with {_XI}, {_T} select gid, {_sixes([*((f'm{j}{i} / es', f'm{i}{j}') for i in range(3) for j in range(3)), *((f'-(m0{i} * m03 + m1{i} * m13 + m2{i} * m23) / es', f'm{i}3') for i in range(3))])} from t")
def transform_inverse(spark, sf_dir):
    """Inverses of similarities."""
    return _by_row(_tangents(spark, sf_dir), lambda v: lie.inverse(lie.sim3_exp(v))[:3], ENTRIES)


@query(f"with {_XI}, {_T} select gid, {_sixes((f'm{i}{j}', f'm{i}{j}') for i in range(3) for j in range(3))} from t")
def nearest_rotation(spark, sf_dir):
    """The rotation nearest to a scaled one is that rotation."""
    return _by_row(_tangents(spark, sf_dir), lambda v: lie.so3_project(lie.sim3_exp(v)[:3, :3]), [f"m{i}{j}" for i in range(3) for j in range(3)])


@query(f"with {_XI} select gid, {_sixes((_SKEW[i][j], f'm{i}{j}') for i in range(3) for j in range(3))} from x")
def cross_matrices(spark, sf_dir):
    """The matrix of a cross product."""
    return _by_row(_tangents(spark, sf_dir), lambda v: lie.skew(v[3:6]), [f"m{i}{j}" for i in range(3) for j in range(3)])


@query(f"with {_XI}, {_T} select gid, {_sixes((f'm{i}{j}', f'm{i}{j}') for i in range(3) for j in range(3))} from t")
def axis_rotations(spark, sf_dir):
    """Rotations about an axis by its length."""
    return _by_row(_tangents(spark, sf_dir), lambda v: lie.so3_exp(v[3:6]), [f"m{i}{j}" for i in range(3) for j in range(3)])


_LOOK = """l as (select gid, x as ex, y as ey, z as ez, -x / n as zx, -y / n as zy, -z / n as zz from (select *, greatest(sqrt(x * x + y * y + z * z), 1e-12) as n from e)),
 o as (select *, case when abs(zz) < 0.95 then 0.0 when abs(zy) < 0.95 then 0.0 else 1.0 end as ax, case when abs(zz) >= 0.95 and abs(zy) < 0.95 then 1.0 else 0.0 end as ay, case when abs(zz) < 0.95 then 1.0 else 0.0 end as az from l),
 p as (select *, zy * az - zz * ay as hx, zz * ax - zx * az as hy, zx * ay - zy * ax as hz from o),
 q as (select *, hx / sqrt(hx * hx + hy * hy + hz * hz) as xx, hy / sqrt(hx * hx + hy * hy + hz * hz) as xy, hz / sqrt(hx * hx + hy * hy + hz * hz) as xz from p)"""
_LOOKED = [["xx", "zy * xz - zz * xy", "zx", "ex"], ["xy", "zz * xx - zx * xz", "zy", "ey"], ["xz", "zx * xy - zy * xx", "zz", "ez"]]


@query(f"with {SQL_E}, {_LOOK} select gid, {_sixes((_LOOKED[i][j], f'm{i}{j}') for i in range(3) for j in range(4))} from q")
def look_at_poses(spark, sf_dir):
    """Cameras at every place that look at the origin."""
    return _by_row(splats(spark, sf_dir).select("gid", "x", "y", "z"), lambda v: lie.look_at(v, np.zeros(3))[:3], ENTRIES)


def _numbered(spark, rows: np.ndarray, names: list[str]) -> DataFrame:
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "i long, " + ", ".join(f"{n} double" for n in names))
    return df.select("i", *[r6(F.col(n), n) for n in names])


@query("with s as (select i, i + 0.5 as s from range(1024) t(i)), q as (select i, sqrt(s / 1024) as r, sqrt(1 - s / 1024) as k, 2 * pi() * s / sqrt(2.0::double) as a, 2 * pi() * s / 1.533751168755204::double as b from s), u as (select i, case when k * cos(b) < 0 then -1 else 1 end as g, * exclude (i) from q) select i, " + _sixes([("g * k * cos(b)", "qw"), ("g * r * sin(a)", "qx"), ("g * r * cos(a)", "qy"), ("g * k * sin(b)", "qz")]) + " from u")
def rotation_seeds(spark, sf_dir):
    """1024 rotations spread over all of them, as quaternions with a positive first number."""
    return _numbered(spark, np.array([lie.matrix_to_quat(r) for r in lie.super_fibonacci(1024)]), ["qw", "qx", "qy", "qz"])


_RING = "with s as (select i, 2 * pi() * i / 8.0 as a, radians(20) * (case when i % 2 = 0 then 1 else -1 end) as u from range(8) t(i))"


@query(f"{_RING} select i, {_sixes([('0.1 + 2 * cos(u) * cos(a)', 'ex'), ('0.2 + 2 * cos(u) * sin(a)', 'ey'), ('0.3 + 2 * sin(u)', 'ez'), ('-cos(u) * cos(a)', 'zx'), ('-cos(u) * sin(a)', 'zy'), ('-sin(u)', 'zz')])} from s")
def camera_ring(spark, sf_dir):
    """Places and directions of cameras around a point."""
    poses = photometric.camera_ring(np.array([0.1, 0.2, 0.3]), 2.0, 8, 20.0)
    return _numbered(spark, np.concatenate((poses[:, :3, 3], poses[:, :3, 2]), 1), ["ex", "ey", "ez", "zx", "zy", "zz"])


_TURNS = "s as (select i, radians(30 * (i // 12) - 60) as u, 2 * pi() * (i % 12) / 12.0 as a from range(60) t(i))"


@query(f"with {_TURNS} select i, {_sixes([('2.5 * cos(u) * cos(a)', 'ex'), ('2.5 * cos(u) * sin(a)', 'ey'), ('2.5 * sin(u)', 'ez'), ('-cos(u) * cos(a)', 'zx'), ('-cos(u) * sin(a)', 'zy'), ('-sin(u)', 'zz')])} from s")
def candidate_cameras(spark, sf_dir):
    """Places and directions of the candidate cameras on a sphere."""
    poses = np.array(camera.candidate_poses(np.zeros(3), 2.5))
    return _numbered(spark, np.concatenate((poses[:, :3, 3], poses[:, :3, 2]), 1), ["ex", "ey", "ez", "zx", "zy", "zz"])


# ---- neighbours ---------------------------------------------------------------------------------------------------


@query(f"with {SQL_E} select q, a, rank, {sql_r6('d', 'd')} from (select q.gid as q, a.gid as a, {sql_d('q', 'a')} as d, row_number() over (partition by q.gid order by {sql_d('q', 'a')}, a.gid)::integer as rank from e q, e a where q.gid <> a.gid) where rank <= 4")
def knn_others(spark, sf_dir):
    """The four nearest others of each row."""
    e = splats(spark, sf_dir)
    return C._rounded(spatial.knn_join(e, e, 4, other=True), ["d"]).select("q", "a", "rank", "d")


@query(f"with {SQL_E} select q, a, rank, {sql_r6('d', 'd')} from (select q.gid as q, a.gid as a, {sql_d('q', 'a')} as d, row_number() over (partition by q.gid order by {sql_d('q', 'a')}, a.gid)::integer as rank from e q, e a where q.gid <> a.gid) where rank <= 4")
def grid_knn_others(spark, sf_dir):
    """The same by rounds of grid joins."""
    e = splats(spark, sf_dir)
    return C._rounded(spatial.grid_knn_join(e, e, 4, other=True), ["d"]).select("q", "a", "rank", "d")


@query(f"with {SQL_AB} select a.gid as q, b.gid as a, {sql_r6(sql_d('a', 'b'), 'd')} from a, b where {sql_d('a', 'b')} <= 0.08")
def index_radius(spark, sf_dir):
    """Pairs of A and B within a radius, through the index."""
    a, b = halves(spark, sf_dir)
    return C._rounded(spatial.build_index(b, 0.1).radius_batch(a, 0.08), ["d"])


@query(f"with {SQL_AB} select q, a, rank, {sql_r6('d', 'd')} from (select a.gid as q, b.gid as a, {sql_d('a', 'b')} as d, row_number() over (partition by a.gid order by {sql_d('a', 'b')}, b.gid)::integer as rank from a, b) where rank <= 2")
def index_knn(spark, sf_dir):
    """The two nearest of B for each row of A, through the index."""
    a, b = halves(spark, sf_dir)
    return C._rounded(spatial.build_index(b, 0.1).knn_batch(a, 2), ["d"]).select("q", "a", "rank", "d")


# ---- metrics ------------------------------------------------------------------------------------------------------


@query(f"with {SQL_E}, m as (select avg(x) as x, avg(y) as y, avg(z) as z from e) select {', '.join(sql_r6(f'max(m.{c})', f'c{c}') for c in 'xyz')}, {sql_r6('sqrt(avg(' + sql_d('e', 'm') + ' ** 2))', 'rms')}, {sql_r6('max(' + sql_d('e', 'm') + ')', 'radius')} from e, m")
def centroid(spark, sf_dir):
    """Centroid, root mean square and bounding radius."""
    found = metrics.centroid_stats(splats(spark, sf_dir))
    return C._rounded(C._row(spark, **found), list(found))


def _sql_trimmed(name: str, share: float) -> str:
    return f"{name}o as (select d, row_number() over (order by d) as r, count(*) over () as c from {name}), {name}t as (select avg(d) as t from {name}o where r <= greatest(1, floor({share} * c)))"


@query(f"with {SQL_AB}, {sql_nn('b', 'a', 'f')}, {sql_nn('a', 'b', 'g')}, {_sql_trimmed('f', 0.8)}, {_sql_trimmed('g', 0.5)}, m as (select avg(x) as x, avg(y) as y, avg(z) as z from b), s as (select max({sql_d('b', 'm')}) as s from b, m) select {sql_r6('(ft.t + gt.t) / s.s', 'residual')} from ft, gt, s")
def symmetric_overlap(spark, sf_dir):
    """Trimmed distances both ways, each with its own share."""
    a, b = halves(spark, sf_dir)
    return C._rounded(C._row(spark, residual=metrics.symmetric_overlap_residual(a, b)), ["residual"])


@query(f"with {SQL_AB}, p as (select gid, {', '.join(f'{m} as {c}' for m, c in zip(sql_moved(RIGID), 'xyz', strict=True))} from a), {sql_nn('b', 'p', 'f')} select count(*) as inliers from f where d < 0.2")
def overlap_inliers(spark, sf_dir):
    """Rows of B near the moved A."""
    a, b = halves(spark, sf_dir)
    return C._row(spark, inliers=metrics.overlap_inliers(a, b, RIGID, 0.2))


def _errors(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = lambda i: F.abs(F.col("embedding")[i].cast("double"))
    return e.select(F.col("vec_id").alias("gid"), F.col("label").alias("scene"), (at(30) * 20).alias("rotation_deg"), (at(31) * 0.2).alias("scale"), F.when(F.col("vec_id") % 7 != 0, at(32)).alias("error"))


_ERR = "r as (select vec_id as gid, label as scene, abs(embedding[31]::double) * 20 as rotation_deg, abs(embedding[32]::double) * 0.2 as scale, case when vec_id % 7 <> 0 then abs(embedding[33]::double) end as error from embeddings)"


@query(f"with {_ERR}, o as (select *, row_number() over (partition by scene order by rotation_deg) as ro, row_number() over (partition by scene order by scale) as so, count(*) over (partition by scene) as c from r) select scene, count(*) as n, {_sixes([('max(rotation_deg) filter (ro = (c + 1) // 2)', 'median_rotation_deg'), ('max(scale) filter (so = (c + 1) // 2)', 'median_scale'), ('avg((rotation_deg < 2 and scale < 0.02)::int)', 'solved')])} from o group by scene")
def success_rates(spark, sf_dir):
    """Median errors and the share of solved cases of each scene."""
    return C._rounded(metrics.success_rates(_errors(spark, sf_dir), "scene"), ["median_rotation_deg", "median_scale", "solved"])


@query(f"with {_ERR}, h as (select scene, avg(coalesce((error <= 0.04)::int, 0)) as s, sum(coalesce((error <= 0.04)::int, 0)) as k, count(*) as n from r group by scene) select {_sixes([('avg(s)', 'mean_of_scenes'), ('sum(k) / sum(n)', 'pooled')])} from h")
def registration_recall(spark, sf_dir):
    """Recall by scenes and pooled."""
    return C._rounded(metrics.registration_recall(_errors(spark, sf_dir), 0.2), ["mean_of_scenes", "pooled"])


_FLAT = ", ".join(f"{float(v)!r}::double" for v in RIGID.ravel())


@query(f"with {SQL_E}, {_UNIT}, r as (select gid, x, y, z, {', '.join(f'{_ROTATION[i][j]} as r{i}{j}' for i in range(3) for j in range(3))} from u) select gid, {_sixes([('degrees(acos(least(1.0, greatest(-1.0, (' + ' + '.join(f'r{i}{j} * {float(RIGID[i, j])!r}::double' for i in range(3) for j in range(3)) + ' - 1) / 2))))', 'rre'), ('sqrt(' + ' + '.join(f'({c} - {float(RIGID[i, 3])!r}::double) ** 2' for i, c in enumerate('xyz')) + ')', 'rte')])} from r")
def pose_errors(spark, sf_dir):
    """Rotation and translation errors of poses."""
    m = E.rotation_columns()
    estimate = F.array(*[v for i, c in enumerate("xyz") for v in (*m[i], F.col(c))], *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])
    truth = F.array(*[F.lit(float(v)) for v in RIGID.ravel()])
    pairs = splats(spark, sf_dir).select("gid", estimate.alias("estimate"), truth.alias("truth"))
    return C._rounded(metrics.rotation_translation_errors(pairs).select("gid", "rre", "rte"), ["rre", "rte"])


@query(f"with {_ERR}, b as (select min(rotation_deg) as b from r), n as (select r.* from r, b where rotation_deg <= b + 0.2 * greatest(1.0, abs(b))) select gid, {_sixes([('rotation_deg', 'rotation_deg'), ('scale', 'scale')])} from n order by scale, gid limit 1")
def near_best_pick(spark, sf_dir):
    """Of the scores about as good as the best, the row that is off least."""
    got = metrics.pick_near_best(_errors(spark, sf_dir), "rotation_deg", "scale", "gid", 0.2)
    return C._rounded(got.select("gid", "rotation_deg", "scale"), ["rotation_deg", "scale"])


_TRIED = [lie.se3_exp(np.array([0.05, -0.02, 0.03, 0.2, -0.1, 0.3]) * k / 10) for k in range(16)]
_TRIES = ", ".join("(" + ", ".join([str(i), *(f"{float(v)!r}::double" for v in p[:3].ravel())]) + ")" for i, p in enumerate(_TRIED))
_APART = "sqrt(" + " + ".join(f"(m{i}0 * sx + m{i}1 * sy + m{i}2 * sz + m{i}3 - t{c}) ** 2" for i, c in enumerate("xyz")) + ")"


@query(f"with {C._C}, h(pose_id, {', '.join(ENTRIES)}) as (values {_TRIES}), d as (select pose_id, {_APART} as d from c, h) select pose_id::integer as pose_id, count(*) filter (d < 0.1) as inliers, {sql_r6('avg(d) filter (d < 0.1)', 'error')} from d group by pose_id")
def hypothesis_inliers(spark, sf_dir):
    """Inliers and mean error of 16 poses over all correspondences."""
    return C._rounded(metrics.score_hypotheses(C.correspondences(spark, sf_dir), _TRIED, 0.1), ["error"])


@query("select 0.8::double as largest, 0.08::double as mean")
def edge_consistency(spark, sf_dir):
    """Ten edges of which one is off by a tangent of length 0.8."""
    poses = [lie.se3_exp(np.array([0.1, 0.05, -0.02, 0.2, 0.1, -0.1]) * k) for k in range(5)]
    rel = {(i, j): lie.inverse(poses[i]) @ poses[j] for i in range(5) for j in range(i + 1, 5)}
    rel[1, 3] = rel[1, 3] @ lie.se3_exp(np.array([0.3, 0.2, 0.1, 0.5, 0.4, 0.3]))
    got = bundle.pairwise_consistency(poses, rel)
    return C._rounded(C._row(spark, largest=float(got["max"]), mean=float(got["mean"])), ["largest", "mean"])


@query("select i::integer as i, j::integer as j, i = 1 and j = 3 as rejected from range(5) a(i), range(5) b(j) where i < j")
def pose_graph(spark, sf_dir):
    """Five captures from all pairs: the one wrong edge is rejected."""
    truth = [lie.se3_exp(np.array([0.1, 0.05, -0.02, 0.2, 0.1, -0.1]) * k) for k in range(5)]
    rel = {(i, j): lie.inverse(truth[i]) @ truth[j] for i in range(5) for j in range(i + 1, 5)}
    rel[1, 3] = rel[1, 3] @ lie.se3_exp(np.array([0.3, 0.2, 0.1, 0.5, 0.4, 0.3]))
    got = bundle.solve_pose_graph(5, rel)
    return spark.createDataFrame([(i, j, (i, j) in got.rejected_edges) for i, j in got.edge_weights], "i int, j int, rejected boolean")


@query("select * from (values ('full', 0::bigint, 50::bigint, 20::bigint, 10::bigint), ('balanced', 4096, 50, 20, 8), ('low', 1024, 24, 20, 5), ('half', 8192, 37, 20, 8)) t(label, n_points, knn, max_iters, refine_iters)")
def quality_presets(spark, sf_dir):
    """What the presets and a share of one half ask for; 0 points are all."""
    rows = [(n, q.n_points or 0, q.knn, q.max_iters, q.refine_iters) for n, q in (("full", resolve_quality("full")), ("balanced", resolve_quality("balanced")), ("low", resolve_quality("low")), ("half", resolve_quality(0.5)))]
    return spark.createDataFrame(rows, "label string, n_points long, knn long, max_iters long, refine_iters long")


# ---- residuals ----------------------------------------------------------------------------------------------------

_HUBER = C._P2P.replace("1.0 as w", "(case when d <= 0.05 then 1.0 else 0.05 / d end) ** 2 as w")


@query(C._sql_normal_equations(_HUBER))
def normal_equations_huber(spark, sf_dir):
    """Sums of a point-to-point step under a robust kernel."""
    a, b = halves(spark, sf_dir)
    return _system(spark, [solve.ICP(robust=E.Kernel("huber", 0.05))], b, a)


def _system(spark, residuals: list, target: DataFrame, source: DataFrame) -> DataFrame:
    h, b, cost, n = solve._system(POSE, residuals, target, source, 7)
    values = {f"h{i}{j}": float(h[i, j]) for i in range(7) for j in range(i, 7)} | {f"b{i}": float(b[i]) for i in range(7)} | {"cost": cost}
    return C._rounded(C._row(spark, **values, n=n), list(values))


@query(C._sql_normal_equations(C._P2L.replace("select r, w,", "select r, 0.25 / ((1 + (r / 0.1) ** 2) ** 2) as w,").replace("from nn join a on a.gid = nn.q", "from (select * from nn where d <= 0.15) nn join a on a.gid = nn.q")))
def normal_equations_gated(spark, sf_dir):
    """Point-to-plane rows no further than a gate, weighed, under another kernel."""
    a, b = halves(spark, sf_dir)
    return _system(spark, [solve.ICP(point_to_plane=True, max_distance=0.15, weight=0.25, robust=E.Kernel("cauchy", 0.1))], b, a)


_AB_MOVED = SQL_AB.replace("a as (select * from e where label < 5)", f"a0 as (select * from e where label < 5), a as (select gid, {', '.join(f'{m} as {c}' for m, c in zip(sql_moved(POSE), 'xyz', strict=True))} from a0)")
_FIELD = C._GRAD.replace(SQL_AB, _AB_MOVED)
_FIELD_ROWS = f"{_FIELD}, g as (select a0.x, a0.y, a0.z, a.x as px, a.y as py, a.z as pz, coalesce(f.d, 0.0) as r, 0.3 as w, coalesce(o.gx, 0.0) as gx, coalesce(o.gy, 0.0) as gy, coalesce(o.gz, 0.0) as gz from a join a0 using (gid) left join f on f.q = a.gid left join o on o.q = a.gid)".replace(", g as (select f.q", ", g1 as (select f.q").replace("from f join g on f.q = g.q)", "from f join g1 on f.q = g1.q)")


def _four(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(F.col(c), 3) + F.lit(0.0)).alias(c) if c != "n" else F.col(c) for c in df.columns])


@query(C._sql_normal_equations(f"{_FIELD_ROWS}, t as (select *, {C._TURN} from g), j as (select r, w, {C._JACOBIAN} from t)").replace(", 6) + 0.0", ", 3) + 0.0"))
def normal_equations_field(spark, sf_dir):
    """Sums of a step along the signed distance of the target's field."""
    a, b = halves(spark, sf_dir)
    return _four(_system(spark, [solve.SDF(SIGMA, weight=0.3, samples=None, knn=None)], b, a))


def _recovered(spark, t: np.ndarray, truth: np.ndarray, rotation: float, translation: float) -> DataFrame:
    error = metrics.pose_error(t, truth)
    return C._row(spark, rotation=bool(error["rotation_deg"] < rotation), translation=bool(error["translation"] < translation))


@query(f"select {', '.join(f'round({float(POSE[i, j])!r}::double, 6) + 0.0 as m{i}{j}' for i in range(3) for j in range(4))}")
def umeyama_pose(spark, sf_dir):
    """The similarity of exact pairs, weighed by opacity, is the one that made them."""
    e = splats(spark, sf_dir)
    t = E.moved(POSE)
    pairs = e.select("opacity", *[F.col(c).alias(f"s{c}") for c in "xyz"], *[v.alias(f"t{c}") for v, c in zip(t, "xyz", strict=True)])
    got = moments.fit(pairs, weight="opacity")
    return got.select(*[r6(F.col("pose")[4 * i + j], f"m{i}{j}") for i in range(3) for j in range(4)])


@query(f"with {SQL_AB} select label, count(*) as n, true as same from e group by label")
def umeyama_by_key(spark, sf_dir):
    """The same for each label by its own pose."""
    e = splats(spark, sf_dir).withColumn("label", F.col("splat_id").cast("int"))
    t = E.moved(RIGID)
    pairs = e.select("label", *[F.col(c).alias(f"s{c}") for c in "xyz"], *[(v + (F.col("label") if c == "x" else F.lit(0))).alias(f"t{c}") for v, c in zip(t, "xyz", strict=True)])
    got = moments.fit(pairs, ["label"], with_scale=False)
    off = sum((F.abs(F.col("pose")[4 * i + j] - float(RIGID[i, j]) - (F.col("label") if (i, j) == (0, 3) else F.lit(0))) for i in range(3) for j in range(4)), F.lit(0.0))
    return got.select("label", "n", (off < 1e-6).alias("same"))


# ---- normals and descriptors --------------------------------------------------------------------------------------

_NEAR8 = f"k as (select q, a from (select q.gid as q, a.gid as a, row_number() over (partition by q.gid order by {sql_d('q', 'a')}, a.gid) as r from e q, e a) where r <= 8)"
_COV = "v as (select q, " + ", ".join(f"covar_pop({i}, {j}) as {i}{j}" for i, j in ("xx", "xy", "xz", "yy", "yz", "zz")) + " from k join e on e.gid = k.a group by q)"
_EIG = "w as (select *, (xx + yy + zz) / 3 as t, sqrt(greatest(((xx - (xx + yy + zz) / 3) ** 2 + (yy - (xx + yy + zz) / 3) ** 2 + (zz - (xx + yy + zz) / 3) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6, 1e-300)) as p from v), d as (select *, greatest(-1.0, least(1.0, (((xx - t) / p) * (((yy - t) / p) * ((zz - t) / p) - (yz / p) ** 2) - (xy / p) * ((xy / p) * ((zz - t) / p) - (yz / p) * (xz / p)) + (xz / p) * ((xy / p) * (yz / p) - ((yy - t) / p) * (xz / p))) / 2)) as h from w)"


@query(f"with {SQL_E}, {_NEAR8}, {_COV}, {_EIG} select q as gid, {sql_r6('t + 2 * p * cos(acos(h) / 3 + 2 * pi() / 3)', 'variance')}, true as unit, true as outward from d")
def pca_normals(spark, sf_dir):
    """Normals from neighbours: the variance along them is the least eigenvalue, they have length one and point away."""
    e = splats(spark, sf_dir).select("gid", "x", "y", "z")
    n = field.estimate_anchor_normals(e, 8).select("gid", "nx", "ny", "nz")
    m = metrics.centroid_stats(e)
    near = spatial.knn_join(e, e, 8).join(e.withColumnRenamed("gid", "a"), "a")
    cov = near.groupBy(F.col("q").alias("gid")).agg(*[F.covar_pop(i, j).alias(i + j) for i, j in ("xx", "xy", "xz", "yy", "yz", "zz")])
    both = n.join(cov, "gid").join(e, "gid")
    along = sum((F.col(f"n{i}") * F.col(f"n{j}") * F.col("".join(sorted(i + j))) for i in "xyz" for j in "xyz"), F.lit(0.0))
    side = sum((F.col(f"n{c}") * (F.col(c) - m[f"c{c}"]) for c in "xyz"), F.lit(0.0))
    length = sum((F.col(f"n{c}") * F.col(f"n{c}") for c in "xyz"), F.lit(0.0))
    return both.select("gid", r6(along, "variance"), (F.abs(length - 1) < 1e-9).alias("unit"), (side >= 0).alias("outward"))


_SPFH = f"""with {SQL_E}, n as ({C._sql_normals('e')}), k as (select q, a, d from (select q.gid as q, a.gid as a, {sql_d('q', 'a')} as d, row_number() over (partition by q.gid order by {sql_d('q', 'a')}, a.gid) as r from e q, e a where q.gid <> a.gid) where r <= 6),
 b as (select k.q, k.a, k.d, p.nx as ux, p.ny as uy, p.nz as uz, o.nx as mx, o.ny as my, o.nz as mz, (o.x - p.x) / greatest(k.d, 1e-12) as lx, (o.y - p.y) / greatest(k.d, 1e-12) as ly, (o.z - p.z) / greatest(k.d, 1e-12) as lz from k join n p on p.gid = k.q join n o on o.gid = k.a),
 c as (select *, ly * uz - lz * uy as hx, lz * ux - lx * uz as hy, lx * uy - ly * ux as hz from b), c2 as (select *, greatest(sqrt(hx * hx + hy * hy + hz * hz), 1e-12) as hn from c), c3 as (select *, hx / hn as vx, hy / hn as vy, hz / hn as vz from c2),
 c4 as (select *, uy * vz - uz * vy as wx, uz * vx - ux * vz as wy, ux * vy - uy * vx as wz from c3),
 g as (select q, a, d, (vx * mx + vy * my + vz * mz + 1) / 2 as f0, (ux * lx + uy * ly + uz * lz + 1) / 2 as f1, atan2(wx * mx + wy * my + wz * mz, ux * mx + uy * my + uz * mz) / (2 * pi()) + 0.5 as f2 from c4),
 s as (select q, unnest([least(greatest(floor(f0 * 11), 0), 10), least(greatest(floor(f1 * 11), 0), 10) + 11, least(greatest(floor(f2 * 11), 0), 10) + 22])::integer as bin from g),
 h as (select q, bin, count(*) / 6.0::double as h from s group by q, bin)"""


@query(f"{_SPFH} select q, bin, {sql_r6('h', 'h')} from h")
def simple_histograms(spark, sf_dir):
    """Histograms of the angles to six neighbours."""
    return C._rounded(features.simple_bins(field.thin_normals(splats(spark, sf_dir)), 6), ["h"])


@query(f"{_SPFH}, i as (select q, a, 1 / greatest(d, 1e-12) as i from k), z as (select q, sum(i) as z from i group by q), x as (select i.q, h.bin, i.i / z.z * h.h as h from i join z on z.q = i.q join h on h.q = i.a union all select q, bin, h from h), y as (select q, bin, sum(h) as h from x group by q, bin), l as (select q, sqrt(sum(h * h)) as l from y group by q) select y.q as gid, bin, {sql_r6('h / greatest(l, 1e-12)', 'value')} from y join l on l.q = y.q")
def fpfh_descriptors(spark, sf_dir):
    """The same with the neighbours' histograms added, of length one: the numbers that are not zero."""
    made = features.fpfh(field.thin_normals(splats(spark, sf_dir)), 6)
    rows = made.select("gid", F.posexplode("descriptor").alias("bin", "value"))
    return rows.where("value > 0").select("gid", "bin", r6(F.col("value"), "value"))


# ---- cameras ------------------------------------------------------------------------------------------------------


@query("with p as (select vec_id as gid, abs(embedding[21]::double) as r, abs(embedding[22]::double) as g, abs(embedding[23]::double) as b, abs(embedding[24]::double) * 4 as mask from embeddings) select 'mask' as cue, count(*) as n, sum(gid)::bigint as total from p where mask > 0.5 union all select 'color', count(*), sum(gid)::bigint from p where (r + g + b) / 3 > 0.1 * 0.01")
def foreground_pixels(spark, sf_dir):
    """Pixels of an object by a mask and by colour."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = lambda i: F.abs(F.col("embedding")[i].cast("double"))
    frame = e.select(F.col("vec_id").alias("gid"), at(20).alias("r"), at(21).alias("g"), at(22).alias("b"), (at(23) * 4).alias("mask"))
    one = lambda name, mask: camera.foreground(frame, mask).agg(F.lit(name).alias("cue"), F.count("*").alias("n"), F.sum("gid").alias("total"))
    return one("mask", True).union(one("color", False))


_CAM = f"""m as (select avg(x) as x, avg(y) as y, avg(z) as z from e), far as (select 2.5 * max({sql_d('e', 'm')}) as far from e, m), {_TURNS}, c0 as (select i, m.x + far * cos(u) * cos(a) as ex, m.y + far * cos(u) * sin(a) as ey, m.z + far * sin(u) as ez, m.x as tx, m.y as ty, m.z as tz from s, m, far),
 c1 as (select *, sqrt((tx - ex) ** 2 + (ty - ey) ** 2 + (tz - ez) ** 2) as n from c0), c2 as (select *, (tx - ex) / n as zx, (ty - ey) / n as zy, (tz - ez) / n as zz from c1), c3 as (select *, zy / sqrt(zx * zx + zy * zy) as xx, -zx / sqrt(zx * zx + zy * zy) as xy from c2), c4 as (select *, -zz * xy as yx, zz * xx as yy, zx * xy - zy * xx as yz from c3),
 p0 as (select i, xx * (e.x - ex) + xy * (e.y - ey) as a, yx * (e.x - ex) + yy * (e.y - ey) + yz * (e.z - ez) as b, zx * (e.x - ex) + zy * (e.y - ey) + zz * (e.z - ez) as d from c4, e), p1 as (select i, 180.0 * a / d + 80 as u, 180.0 * b / d + 80 as v from p0 where d > 1e-6),
 cells as (select distinct i, floor(u * 24 / 160)::bigint as cu, floor(v * 24 / 160)::bigint as cv from p1 where u >= 0 and u < 160 and v >= 0 and v < 160),
 wide as (select distinct i, cu + du.g as cu, cv + dv.g as cv from cells, (select unnest([-2, -1, 0, 1, 2]) as g) du, (select unnest([-2, -1, 0, 1, 2]) as g) dv where cu + du.g between 0 and 23 and cv + dv.g between 0 and 23),
 f0 as (select {', '.join(f'{v} as p{c}' for v, c in zip(C._V, 'xyz', strict=True))} from e), f1 as (select 180.0 * px / greatest(pz, 1e-6) + 80 as u, 180.0 * py / greatest(pz, 1e-6) + 80 as v from f0 where pz > 1e-6), f2 as (select distinct floor(u * 24 / 160)::bigint as cu, floor(v * 24 / 160)::bigint as cv from f1 where u >= 0 and u < 160 and v >= 0 and v < 160),
 mask as (select distinct cu + du.g as cu, cv + dv.g as cv from f2, (select unnest([-2, -1, 0, 1, 2]) as g) du, (select unnest([-2, -1, 0, 1, 2]) as g) dv where cu + du.g between 0 and 23 and cv + dv.g between 0 and 23),
 k as (select i, count(*) as n, count(mask.cu) as b from wide left join mask on wide.cu = mask.cu and wide.cv = mask.cv group by i), o as (select i, b / greatest(n + (select count(*) from mask) - b, 1) as iou from k)"""


@query(f"with {SQL_E}, {_CAM} select o.i::integer as pose_id, {_sixes([('iou', 'iou'), ('ex', 'ex'), ('ey', 'ey'), ('ez', 'ez')])} from o join c4 on c4.i = o.i order by round(iou, 9) desc, o.i limit 1")
def coarse_camera(spark, sf_dir):
    """The candidate camera whose silhouette fits a frame best."""
    e = splats(spark, sf_dir)
    frame = camera.project(e, C.VIEW, C.INTRINSICS).where("in_front and u >= 0 and u < 160 and v >= 0 and v < 160").select("u", "v", F.lit(1.0).alias("mask"))
    got = camera.coarse_localize_camera(e, frame, C.INTRINSICS, 160, 160)
    eye = got["pose"][:3, 3]
    found = C._row(spark, iou=got["iou"], ex=float(eye[0]), ey=float(eye[1]), ez=float(eye[2]))
    return C._rounded(found, ["iou", "ex", "ey", "ez"]).select(F.lit(got["index"]).alias("pose_id"), "*")


# ---- whole registrations: the truth is known ----------------------------------------------------------------------


@query("select true as rotation, true as translation")
def register_global(spark, sf_dir):
    """The pose that brings the moved splat back, from seeds over all rotations, over all rows."""
    e = splats(spark, sf_dir)
    return _recovered(spark, C.register(e, transform.apply_transform(e, lie.inverse(RIGID)), init="global", max_iters=10).T, RIGID, 2.0, 0.01)


@query("select true as rotation, true as translation")
def register_mac(spark, sf_dir):
    """The same from noisy correspondences by maximal cliques, of which the search takes 1000."""
    c = C.correspondences(spark, sf_dir).select(F.col("cid").alias("gid"), "sx", "sy", "sz", "tx", "ty", "tz")
    t = C.stride_sample(c, C.rigidity.MOST).orderBy("gid").toPandas()
    got = C.rigidity.mac_pose(t[["sx", "sy", "sz"]].to_numpy(), t[["tx", "ty", "tz"]].to_numpy(), tolerance=0.1)
    return _recovered(spark, got["T"], RIGID, 5.0, 0.05)


@query("select true as rotation, true as translation")
def register_features(spark, sf_dir):
    """The same from descriptors of 600 rows, matches and hypotheses: the search by features."""
    e = splats(spark, sf_dir)
    t, _ = C.align.feature_align(C.points(transform.apply_transform(e, lie.inverse(RIGID)), 600), C.points(e, 600), sweep=False)
    return _recovered(spark, t, RIGID, 2.0, 0.01)
