"""Named queries over the driver tables and the SQL that gives the same rows.

The tables hold no splats, so two are made of them: `embeddings` gives anisotropic Gaussians (first dimensions as place,
opacity, scale, rotation), `lineitem` a lattice with many equal places. Clouds A and B are the labels below 5 and the
others. Every query runs over whole tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions import lie
from ..model import conform, points, step_sample, stride_sample
from ..operators import align, camera, features, field, fuse, metrics, moments, rigidity, solve, spatial, transform
from ..operators.register import merge, register
from ..streaming.tracker import replay

POSE = lie.sim3_exp(np.array([0.05, -0.02, 0.03, 0.2, -0.1, 0.3, 0.1]))
RIGID = lie.se3_exp(np.array([0.05, -0.02, 0.03, 0.2, -0.1, 0.3]))
INTRINSICS = np.array([[180.0, 0, 80], [0, 180.0, 80], [0, 0, 1]])
SIGMA, VOXEL, RADIUS = 0.06, 0.09, 0.07


def splats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The splat table made of the embeddings."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = lambda i: F.col("embedding")[i].cast("double")
    made = {"gid": F.col("vec_id"), "splat_id": F.col("label").cast("string"), "x": at(0), "y": at(1), "z": at(2), "opacity": F.abs(at(3)), "sx": F.abs(at(4)), "sy": F.abs(at(5)), "sz": F.abs(at(6)), "qx": at(7), "qy": at(8), "qz": at(9), "qw": at(10)}
    return conform(e, **made)


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattice made of the line items."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("gid"), (F.col("l_quantity") / 50).alias("x"), (F.col("l_discount") * 10).alias("y"), (F.col("l_tax") * 12.5).alias("z"), F.col("l_extendedprice").alias("opacity"))


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Clouds A and B."""
    e = splats(spark, sf_dir)
    low = F.col("splat_id").cast("int") < 5
    return e.where(low), e.where(~low)


def descriptors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """gid and descriptor (the whole embedding) of clouds A and B."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("gid"), F.col("embedding").cast("array<double>").alias("descriptor"), "label")
    return e.where("label < 5").drop("label"), e.where("label >= 5").drop("label")


def correspondences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cid, a place, and the place under a rigid pose with noise."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = lambda i: F.col("embedding")[i].cast("double")
    s = e.select(F.col("vec_id").alias("cid"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), *[(at(11 + i) * 0.3).alias(f"n{i}") for i in range(3)])
    t = E.moved(RIGID)
    return s.select("cid", *[F.col(c).alias(f"s{c}") for c in "xyz"], *[(t[i] + F.col(f"n{i}")).alias(f"t{c}") for i, c in enumerate("xyz")])


def r6(c, name: str):
    """Rounded to 6 places, without negative zero."""
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def _row(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], list(values))


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[r6(F.col(c), c) if c in names else F.col(c) for c in df.columns])


# ---- the SQL side -------------------------------------------------------------------------------------------------

SQL_E = """e as (select vec_id as gid, label, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z,
 abs(embedding[4]::double) as opacity, abs(embedding[5]::double) as sx, abs(embedding[6]::double) as sy, abs(embedding[7]::double) as sz,
 embedding[8]::double as qx, embedding[9]::double as qy, embedding[10]::double as qz, embedding[11]::double as qw from embeddings)"""
SQL_AB = SQL_E + ", a as (select * from e where label < 5), b as (select * from e where label >= 5)"
SQL_L = "l as (select l_orderkey * 8 + l_linenumber as gid, l_quantity / 50 as x, l_discount * 10 as y, l_tax * 12.5 as z, l_extendedprice as opacity from lineitem)"


def sql_cell(size: float, of: str = "") -> str:
    """Cell numbers in SQL."""
    return ", ".join(f"floor({of}{p} / {size!r}::double)::bigint as c{p}" for p in "xyz")


def sql_d(a: str, b: str) -> str:
    """Distance of two aliases in SQL."""
    return "sqrt(" + " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in "xyz") + ")"


def sql_nn(q: str, a: str, name: str) -> str:
    """A CTE (q, a, d) of nearest rows in SQL."""
    return f"{name} as (select q, a, d from (select q.gid as q, a.gid as a, {sql_d('q', 'a')} as d, row_number() over (partition by q.gid order by {sql_d('q', 'a')}, a.gid) as r from {q} q, {a} a) where r = 1)"


def sql_moved(t: np.ndarray, of: str = "") -> list[str]:
    """Three coordinates after a transform in SQL."""
    return [f"({float(r[0])!r}::double * {of}x + {float(r[1])!r}::double * {of}y + {float(r[2])!r}::double * {of}z + {float(r[3])!r}::double)" for r in t[:3]]


def sql_r6(x: str, name: str) -> str:
    """Rounded to 6 places in SQL."""
    return f"round({x}, 6) + 0.0 as {name}"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- voxels and radii ---------------------------------------------------------------------------------------------


@query(f"with {SQL_E}, v as (select *, {sql_cell(VOXEL)} from e) select gid, x, y, z, opacity from v qualify row_number() over (partition by cx, cy, cz order by opacity desc, gid) = 1")
def voxel_dedupe(spark, sf_dir):
    """The most opaque row of each voxel."""
    return fuse.voxel_dedupe(splats(spark, sf_dir), VOXEL).select("gid", "x", "y", "z", "opacity")


@query(f"with {SQL_L}, v as (select *, {sql_cell(0.13)} from l) select gid, opacity from v qualify row_number() over (partition by cx, cy, cz order by opacity desc, gid) = 1")
def voxel_dedupe_lattice(spark, sf_dir):
    """The same where many rows share a place."""
    return fuse.voxel_dedupe(lattice(spark, sf_dir), 0.13).select("gid", "opacity")


@query(f"with {SQL_L}, v as (select *, {sql_cell(0.13)} from l) select cx, cy, cz, arg_max(gid, (opacity, -gid)) as gid, count(*) as n from v group by cx, cy, cz")
def voxel_count(spark, sf_dir):
    """Occupied voxels, their best row and their rows."""
    return fuse.voxel_winners(lattice(spark, sf_dir), 0.13)


@query(f"with {SQL_E}, v as (select *, {sql_cell(0.12)} from e) select cx, cy, cz, min(gid) as gid from v group by cx, cy, cz")
def first_per_voxel(spark, sf_dir):
    """The first row of each voxel."""
    return fuse.first_per_voxel(splats(spark, sf_dir), 0.12)


SQL_SPACING = f"with {SQL_E}, n as (select count(*) as n from e), p as (select a.gid, min({sql_d('a', 'b')}) filter ({sql_d('a', 'b')} > 1e-12) as d from e a, e b group by a.gid), o as (select d, row_number() over (order by d) as r, count(*) over () as c from p where d is not null)"


@query(f"{SQL_SPACING} select {sql_r6('0.5 * d', 'voxel')}, {sql_r6('0.5 * d', 'radius')} from o where r = (c + 1) // 2")
def auto_sizes(spark, sf_dir):
    """Voxel and radius that fit the spacing of all rows."""
    e = splats(spark, sf_dir)
    return _rounded(_row(spark, voxel=fuse.auto_voxel_size(e, None), radius=fuse.auto_knn_radius(e, None)), ["voxel", "radius"])


@query(f"with {SQL_E}, m as (select (sx + sy + sz) / 3 as m from e where (sx + sy + sz) > 0), o as (select m, row_number() over (order by m) as r, count(*) over () as c from m) select {sql_r6('m', 'fallback')}, {sql_r6('2 * m', 'sigma')} from o where r = (c + 1) // 2")
def scale_sizes(spark, sf_dir):
    """Sizes from the rows' own scales."""
    e = splats(spark, sf_dir)
    return _rounded(_row(spark, fallback=fuse.spacing_fallback(e), sigma=fuse.auto_sdf_sigma(e)), ["fallback", "sigma"])


@query(f"with {SQL_E} select gid from e i where not exists (select 1 from e j where {sql_d('i', 'j')} <= {VOXEL!r} and (j.opacity > i.opacity or (j.opacity = i.opacity and j.gid < i.gid)))")
def knn_dedupe(spark, sf_dir):
    """Rows that no more opaque row is near."""
    return fuse.knn_dedupe(splats(spark, sf_dir), VOXEL).select("gid")


@query(f"with {SQL_E} select q.gid as q, a.gid as a, {sql_r6(sql_d('q', 'a'), 'd')} from e q, e a where {sql_d('q', 'a')} <= {RADIUS!r}")
def radius_pairs(spark, sf_dir):
    """All pairs within a radius."""
    e = splats(spark, sf_dir)
    return _rounded(spatial.radius_join(e, e, RADIUS), ["d"])


@query(f"with {SQL_E} select q.gid as q, a.gid as a, {sql_r6(sql_d('q', 'a'), 'd')} from e q, e a where {sql_d('q', 'a')} <= {RADIUS!r}")
def grid_radius_pairs(spark, sf_dir):
    """The same by grid cells, as for tables of any size."""
    e = splats(spark, sf_dir)
    return _rounded(spatial.grid_radius_join(e, e, RADIUS), ["d"])


@query(f"with {SQL_AB} select q, a, rank, {sql_r6('d', 'd')} from (select q.gid as q, a.gid as a, {sql_d('q', 'a')} as d, row_number() over (partition by q.gid order by {sql_d('q', 'a')}, a.gid)::integer as rank from a q, b a) where rank <= 3")
def grid_knn(spark, sf_dir):
    """The three nearest rows of B for each row of A by rounds of grid joins."""
    return _rounded(spatial.grid_knn_join(*halves(spark, sf_dir), 3), ["d"]).select("q", "a", "rank", "d")


@query(f"with {SQL_E} select q, a, rank, {sql_r6('d', 'd')} from (select q.gid as q, a.gid as a, {sql_d('q', 'a')} as d, row_number() over (partition by q.gid order by {sql_d('q', 'a')}, a.gid)::integer as rank from e q, e a) where rank <= 5")
def knn_k(spark, sf_dir):
    """The five nearest of each row."""
    e = splats(spark, sf_dir)
    return _rounded(spatial.knn_join(e, e, 5), ["d"]).select("q", "a", "rank", "d")


@query(f"with {SQL_AB}, {sql_nn('a', 'b', 'nn')} select q, a, {sql_r6('d', 'd')} from nn")
def nearest_neighbour(spark, sf_dir):
    """The nearest row of B for each row of A."""
    a, b = halves(spark, sf_dir)
    return _rounded(spatial.nearest_join(a, b), ["d"])


@query(f"with {SQL_AB}, {sql_nn('a', 'b', 'f')}, {sql_nn('b', 'a', 'g')} select f.q as s, f.a as t from f join g on f.a = g.q and g.a = f.q")
def mutual_nearest(spark, sf_dir):
    """Pairs that are each other's nearest."""
    a, b = halves(spark, sf_dir)
    there = spatial.nearest_join(a, b).select(F.col("q").alias("s"), F.col("a").alias("t"))
    back = spatial.nearest_join(b, a).select(F.col("a").alias("s"), F.col("q").alias("t"))
    return there.join(back, ["s", "t"])


@query(f"with {SQL_E} select gid, x, y, z from e where x between -0.05 and 0.1 and y between -0.1 and 0.1 and z between -0.2 and 0.05")
def region(spark, sf_dir):
    """Rows inside a box."""
    return spatial.region(splats(spark, sf_dir), (-0.05, -0.1, -0.2), (0.1, 0.1, 0.05)).select("gid", "x", "y", "z")


# ---- samples ------------------------------------------------------------------------------------------------------


@query(f"with {SQL_E}, k as (select row_number() over (order by gid) - 1 as r, count(*) over () as n, gid from e), w as (select distinct round_even(i * ((select max(n) from k) - 1) / 100.0, 0)::bigint as r from range(101) t(i)) select gid from k join w using (r)")
def stride_rows(spark, sf_dir):
    """101 evenly spread rows: the sampling operator."""
    return stride_sample(splats(spark, sf_dir), 101).select("gid")


@query(f"with {SQL_E}, n as (select count(*) as n from e), s as (select greatest(1, n // least(n, 300)) as s, least(n, 300) as m from n) select gid from e, s where gid % s = 0 and gid // s < m")
def step_rows(spark, sf_dir):
    """Every step-th row, 300 at most: the sampling operator."""
    return step_sample(splats(spark, sf_dir), 300).select("gid")


# ---- transforms and unions ----------------------------------------------------------------------------------------

_M, _S = sql_moved(POSE), lie.scale_of(POSE)
_Q = [float(v) for v in lie.matrix_to_quat(POSE[:3, :3] / _S)]
_H = [
    f"({_Q[0]!r} * qw - {_Q[1]!r} * qx - {_Q[2]!r} * qy - {_Q[3]!r} * qz)",
    f"({_Q[0]!r} * qx + {_Q[1]!r} * qw + {_Q[2]!r} * qz - {_Q[3]!r} * qy)",
    f"({_Q[0]!r} * qy - {_Q[1]!r} * qz + {_Q[2]!r} * qw + {_Q[3]!r} * qx)",
    f"({_Q[0]!r} * qz + {_Q[1]!r} * qy - {_Q[2]!r} * qx + {_Q[3]!r} * qw)",
]
_N = "greatest(sqrt(" + " + ".join(f"{h} * {h}" for h in _H) + "), 1e-12)"


@query(f"with {SQL_E} select gid, " + ", ".join([sql_r6(m, c) for m, c in zip(_M, "xyz", strict=True)] + [sql_r6(f"{h} / {_N}", c) for h, c in zip(_H, ("qw", "qx", "qy", "qz"), strict=True)] + [sql_r6(f"{c} * {_S!r}", c) for c in ("sx", "sy", "sz")]) + ", opacity from e")
def apply_transform(spark, sf_dir):
    """Every splat moved by a similarity."""
    names = ["x", "y", "z", "qw", "qx", "qy", "qz", "sx", "sy", "sz"]
    return _rounded(transform.apply_transform(splats(spark, sf_dir), POSE).select("gid", *names, "opacity"), names)


@query(f"with {SQL_AB}, m as (select max(gid) + 1 as m from a) select gid, {sql_r6('sx', 'sx')}, {sql_r6('sy', 'sy')}, {sql_r6('sz', 'sz')}, false as log_scales from a union all select gid + m, {sql_r6('exp(ln(greatest(sx, 1e-20)))', 'sx')}, {sql_r6('exp(ln(greatest(sy, 1e-20)))', 'sy')}, {sql_r6('exp(ln(greatest(sz, 1e-20)))', 'sz')}, false from b, m")
def union_scales(spark, sf_dir):
    """A with linear scales and B with logarithmic ones, united in A's convention."""
    from ..model import with_scale_convention

    a, b = halves(spark, sf_dir)
    names = ["sx", "sy", "sz"]
    return _rounded(transform.union_splats([a, with_scale_convention(b, True)]).select("gid", *names, "log_scales"), names)


@query(f"with {SQL_AB} select 'both' as case_name, count(*) as n, count(*) as with_colors from e union all select 'one', count(*), 0 from e")
def union_colors(spark, sf_dir):
    """Colours survive a union only if every row has them."""
    a, b = halves(spark, sf_dir)
    rgb = F.array(F.array("sx", "sy", "sz"))
    ca, cb = (d.withColumns({"colors": rgb, "is_rgb": F.lit(True)}) for d in (a, b))
    count = lambda name, d: d.agg(F.lit(name).alias("case_name"), F.count("*").alias("n"), F.count("colors").alias("with_colors"))
    return count("both", transform.union_splats([ca, cb])).union(count("one", transform.union_splats([ca, b])))


@query(f"with {SQL_E}, m as (select *, (sx + sy + sz) / 3 as m from e), o as (select m, row_number() over (order by m) as r, count(*) over () as c from m) select count(*) as n, " + ", ".join(f"min({c}) as min_{c}, max({c}) as max_{c}, max({c}) - min({c}) as extent_{c}" for c in "xyz") + f", min(opacity) as min_opacity, max(opacity) as max_opacity, {sql_r6('avg(1 / (1 + exp(-opacity)))', 'mean_alpha')}, max(greatest(sx, sy, sz)) as max_scale, {sql_r6('(select m from o where r = (c + 1) // 2)', 'median_scale')} from e")
def info(spark, sf_dir):
    """Facts of the splat table."""
    return _rounded(transform.info(splats(spark, sf_dir)).drop("sh_degree"), ["mean_alpha", "median_scale"])


# ---- metrics ------------------------------------------------------------------------------------------------------


@query(f"with {SQL_AB}, {sql_nn('a', 'b', 'f')}, {sql_nn('b', 'a', 'g')} select {sql_r6('1000 * 0.5 * ((select avg(d) from f) + (select avg(d) from g))', 'chamfer')}")
def chamfer(spark, sf_dir):
    """Chamfer distance of A and B."""
    return _rounded(_row(spark, chamfer=metrics.chamfer(*halves(spark, sf_dir), most=None)), ["chamfer"])


@query(f"with {SQL_AB}, {sql_nn('b', 'a', 'g')} select {sql_r6('avg((d <= 0.07)::int)', 'overlap')} from g")
def overlap_fraction(spark, sf_dir):
    """Share of B near A."""
    return _rounded(_row(spark, overlap=metrics.overlap_fraction(*halves(spark, sf_dir), 0.07, most=None)), ["overlap"])


_R = sql_moved(RIGID)
_ADD = "sqrt(" + " + ".join(f"({m} - {r}) * ({m} - {r})" for m, r in zip(_M, _R, strict=True)) + ")"


@query(f"with {SQL_E} select {sql_r6(f'avg({_ADD})', 'add_error')} from e")
def add_error(spark, sf_dir):
    """Mean distance of model points under two poses."""
    return _rounded(_row(spark, add_error=metrics.add_metric(splats(spark, sf_dir), POSE, RIGID)), ["add_error"])


@query(f"with {SQL_E}, p as (select gid, {', '.join(f'{m} as {c}' for m, c in zip(_M, 'xyz', strict=True))} from e), q as (select gid, {', '.join(f'{m} as {c}' for m, c in zip(_R, 'xyz', strict=True))} from e), {sql_nn('q', 'p', 'f')} select {sql_r6('avg(d)', 'adds_error')} from f")
def adds_error(spark, sf_dir):
    """The same to the nearest point."""
    return _rounded(_row(spark, adds_error=metrics.adds_metric(splats(spark, sf_dir), POSE, RIGID, most=None)), ["adds_error"])


@query(f"with {SQL_AB}, {sql_nn('a', 'b', 'f')}, t as (select i, i * 0.0001 as t from range(1001) s(i)), r as (select i, avg((d <= t)::int) as r from t, f group by i) select {sql_r6('(sum(r) - 0.5 * (max(r) filter (i = 0) + max(r) filter (i = 1000))) / 1000', 'auc')} from r")
def add_auc(spark, sf_dir):
    """Area under the recall of nearest distances up to 0.1."""
    a, b = halves(spark, sf_dir)
    return _rounded(_row(spark, auc=metrics.add_auc(spatial.nearest_join(a, b), "d")), ["auc"])


@query(f"with {SQL_AB}, {sql_nn('a', 'b', 'f')}, o as (select d, row_number() over (order by d) as r, count(*) over () as c from f) select {sql_r6('avg(d)', 'residual')} from o where r <= greatest(1, floor(0.85 * c))")
def trimmed_residual(spark, sf_dir):
    """Mean of the lowest 85 % of nearest distances."""
    a, b = halves(spark, sf_dir)
    return _rounded(_row(spark, residual=metrics.trimmed(spatial.nearest_join(a, b), 0.85)), ["residual"])


@query(f"with {SQL_AB}, {sql_nn('b', 'a', 'f')}, o as (select d, row_number() over (order by d) as r, count(*) over () as c from f), m as (select avg(x) as x, avg(y) as y, avg(z) as z from b), s as (select max({sql_d('b', 'm')}) as s from b, m) select {sql_r6('avg(d) / max(s)', 'residual')} from o, s where r <= greatest(1, floor(0.85 * c))")
def overlap_residual(spark, sf_dir):
    """The same from B to A over B's radius."""
    a, b = halves(spark, sf_dir)
    return _rounded(_row(spark, residual=metrics.overlap_residual(a, b)), ["residual"])


@query(f"with {SQL_AB}, {sql_nn('a', 'b', 'f')}, o as (select *, row_number() over (order by d) as r, count(*) over () as c from f), k as (select max(d) as k from o where r <= greatest(1, floor(0.85 * c))) select q, a from f, k where d <= k")
def trim_mask(spark, sf_dir):
    """Pairs not above the 85 % cut."""
    a, b = halves(spark, sf_dir)
    return metrics.trim_mask(spatial.nearest_join(a, b), 0.85).select("q", "a")


# ---- residuals, fields, normals ----------------------------------------------------------------------------------


def _sql_normal_equations(rows: str) -> str:
    sums = [sql_r6(f"sum(w * j{i} * j{j})", f"h{i}{j}") for i in range(7) for j in range(i, 7)]
    sums += [sql_r6(f"sum(w * j{i} * r)", f"b{i}") for i in range(7)]
    return f"{rows} select {', '.join(sums)}, {sql_r6('0.5 * sum(w * r * r)', 'cost')}, count(*) as n from j"


def _system_row(spark, rows: DataFrame) -> DataFrame:
    h, b, cost, n = solve.normal_equations(rows)
    values = {f"h{i}{j}": float(h[i, j]) for i in range(7) for j in range(i, 7)} | {f"b{i}": float(b[i]) for i in range(7)} | {"cost": cost}
    return _rounded(_row(spark, **values, n=n), list(values))


_T = [[float(v) for v in r] for r in POSE]
_TURN = ", ".join("(" + " + ".join(f"g{c} * {_T[i][k]!r}" for i, c in enumerate("xyz")) + f") as u{k}" for k in range(3))
_JACOBIAN = "u0 as j0, u1 as j1, u2 as j2, y * u2 - z * u1 as j3, z * u0 - x * u2 as j4, x * u1 - y * u0 as j5, " + " + ".join(f"g{c} * (p{c} - {_T[i][3]!r})" for i, c in enumerate("xyz")) + " as j6"
_MOVED_A = f"p as (select gid, {', '.join(f'{m} as {c}' for m, c in zip(_M, 'xyz', strict=True))} from a)"
_PAIRED = f"with {SQL_AB}, {_MOVED_A}, {sql_nn('p', 'b', 'nn')}, k as (select a.x, a.y, a.z, p.x as px, p.y as py, p.z as pz, b.x as ox, b.y as oy, b.z as oz, nn.d, b.sx, b.sy, b.sz, b.qw, b.qx, b.qy, b.qz from nn join a on a.gid = nn.q join p on p.gid = nn.q join b on b.gid = nn.a)"
_P2P = f"{_PAIRED}, g as (select *, d as r, 1.0 as w, " + ", ".join(f"(p{c} - o{c}) / greatest(d, 1e-12) as g{c}" for c in "xyz") + f" from k), t as (select *, {_TURN} from g), j as (select r, w, {_JACOBIAN} from t)"


@query(_sql_normal_equations(_P2P))
def normal_equations_points(spark, sf_dir):
    """Sums of a point-to-point step from A to B."""
    a, b = halves(spark, sf_dir)
    return _system_row(spark, solve.ICP().table(POSE, b, a))


def _sql_normals(of: str) -> str:
    length = "greatest(sqrt(qw * qw + qx * qx + qy * qy + qz * qz), 1e-12)"
    w, x, y, z = (f"(q{c} / {length})" for c in "wxyz")
    columns = [
        (f"1 - 2 * ({y} * {y} + {z} * {z})", f"2 * ({x} * {y} + {w} * {z})", f"2 * ({x} * {z} - {w} * {y})"),
        (f"2 * ({x} * {y} - {w} * {z})", f"1 - 2 * ({x} * {x} + {z} * {z})", f"2 * ({y} * {z} + {w} * {x})"),
        (f"2 * ({x} * {z} + {w} * {y})", f"2 * ({y} * {z} - {w} * {x})", f"1 - 2 * ({x} * {x} + {y} * {y})"),
    ]
    out = ", ".join(f"case when sx <= sy and sx <= sz then {a} when sy <= sz then {b} else {c} end as {n}" for a, b, c, n in zip(*columns, ("nx", "ny", "nz"), strict=True))
    return f"select *, {out} from {of}"


_P2L = f"{_PAIRED}, n as ({_sql_normals('k')}), s as (select *, case when " + " + ".join(f"n{c} * (p{c} - o{c})" for c in "xyz") + " < 0 then -1.0 else 1.0 end as side from n), g as (select *, 1.0 as w, " + ", ".join(f"n{c} * side as g{c}" for c in "xyz") + f" from s), r as (select *, " + " + ".join(f"g{c} * (p{c} - o{c})" for c in "xyz") + f" as r from g), t as (select *, {_TURN} from r), j as (select r, w, {_JACOBIAN} from t)"


@query(_sql_normal_equations(_P2L))
def normal_equations_planes(spark, sf_dir):
    """Sums of a point-to-plane step from A to B."""
    a, b = halves(spark, sf_dir)
    return _system_row(spark, solve.ICP(point_to_plane=True).table(POSE, b, a))


@query(f"with {SQL_AB}, {sql_nn('a', 'b', 'nn')}, k as (select a.x, a.y, a.z, b.x as ox, b.y as oy, b.z as oz from nn join a on a.gid = nn.q join b on b.gid = nn.a) select count(*) as n, " + ", ".join(sql_r6(f"avg({s})", n) for s, n in [("x", "sx"), ("y", "sy"), ("z", "sz"), ("ox", "tx"), ("oy", "ty"), ("oz", "tz")]) + ", " + ", ".join(sql_r6(f"covar_pop(o{i}, {j})", f"c{i}{j}") for i in "xyz" for j in "xyz") + f", {sql_r6('var_pop(x) + var_pop(y) + var_pop(z)', 'variance')} from k")
def umeyama_moments(spark, sf_dir):
    """Moments of nearest pairs, from which the best similarity follows."""
    a, b = halves(spark, sf_dir)
    nn = spatial.nearest_join(a, b)
    source = a.select(F.col("gid").alias("q"), *[F.col(c).alias(f"s{c}") for c in "xyz"])
    target = b.select(F.col("gid").alias("a"), *[F.col(c).alias(f"t{c}") for c in "xyz"])
    out = moments.pair_moments(nn.join(source, "q").join(target, "a"))
    return _rounded(out, [c for c in out.columns if c != "n"])


@query(f"with {SQL_E}, n as ({_sql_normals('e')}) select gid, " + ", ".join(sql_r6(c, c) for c in ("nx", "ny", "nz")) + " from n")
def thin_normals(spark, sf_dir):
    """Normals from the thinnest axis."""
    names = ["nx", "ny", "nz"]
    return _rounded(field.thin_normals(splats(spark, sf_dir)).select("gid", *names), names)


_SDF = f"""with {SQL_AB}, nb as ({_sql_normals('b')}), u as (select a.gid as q, a.x, a.y, a.z, nb.x as ox, nb.y as oy, nb.z as oz, nb.nx, nb.ny, nb.nz, exp(-({sql_d('a', 'nb')} ** 2) / (2 * {SIGMA!r} * {SIGMA!r})) as w from a, nb where {sql_d('a', 'nb')} <= 3.0 * {SIGMA!r}),
 s as (select q, max(x) as x, max(y) as y, max(z) as z, sum(w) as sw, sum(w * ox) / greatest(sum(w), 1e-12) as mx, sum(w * oy) / greatest(sum(w), 1e-12) as my, sum(w * oz) / greatest(sum(w), 1e-12) as mz, sum(w * nx) as tx, sum(w * ny) as ty, sum(w * nz) as tz from u group by q),
 h as (select *, sqrt(tx * tx + ty * ty + tz * tz) as len, tx / greatest(sqrt(tx * tx + ty * ty + tz * tz), 1e-12) as hx, ty / greatest(sqrt(tx * tx + ty * ty + tz * tz), 1e-12) as hy, tz / greatest(sqrt(tx * tx + ty * ty + tz * tz), 1e-12) as hz from s),
 f as (select *, (x - mx) * hx + (y - my) * hy + (z - mz) * hz as d from h)"""


@query(f"{_SDF} select a.gid as q, {sql_r6('coalesce(f.d, 0.0)', 'd')} from a left join f on a.gid = f.q")
def sdf_value(spark, sf_dir):
    """Signed distance of A's rows in B's field."""
    a, b = halves(spark, sf_dir)
    return _rounded(field.gaussian_sdf(field.thin_normals(b), a, SIGMA).select("q", "d"), ["d"])


_GRAD = f"""{_SDF}, g as (select f.q, sum(u.w * ((u.ox - mx) * hx + (u.oy - my) * hy + (u.oz - mz) * hz) * (u.ox - mx)) as vx, sum(u.w * ((u.ox - mx) * hx + (u.oy - my) * hy + (u.oz - mz) * hz) * (u.oy - my)) as vy, sum(u.w * ((u.ox - mx) * hx + (u.oy - my) * hy + (u.oz - mz) * hz) * (u.oz - mz)) as vz,
 sum(u.w * (nx * (f.x - mx - d * hx) + ny * (f.y - my - d * hy) + nz * (f.z - mz - d * hz)) * (f.x - ox)) as ex, sum(u.w * (nx * (f.x - mx - d * hx) + ny * (f.y - my - d * hy) + nz * (f.z - mz - d * hz)) * (f.y - oy)) as ey, sum(u.w * (nx * (f.x - mx - d * hx) + ny * (f.y - my - d * hy) + nz * (f.z - mz - d * hz)) * (f.z - oz)) as ez from f join u on f.q = u.q group by f.q),
 o as (select f.q, {', '.join(f"case when sw < 1e-12 or len < 1e-12 then h{c} else h{c} - v{c} / sw / ({SIGMA!r} * {SIGMA!r}) - e{c} / ({SIGMA!r} * {SIGMA!r} * len) end as g{c}" for c in 'xyz')} from f join g on f.q = g.q)"""


@query(f"{_GRAD} select a.gid as q, " + ", ".join(f"round(coalesce(g{c}, 0.0), 4) + 0.0 as g{c}" for c in "xyz") + " from a left join o on a.gid = o.q")
def sdf_gradient(spark, sf_dir):
    """Its gradient."""
    a, b = halves(spark, sf_dir)
    out = field.gaussian_sdf_grad(field.thin_normals(b), a, SIGMA)
    return out.select("q", *[(F.round(f"g{c}", 4) + F.lit(0.0)).alias(f"g{c}") for c in "xyz"])


@query(f"with {SQL_AB}, {sql_nn('a', 'b', 'nn')} select q, {sql_r6('case when d <= 0.05 then 1.0 else 0.05 / d end', 'huber')}, {sql_r6('1 / (1 + (d / 0.05) * (d / 0.05))', 'cauchy')} from nn")
def robust_weights(spark, sf_dir):
    """Robust weights of nearest distances."""
    a, b = halves(spark, sf_dir)
    nn = spatial.nearest_join(a, b)
    return nn.select("q", r6(E.robust_weight(F.col("d"), 0.05, "huber"), "huber"), r6(E.robust_weight(F.col("d"), 0.05, "cauchy"), "cauchy"))


# ---- descriptors and rigidity -------------------------------------------------------------------------------------

_EMB = "da as (select vec_id as gid, embedding from embeddings where label < 5), db as (select vec_id as gid, embedding from embeddings where label >= 5)"
_ED = "sqrt(list_sum([(u[1] - u[2]) * (u[1] - u[2]) for u in list_zip(a.embedding::double[], b.embedding::double[])]))"


@query(f"with {_EMB}, p as (select a.gid as s, b.gid as t, {_ED} as d from da a, db b), f as (select *, row_number() over (partition by s order by d, t) as r, lead(d) over (partition by s order by d, t) as d2 from p), k as (select s, t, row_number() over (partition by t order by d, s) as r from p) select f.s, f.t, {sql_r6('f.d', 'd')} from f join k on f.s = k.s and f.t = k.t where f.r = 1 and k.r = 1 and f.d < 0.92 * f.d2")
def feature_matches(spark, sf_dir):
    """Mutual nearest descriptors of A and B that pass the ratio test."""
    return _rounded(features.match_features(*descriptors(spark, sf_dir)), ["d"])


GAMMA = 0.02
_C = f"c as (select vec_id as cid, embedding[1]::double as sx, embedding[2]::double as sy, embedding[3]::double as sz, " + ", ".join(f"({float(RIGID[i, 0])!r}::double * embedding[1]::double + {float(RIGID[i, 1])!r}::double * embedding[2]::double + {float(RIGID[i, 2])!r}::double * embedding[3]::double + {float(RIGID[i, 3])!r}::double) + embedding[{12 + i}]::double * 0.3 as t{c}" for i, c in enumerate("xyz")) + " from embeddings)"
_GAP = "abs(sqrt(" + " + ".join(f"(a.s{c} - b.s{c}) * (a.s{c} - b.s{c})" for c in "xyz") + ") - sqrt(" + " + ".join(f"(a.t{c} - b.t{c}) * (a.t{c} - b.t{c})" for c in "xyz") + "))"
_EDGES = f"with {_C}, g as (select a.cid as i, b.cid as j, {_GAP} as d from c a join c b on a.cid < b.cid), e as (select i, j, exp(-d * d / (2 * {GAMMA} * {GAMMA})) as s from g where d < {GAMMA})"
_SECOND = f"{_EDGES}, h as materialized (select i, j, s from e union all select j, i, s from e), p as materialized (select l.i, r.j, sum(l.s * r.s) as p from h l join h r on l.j = r.i where l.i < r.j group by l.i, r.j), w as (select e.i, e.j, e.s * p.p as w from e join p on e.i = p.i and e.j = p.j where e.s * p.p > 0)"


@query(f"{_EDGES} select i, j, {sql_r6('s', 's')} from e")
def rigidity_edges(spark, sf_dir):
    """Pairs of correspondences that keep their distance."""
    return _rounded(rigidity.compatibility_edges(correspondences(spark, sf_dir), GAMMA), ["s"])


@query(f"{_SECOND} select i, j, {sql_r6('w', 'w')} from w")
def rigidity_second_order(spark, sf_dir):
    """Their second-order weights."""
    return _rounded(rigidity.second_order_weights(correspondences(spark, sf_dir), GAMMA), ["w"])


@query(f"{_SECOND}, z as materialized (select i, j, round(w, 6) as w from w), y as materialized (select i, j, w from z union all select j, i, w from z), x as materialized (select i, j, w, row_number() over (partition by i order by w desc, j) as r from y), k as materialized (select i, j, w from x where r <= 8) select k.i, k.j from k join k k2 on k.i = k2.j and k.j = k2.i where k.i < k.j")
def rigidity_degree_cap(spark, sf_dir):
    """The eight heaviest edges of both ends."""
    return rigidity.capped_weights(correspondences(spark, sf_dir), GAMMA, 8).select("i", "j")


@query(f"{_EDGES}, y as (select i, j from e union all select j, i from e), y2 as (select i, count(*) as n from y group by i), m as (select i from y2 order by n desc, i limit 1) select j as cid from y where i = (select i from m) union all select i from m order by cid limit 200")
def rigidity_hub(spark, sf_dir):
    """The best connected correspondence and its neighbours, 200 at most: the clique prefilter."""
    c = correspondences(spark, sf_dir)
    return rigidity.hub_neighbourhood(rigidity.compatibility_edges(c, GAMMA), c.count())


# ---- cameras ------------------------------------------------------------------------------------------------------

VIEW = lie.look_at(np.array([2.0, 1.0, 0.5]), np.zeros(3))
_V = sql_moved(lie.inverse(VIEW))


@query(f"with {SQL_E}, p as (select gid, {', '.join(f'{v} as p{c}' for v, c in zip(_V, 'xyz', strict=True))} from e) select gid, {sql_r6('180.0 * px / greatest(pz, 1e-6) + 80', 'u')}, {sql_r6('180.0 * py / greatest(pz, 1e-6) + 80', 'v')}, {sql_r6('pz', 'depth')}, pz > 1e-6 as in_front from p")
def project_points(spark, sf_dir):
    """Pixels of all rows seen from a camera."""
    return _rounded(camera.project(splats(spark, sf_dir), VIEW, INTRINSICS), ["u", "v", "depth"])


_POSES = camera.candidate_poses(np.zeros(3), 2.5)
_VALUES = ", ".join("(" + ", ".join([str(i), *(f"{float(v)!r}::double" for v in lie.inverse(p)[:3].ravel())]) + ")" for i, p in enumerate(_POSES))
_MNAMES = ", ".join(f"m{i}{j}" for i in range(3) for j in range(4))
_SEEN = ", ".join(f"(m{i}0 * x + m{i}1 * y + m{i}2 * z + m{i}3) as s{i}" for i in range(3))
_PIX = "180.0 * s0 / s2 + 80 as u, 180.0 * s1 / s2 + 80 as v"


@query(f"""with {SQL_AB}, poses(pose_id, {_MNAMES}) as (values {_VALUES}), p as (select pose_id, {_PIX} from (select pose_id, {_SEEN} from a, poses) where s2 > 1e-6),
 c as (select distinct pose_id, floor(u * 24 / 160)::bigint as cu, floor(v * 24 / 160)::bigint as cv from p where u >= 0 and u < 160 and v >= 0 and v < 160),
 m as (select distinct floor(u * 24 / 160)::bigint as cu, floor(v * 24 / 160)::bigint as cv from (select {_PIX} from (select {_SEEN} from b, poses where pose_id = 7) where s2 > 1e-6) where u >= 0 and u < 160 and v >= 0 and v < 160),
 k as (select pose_id, count(*) as n, count(m.cu) as b from c left join m on c.cu = m.cu and c.cv = m.cv group by pose_id)
 select pose_id::integer as pose_id, {sql_r6('b / greatest(n + (select count(*) from m) - b, 1)', 'iou')} from k""")
def silhouette_iou(spark, sf_dir):
    """Overlap of A's silhouette from 60 cameras with B's from the eighth."""
    a, b = halves(spark, sf_dir)
    cells = camera.occupancy(a, _POSES, INTRINSICS, 160, 160, 24)
    mask = camera.occupancy(b, _POSES[7:8], INTRINSICS, 160, 160, 24).select("cu", "cv")
    return _rounded(camera.silhouette_iou(cells, mask), ["iou"])


def _pixels(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = lambda i: F.col("embedding")[i].cast("double")
    p = [F.abs(at(20 + i)) for i in range(3)]
    return e.select(*[c.alias(f"p{n}") for c, n in zip(p, "rgb", strict=True)], *[(c * 0.8 + 0.05 + at(24 + i) * 0.02).alias(f"t{n}") for i, (c, n) in enumerate(zip(p, "rgb", strict=True))])


_PX = "x as (select " + ", ".join(f"abs(embedding[{21 + i}]::double) as p{n}, abs(embedding[{21 + i}]::double) * 0.8 + 0.05 + embedding[{25 + i}]::double * 0.02 as t{n}" for i, n in enumerate("rgb")) + " from embeddings), y as (select * from x where pr + pg + pb > 0.02 or tr + tg + tb > 0.02)"
_GAIN = {n: f"(case when var_pop(p{n}) > 1e-8 then greatest(0.5, least(2.0, covar_pop(p{n}, t{n}) / var_pop(p{n}))) else 1.0 end)" for n in "rgb"}


@query(f"with {_PX} " + " union all ".join(f"select '{n}' as channel, {sql_r6(_GAIN[n], 'gain')}, {sql_r6(f'greatest(-0.2, least(0.2, avg(t{n}) - {_GAIN[n]} * avg(p{n})))', 'bias')} from y" for n in "rgb"))
def exposure_fit(spark, sf_dir):
    """Gain and bias by channel."""
    fit = camera.exposure_fit(_pixels(spark, sf_dir))
    return _rounded(spark.createDataFrame([(c, g, b) for c, (g, b) in fit.items()], "channel string, gain double, bias double"), ["gain", "bias"])


# ---- state over ordered events ------------------------------------------------------------------------------------


@query("select user_id, round(list_reduce(list(value order by ts, event_id), lambda s, v: s * 0.5 + v * 0.5, 0.0::double), 6) + 0.0 as state, count(*) as n from events group by user_id")
def event_state(spark, sf_dir):
    """A running state of each user over ordered events."""
    return _rounded(replay(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", ["ts", "event_id"]), ["state"])


from . import geometry  # noqa: E402, F401  (adds its queries)
