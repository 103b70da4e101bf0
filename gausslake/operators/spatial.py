"""Joins and statistics by place: grid cells make range predicates equi-joins.

A query row is copied to the cells that its ball touches and joined to anchors by cell; the exact distance is the
residual predicate. Ties in distance go to the smaller anchor id.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import finite, step_sample

CELL = ("cx", "cy", "cz")
#: Anchors that may be sent to all tasks, and queries that are then compared with all of them.
FEW_ANCHORS, FEW_QUERIES = 10_000, 1_000_000


def settled(df: DataFrame) -> DataFrame:
    """`df` computed once into the shared checkpoint folder of the session.

    Only a session on one machine that names no folder gets a temporary one; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gausslake-"))
    return df.checkpoint(eager=True)


def cell(size: float) -> list[Column]:
    """The three cell numbers of a row for cubes of `size`, counted from the origin."""
    return [F.floor(F.col(p) / F.lit(float(size))).cast("long").alias(c) for p, c in zip(("x", "y", "z"), CELL, strict=True)]


def with_cells(df: DataFrame, size: float) -> DataFrame:
    """`df` with its cell; rows without a finite place are left out."""
    if not size > 0:
        raise ValueError(f"a cell must have a size, not {size}")
    return finite(df).select("*", *cell(size))


def reached(df: DataFrame, radius: float, size: float) -> DataFrame:
    """Each row of finite place once for each cell that its ball touches: 8 on average for cells of two radii."""
    wide = radius * (1 + 1e-9)
    out = finite(df)
    for p, c in zip(("x", "y", "z"), CELL, strict=True):
        lo, hi = (F.floor((F.col(p) + F.lit(float(d))) / F.lit(float(size))).cast("long") for d in (-wide, wide))
        out = out.withColumn(c, F.explode(F.sequence(lo, hi)))
    return out


def _pairs(queries: DataFrame, anchors: DataFrame, radius: float, ids: tuple[str, str]) -> DataFrame:
    size = 2 * radius if radius > 0 else 1.0
    q = reached(queries.select(F.col(ids[0]).alias("q"), "x", "y", "z"), radius, size).withColumnsRenamed({"x": "qx_", "y": "qy_", "z": "qz_"})
    a = with_cells(anchors.select(F.col(ids[1]).alias("a"), "x", "y", "z"), size).withColumnsRenamed({"x": "ax_", "y": "ay_", "z": "az_"})
    return q.join(a, list(CELL)).drop(*CELL)


def _squared() -> Column:
    x, y, z = (F.col(f"q{c}_") - F.col(f"a{c}_") for c in "xyz")
    return x * x + y * y + z * z


def _few(queries: DataFrame, anchors: DataFrame, ids: tuple[str, str]) -> tuple[np.ndarray, np.ndarray] | None:
    """(ids, places) of the anchors if they are few enough to be sent to all tasks, and the queries few enough, too."""
    if any(df.schema[i].dataType.typeName() != "long" for df, i in zip((queries, anchors), ids, strict=True)):
        return None
    own = finite(anchors).select(ids[1], "x", "y", "z").limit(FEW_ANCHORS + 1).toPandas()
    if len(own) > FEW_ANCHORS or queries.limit(FEW_QUERIES + 1).count() > FEW_QUERIES:
        return None
    own = own.sort_values(ids[1])
    return own[ids[1]].to_numpy(np.int64), own[["x", "y", "z"]].to_numpy(float)


def _compared(queries: DataFrame, few: tuple[np.ndarray, np.ndarray], id: str, pick, names: str) -> DataFrame:
    """Rows that `pick` takes from the distances of blocks of queries to all of a few anchors."""
    shared = queries.sparkSession.sparkContext.broadcast(few)
    fields = [n.split()[0] for n in names.split(", ")]

    def work(batches):
        ids, places = shared.value
        step = max(1, 2_000_000 // max(1, len(ids)))
        for batch in batches:
            q, p = batch.column(0).to_numpy(), np.stack([batch.column(i).to_numpy() for i in (1, 2, 3)], 1)
            for lo in range(0, len(q), step):
                x, y, z = (p[lo : lo + step, i, None] - places[None, :, i] for i in range(3))
                rows = pick(q[lo : lo + step], ids, np.sqrt(x * x + y * y + z * z))
                yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], fields)

    return finite(queries).select(id, "x", "y", "z").mapInArrow(work, names)


def radius_join(queries: DataFrame, anchors: DataFrame, radius: float, ids: tuple[str, str] = ("gid", "gid"), other: bool = False) -> DataFrame:
    """(q, a, d): pairs at a distance of `radius` or less. `other` leaves out pairs with the same id.

    Few anchors go to all tasks; otherwise both sides meet by grid cell.
    """
    few = _few(queries, anchors, ids)
    if few is not None:

        def pick(q, a, d):
            good = d <= radius
            if other:
                good &= q[:, None] != a[None]
            i, j = np.nonzero(good)
            return q[i], a[j], d[i, j]

        return _compared(queries, few, ids[0], pick, "q long, a long, d double")
    return grid_radius_join(queries, anchors, radius, ids, other)


def grid_radius_join(queries: DataFrame, anchors: DataFrame, radius: float, ids: tuple[str, str] = ("gid", "gid"), other: bool = False) -> DataFrame:
    """`radius_join` by grid cells, whatever the sizes."""
    found = _pairs(queries, anchors, radius, ids).withColumn("d", F.sqrt(_squared())).where(F.col("d") <= float(radius))
    return (found.where("q <> a") if other else found).select("q", "a", "d")


def extent(df: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Least and greatest corner of the finite places of a table, and their number."""
    r = finite(df).agg(*[f(c) for f in (F.min, F.max) for c in ("x", "y", "z")], F.count("*")).first()
    if not r[6]:
        return np.zeros(3), np.zeros(3), 0
    return np.array(r[:3], float), np.array(r[3:6], float), int(r[6])


def knn_join(queries: DataFrame, anchors: DataFrame, k: int, ids: tuple[str, str] = ("gid", "gid"), other: bool = False) -> DataFrame:
    """(q, a, d, rank): the `k` nearest anchors of each query, nearest first, or all if there are fewer.

    Few anchors go to all tasks; otherwise rounds of grid joins find them.
    """
    few = _few(queries, anchors, ids)
    if few is not None and len(few[0]):

        def pick(q, a, d):
            if other:
                d = np.where(q[:, None] == a[None], np.inf, d)
            most = min(k, len(a))
            cut = np.partition(d, most - 1, axis=1)[:, most - 1 : most]
            i, j = np.nonzero((d <= cut) & np.isfinite(d))
            order = np.lexsort((a[j], d[i, j], i))
            i, j = i[order], j[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            keep = rank < k
            return q[i[keep]], a[j[keep]], d[i[keep], j[keep]], (rank[keep] + 1).astype(np.int32)

        return _compared(queries, few, ids[0], pick, "q long, a long, d double, rank int")
    return grid_knn_join(queries, anchors, k, ids, other)


def grid_knn_join(queries: DataFrame, anchors: DataFrame, k: int, ids: tuple[str, str] = ("gid", "gid"), other: bool = False) -> DataFrame:
    """`knn_join` by rounds of grid joins, whatever the sizes.

    The search radius starts at that of an even spread of anchors and doubles; a round keeps only the queries that
    have not found `k` within it. The rounds end when the radius spans everything, so the result is exact.
    """
    lo, hi, n = extent(anchors)
    qlo, qhi, m = extent(queries)
    spark = queries.sparkSession
    if not n or not m:
        kind = queries.schema[ids[0]].dataType.simpleString(), anchors.schema[ids[1]].dataType.simpleString()
        return spark.createDataFrame([], f"q {kind[0]}, a {kind[1]}, d double, rank int")
    span = float(np.linalg.norm(np.maximum(hi, qhi) - np.minimum(lo, qlo))) * (1 + 1e-9) + 1e-12
    sides = np.maximum(hi - lo, span * 1e-3)
    radius = min(span, 1.2 * float(np.prod(sides) * (k + 1) / n) ** (1 / 3))
    rest = queries.select(F.col(ids[0]).alias("q"), "x", "y", "z")
    anchors = anchors.select(F.col(ids[1]).alias("a"), "x", "y", "z")
    out = None
    while True:
        near = grid_radius_join(rest, anchors, radius, ("q", "a"), other)
        best = near.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("d", "a"))).where(F.col("rank") <= k)
        last = radius >= span
        if last and out is None:
            return best
        best = settled(best)
        if last:
            return out.union(best)
        full = best.where(F.col("rank") == k).select("q")
        done = best.join(full, "q", "left_semi")
        out = done if out is None else out.union(done)
        rest = settled(rest.join(full, "q", "left_anti"))
        if rest.isEmpty():
            return out
        radius = min(span, 2 * radius)


def nearest_join(queries: DataFrame, anchors: DataFrame, ids: tuple[str, str] = ("gid", "gid"), other: bool = False) -> DataFrame:
    """(q, a, d): the nearest anchor of each query."""
    return knn_join(queries, anchors, 1, ids, other).select("q", "a", "d")


def region(df: DataFrame, lo, hi) -> DataFrame:
    """Rows inside a box, its faces included; the bounds reach the file scan."""
    good = F.lit(True)
    for c, a, b in zip(("x", "y", "z"), lo, hi, strict=True):
        good = good & F.col(c).between(float(a), float(b))
    return df.where(good)


def lower_median(df: DataFrame, column: str) -> float | None:
    """The lower median: of an even number of values the smaller of the middle two."""
    return df.agg(F.expr(f"percentile_disc(0.5) within group (order by {column})")).first()[0]


def median_spacing(df: DataFrame, sample: int | None = 4096, reference: int = 20_000) -> float | None:
    """Lower median distance of sampled rows to their nearest row that is not at the same place (1e-12); null if none.

    Sampled rows and those they are compared with are every step-th by gid, of bounded number, so this stays small.
    With `sample` None it is that of all rows: rows of one place are one, which finds its nearest other by a join.
    """
    if sample is None:
        rows = finite(df).select("gid", *[(F.col(c) + F.lit(0.0)).alias(c) for c in ("x", "y", "z")])
        places = settled(rows.groupBy("x", "y", "z").agg(F.min("gid").alias("gid"), F.count("*").alias("n")))
        far = nearest_join(places, places, other=True).where(F.col("d") > 1e-12)
        weighed = far.join(places.select(F.col("gid").alias("q"), "n"), "q").select("d", "n")
        total = weighed.agg(F.sum("n")).first()[0]
        if not total:
            return None
        # equal distances are one row before they are put in order
        steps = weighed.groupBy("d").agg(F.sum("n").alias("n"))
        before = steps.repartitionByRange("d").withColumn("part", F.spark_partition_id())
        before = settled(before)
        sizes = sorted(tuple(r) for r in before.groupBy("part").agg(F.sum("n")).collect())
        at = (int(total) - 1) // 2
        for part, n in sizes:
            if at < n:
                ordered = before.where(F.col("part") == part).withColumn("upto", F.sum("n").over(W.orderBy("d")))
                return float(ordered.where(F.col("upto") > at).agg(F.min("d")).first()[0])
            at -= n
    n = df.count()
    a = finite(step_sample(df, sample, n)).select("x", "y", "z").toPandas().to_numpy(float)
    b = finite(step_sample(df, reference, n)).select("x", "y", "z").toPandas().to_numpy(float)
    best = []
    for at in range(0, len(a), 256):
        d = np.sqrt(((a[at : at + 256, None] - b[None]) ** 2).sum(2))
        d[d <= 1e-12] = np.inf
        best.append(d.min(1, initial=np.inf))
    best = np.concatenate(best) if best else np.zeros(0)
    best = np.sort(best[np.isfinite(best)])
    return float(best[(len(best) - 1) // 2]) if len(best) else None


class SpatialIndex:
    """Anchors with a cell size; queries as tables."""

    def __init__(self, anchors: DataFrame, cell: float | None = None):
        self.anchors = anchors
        self.cell = cell or median_spacing(anchors, 2048, 8000) or 1.0

    def radius(self, queries: DataFrame, radius: float) -> DataFrame:
        """All pairs within a radius."""
        return radius_join(queries, self.anchors, radius)

    radius_batch = radius

    def knn(self, queries: DataFrame, k: int) -> DataFrame:
        """The k nearest anchors."""
        return knn_join(queries, self.anchors, max(1, k))

    knn_batch = knn

    def region(self, lo, hi) -> DataFrame:
        """Anchors inside a box, by gid."""
        return region(self.anchors, lo, hi).orderBy("gid")


def build_index(df: DataFrame, cell: float | None = None) -> SpatialIndex:
    """An index over a splat table."""
    return SpatialIndex(df, cell)


def nearest_arrays(queries: np.ndarray, anchors: np.ndarray, chunk: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(distance, index) of the nearest anchor of each query, for arrays of bounded size inside one task."""
    step = max(1, chunk // max(1, len(anchors)))
    norms = (anchors * anchors).sum(1)
    index = np.concatenate([(norms[None] - 2 * queries[k : k + step] @ anchors.T).argmin(1) for k in range(0, len(queries), step)]) if len(queries) else np.zeros(0, int)
    return np.sqrt(((queries - anchors[index]) ** 2).sum(1)), index
