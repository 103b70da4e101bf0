"""Local descriptors and mutual matches.

Histograms of angles between neighbours are join-and-count over tables; the same on arrays serves the bounded samples
that registration works with.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .field import estimate_anchor_normals
from .spatial import knn_join, settled

BINS = 11


def _dot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a, b):
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def fpfh(df: DataFrame, k: int = 16, bins: int = BINS) -> DataFrame:
    """(gid, descriptor): fast point feature histograms, 3 * bins numbers of length one.

    Neighbour pairs are made once; their three angles are counted by bin, and the histograms of the neighbours are
    added with inverse-distance weights. Rows without neighbours have zeros. Normals that `df` has (nx, ny, nz) are
    used; otherwise they come from the neighbours.
    """
    summed = fpfh_bins(df, k, bins)
    entries = summed.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("bin", "h"))).alias("m"), F.sqrt(F.sum(F.col("h") * F.col("h"))).alias("norm"))
    full = F.transform(F.sequence(F.lit(0), F.lit(3 * bins - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)) / F.greatest("norm", F.lit(1e-12)))
    made = entries.select(F.col("q").alias("gid"), full.alias("descriptor"))
    zero = F.array_repeat(F.lit(0.0), 3 * bins)
    return df.select("gid").join(made, "gid", "left").select("gid", F.coalesce("descriptor", zero).alias("descriptor"))


def simple_bins(df: DataFrame, k: int = 16, bins: int = BINS) -> DataFrame:
    """(q, bin, h): the share of a row's neighbours in each occupied bin of the three angles, before any spreading."""
    return _bins(df, k, bins)[0]


def fpfh_bins(df: DataFrame, k: int = 16, bins: int = BINS) -> DataFrame:
    """(q, bin, h): the occupied bins of `fpfh` before they are scaled to length one."""
    spfh, both, near = _bins(df, k, bins)
    share = both.select("q", "a", (1 / F.greatest("d", F.lit(1e-12))).alias("inv")).join(near.select("q", "total"), "q")
    added = share.join(spfh.select(F.col("q").alias("a"), "bin", "h"), "a").select("q", "bin", (F.col("inv") / F.col("total") * F.col("h")).alias("h"))
    return spfh.unionByName(added).groupBy("q", "bin").agg(F.sum("h").alias("h"))


def _bins(df: DataFrame, k: int, bins: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    has = {"nx", "ny", "nz"} <= set(df.columns)
    own = settled(df.select("gid", "x", "y", "z", "nx", "ny", "nz") if has else estimate_anchor_normals(df.select("gid", "x", "y", "z"), k, itself=False))
    pairs = knn_join(own, own, k, other=True)
    p = own.select(F.col("gid").alias("q"), *[F.col(c).alias(f"p{c}") for c in ("x", "y", "z", "nx", "ny", "nz")])
    q = own.select(F.col("gid").alias("a"), *[F.col(c).alias(f"q{c}") for c in ("x", "y", "z", "nx", "ny", "nz")])
    both = settled(pairs.join(p, "q").join(q, "a"))
    length = F.greatest("d", F.lit(1e-12))
    line = [(F.col(f"q{c}") - F.col(f"p{c}")) / length for c in "xyz"]
    u, m = [F.col(f"pn{c}") for c in "xyz"], [F.col(f"qn{c}") for c in "xyz"]
    v = _cross(line, u)
    size = F.greatest(F.sqrt(_dot(v, v)), F.lit(1e-12))
    v = [c / size for c in v]
    w = _cross(u, v)
    angles = [(_dot(v, m) + 1) / 2, (_dot(u, line) + 1) / 2, F.atan2(_dot(w, m), _dot(u, m)) / (2 * np.pi) + 0.5]
    slot = F.explode(F.array(*[(F.least(F.greatest(F.floor(a * bins), F.lit(0)), F.lit(bins - 1)) + i * bins).cast("int") for i, a in enumerate(angles)]))
    near = both.groupBy("q").agg(F.count("*").alias("k"), F.sum(1 / length).alias("total"))
    spfh = settled(both.select("q", slot.alias("bin")).groupBy("q", "bin").agg(F.count("*").alias("n")).join(near, "q").select("q", "bin", (F.col("n") / F.col("k")).alias("h")))
    return spfh, both, near


def match_features(source: DataFrame, target: DataFrame, ratio: float = 0.92, block: int = 2048) -> DataFrame:
    """(s, t, d): pairs that are each other's nearest descriptor and clearly nearer than the second (d1 < ratio * d2).

    The target is dealt out in blocks; a block is compared with a block in Arrow, keeping two candidates a row, so no
    pair table is made. Ties go to the smaller id. Columns are gid and descriptor; both tables should be samples.
    """
    two = _two_nearest(source, target, block)
    back = _two_nearest(target, source, block).where("r = 1").select(F.col("q").alias("t"), F.col("a").alias("s"))
    first = two.where("r = 1").select(F.col("q").alias("s"), F.col("a").alias("t"), "d")
    second = two.where("r = 2").select(F.col("q").alias("s"), F.col("d").alias("d2"))
    clear = first.join(second, "s", "left").where(F.col("d2").isNull() | (F.col("d") < ratio * F.col("d2")))
    return clear.join(back, ["s", "t"]).select("s", "t", "d")


def _two_nearest(queries: DataFrame, anchors: DataFrame, block: int) -> DataFrame:
    def packed(df: DataFrame, name: str) -> DataFrame:
        blocks = max(1, -(-df.count() // block))
        part = F.pmod(F.xxhash64("gid"), F.lit(blocks)).cast("int")
        rows = df.where("descriptor is not null").groupBy(part.alias(f"{name}_part")).agg(F.collect_list(F.struct("gid", "descriptor")).alias("rows"))
        return rows.select(f"{name}_part", F.col("rows.gid").alias(f"{name}_ids"), F.col("rows.descriptor").alias(f"{name}_vectors"))

    # every block of queries meets every block of anchors: the stated search, block by block
    q, a = packed(queries, "q"), packed(anchors, "a")
    n = max(1, -(-anchors.count() // block))
    pairs = q.withColumn("a_part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(a, "a_part").select("q_ids", "q_vectors", "a_ids", "a_vectors")

    def work(batches):
        for b in batches:
            for qi, qv, ai, av in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, y, ids = np.array(qv, float), np.array(av, float), np.array(ai)
                d = np.sqrt(np.maximum(((x[:, None] - y[None]) ** 2).sum(2), 0)) if len(x) * len(y) * x.shape[1] < 5e7 else np.stack([np.sqrt(((y - r) ** 2).sum(1)) for r in x])
                order = np.stack([np.lexsort((ids, row))[:2] for row in d])
                out = [(q, int(ids[k]), float(d[i, k])) for i, q in enumerate(qi) for k in order[i]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["q", "a", "d"])

    best = pairs.mapInArrow(work, "q long, a long, d double")
    return best.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("d", "a"))).where("r <= 2")


def neighbours(p: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each point of a bounded sample."""
    d = ((p[:, None] - p[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, : min(k, len(p) - 1)]


def normals(p: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Direction of least variance of each neighbourhood, away from the centroid."""
    group = p[near] - p[near].mean(1, keepdims=True)
    v = np.linalg.eigh(np.einsum("nki,nkj->nij", group, group))[1][:, :, 0]
    return v * np.where(((p - p.mean(0)) * v).sum(1) < 0, -1.0, 1.0)[:, None]


def fpfh_arrays(p: np.ndarray, k: int = 16, bins: int = BINS) -> np.ndarray:
    """Descriptors of a bounded sample."""
    if len(p) < 4:
        return np.zeros((len(p), 3 * bins))
    near = neighbours(p, k)
    n = normals(p, near)
    apart = p[near] - p[:, None]
    d = np.maximum(np.linalg.norm(apart, axis=2), 1e-12)
    line = apart / d[:, :, None]
    u, m = np.broadcast_to(n[:, None], line.shape), n[near]
    v = np.cross(line, u)
    v /= np.maximum(np.linalg.norm(v, axis=2, keepdims=True), 1e-12)
    w = np.cross(u, v)
    angles = ((v * m).sum(2) / 2 + 0.5, (u * line).sum(2) / 2 + 0.5, np.arctan2((w * m).sum(2), (u * m).sum(2)) / (2 * np.pi) + 0.5)
    rows = np.repeat(np.arange(len(p)), near.shape[1])
    h = np.zeros((len(p), 3 * bins))
    for i, a in enumerate(angles):
        np.add.at(h, (rows, i * bins + np.clip((a * bins).astype(int), 0, bins - 1).ravel()), 1 / near.shape[1])
    inv = 1 / d
    out = h + np.einsum("nk,nkb->nb", inv / inv.sum(1, keepdims=True), h[near])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def match_arrays(a: np.ndarray, b: np.ndarray, ratio: float = 0.92) -> np.ndarray:
    """(M, 2) mutual nearest rows of two bounded sets of descriptors that pass the ratio test."""
    d = np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))
    first = d.argmin(1)
    back = d.argmin(0)
    rows = np.arange(len(a))
    best = d[rows, first]
    d[rows, first] = np.inf
    clear = best < ratio * d.min(1)
    keep = clear & (back[first] == rows)
    return np.stack((rows[keep], first[keep]), 1)
