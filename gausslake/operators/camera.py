"""Camera seeds from silhouettes, and exposure between images; joins and aggregations on pixel cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions import lie


def candidate_poses(target: np.ndarray, radius: float, around: int = 12, levels: int = 5) -> list[np.ndarray]:
    """Camera poses that look at a point from a sphere: elevations of -60 to 60 degrees, even azimuths."""
    out = []
    for up in np.radians(np.linspace(-60, 60, levels)):
        for turn in np.arange(around) * 2 * np.pi / around:
            out.append(lie.look_at(target + radius * np.array([np.cos(up) * np.cos(turn), np.cos(up) * np.sin(turn), np.sin(up)]), target))
    return out


def occupancy(points: DataFrame, poses: list[np.ndarray], k: np.ndarray, width: int, height: int, grid: int, first: int = 0) -> DataFrame:
    """(pose_id, cu, cv): distinct image cells that points fall into from each camera-to-world pose.

    `poses` is a bounded list of candidates, which becomes one constant of the plan; the points are read once, and
    cells are made distinct before the shuffle. Numbers of poses start at `first`.
    """
    listed = F.array(*[F.struct(F.lit(first + n).alias("pose_id"), F.array(*[F.lit(float(v)) for v in lie.inverse(p)[:3].ravel()]).alias("m")) for n, p in enumerate(poses)])
    x, y, z = (F.col(c) for c in "xyz")
    both = points.select("x", "y", "z", F.explode(listed).alias("p")).select("x", "y", "z", "p.pose_id", "p.m")
    m = lambda i: F.col("m")[i]
    seen = [m(4 * i) * x + m(4 * i + 1) * y + m(4 * i + 2) * z + m(4 * i + 3) for i in range(3)]
    both = both.select("pose_id", *[c.alias(n) for c, n in zip(seen, ("a", "b", "depth"), strict=True)]).where("depth > 1e-6")
    u, v = float(k[0, 0]) * F.col("a") / F.col("depth") + float(k[0, 2]), float(k[1, 1]) * F.col("b") / F.col("depth") + float(k[1, 2])
    inside = both.select("pose_id", u.alias("u"), v.alias("v")).where((F.col("u") >= 0) & (F.col("u") < width) & (F.col("v") >= 0) & (F.col("v") < height))
    return inside.select("pose_id", F.floor(F.col("u") * grid / width).alias("cu"), F.floor(F.col("v") * grid / height).alias("cv")).distinct()


def dilated(cells: DataFrame, by: int, grid: int, keys: list[str]) -> DataFrame:
    """Cells and those at most `by` away along each axis, inside the grid."""
    steps = F.sequence(F.lit(-by), F.lit(by))
    out = cells.withColumn("du", F.explode(steps)).withColumn("dv", F.explode(steps))
    out = out.select(*keys, (F.col("cu") + F.col("du")).alias("cu"), (F.col("cv") + F.col("dv")).alias("cv"))
    return out.where(F.col("cu").between(0, grid - 1) & F.col("cv").between(0, grid - 1)).distinct()


def silhouette_iou(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """(pose_id, iou) of the cells of each pose and those of a mask (cu, cv)."""
    m = mask.count()
    hit = cells.join(F.broadcast(mask.withColumn("__in", F.lit(1))), ["cu", "cv"], "left")
    both = F.sum(F.coalesce("__in", F.lit(0)))
    return hit.groupBy("pose_id").agg((both / F.greatest(F.count("*") + m - both, F.lit(1))).alias("iou"))


def foreground(frame: DataFrame, has_mask: bool) -> DataFrame:
    """Pixels of the object: mask above a half, or else a mean colour above a thousandth."""
    return frame.where(F.col("mask") > 0.5) if has_mask else frame.where((F.col("r") + F.col("g") + F.col("b")) / 3 > 1e-3)


def coarse_localize_camera(splat: DataFrame, frame: DataFrame, k: np.ndarray, width: int, height: int, grid: int = 24, dilate: int = 2, around: int = 12, levels: int = 5, poses: list[np.ndarray] | None = None) -> dict:
    """The candidate camera whose silhouette fits the frame's foreground best (ties to the first): pose, iou, index.

    `frame` has u, v, r, g, b and, if it has one, mask.
    """
    c = splat.agg(*[F.avg(x) for x in "xyz"]).first()
    centre = np.array(c, float)
    far = splat.agg(F.max(F.sqrt(sum(((F.col(x) - float(v)) ** 2 for x, v in zip("yz", c[1:], strict=True)), (F.col("x") - float(c[0])) ** 2)))).first()[0]
    poses = candidate_poses(centre, 2.5 * far, around, levels) if poses is None else poses
    cells = dilated(occupancy(splat, poses, k, width, height, grid), dilate, grid, ["pose_id"])
    mask = foreground(frame, "mask" in frame.columns).select(F.floor(F.col("u") * grid / width).alias("cu"), F.floor(F.col("v") * grid / height).alias("cv")).distinct()
    mask = dilated(mask, dilate, grid, [])
    best = silhouette_iou(cells, mask).orderBy(F.desc("iou"), "pose_id").first()
    if best is None:
        return {"pose": poses[0], "iou": 0.0, "index": 0}
    return {"pose": poses[best["pose_id"]], "iou": float(best["iou"]), "index": int(best["pose_id"])}


def project(points: DataFrame, pose: np.ndarray, k: np.ndarray) -> DataFrame:
    """gid, u, v, depth, in_front of points seen from a camera."""
    return points.select("gid", *E.projected(pose, k)).withColumn("in_front", F.col("depth") > 1e-6)


def exposure_fit(pixels: DataFrame, least: int = 16) -> dict[str, tuple[float, float]]:
    """Gain and bias by channel that take p_c to t_c over the foreground: one aggregation of variances.

    `pixels` has pr, pg, pb, tr, tg, tb. Gains are clamped to 0.5..2, biases to -0.2..0.2; few pixels give the identity.
    """
    lit = pixels.where((F.col("pr") + F.col("pg") + F.col("pb") > 0.02) | (F.col("tr") + F.col("tg") + F.col("tb") > 0.02))
    got = lit.agg(F.count("*").alias("n"), *[f for c in "rgb" for f in (F.covar_pop(f"p{c}", f"t{c}").alias(f"c{c}"), F.var_pop(f"p{c}").alias(f"v{c}"), F.avg(f"p{c}").alias(f"p{c}"), F.avg(f"t{c}").alias(f"t{c}"))]).first()
    if got["n"] < least:
        return {c: (1.0, 0.0) for c in "rgb"}
    out = {}
    for c in "rgb":
        gain = float(np.clip(got[f"c{c}"] / got[f"v{c}"], 0.5, 2.0)) if got[f"v{c}"] > 1e-8 else 1.0
        out[c] = (gain, float(np.clip(got[f"t{c}"] - gain * got[f"p{c}"], -0.2, 0.2)))
    return out
