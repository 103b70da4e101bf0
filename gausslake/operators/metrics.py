"""Distances between point tables and accuracy of poses; all are joins and aggregations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions import lie
from ..model import stride_sample
from .spatial import nearest_join


def _rows(df: DataFrame, most: int | None) -> DataFrame:
    return df if most is None else stride_sample(df, most)


def mean_nearest(a: DataFrame, b: DataFrame) -> float:
    """Mean distance of the rows of `a` to their nearest row of `b`."""
    return nearest_join(a, b).agg(F.avg("d")).first()[0]


def chamfer(a: DataFrame, b: DataFrame, most: int | None = 4000, unit: float = 1000.0) -> float:
    """Half the sum of the mean nearest distances both ways, in thousandths; on `most` evenly spread rows of each (None: all)."""
    a, b = _rows(a, most), _rows(b, most)
    return unit * 0.5 * (mean_nearest(a, b) + mean_nearest(b, a))


def overlap_fraction(a: DataFrame, b: DataFrame, within: float, most: int | None = 8000) -> float:
    """Share of `b` with a row of `a` at a distance of `within` or less."""
    a, b = _rows(a, most), _rows(b, most)
    return nearest_join(b, a).agg(F.avg((F.col("d") <= within).cast("double"))).first()[0]


def add_metric(model: DataFrame, estimate: np.ndarray, truth: np.ndarray) -> float:
    """Mean distance between the places of the same model point under two poses."""
    apart = [p - q for p, q in zip(E.moved(estimate), E.moved(truth), strict=True)]
    return model.agg(F.avg(F.sqrt(sum((c * c for c in apart[1:]), apart[0] * apart[0])))).first()[0]


def adds_metric(model: DataFrame, estimate: np.ndarray, truth: np.ndarray, most: int | None = 4000) -> float:
    """Mean distance to the nearest model point under the other pose, for symmetric models."""
    m = _rows(model, most).select("gid", "x", "y", "z")
    return mean_nearest(m.select("gid", *E.moved(truth)), m.select("gid", *E.moved(estimate)))


def add_auc(errors: DataFrame, column: str = "error", largest: float = 0.1, steps: int = 1001) -> float:
    """Area under the recall curve of errors up to `largest`, by trapezoids over even thresholds; 0 without errors."""
    spark = errors.sparkSession
    n, = errors.agg(F.count(column)).first()
    if not n:
        return 0.0
    # an error is recalled from the first threshold that reaches it on; counting by that threshold needs no cross join
    step = largest / (steps - 1)
    at = F.greatest(F.lit(0), F.ceil(F.col(column) / step - 1e-12)).cast("long")
    counts = errors.where(F.col(column) <= largest).groupBy(at.alias("k")).count()
    reached = np.zeros(steps)
    for k, c in counts.collect():
        reached[min(int(k), steps - 1)] += c
    recall = np.cumsum(reached) / n
    return float(((recall[1:] + recall[:-1]) / 2).mean())


def trimmed(distances: DataFrame, share: float, column: str = "d") -> float:
    """Mean of the lowest share of a column (one value at least), exact at any size.

    The cut is the k-th lowest value; rows below it are averaged with as many copies of it as are missing.
    """
    n = distances.where(F.col(column).isNotNull()).count()
    if not n:
        return float("nan")
    k = max(1, int(share * n))
    cut = distances.agg(F.expr(f"percentile_disc({(k - 0.5) / n}) within group (order by {column})")).first()[0]
    total, below = distances.where(F.col(column) < cut).agg(F.coalesce(F.sum(column), F.lit(0.0)), F.count("*")).first()
    return (total + (k - below) * cut) / k


def trim_mask(distances: DataFrame, share: float, column: str = "d") -> DataFrame:
    """Rows not above the k-th lowest value; ties stay."""
    n = distances.count()
    k = max(1, int(share * n))
    cut = distances.agg(F.expr(f"percentile_disc({(k - 0.5) / max(n, 1)}) within group (order by {column})")).first()[0]
    return distances.where(F.col(column) <= cut)


def overlap_residual(source: DataFrame, target: DataFrame, share: float = 0.85) -> float:
    """Trimmed mean distance of target rows to the source, over the target's bounding radius."""
    d = trimmed(nearest_join(target, source), share)
    return d / max(centroid_stats(target)["radius"], 1e-12)


def symmetric_overlap_residual(source: DataFrame, target: DataFrame, share: float = 0.8, share_back: float = 0.5) -> float:
    """`overlap_residual` and the same from the source to the target, which may show only a part of it and is therefore
    trimmed harder; both over the target's bounding radius."""
    back = trimmed(nearest_join(source, target), share_back)
    return overlap_residual(source, target, share) + back / max(centroid_stats(target)["radius"], 1e-12)


def overlap_inliers(source: DataFrame, target: DataFrame, t: np.ndarray, within: float) -> int:
    """Rows of the target that lie nearer than `within` to a row of the moved source."""
    return nearest_join(target, source.select("gid", *E.moved(t))).where(F.col("d") < within).count()


def centroid_stats(df: DataFrame) -> dict[str, float]:
    """Centroid (cx, cy, cz), root mean square distance from it (rms) and largest one (radius): two aggregations."""
    m = df.agg(*[F.avg(c) for c in "xyz"]).first()
    d2 = sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip("yz", m[1:], strict=True)), (F.col("x") - m[0]) * (F.col("x") - m[0]))
    rms, radius = df.agg(F.sqrt(F.avg(d2)), F.sqrt(F.max(d2))).first()
    return {"cx": m[0], "cy": m[1], "cz": m[2], "rms": rms, "radius": radius}


def pick_near_best(rows: DataFrame, score: str, off: str, id: str, within: float = 5e-3) -> DataFrame:
    """The one row that is `off` least among those whose score is about as good as the least: within `within` of it, in
    units of it if it is above 1. Ties go to the smaller id."""
    best = F.min(score).alias("__best")
    near = rows.join(F.broadcast(rows.agg(best)), F.col(score) <= F.col("__best") + within * F.greatest(F.lit(1.0), F.abs("__best")))
    return near.drop("__best").orderBy(off, id).limit(1)


def score_hypotheses(pairs: DataFrame, poses: list[np.ndarray], tolerance: float) -> DataFrame:
    """(pose_id, inliers, error) of a bounded list of poses over point pairs (sx.., tx..): pairs nearer than `tolerance`
    after the move, and their mean distance. The pairs are read once, the poses are a constant of the plan."""
    listed = F.array(*[F.struct(F.lit(i).alias("pose_id"), F.array(*[F.lit(float(v)) for v in p[:3].ravel()]).alias("m")) for i, p in enumerate(poses)])
    rows = pairs.withColumn("p", F.explode(listed)).select("*", "p.pose_id", "p.m")
    m = lambda i: F.col("m")[i]
    apart = [m(4 * i) * F.col("sx") + m(4 * i + 1) * F.col("sy") + m(4 * i + 2) * F.col("sz") + m(4 * i + 3) - F.col(f"t{c}") for i, c in enumerate("xyz")]
    d = F.sqrt(apart[0] * apart[0] + apart[1] * apart[1] + apart[2] * apart[2])
    hit = F.when(F.col("d") < tolerance, F.col("d"))
    return rows.select("pose_id", d.alias("d")).groupBy("pose_id").agg(F.count(hit).alias("inliers"), F.avg(hit).alias("error"))


def success_rates(errors: DataFrame, by: str, rotation: float = 2.0, scale: float = 0.02) -> DataFrame:
    """`by`, n, the lower medians of rotation_deg and scale, and the share of rows below both limits."""
    solved = ((F.col("rotation_deg") < rotation) & (F.col("scale") < scale)).cast("double")
    middle = [F.expr(f"percentile_disc(0.5) within group (order by {c})").alias(f"median_{c}") for c in ("rotation_deg", "scale")]
    return errors.groupBy(by).agg(F.count("*").alias("n"), *middle, F.avg(F.coalesce(solved, F.lit(0.0))).alias("solved"))


def rank_within(df: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """The first `most` rows of each key in an order."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= most).drop("__r")


def pose_error(estimate: np.ndarray, truth: np.ndarray) -> dict[str, float]:
    """Rotation error in degrees, translation error, relative scale error."""
    d = lie.inverse(truth) @ estimate
    s = lie.scale_of(d)
    angle = np.degrees(np.linalg.norm(lie.so3_log(lie.so3_project(d[:3, :3] / s))))
    return {"rotation_deg": float(angle), "translation": float(np.linalg.norm(estimate[:3, 3] - truth[:3, 3])), "scale": abs(s - 1)}


def weighted_pose_error(estimate: np.ndarray, truth: np.ndarray, information: np.ndarray) -> float:
    """Squared error of a relative pose, weighted by its information matrix over that of translations along x."""
    d = lie.inverse(truth) @ estimate
    w, x, y, z = lie.matrix_to_quat(lie.so3_project(d[:3, :3]))
    e = np.concatenate((d[:3, 3], [-x, -y, -z]))
    return float(e @ information @ e / information[0, 0])


def registration_recall(errors: DataFrame, largest: float = 0.2, scene: str = "scene", error: str = "error") -> DataFrame:
    """One row: the share of pairs whose weighted error is at most `largest` squared, as the mean over scenes and pooled.

    Pairs without an estimate (null error) count as missed.
    """
    hit = F.coalesce((F.col(error) <= largest * largest).cast("double"), F.lit(0.0))
    by = errors.groupBy(scene).agg(F.sum(hit).alias("hits"), F.count("*").alias("n"))
    return by.agg(F.avg(F.col("hits") / F.col("n")).alias("mean_of_scenes"), (F.sum("hits") / F.sum("n")).alias("pooled"))


def rotation_translation_errors(pairs: DataFrame, estimate: str = "estimate", truth: str = "truth") -> DataFrame:
    """`pairs` with rre (degrees) and rte of two row-major 4 x 4 poses; column expressions only."""
    e, t = F.col(estimate), F.col(truth)
    trace = sum((e[4 * r + c] * t[4 * r + c] for r in range(3) for c in range(3)), F.lit(0.0))
    angle = F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (trace - 1) / 2))))
    apart = sum(((e[4 * r + 3] - t[4 * r + 3]) * (e[4 * r + 3] - t[4 * r + 3]) for r in range(3)), F.lit(0.0))
    return pairs.withColumns({"rre": angle, "rte": F.sqrt(apart)})
