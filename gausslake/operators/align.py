"""Finding a pose without a guess: seeds over all rotations, feature matches, trimmed polishing.

Seeds are independent, so they are rows of a table: chunks of them go to Arrow tasks with the two bounded samples, and
only scores and poses come back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from ..functions import lie
from ..model import even_rows
from .features import fpfh_arrays, match_arrays, neighbours, normals
from .spatial import nearest_arrays

AMBIGUOUS_RESIDUAL, AMBIGUOUS_SPREAD, FEW_INLIERS = 0.04, 0.02, 6


def spread(p: np.ndarray, most: int) -> np.ndarray:
    """`most` evenly spread rows."""
    return p[even_rows(len(p), most)]


def trimmed_icp(source: np.ndarray, target: np.ndarray, t: np.ndarray, iterations: int, keep: float, with_scale: bool, back: bool = False) -> np.ndarray:
    """Pose after rounds of nearest neighbours, keeping the nearest share (ties stay) and solving for the pose.

    `back` looks for the source point of each target point, which suits partial overlap.
    """
    for _ in range(iterations):
        p = lie.apply(t, source)
        d, at = nearest_arrays(target, p) if back else nearest_arrays(p, target)
        near = d <= np.partition(d, max(0, int(keep * len(d)) - 1))[max(0, int(keep * len(d)) - 1)]
        a, b = (source[at[near]], target[near]) if back else (source[near], target[at[near]])
        if len(a) < 3:
            return t
        new = lie.umeyama(a, b, with_scale=with_scale)
        if np.abs(new - t).max() < 1e-6:
            return new
        t = new
    return t


def trimmed_mean(d: np.ndarray, keep: float) -> float:
    """Mean of the lowest share, one value at least."""
    return float(np.sort(d)[: max(1, int(keep * len(d)))].mean())


def symmetric_score(source: np.ndarray, target: np.ndarray, t: np.ndarray, keep: float = 0.85) -> float:
    """Half the sum of the trimmed mean nearest distances both ways."""
    p = lie.apply(t, source)
    return 0.5 * (trimmed_mean(nearest_arrays(p, target)[0], keep) + trimmed_mean(nearest_arrays(target, p)[0], keep))


def overlap_residual(source: np.ndarray, target: np.ndarray, t: np.ndarray, keep: float = 0.85) -> float:
    """Trimmed mean distance of the target to the moved source, over the target's radius."""
    radius = np.linalg.norm(target - target.mean(0), axis=1).max()
    return trimmed_mean(nearest_arrays(target, lie.apply(t, source))[0], keep) / max(radius, 1e-12)


def seeds(source: np.ndarray, target: np.ndarray, n: int, with_scale: bool) -> np.ndarray:
    """Poses that take centroid to centroid (and spread to spread): identity, principal axes with all proper flips, a spiral."""
    a, b = source.mean(0), target.mean(0)
    ra, rb = np.sqrt(((source - a) ** 2).sum(1).mean()), np.sqrt(((target - b) ** 2).sum(1).mean())
    s = rb / max(ra, 1e-12) if with_scale else 1.0
    va, vb = np.linalg.eigh(np.cov((source - a).T))[1], np.linalg.eigh(np.cov((target - b).T))[1]
    turns = [np.eye(3)]
    for flip in ((1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1)):
        m = vb * np.array(flip) @ va.T
        turns.append(m if np.linalg.det(m) > 0 else (vb * np.array(flip) * np.array([-1, 1, 1])) @ va.T)
    turns = np.concatenate((np.array(turns), lie.super_fibonacci(n))) if n else np.array(turns)
    out = np.tile(np.eye(4), (len(turns), 1, 1))
    out[:, :3, :3] = s * turns
    out[:, :3, 3] = b - np.einsum("nij,j->ni", out[:, :3, :3], a)
    return out


def over_poses(spark: SparkSession | None, poses: np.ndarray, data: tuple, one) -> tuple[np.ndarray, np.ndarray]:
    """(poses, scores) that `one(pose, *data)` makes of each pose, `data` being arrays of bounded size; on the executors
    if there are many poses."""
    if spark is None or len(poses) < 64:
        done = [one(t, *data) for t in poses]
        return np.array([t for t, _ in done]).reshape(-1, 4, 4), np.array([s for _, s in done])
    shared = spark.sparkContext.broadcast(data)

    def work(batches):
        for batch in batches:
            ids, ts, ss = batch.column(0).to_pylist(), [], []
            for flat in batch.column(1).to_pylist():
                t, s = one(np.array(flat).reshape(4, 4), *shared.value)
                ts.append(t.ravel().tolist())
                ss.append(float(s))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ts, pa.list_(pa.float64())), pa.array(ss, pa.float64())], ["i", "t", "score"])

    rows = spark.createDataFrame([(i, t.ravel().tolist()) for i, t in enumerate(poses)], "i long, t array<double>")
    slices = min(len(poses) // 16 + 1, 2 * spark.sparkContext.defaultParallelism)
    got = sorted(rows.repartition(slices).mapInArrow(work, "i long, t array<double>, score double").collect())
    return np.array([r.t for r in got]).reshape(-1, 4, 4), np.array([r.score for r in got])


def _refined(spark: SparkSession | None, poses: np.ndarray, source: np.ndarray, target: np.ndarray, iterations: int, keep: float, with_scale: bool, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(poses, scores) after trimmed rounds from each pose; a search `back` is scored from target to source only."""

    def one(t, a, b):
        t = trimmed_icp(a, b, t, iterations, keep, with_scale, back)
        return t, trimmed_mean(nearest_arrays(b, lie.apply(t, a))[0], 0.9) if back else symmetric_score(a, b, t, keep)

    return over_poses(spark, poses, (source, target), one)


def near_best(scores: np.ndarray, within: float = 5e-3) -> np.ndarray:
    """Which scores are about as good as the least: within `within` of it, in units of it if it is above 1."""
    return np.flatnonzero(scores <= scores.min() + within * max(1.0, abs(float(scores.min()))))


def global_align(source: np.ndarray, target: np.ndarray, transform: str = "se3", n_seeds: int = 1024, spark: SparkSession | None = None, most_source: int = 4096, most_target: int = 12_288, coarse: int = 200, finalists: int = 64) -> tuple[np.ndarray, dict]:
    """Pose with the best trimmed two-way distance over all seeds, and facts about it.

    All seeds are judged on small samples first; the best go on to larger ones. Distances are measured in radii of the
    target. Among poses about as good as the best the one whose centroid moves nearest to the target's wins. Fewer
    than 3 points on a side give the identity.
    """
    if min(len(source), len(target)) < 3:
        return np.eye(4), {"score": float("inf"), "seeds": 0}
    with_scale = transform == "sim3"
    source, target = spread(source, most_source), spread(target, most_target)
    a, b = spread(source, coarse), spread(target, 2 * coarse)
    poses, scores = _refined(spark, seeds(source, target, n_seeds, with_scale), a, b, 12, 0.85, with_scale)
    poses = poses[np.argsort(scores, kind="stable")[:finalists]]
    a, b = spread(source, 5 * coarse), spread(target, 10 * coarse)
    poses, scores = _refined(spark, poses, a, b, 40, 0.85, with_scale)
    radius = max(float(np.linalg.norm(target - target.mean(0), axis=1).max()), 1e-12)
    good = near_best(scores / radius)
    off = [np.linalg.norm(lie.apply(poses[i], source).mean(0) - target.mean(0)) for i in good]
    best = poses[good[int(np.argmin(off))]]
    best = trimmed_icp(source, target, best, 10, 0.85, with_scale) if len(source) * len(target) <= 2e7 else best
    return best, {"score": float(scores.min()), "seeds": len(poses)}


def basin_sweep(source: np.ndarray, target: np.ndarray, spark: SparkSession | None = None, rotations: int = 2048, top: int = 200, iterations: int = 12, refine: int = 150, most_source: int = 1400, most_target: int = 800) -> np.ndarray:
    """Rigid pose for a target that shows only a part of the source: a dense covering of rotations.

    Every rotation is run through rounds from target to source and judged by them; the `top` best go through rounds
    along the source's normals; of those about as good one way, the least distance both ways wins.
    """
    a, b = spread(source, most_source), spread(target, most_target)
    if min(len(a), len(b)) < 6:
        return np.eye(4)
    start = np.tile(np.eye(4), (rotations, 1, 1))
    start[:, :3, :3] = lie.super_fibonacci(rotations)
    start[:, :3, 3] = b.mean(0) - np.einsum("nij,j->ni", start[:, :3, :3], a.mean(0))
    poses, scores = _refined(spark, start, a, b, iterations, 0.7, False, back=True)
    poses = poses[np.argsort(scores, kind="stable")[:top]]
    own = normals(a, neighbours(a, 16))

    def one(t, a, b, n):
        t = point_to_plane(a, n, b, t, refine)
        return t, trimmed_mean(nearest_arrays(b, lie.apply(t, a))[0], 0.8)

    poses, scores = over_poses(spark, poses, (a, b, own), one)
    rivals = np.flatnonzero(scores <= max(3 * scores.min(), scores.min() + 1e-4))
    return poses[rivals[int(np.argmin([two_way_residual(a, b, poses[i]) for i in rivals]))]]


def two_way_residual(source: np.ndarray, target: np.ndarray, t: np.ndarray, keep: float = 0.8, keep_back: float = 0.5) -> float:
    """Trimmed mean distance of the target to the moved source and of the moved source to the target; the way from the
    source is trimmed harder, as the target may show only a part of it."""
    p = lie.apply(t, source)
    return trimmed_mean(nearest_arrays(target, p)[0], keep) + trimmed_mean(nearest_arrays(p, target)[0], keep_back)


def overlap_inliers(source: np.ndarray, target: np.ndarray, t: np.ndarray, tolerance: float, most_source: int = 2048, most_target: int = 1024) -> int:
    """Target points that lie within `tolerance` of the moved source."""
    a, b = spread(source, most_source), spread(target, most_target)
    return int((nearest_arrays(b, lie.apply(t, a))[0] < tolerance).sum()) if min(len(a), len(b)) >= 3 else 0


def cloud_voxel(points: np.ndarray, factor: float = 1.5, sample: int = 2000) -> float:
    """A size that follows the spacing of a cloud, whatever its unit: `factor` lower median nearest distances."""
    if len(points) < 4:
        return 0.05
    p = spread(points, sample)
    d = nearest_others(p)
    step = float(np.sort(d)[(len(d) - 1) // 2])
    if not np.isfinite(step) or step <= 0:
        step, factor = float(np.linalg.norm(points.max(0) - points.min(0))) / 50, 1.0
    return max(step * factor, 1e-4)


def nearest_others(p: np.ndarray, chunk: int = 512) -> np.ndarray:
    """Distance of each point of a bounded sample to its nearest other."""
    out = []
    for lo in range(0, len(p), chunk):
        d = np.linalg.norm(p[lo : lo + chunk, None] - p[None], axis=2)
        d[np.arange(len(d)), lo + np.arange(len(d))] = np.inf
        out.append(d.min(1))
    return np.concatenate(out)


#: Hypotheses are about as good from this share of the best one's inliers on; so many of them are compared;
#: rotations further apart than this (degrees) contradict each other.
SLACK, RIVALS, CONTRADICTION = 0.85, 12, 12.0


def rotation_spread(rotations: np.ndarray) -> float:
    """The largest angle in degrees between two of some rotations; 0 for fewer than two."""
    if len(rotations) < 2:
        return 0.0
    trace = np.einsum("aij,bij->ab", rotations, rotations)
    return float(np.degrees(np.arccos(np.clip((trace - 1) / 2, -1, 1))).max())


def ransac(cs: np.ndarray, ct: np.ndarray, with_scale: bool, tolerance: float, hypotheses: int = 2000, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """(pose, inlier mask, spread) of matched points: three-point hypotheses, the most inliers (then the least mean
    error), refit; `spread` is the largest angle between the best hypotheses that are about as good.

    Triples are drawn from the matches that agree in distance with the best connected one, if those are enough.
    """
    n = len(cs)
    if n < 3:
        return np.eye(4), np.zeros(n, bool), 0.0
    ds, dt = (np.linalg.norm(c[:, None] - c[None], axis=2) for c in (cs, ct))
    agree = np.abs(ds - dt) < 2 * tolerance if not with_scale else np.ones((n, n), bool)
    hub = int(agree.sum(1).argmax())
    pool = np.flatnonzero(agree[hub])
    if len(pool) < 4:
        pool = np.arange(n)
    random = np.random.default_rng(seed)
    best, best_mask, best_key = np.eye(4), np.zeros(n, bool), (-1, 0.0)
    tried: list[tuple[int, np.ndarray]] = []
    for _ in range(hypotheses):
        pick = random.choice(pool, 3, replace=False)
        t = lie.umeyama(cs[pick], ct[pick], with_scale=with_scale)
        if with_scale and not 0.1 < lie.scale_of(t) < 10:
            continue
        e = np.linalg.norm(lie.apply(t, cs) - ct, axis=1)
        mask = e < tolerance
        key = (int(mask.sum()), -float(e[mask].mean()) if mask.any() else 0.0)
        if key[0] >= max(3, SLACK * best_key[0]):
            tried.append((key[0], t[:3, :3] / lie.scale_of(t)))
        if key > best_key:
            best, best_mask, best_key = t, mask, key
    tried = sorted((x for x in tried if x[0] >= SLACK * best_key[0]), key=lambda x: -x[0])[:RIVALS]
    for _ in range(3):
        if best_mask.sum() < 3:
            break
        best = lie.umeyama(cs[best_mask], ct[best_mask], with_scale=with_scale)
        best_mask = np.linalg.norm(lie.apply(best, cs) - ct, axis=1) < tolerance
    return best, best_mask, rotation_spread(np.array([r for _, r in tried]))


def polish(source: np.ndarray, target: np.ndarray, t: np.ndarray, with_scale: bool, iterations: int = 10, keep: float = 0.85) -> np.ndarray:
    """Trimmed rounds from target to source on bounded samples."""
    return trimmed_icp(spread(source, 2048), spread(target, 1024), t, iterations, keep, with_scale, back=True)


def point_to_plane(source: np.ndarray, own: np.ndarray, target: np.ndarray, t: np.ndarray, iterations: int = 20, keep: float = 0.8, damping: float = 0.5) -> np.ndarray:
    """Rigid rounds from target to source along the source's normals `own`, about the centroid of the overlap, so that a
    part can slide along the surface that it is a part of."""
    for _ in range(iterations):
        p = lie.apply(t, source)
        d, at = nearest_arrays(target, p)
        cut = max(0, int(keep * len(d)) - 1)
        near = d <= np.partition(d, cut)[cut]
        x, q, n = p[at[near]], target[near], own[at[near]] @ t[:3, :3].T
        pivot = x.mean(0)
        rows = np.concatenate((np.cross(x - pivot, n), n), 1)
        h = rows.T @ rows
        step = np.linalg.solve(h + damping * np.diag(np.diag(h)) + 1e-12 * np.eye(6), rows.T @ ((q - x) * n).sum(1))
        turn = np.eye(4)
        turn[:3, :3] = lie.so3_exp(step[:3])
        turn[:3, 3] = pivot - turn[:3, :3] @ pivot + step[3:]
        t = turn @ t
        if np.abs(step).max() < 1e-6:
            break
    return t


def scale_search(source: np.ndarray, target: np.ndarray, t: np.ndarray, span: float = 0.4, steps: int = 28) -> np.ndarray:
    """Golden-section search for the scale about the overlap's centroid, taken if it is no worse."""
    centre = lie.apply(t, source).mean(0)
    golden = (5**0.5 - 1) / 2

    def at(s: float) -> np.ndarray:
        out = t.copy()
        out[:3, :3] = t[:3, :3] * s
        out[:3, 3] = centre + s * (t[:3, 3] - centre)
        return out

    lo, hi = 1 / (1 + span), 1 + span
    a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
    fa, fb = (symmetric_score(source, target, at(x), 0.8) for x in (a, b))
    for _ in range(steps):
        if fa <= fb:
            hi, b, fb = b, a, fa
            a = hi - golden * (hi - lo)
            fa = symmetric_score(source, target, at(a), 0.8)
        else:
            lo, a, fa = a, b, fb
            b = lo + golden * (hi - lo)
            fb = symmetric_score(source, target, at(b), 0.8)
    new = at((lo + hi) / 2)
    return new if symmetric_score(source, target, new, 0.8) <= symmetric_score(source, target, t, 0.8) else t


def sensitivity(source: np.ndarray, target: np.ndarray, t: np.ndarray, probe: float = 10.0, floor: float = 1.0) -> float:
    """How much the overlap residual of the pose rises if it is turned by `probe` degrees rather than by `floor`, about
    the axis for which it rises least, in root mean square radii of the target; 0 where a turn changes nothing.

    The turn by `floor` takes out what any turn costs on a sampled surface. Turns are about the overlap's centroid.
    """
    if min(len(source), len(target)) < 3:
        return 0.0
    size = max(float(np.sqrt(((target - target.mean(0)) ** 2).sum(1).mean())), 1e-9)
    p = lie.apply(t, source)
    pivot = p[nearest_arrays(target, p)[1]].mean(0)

    def turned(axis: np.ndarray, degrees: float) -> float:
        r = lie.so3_exp(np.radians(degrees) * axis)
        return trimmed_mean(nearest_arrays(target, (p - pivot) @ r.T + pivot)[0], 0.85)

    axes = np.concatenate((np.eye(3), np.array([[1, 1, 0], [1, 0, 1], [0, 1, 1]]) / np.sqrt(2)))
    return max(0.0, min((turned(a, s * probe) - turned(a, s * floor)) / size for a in axes for s in (1, -1)))


def feature_align(source: np.ndarray, target: np.ndarray, transform: str = "se3", sample: int = 600, tolerance: float = 0.02, sweep: bool = True, spark: SparkSession | None = None, correspondences: tuple[np.ndarray, np.ndarray] | None = None, seed: int = 0) -> tuple[np.ndarray, dict]:
    """Pose from descriptor matches (or given ones): hypotheses, polish, and a sweep over rotations if that fits badly.

    The facts say how well it fits, whether the answer is ambiguous, and a confidence between 0 and 1.
    """
    with_scale = transform == "sim3"
    a, b = spread(source, sample), spread(target, sample)
    if correspondences is None:
        m = match_arrays(fpfh_arrays(a), fpfh_arrays(b))
        cs, ct = a[m[:, 0]], b[m[:, 1]]
    else:
        cs, ct = correspondences
    t, inliers, rivals = np.eye(4), 0, 0.0
    t[:3, 3] = target.mean(0) - source.mean(0)
    if len(cs) >= 4:
        got, mask, rivals = ransac(cs, ct, with_scale, tolerance, seed=seed)
        inliers = int(mask.sum())
        if inliers >= 3:
            t = polish(source, target, got, with_scale)
    a, b = spread(source, 1024), spread(target, 1024)
    residual = overlap_residual(a, b, t)
    if sweep and residual > AMBIGUOUS_RESIDUAL:
        others = [global_align(source, target, transform, spark=spark)[0]]
        if overlap_residual(a, b, others[0]) > AMBIGUOUS_RESIDUAL and not with_scale:
            others.append(basin_sweep(source, target, spark))
        for other in others:
            again = overlap_residual(a, b, other)
            if again < residual:
                t, residual, rivals, inliers = other, again, 0.0, overlap_inliers(source, target, other, tolerance)
    spread_of = sensitivity(spread(source, 400), spread(target, 400), t)
    ambiguous = inliers < FEW_INLIERS or residual > AMBIGUOUS_RESIDUAL or spread_of < AMBIGUOUS_SPREAD or rivals > CONTRADICTION
    confidence = max(0.0, 1 - residual / AMBIGUOUS_RESIDUAL) * min(1.0, max(0.0, spread_of) / 0.04) * min(1.0, inliers / 12)
    return t, {"matches": len(cs), "inliers": inliers, "residual": residual, "sensitivity": spread_of, "spread_deg": rivals, "ambiguous": ambiguous, "confidence": min(confidence, 0.3) if ambiguous else confidence}


def seed_gate_score(source: np.ndarray, target: np.ndarray, t: np.ndarray, sample: int = 800) -> float:
    """Share of mutual neighbours within three spacings, times the root of how many pairs of them keep their distance."""
    a, b = lie.apply(t, spread(source, sample)), spread(target, sample)
    d, at = nearest_arrays(a, b)
    _, back = nearest_arrays(b, a)
    near = np.sort(((b[:, None] - b[None]) ** 2).sum(2), axis=1)[:, 1]
    tolerance = 3 * float(np.sqrt(np.median(near)))
    mutual = (back[at] == np.arange(len(a))) & (d < tolerance)
    if mutual.sum() < 3:
        return 0.0
    x, y = a[mutual][:256], b[at[mutual]][:256]
    agree = np.abs(np.linalg.norm(x[:, None] - x[None], axis=2) - np.linalg.norm(y[:, None] - y[None], axis=2)) < 2 * tolerance
    n = len(x)
    return float(mutual.mean() * np.sqrt((agree.sum() - n) / max(1, n * (n - 1))))
