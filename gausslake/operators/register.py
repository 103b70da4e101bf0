"""Registration, merging, tracking and object pose."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..functions import lie
from ..plans.quality import QualityConfig, resolve_quality
from . import align, fuse, rigidity
from .solve import ICP, SDF, Cloud, LevenbergMarquardt, RegisterResult, run_lm
from .transform import apply_transform, union_splats

#: Above this number of rows on a side, iterations run on tables instead of arrays; both minimise the same. Seeds are
#: searched for on samples of at most so many rows, of which each search takes its own documented number.
LOCAL = 50_000
SHORT = ("features", "robust", "learned", "bufferx", "mac")


def _sample(df: DataFrame, n: int | None) -> Cloud:
    from ..model import stride_sample

    return Cloud.of(stride_sample(df, min(n or LOCAL, LOCAL)))


def _sides(target: DataFrame, source: DataFrame, target_sample: Cloud, source_sample: Cloud, n: int | None) -> tuple:
    """What the iterations run on: the arrays if they hold all rows that take part, else tables of these rows."""
    from ..model import stride_sample

    if max(n or source.count(), n or target.count()) <= LOCAL:
        return target_sample, source_sample
    return (target, source) if n is None else (stride_sample(target, n), stride_sample(source, n))


def _seed(init, source: Cloud, target: Cloud, transform: str, spark, correspondences) -> tuple[np.ndarray, dict]:
    a, b = source.means, target.means
    if init is None or init == "fast":
        return align.feature_align(a, b, transform, spark=spark)
    if isinstance(init, np.ndarray):
        return np.array(init, float), {"init": "given"}
    if init == "identity":
        return np.eye(4), {}
    if init == "centroid":
        t = np.eye(4)
        t[:3, 3] = b.mean(0) - a.mean(0)
        return t, {}
    if init == "global":
        return align.global_align(a, b, transform, spark=spark)
    if init == "features":
        return align.feature_align(a, b, transform, spark=spark)
    if init in ("learned", "bufferx") and correspondences is None:
        # no pretrained matcher comes with this engine: matches are given, or the robust path answers
        init = "robust"
    if init == "mac":
        return rigidity.mac_feature_align(a, b, transform, correspondences=correspondences, spark=spark)
    if init in ("robust", "learned", "bufferx"):
        # matches of clouds of any unit are held to their own spacing
        step = max(align.cloud_voxel(a), align.cloud_voxel(b))
        t, facts = align.feature_align(a, b, transform, tolerance=max(0.02, 1.5 * step), spark=spark, correspondences=correspondences)
        if transform == "sim3" and init == "robust":
            t = align.scale_search(align.spread(a, 800), align.spread(b, 800), t)
        return t, facts
    raise ValueError(f"unknown init {init!r}")


def register(target: DataFrame, source: DataFrame, *, residuals=None, init=None, transform: str = "se3", backend: str = "builtin", max_iters: int | None = None, quality="full", refine: str | None = None, refine_kwargs: dict | None = None, seed_gate: bool = False, correspondences=None) -> RegisterResult:
    """The pose that takes `source` to `target`.

    A seed by `init` is followed by iterations over `residuals` (by default nearest points and the target's field);
    feature seeds without own residuals are the answer already. Tables of more than 50 000 rows iterate as tables, with
    the same residuals, samples and kernels. `quality` sets how many points take part (full: all).
    """
    if transform not in ("se3", "sim3"):
        raise ValueError(f"transform must be se3 or sim3, not {transform!r}")
    if backend != "builtin":
        raise NotImplementedError(f"backend {backend!r} is not part of this engine; use builtin")
    if refine not in (None, "photometric"):
        raise ValueError(f"refine must be None or photometric, not {refine!r}")
    q: QualityConfig = resolve_quality(quality)
    spark = target.sparkSession
    a, b = _sample(source, q.n_points), _sample(target, q.n_points)
    if min(len(a.means), len(b.means)) < 3:
        return RegisterResult(np.eye(4), 1.0, False, {"reason": "fewer than 3 points"})
    t0, facts = _seed(init, a, b, transform, spark, correspondences)
    if seed_gate:
        score = align.seed_gate_score(a.means, b.means, t0)
        facts["seed_gate"] = score
        if score < 0.10:
            other, more = align.global_align(a.means, b.means, transform, spark=spark)
            again = align.seed_gate_score(a.means, b.means, other)
            if again > score:
                t0, facts = other, facts | more | {"seed_gate": again, "reseeded": True}
    if isinstance(init, str) and init in SHORT and residuals is None:
        result = RegisterResult(t0, lie.scale_of(t0), True, facts)
    else:
        if residuals is None:
            sigma = fuse.auto_sdf_sigma(target)
            residuals = [ICP(weight=1.0), SDF(sigma, weight=0.3, knn=q.knn)]
        result = run_lm(t0, residuals, *_sides(target, source, b, a, q.n_points), transform, n_iters=max_iters if max_iters is not None else q.max_iters)
        result.info = facts | result.info
    if refine == "photometric":
        from .photometric import refine_photometric

        result = refine_photometric(target, source, result, transform=transform, iterations=q.refine_iters, **(refine_kwargs or {}))
    return result


def merge(splats: list[DataFrame], ref: int = 0, transform: str = "sim3", init="global", dedupe: bool = True, dedupe_method: str = "voxel", voxel: float | None = None, knn_radius: float | None = None, max_iters: int | None = None, quality="full", poses: list[np.ndarray] | None = None) -> tuple[DataFrame, dict]:
    """All splats in the frame of `splats[ref]`, registered (unless `poses` are given), united and de-duplicated.

    Sizes come from the reference splat. Everything after the poses is one lazy plan.
    """
    if not splats:
        raise ValueError("merge needs at least one splat")
    if dedupe_method not in ("voxel", "knn"):
        raise ValueError(f"dedupe_method must be voxel or knn, not {dedupe_method!r}")
    results, moved = [], []
    for i, s in enumerate(splats):
        if i == ref:
            moved.append(s)
            results.append(None)
            continue
        r = RegisterResult(poses[i], lie.scale_of(poses[i])) if poses is not None else register(splats[ref], s, init=init, transform=transform, max_iters=max_iters, quality=quality)
        results.append(r)
        moved.append(apply_transform(s, r.T))
    order = [ref, *(i for i in range(len(splats)) if i != ref)]
    united = union_splats([moved[i] for i in order])
    report: dict = {"results": results}
    if not dedupe:
        return united, report
    if dedupe_method == "voxel":
        size = voxel if voxel is not None else fuse.auto_voxel_size(splats[ref])
        return fuse.voxel_dedupe(united, size), report | {"voxel": size}
    radius = knn_radius if knn_radius is not None else fuse.auto_knn_radius(splats[ref])
    return fuse.knn_dedupe(united, radius), report | {"radius": radius}


#: Iterations and step clamps of a tracked frame.
TRACK_ITERATIONS, TRACK_TRANSLATION, TRACK_ROTATION = 4, 0.05, 0.3


def make_track_residuals(sigma: float, samples: int = 300, knn: int = 16, truncate: float = 3.0) -> list:
    """What a tracked frame is held against: the target's field at few points."""
    return [SDF(sigma, weight=1.0, samples=samples, knn=knn, truncate=truncate)]


def track_arrays(target: Cloud, source: Cloud, prior: np.ndarray, sigma: float, transform: str = "se3", iterations: int = TRACK_ITERATIONS) -> RegisterResult:
    """One warm-started frame on arrays; runs inside a task."""
    return run_lm(prior, make_track_residuals(sigma), target, source, transform, LevenbergMarquardt(), iterations, TRACK_TRANSLATION, TRACK_ROTATION, 0.0)


def track(target: DataFrame, source: DataFrame, prior: np.ndarray, transform: str = "se3", iterations: int = TRACK_ITERATIONS, sigma: float | None = None) -> RegisterResult:
    """The pose of a frame from the pose of the one before."""
    sigma = sigma or fuse.auto_sdf_sigma(target)
    if max(source.count(), target.count()) <= LOCAL:
        return track_arrays(Cloud.of(target), Cloud.of(source), prior, sigma, transform, iterations)
    return run_lm(prior, make_track_residuals(sigma), target, source, transform, LevenbergMarquardt(), iterations, TRACK_TRANSLATION, TRACK_ROTATION, 0.0)


class Tracker:
    """Poses of a source over frames, each from the one before; the first from `init`."""

    def __init__(self, source: DataFrame, init="identity", transform: str = "se3"):
        self.source, self.init, self.transform = source, init, transform
        self.pose: np.ndarray | None = None

    def reset(self, pose: np.ndarray | None = None) -> None:
        """Forget the pose, or set it."""
        self.pose = pose

    def track(self, frame: DataFrame) -> RegisterResult:
        """The pose in a frame."""
        if self.pose is None and not isinstance(self.init, str):
            self.pose = np.array(self.init, float)
        if self.pose is None and self.init == "identity":
            self.pose = np.eye(4)
        result = register(frame, self.source, init=self.init, transform=self.transform) if self.pose is None else track(frame, self.source, self.pose, self.transform)
        self.pose = result.T
        return result


def estimate_object_pose(model: DataFrame, observed: DataFrame, *, init=None, transform: str = "se3", **more) -> RegisterResult:
    """The pose of a model in an observation."""
    return register(observed, model, init=init, transform=transform, **more)


class ObjectPoseEstimator:
    """Poses of a model over observations: the first from scratch, later ones warm."""

    def __init__(self, model: DataFrame, init=None, transform: str = "se3"):
        self.model, self.init, self.transform = model, init, transform
        self.sigma = fuse.auto_sdf_sigma(model)
        self.pose: np.ndarray | None = None

    def reset(self) -> None:
        """Forget the pose."""
        self.pose = None

    def estimate(self, observed: DataFrame) -> RegisterResult:
        """The pose in an observation."""
        result = estimate_object_pose(self.model, observed, init=self.init, transform=self.transform) if self.pose is None else track(observed, self.model, self.pose, self.transform, sigma=self.sigma)
        self.pose = result.T
        return result
