"""Spark-native queries over tables of 3-D Gaussians.

The public names are loaded when they are first used, so that Python workers import only what they run.
"""

from importlib import import_module

__version__ = "0.1.0"

_NAMES = {
    "functions.harmonics": "rotate_sh=rotate sh_rotation_matrix=rotation_matrix",
    "model": "from_arrays from_gsplat to_arrays to_gsplat",
    "operators.bundle": "bundle_register pairwise_consistency solve_pose_graph",
    "operators.camera": "coarse_localize_camera",
    "operators.field": "estimate_anchor_normals gaussian_sdf gaussian_sdf_grad",
    "operators.fuse": "auto_knn_radius auto_voxel_size knn_dedupe knn_dedupe_report voxel_dedupe voxel_dedupe_report",
    "operators.metrics": "add_auc add_metric adds_metric",
    "operators.photometric": "CameraPhotometric Photometric SplatPhotometric camera_ring localize_camera refine_photometric",
    "operators.register": "ObjectPoseEstimator Tracker estimate_object_pose make_track_residuals merge register track",
    "operators.rigidity": "mac_feature_align mac_pose",
    "operators.solve": "ICP SDF LevenbergMarquardt Prior RegisterResult Residual run_lm",
    "operators.spatial": "SpatialIndex build_index",
    "operators.transform": "apply_transform union_splats",
    "plans.quality": "QualityConfig resolve_quality",
    "sources.ply": "load_ply load_plys save_ply",
}
_PLACES = {}
for _module, _listed in _NAMES.items():
    for _entry in _listed.split():
        _name, _, _source = _entry.partition("=")
        _PLACES[_name] = (_module, _source or _name)

__all__ = sorted(_PLACES)


def __getattr__(name: str):
    if name not in _PLACES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    module, source = _PLACES[name]
    return getattr(import_module(f"{__name__}.{module}"), source)
