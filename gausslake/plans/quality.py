"""How much work a registration puts in."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class QualityConfig:
    """Points a side (None: all), support of the field, iterations. Chunk sizes are accepted and left to the engine."""

    n_points: int | None = None
    knn: int = 50
    max_iters: int = 20
    refine_iters: int = 10
    label: str = "full"
    jac_row_chunk: int | None = None
    sdf_chunk_size: int | None = None


#: The presets.
PRESETS = {"full": QualityConfig(), "balanced": QualityConfig(4096, 50, 20, 8, "balanced"), "low": QualityConfig(1024, 24, 20, 5, "low")}
MOST = 16_384


def resolve_quality(quality="full", memory: int | None = None, anchors: int | None = None) -> QualityConfig:
    """A preset by name, a share of the work between 0 and 1, "auto" (by `memory` bytes and target rows), or a config."""
    if isinstance(quality, QualityConfig):
        return quality
    if quality == "auto":
        if not memory or not anchors:
            return replace(PRESETS["balanced"], label="auto")
        return replace(PRESETS["full"], n_points=max(128, min(MOST, memory // (32 * anchors))), label="auto")
    if isinstance(quality, str):
        if quality in PRESETS:
            return PRESETS[quality]
        raise ValueError(f"quality must be one of {', '.join(PRESETS)}, auto, or a number, not {quality!r}")
    s = float(quality)
    if not 0 < s <= 1:
        raise ValueError(f"quality as a number must be above 0 and at most 1, not {quality}")
    if s == 1:
        return PRESETS["full"]
    return QualityConfig(max(128, round(MOST * s)), round(50 * s + 24 * (1 - s)), 20, max(3, round(10 * s + 5 * (1 - s))), f"{s:g}")
