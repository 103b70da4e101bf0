"""De-duplication of splats and the sizes it works with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import finite, linear_scales
from .spatial import CELL, cell, lower_median, median_spacing, reached, with_cells


def spacing_fallback(df: DataFrame) -> float:
    """A size where no spacing is to be had: lower median of the positive finite mean scales, else 1 % of the diagonal."""
    mean = df.select(*linear_scales(df)).select(((F.col("sx") + F.col("sy") + F.col("sz")) / 3).alias("m"))
    m = lower_median(mean.where("m > 0 and not isnan(m) and m < double('infinity')"), "m")
    return float(m) if m else max(0.01 * diagonal(df), 1e-12)


def diagonal(df: DataFrame) -> float:
    """Diagonal of the bounding box."""
    r = finite(df).agg(*[(F.max(c) - F.min(c)).alias(c) for c in ("x", "y", "z")]).first()
    return sum((v or 0.0) ** 2 for v in r) ** 0.5


def _half_spacing(df: DataFrame, alone: float, sample: int | None) -> float:
    if df.limit(2).count() <= 1:
        return alone
    return 0.5 * (median_spacing(df, sample) or spacing_fallback(df))


def auto_voxel_size(df: DataFrame, sample: int | None = 4096) -> float:
    """Half the median spacing of `sample` rows (None: all); 1 for a table of one row or none."""
    return _half_spacing(df, 1.0, sample)


def auto_knn_radius(df: DataFrame, sample: int | None = 4096) -> float:
    """Half the median spacing of `sample` rows (None: all); almost nothing for a table of one row or none."""
    return _half_spacing(df, 1e-12, sample)


def auto_sdf_sigma(df: DataFrame) -> float:
    """Twice the lower median of the mean scales, else 1 % of the diagonal."""
    mean = df.select(*linear_scales(df)).select(((F.col("sx") + F.col("sy") + F.col("sz")) / 3).alias("m"))
    m = lower_median(mean.where("m > 0 and not isnan(m) and m < double('infinity')"), "m")
    return 2 * float(m) if m else max(0.01 * diagonal(df), 1e-12)


def voxel_winners(df: DataFrame, size: float, weight: str = "opacity") -> DataFrame:
    """(cx, cy, cz, gid, n): of each occupied cell the row of the largest weight, then of the smallest gid.

    One partial and one final aggregation on the cell; a crowded cell is reduced before the shuffle.
    """
    key = F.struct(F.col(weight), (-F.col("gid")).alias("o"))
    return with_cells(df, size).groupBy(*CELL).agg(F.max_by("gid", key).alias("gid"), F.count("*").alias("n"))


def voxel_dedupe(df: DataFrame, voxel: float | None = None) -> DataFrame:
    """One row of each occupied voxel, that of the largest opacity, then of the smallest gid.

    The row itself travels through the aggregation as a struct, so no join follows.
    """
    size = auto_voxel_size(df) if voxel is None else voxel
    columns = df.columns
    key = F.struct(F.col("opacity"), (-F.col("gid")).alias("o"))
    best = with_cells(df, size).groupBy(*CELL).agg(F.max_by(F.struct(*columns), key).alias("row"))
    return best.select("row.*")


def voxel_dedupe_report(df: DataFrame, voxel: float | None = None) -> tuple[DataFrame, dict]:
    """`voxel_dedupe` with counts of rows before, after and dropped, and the size used."""
    size = auto_voxel_size(df) if voxel is None else voxel
    kept = voxel_dedupe(df, size)
    before, after = df.count(), kept.count()
    return kept, {"before": before, "after": after, "dropped": before - after, "voxel": size}


def first_per_voxel(df: DataFrame, size: float) -> DataFrame:
    """The smallest gid of each occupied voxel."""
    return with_cells(df, size).groupBy(*CELL).agg(F.min("gid").alias("gid"))


def knn_dedupe(df: DataFrame, radius: float | None = None) -> DataFrame:
    """Rows for which no row of higher opacity (then smaller gid) lies within `radius`, dropped rows counting, too.

    Only the neighbour side is copied to the cells that it reaches; the left side of an anti-join must not be.
    """
    r = auto_knn_radius(df) if radius is None else radius
    left = finite(df).select("*", *cell(2 * r))
    right = reached(df.select("x", "y", "z", "opacity", "gid"), r, 2 * r)
    right = right.withColumnsRenamed({c: f"n_{c}" for c in ("x", "y", "z", "opacity", "gid", *CELL)})
    near = sum(((F.col(c) - F.col(f"n_{c}")) * (F.col(c) - F.col(f"n_{c}")) for c in ("y", "z")), (F.col("x") - F.col("n_x")) * (F.col("x") - F.col("n_x")))
    higher = (F.col("n_opacity") > F.col("opacity")) | ((F.col("n_opacity") == F.col("opacity")) & (F.col("n_gid") < F.col("gid")))
    on = higher & (F.sqrt(near) <= float(r))
    for c in CELL:
        on = on & (F.col(c) == F.col(f"n_{c}"))
    return left.join(right, on, "left_anti").drop(*CELL)


def knn_dedupe_report(df: DataFrame, radius: float | None = None) -> tuple[DataFrame, dict]:
    """`knn_dedupe` with counts of rows before, after and dropped, and the radius used."""
    r = auto_knn_radius(df) if radius is None else radius
    kept = knn_dedupe(df, r)
    before, after = df.count(), kept.count()
    return kept, {"before": before, "after": after, "dropped": before - after, "radius": r}
