"""Poses applied to splats, and unions of splats."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions import harmonics, lie
from ..model import SCALE, with_scale_convention


def apply_transform(df: DataFrame, t: np.ndarray, scale: float = 1.0, rotate_colors: bool = True) -> DataFrame:
    """A splat moved by `t` (times `scale`): places, quaternions, scales in either convention, colour coefficients."""
    t = np.array(t, float)
    t[:3, :3] *= scale
    s = lie.scale_of(t)
    r = t[:3, :3] / s
    new = dict(zip(("x", "y", "z"), E.moved(t), strict=True)) | dict(zip(("qw", "qx", "qy", "qz"), E.turned(r), strict=True)) | scaled(s)
    out = df.withColumns(new)
    if rotate_colors and not np.allclose(r, np.eye(3), atol=1e-15):
        sizes = sorted(k for k in out.agg(F.collect_set(F.size("colors"))).first()[0] if k > 1)
        return harmonics.rotate_column(out, r, sizes) if sizes else out
    return out


def bake(df: DataFrame, t: np.ndarray) -> DataFrame:
    """A splat whose places and scales are moved by `t`; quaternions, opacities and colours stay: a known truth for
    what reads only geometry."""
    t = np.array(t, float)
    return df.withColumns(dict(zip(("x", "y", "z"), E.moved(t), strict=True)) | scaled(lie.scale_of(t)))


def scaled(s: float) -> dict:
    """The three scales times s, in either convention."""
    return {c: F.when(F.col("log_scales"), F.col(c) + float(np.log(s))).otherwise(F.col(c) * float(s)) for c in SCALE}


def union_splats(splats: list[DataFrame], renumber: bool = True) -> DataFrame:
    """All rows in the scale convention of the first table. Colours stay only if every row has them; RGB rows become
    first coefficients where others hold harmonics. New gids follow the order of the tables."""
    log = bool((splats[0].select("log_scales").first() or [False])[0])
    parts, at = [], 0
    for i, s in enumerate(splats):
        part = with_scale_convention(s, log)
        if renumber:
            part = part.withColumn("gid", F.col("gid") + at)
            if i < len(splats) - 1:
                at += (s.agg(F.max("gid")).first()[0] or -1) + 1
        parts.append(part)
    every = reduce(DataFrame.unionByName, parts)
    facts = every.agg(F.bool_or(F.col("colors").isNull()), F.bool_and(F.coalesce("is_rgb", F.lit(False)))).first()
    kind = every.schema["colors"].dataType
    if facts[0] or facts[0] is None:
        return every.withColumns({"colors": F.lit(None).cast(kind), "is_rgb": F.lit(None).cast("boolean")})
    if facts[1]:
        return every
    first = F.transform("colors", lambda c: F.transform(c, E.rgb_to_dc))
    return every.withColumns({"colors": F.when(F.col("is_rgb"), first).otherwise(F.col("colors")), "is_rgb": F.lit(False)})


def info(df: DataFrame) -> DataFrame:
    """One row of facts: count, box, harmonic degree, opacities, scales."""
    linear = [F.when(F.col("log_scales"), F.exp(c)).otherwise(F.col(c)) for c in SCALE]
    mean = sum(linear[1:], linear[0]) / 3
    facts = [F.count("*").alias("n")]
    for c in ("x", "y", "z"):
        facts += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), (F.max(c) - F.min(c)).alias(f"extent_{c}")]
    facts += [
        (F.sqrt(F.max(F.size("colors").cast("double"))) - 1).cast("int").alias("sh_degree"),
        F.min("opacity").alias("min_opacity"),
        F.max("opacity").alias("max_opacity"),
        F.avg(1 / (1 + F.exp(-F.col("opacity")))).alias("mean_alpha"),
        F.max(F.greatest(*linear)).alias("max_scale"),
    ]
    return df.withColumn("__m", mean).agg(*facts, F.expr("percentile_disc(0.5) within group (order by __m)").alias("median_scale"))
