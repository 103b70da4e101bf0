"""The splat table: one row per anisotropic 3-D Gaussian, and its ways in and out of arrays.

Row identity is explicit: `gid` breaks ties and orders samples. Scales are linear unless `log_scales`. Quaternions are
(w, x, y, z). `colors` is null, one RGB triple (`is_rgb`), or K triples of spherical-harmonic coefficients.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("splat_id", T.StringType()), T.StructField("gid", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("x", "y", "z", "qw", "qx", "qy", "qz", "sx", "sy", "sz", "opacity")]
    + [T.StructField("colors", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("is_rgb", T.BooleanType()), T.StructField("log_scales", T.BooleanType())]
)
DEFAULTS = {"splat_id": "", "qw": 1.0, "qx": 0.0, "qy": 0.0, "qz": 0.0, "sx": 1.0, "sy": 1.0, "sz": 1.0, "opacity": 1.0, "colors": None, "is_rgb": None, "log_scales": False}
POSITION, ROTATION, SCALE = ("x", "y", "z"), ("qw", "qx", "qy", "qz"), ("sx", "sy", "sz")


def conform(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` as a splat table: `columns` override, missing ones get defaults, all get their types."""
    out = []
    for f in SCHEMA:
        if f.name in columns:
            c = columns[f.name]
        elif f.name in df.columns:
            c = F.col(f.name)
        elif f.name in DEFAULTS:
            c = F.lit(DEFAULTS[f.name])
        else:
            raise ValueError(f"a splat table needs the column {f.name}")
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def finite(df: DataFrame) -> DataFrame:
    """Rows whose position is finite (floor of a NaN would silently be cell 0)."""
    good = F.lit(True)
    for c in POSITION:
        good = good & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return df.where(good)


def linear_scales(df: DataFrame) -> list[Column]:
    """The three scales as linear values."""
    return [F.when(F.col("log_scales"), F.exp(c)).otherwise(F.col(c)).alias(c) for c in SCALE]


def with_scale_convention(df: DataFrame, log: bool) -> DataFrame:
    """`df` with all scales logarithmic or all linear; values below 1e-20 are clamped before the logarithm."""
    new = {}
    for c in SCALE:
        v = F.col(c)
        new[c] = F.when(F.col("log_scales"), v).otherwise(F.log(F.greatest(v, F.lit(1e-20)))) if log else F.when(F.col("log_scales"), F.exp(v)).otherwise(v)
    return df.withColumns(new | {"log_scales": F.lit(log)})


def opacity_weight(logit: bool) -> Column:
    """Opacity between 0 and 1: files hold logits, tables in memory may hold the value."""
    return 1 / (1 + F.exp(-F.col("opacity"))) if logit else F.col("opacity")


def from_arrays(spark: SparkSession, means, quats=None, scales=None, opacities=None, colors=None, log_scales: bool = False, splat_id: str = "", gid_from: int = 0) -> DataFrame:
    """A splat table from arrays; raises ValueError where shapes don't fit."""
    means = np.asarray(means, float)
    if means.ndim != 2 or means.shape[1] != 3:
        raise ValueError(f"means must be (N, 3), not {means.shape}")
    n = len(means)

    def rows(name, value, width, default):
        value = np.tile(np.asarray(default, float), (n, 1)) if value is None else np.asarray(value, float)
        if value.shape != (n, width):
            raise ValueError(f"{name} must be ({n}, {width}), not {value.shape}")
        return value

    quats, scales = rows("quats", quats, 4, (1, 0, 0, 0)), rows("scales", scales, 3, (1, 1, 1))
    opacities = np.ones(n) if opacities is None else np.asarray(opacities, float).reshape(-1)
    if len(opacities) != n:
        raise ValueError(f"opacities must have {n} values, not {len(opacities)}")
    data = {"splat_id": splat_id, "gid": np.arange(gid_from, gid_from + n)}
    data |= dict(zip(POSITION, means.T)) | dict(zip(ROTATION, quats.T)) | dict(zip(SCALE, scales.T)) | {"opacity": opacities}
    is_rgb = None
    if colors is not None:
        colors = np.asarray(colors, float)
        is_rgb = colors.ndim == 2
        colors = colors[:, None, :] if is_rgb else colors
        if colors.ndim != 3 or colors.shape[0] != n or colors.shape[2] != 3:
            raise ValueError(f"colors must be ({n}, 3) or ({n}, K, 3), not {colors.shape}")
        data["colors"] = [c.tolist() for c in colors]
    else:
        data["colors"] = [None] * n
    frame = pd.DataFrame(data | {"is_rgb": [is_rgb] * n, "log_scales": [log_scales] * n}, columns=SCHEMA.names)
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None) if n == 0 else frame, SCHEMA)


def to_arrays(df: DataFrame) -> dict[str, np.ndarray | bool | None]:
    """means, quats, scales, opacities, colors, log_scales of a table that fits the driver, ordered by gid."""
    t = df.orderBy("gid").toPandas()
    log = bool(t["log_scales"].iloc[0]) if len(t) else False
    colors = None
    if len(t) and t["colors"].notna().all():
        colors = np.array([np.array([np.asarray(k, float) for k in c]) for c in t["colors"]])
        if bool(t["is_rgb"].iloc[0]):
            colors = colors[:, 0]
    return {"means": t[list(POSITION)].to_numpy(float), "quats": t[list(ROTATION)].to_numpy(float), "scales": t[list(SCALE)].to_numpy(float), "opacities": t["opacity"].to_numpy(float), "colors": colors, "log_scales": log}


def from_gsplat(spark: SparkSession, means, quats, scales, opacities, colors=None, log_scales: bool = False, **more) -> DataFrame:
    """A splat table from the array bundle that renderers use."""
    return from_arrays(spark, means, quats, scales, opacities, colors, log_scales, **more)


def to_gsplat(df: DataFrame) -> dict[str, np.ndarray | None]:
    """The array bundle that renderers use, with linear scales."""
    out = to_arrays(with_scale_convention(df, log=False))
    out.pop("log_scales")
    return out


def points(df: DataFrame, most: int | None = None) -> np.ndarray:
    """Positions in gid order, of `most` evenly spread rows at most."""
    rows = stride_sample(df, most) if most else df
    return rows.select("gid", *POSITION).orderBy("gid").toPandas()[list(POSITION)].to_numpy(float)


def even_rows(n: int, most: int) -> np.ndarray:
    """`most` row numbers from 0 to n - 1: the half-even roundings of evenly spaced numbers, all rows if they are fewer."""
    if n <= most:
        return np.arange(n)
    return np.unique(np.round(np.arange(most) * (n - 1) / max(most - 1, 1)).astype(int))


def stride_sample(df: DataFrame, most: int) -> DataFrame:
    """`most` rows at most, those whose rank by gid is the (half-even) rounding of evenly spaced numbers.

    Assumes gids 0 to n - 1, as row identity has it; other ids are ranked first.
    """
    return rows_by_rank(df, lambda n: None if n <= most else even_rows(n, most))


def drawn_sample(df: DataFrame, most: int, seed: int) -> DataFrame:
    """`most` rows at most, those whose rank by gid a seeded generator draws without repetition."""
    return rows_by_rank(df, lambda n: None if n <= most else drawn_rows(n, most, seed))


def drawn_rows(n: int, most: int, seed: int) -> np.ndarray:
    """`most` of n row numbers, drawn with a seed, in order."""
    return np.sort(np.random.default_rng(seed).choice(n, most, replace=False))


def strided_rows(n: int, most: int, seed: int = 0) -> np.ndarray:
    """`most` of n row numbers: every step-th from an offset that the seed gives; the last rows fill up what is missing."""
    if n <= most:
        return np.arange(n)
    step = max(1, n // most)
    out = np.arange(seed % step, n, step)[:most]
    return np.union1d(out, np.arange(n - (most - len(out)), n))[:most] if len(out) < most else out


def strided_sample(df: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """The rows whose ranks by gid `strided_rows` gives."""
    return rows_by_rank(df, lambda n: None if n <= most else strided_rows(n, most, seed))


def rows_by_rank(df: DataFrame, choose) -> DataFrame:
    """The rows whose ranks by gid `choose` gives for the number of rows (None: all); a bounded list of them."""
    n, lo, hi = df.agg(F.count("*"), F.min("gid"), F.max("gid")).first()
    chosen = choose(n)
    if chosen is None:
        return df
    if (lo, hi) != (0, n - 1):
        df = ranked(df)
        key = "__rank"
    else:
        key = "gid"
    wanted = chosen.tolist()
    picks = df.sparkSession.createDataFrame([(i,) for i in wanted], f"{key} long")
    return df.join(F.broadcast(picks), key, "left_semi").drop("__rank")


def ranked(df: DataFrame) -> DataFrame:
    """`df` with `__rank`, the rank by gid from 0, without one task for all rows.

    The ids are dealt out by range and settled, since a second dealing could cut elsewhere; a rank is the number of
    ids in the parts before and the place in the own part.
    """
    from pyspark.sql import Window as W

    from .operators.spatial import settled

    dealt = settled(df.select("gid").repartitionByRange("gid").withColumn("__part", F.spark_partition_id()))
    sizes = sorted(tuple(r) for r in dealt.groupBy("__part").count().collect())
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    starts = df.sparkSession.createDataFrame(before, "__part int, __before long")
    inside = F.row_number().over(W.partitionBy("__part").orderBy("gid")) - 1
    ranks = dealt.withColumn("__rank", inside).join(F.broadcast(starts), "__part").select("gid", (F.col("__rank") + F.col("__before")).cast("long").alias("__rank"))
    return df.join(ranks, "gid")


def step_sample(df: DataFrame, most: int, n: int | None = None) -> DataFrame:
    """Every step-th row by gid, `most` at most, step being n // min(n, most)."""
    n = df.count() if n is None else n
    take = min(n, most)
    step = max(1, n // max(take, 1))
    return df.where((F.col("gid") % step == 0) & (F.floor(F.col("gid") / step) < take))
