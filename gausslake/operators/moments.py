"""Best similarities of point pairs from aggregated moments, one for all pairs or one for each key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lie


def pair_moments(pairs: DataFrame, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """n, means, the covariances c_ij = E[(t_i - mean)(s_j - mean)] and the source variance of pairs (sx.., tx..).

    One aggregation with map-side sums; `weight` multiplies each pair. Rows with a null end are left out.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    ends = [f"{p}{c}" for p in "st" for c in "xyz"]
    rows = pairs.dropna(subset=ends).withColumn("__w", w)
    total = F.greatest(F.sum("__w"), F.lit(1e-9))
    mean = {e: F.sum(F.col("__w") * F.col(e)) / total for e in ends}
    if weight is None:
        mixed = {(i, j): F.covar_pop(f"t{i}", f"s{j}") for i in "xyz" for j in "xyz"}
        spread = F.var_pop("sx") + F.var_pop("sy") + F.var_pop("sz")
    else:
        mixed = {(i, j): F.sum(F.col("__w") * F.col(f"t{i}") * F.col(f"s{j}")) / total - mean[f"t{i}"] * mean[f"s{j}"] for i in "xyz" for j in "xyz"}
        spread = sum((F.sum(F.col("__w") * F.col(f"s{j}") * F.col(f"s{j}")) / total - mean[f"s{j}"] * mean[f"s{j}"] for j in "yz"), F.sum(F.col("__w") * F.col("sx") * F.col("sx")) / total - mean["sx"] * mean["sx"])
    out = [F.count("*").alias("n"), *[mean[e].alias(e) for e in ends], *[mixed[i, j].alias(f"c{i}{j}") for i in "xyz" for j in "xyz"], spread.alias("variance")]
    return rows.groupBy(*(by or [])).agg(*out)


def fit(pairs: DataFrame, by: list[str] | None = None, with_scale: bool = True, weight: str | None = None) -> DataFrame:
    """`by` columns, n, pose (16 numbers, row by row) and scale of the best similarity of each key's pairs."""
    by = by or []
    m = pair_moments(pairs, by, weight)

    def solve(batches):
        for b in batches:
            col = {f.name: b.column(i) for i, f in enumerate(b.schema)}
            number = {c: col[c].to_numpy(zero_copy_only=False) for c in col if c not in by}
            poses, scales = [], []
            for k in range(b.num_rows):
                if number["n"][k] == 0:
                    poses.append(np.eye(4).ravel().tolist())
                    scales.append(1.0)
                    continue
                covariance = np.array([[number[f"c{i}{j}"][k] for j in "xyz"] for i in "xyz"])
                t = lie.from_moments(*(np.array([number[f"{p}{c}"][k] for c in "xyz"]) for p in "st"), covariance, float(number["variance"][k]), with_scale)
                poses.append(t.ravel().tolist())
                scales.append(lie.scale_of(t))
            yield pa.RecordBatch.from_arrays([*(col[c] for c in by), col["n"], pa.array(poses, pa.list_(pa.float64())), pa.array(scales, pa.float64())], [*by, "n", "pose", "scale"])

    kinds = "".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}, " for c in by)
    return m.mapInArrow(solve, f"{kinds}n long, pose array<double>, scale double")
