"""Poses of objects over a stream of frames: one pose a key is the state, replaced after each frame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.register import track_arrays
from ..operators.solve import Cloud

OUTPUT = "obj_id string, frame_id long, ts timestamp, pose array<double>, rmse double"
STATE = "pose array<double>, last_ts timestamp"


def frames(points: DataFrame) -> DataFrame:
    """One row a frame from rows of (obj_id, frame_id, ts, x, y, z): the points as arrays, in order of arrival keys."""
    return points.groupBy("obj_id", "frame_id", "ts").agg(F.collect_list(F.struct("x", "y", "z")).alias("points"))


def track_stream(frame_rows: DataFrame, source: Cloud, sigma: float, start: np.ndarray | None = None, transform: str = "se3", watermark: str | None = None, forget_after: float | None = None) -> DataFrame:
    """Poses of `source` in frames (obj_id, frame_id, ts, points array<struct<x,y,z>>[, reset]) of a stream.

    Each key keeps its last pose; frames of one batch are taken by (ts, frame_id); a frame not later than the last is
    dropped; `reset` true starts anew. The source is of bounded size and goes to the tasks with the function.

    With a `watermark` (as "10 minutes") frames later than it are dropped before the state is looked up; a key of which
    no frame came for `forget_after` seconds of event time beyond it is forgotten, so the state does not grow for ever.
    """
    if forget_after is not None and watermark is None:
        raise ValueError("forget_after needs a watermark")
    if watermark is not None:
        frame_rows = frame_rows.withWatermark("ts", watermark)
    first = np.eye(4) if start is None else np.array(start, float)
    has_reset = "reset" in frame_rows.columns

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pose, last = first, None
        if state.exists:
            flat, last = state.get
            pose = np.array(flat, float).reshape(4, 4)
        rows = pd.concat(list(batches)).sort_values(["ts", "frame_id"])
        out = []
        for r in rows.itertuples():
            if last is not None and r.ts <= last:
                continue
            if has_reset and r.reset:
                pose = first
            p = np.array([(q["x"], q["y"], q["z"]) for q in r.points], float)
            result = track_arrays(with_normals(p), source, pose, sigma, transform)
            pose, last = result.T, r.ts
            out.append((key[0], r.frame_id, r.ts, pose.ravel().tolist(), result.info["rmse"]))
        if last is not None:
            state.update((pose.ravel().tolist(), last))
            if forget_after is not None:
                latest = max(int(pd.Timestamp(last, tz="UTC" if pd.Timestamp(last).tzinfo is None else None).timestamp() * 1000), state.getCurrentWatermarkMs())
                state.setTimeoutTimestamp(latest + int(forget_after * 1000) + 1)
        yield pd.DataFrame(out, columns=["obj_id", "frame_id", "ts", "pose", "rmse"])

    return frame_rows.groupBy("obj_id").applyInPandasWithState(step, OUTPUT, STATE, "append", "NoTimeout" if forget_after is None else "EventTimeTimeout")


def with_normals(p: np.ndarray, k: int = 12) -> Cloud:
    """Points of a frame with normals from their neighbours."""
    from ..operators.features import neighbours, normals

    if len(p) < 4:
        return Cloud(p, np.tile([0.0, 0.0, 1.0], (len(p), 1)))
    return Cloud(p, normals(p, neighbours(p, min(k, len(p) - 1))))


def replay(events: DataFrame, key: str, order: list[str], decay: float = 0.5) -> DataFrame:
    """The running state s = decay * s + (1 - decay) * value of each key over ordered events, as a batch query.

    The last state is the sum of the values, each weighed by (1 - decay) * decay**k with k later events of its key. How
    many are later is counted from settled ranges of the order, so one key's events need not meet in a task.
    """
    from pyspark.sql import Window as W

    from ..operators.spatial import settled

    rows = events.select(key, *order, "value").repartitionByRange(key, *order).withColumn("__part", F.spark_partition_id())
    rows = settled(rows)
    sizes = rows.groupBy(key, "__part").agg(F.count("*").alias("__n"))
    later = F.sum("__n").over(W.partitionBy(key).orderBy("__part").rowsBetween(1, W.unboundedFollowing))
    sizes = sizes.select(key, "__part", F.coalesce(later, F.lit(0)).alias("__later"))
    inside = F.row_number().over(W.partitionBy("__part", key).orderBy(*[F.desc(c) for c in order])) - 1
    weighed = rows.withColumn("__k", inside).join(sizes, [key, "__part"])
    return weighed.groupBy(key).agg(F.sum(F.col("value") * (1 - decay) * F.pow(F.lit(decay), F.col("__k") + F.col("__later"))).alias("state"), F.count("*").alias("n"))
