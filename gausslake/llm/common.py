"""Pieces the training-data operators share: table access, checkpoints, Arrow streaming by key, components."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` computed once and written to the folder of spark.checkpoint.dir, which all executors share.

    Only a session on one machine that names no folder gets a temporary one; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gausslake-"))
    return df.checkpoint(eager=True)


#: Rows that Spark hands to a Python worker at once; texts are long, so this is less than Spark's own default.
ARROW_ROWS = 1000


def lean(df: DataFrame) -> DataFrame:
    """`df`, in a session that hands at most ARROW_ROWS rows to a Python worker at once, which bounds its memory."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(name)) > ARROW_ROWS or int(conf.get(name)) <= 0:
        conf.set(name, str(ARROW_ROWS))
    return df


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """One column of an Arrow batch by name."""
    return batch.column(batch.schema.get_field_index(name))


def longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A non-null integer column of an Arrow batch as int64."""
    return column(batch, name).cast(pa.int64()).to_numpy(zero_copy_only=False)


def release() -> None:
    """Gives memory that a worker no longer uses back to the machine: workers live on between stages, and both Arrow and
    the C library keep what was freed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only some C libraries have it
        pass


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, so that what a worker holds besides its input stays small; what is no
    longer used is released after the last."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


def portions(batches: Iterator[pa.RecordBatch], name: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose column `name` (binary) holds about `most` bytes, or one row that holds more."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(column(batch, name)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of rows with equal integer `keys` from a stream sorted by them; holds one group and one batch."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [longs(batch, k) for k in keys]
        cuts = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            cuts[1:] |= c[1:] != c[:-1]
        if rest:
            last = rest[-1]
            cuts[0] = any(longs(last, k)[-1] != c[0] for k, c in zip(keys, cols, strict=True))
        bounds = np.flatnonzero(cuts).tolist()
        if not bounds:
            rest.append(batch)
            continue
        if bounds[0]:
            rest.append(batch.slice(0, bounds[0]))
        if rest:
            yield pa.Table.from_batches(rest)
        for lo, hi in zip(bounds, bounds[1:]):
            yield pa.Table.from_batches([batch.slice(lo, hi - lo)])
        rest = [batch.slice(bounds[-1])]
    if rest:
        yield pa.Table.from_batches(rest)
    release()


def keyed(df: DataFrame, keys: list[str], order: list[str], work: Callable, schema: str) -> DataFrame:
    """`work` over an Arrow stream in which the rows of a key stand together, sorted by key and `order`."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(work, schema)


def apart(name: str):
    """A long column as it is, in a form that a plan does not recognise as the column its table is dealt by.

    An aggregate that is joined back to its own rows by its key would share their exchange, and then adaptive execution
    cannot split a key that holds many of the rows. With an exchange of its own it can; the aggregate is the small side.
    """
    return F.col(name).bitwiseXOR(F.lit(0).cast("long"))


def among(rows: DataFrame, wanted: DataFrame, key: str, few: int) -> DataFrame:
    """`rows` of which others than those of `wanted` keys may be missing: up to `few` keys (counted) are sent to all
    tasks, which spares the other rows the shuffle of the join that follows; with more keys all rows come."""
    keys = wanted.select(key).distinct()
    return rows.join(F.broadcast(keys), key, "left_semi") if keys.limit(few + 1).count() <= few else rows


def merge_labels(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Component labels (the smallest index of each) after joining u[i] with v[i]; vectorised hooking and jumping."""
    a, b = labels[u], labels[v]
    while True:
        differ = a != b
        if not differ.any():
            return labels
        a, b = a[differ], b[differ]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
        a, b = labels[a], labels[b]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table of longs: (node, component), component being its smallest node.

    Alternates large-star and small-star rounds, each a pair of aggregations and joins on narrow rows, until the
    edge set is a star forest. Nothing but two counters a round reaches the driver. Nodes without an edge (or only
    with one to themselves) are absent; null ends are ignored; an empty table gives an empty result.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = checkpointed(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        count = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if count[0] == 0 or tuple(count) == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v")).distinct()
        before = tuple(count)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a hub's edges can be split: see `apart`
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(apart("u").alias("k"), "m")
        e = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        joined = e.join(least.select(apart("u").alias("k"), "m"), F.col("u") == F.col("k"))
        e = checkpointed(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def map_text(df: DataFrame, text: str, keep: list[str], work: Callable[[list], list[pa.Array]], fields: list[tuple[str, str]], rows: int = 256) -> DataFrame:
    """`keep` columns of `df` followed by `fields`, which `work` makes from lists of at most `rows` texts (null: empty).

    The text goes back to Spark only if it is among `keep`. A name that is both in `keep` and a field raises ValueError.
    """
    if clash := sorted(set(keep) & {f for f, _ in fields}):
        raise ValueError(f"columns {', '.join(clash)} of the table have the names of results; leave them out or rename them")
    inside = text in keep
    lean(df)
    source = df.select(*keep) if inside else df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    at = keep.index(text) if inside else len(keep)
    names = [*keep, *(f for f, _ in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, rows):
            made = work([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema), *(f"`{n}` {t}" for n, t in fields)])
    return source.mapInArrow(run, schema)
