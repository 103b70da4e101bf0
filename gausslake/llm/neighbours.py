"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors are rotated by a fixed random orthogonal matrix, dealt to lists around centroids and packed into blocks that
hold a few dimensions of all their vectors side by side. Inside each probed list a query first sees the leading
dimensions of a whole block; a hypothesis test on the partial distance abandons vectors that are too far with high
probability, and only survivors see further dimensions. What is left is measured exactly on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, keyed, sorted_groups


@dataclass(frozen=True)
class Settings:
    """`lists` at most; centroids fitted on `sample` rows at most; lists probed for a recall of `target`, `least` of them.

    The number of probed lists is measured while fitting: `trials` rows of the sample are searched for exactly among
    the sample, and so many lists are probed as hold the share `target` of what was found. In the whole table, which
    is denser, neighbours lie nearer, so its recall is no lower.

    `step` dimensions a scan step; `epsilon` of the test; `block` vectors and `pack` queries to one unit of work.
    """

    lists: int = 4096
    sample: int = 65_536
    target: float = 0.97
    trials: int = 256
    least: int = 8
    step: int = 16
    epsilon: float = 2.1
    block: int = 4096
    pack: int = 512
    rounds: int = 8
    seed: int = 42


def usable(vec: str):
    """Whether a vector takes part: not null, not empty, no null or non-finite component, not zero."""
    c = F.col(vec)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same for the same seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def _centroids(points: np.ndarray, n: int, rounds: int, seed: int) -> np.ndarray:
    centres = points[np.sort(np.random.default_rng(seed).choice(len(points), n, replace=False))].copy()
    for _ in range(rounds):
        own = np.concatenate([_squared(points[k : k + 4096], centres).argmin(1) for k in range(0, len(points), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        sizes = np.bincount(own, minlength=n)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def _probes(points: np.ndarray, centres: np.ndarray, k: int, s: Settings) -> int:
    """Lists that hold the share `target` of the `k` nearest of some sample rows, lists taken by nearness of centroid."""
    own = np.concatenate([_squared(points[i : i + 4096], centres).argmin(1) for i in range(0, len(points), 4096)])
    ranks = []
    for i in np.sort(np.random.default_rng(s.seed).choice(len(points), min(s.trials, len(points)), replace=False)):
        far = ((points - points[i]) ** 2).sum(1)
        far[i] = np.inf
        place = np.empty(len(centres), np.int64)
        place[_squared(points[i : i + 1], centres)[0].argsort(kind="stable")] = np.arange(len(centres))
        ranks.append(place[own[np.argsort(far, kind="stable")[: min(k, len(points) - 1)]]])
    every = np.sort(np.concatenate(ranks))
    return int(every[min(len(every) - 1, int(s.target * len(every)))]) + 1 if len(every) else 1


def _matrix(array: pa.Array, dim: int) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(array), dim)


def search_block(rotated: np.ndarray, original: np.ndarray, queries: np.ndarray, spun: np.ndarray, most: int, s: Settings) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, rows, exact distances) of the `most` nearest rows of a block that the dimension scan leaves for each query.

    `rotated` holds the rotated vectors by dimension, one row per dimension.
    """
    dim, n = rotated.shape
    head = min(s.step, dim)
    first = _squared(spun[:, :head], rotated[:head].T)
    for q in range(len(queries)):
        partial, alive = first[q], np.arange(n)
        if n > 4 * most:
            start = np.argpartition(partial, 2 * most)[: 2 * most]
            full = ((original[start] - queries[q]) ** 2).sum(1)
            limit = np.partition(full, most - 1)[most - 1]
            d = head
            while True:
                share = 1.0 if d >= dim else d / dim * (1 + s.epsilon / np.sqrt(d)) ** 2
                keep = partial <= limit * share * (1 + 1e-5) + 1e-12
                partial, alive = partial[keep], alive[keep]
                if d >= dim or len(alive) <= 2 * most:
                    break
                end = min(dim, d + s.step)
                partial = partial + ((rotated[d:end, alive] - spun[q, d:end, None]) ** 2).sum(0)
                d = end
        exact = np.sqrt(((original[alive] - queries[q]) ** 2).sum(1))
        if len(alive) > most:
            nearest = np.lexsort((alive, exact))[:most]
            alive, exact = alive[nearest], exact[nearest]
        yield q, alive, exact


def nearest(vectors: DataFrame, queries: DataFrame, id: str = "vec_id", vec: str = "embedding", k: int = 10, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the `k` nearest found of each query, nearest first, ties to smaller ids.

    `score` is the Euclidean distance in double precision of the original vectors. Rows with a null id, vectors that
    are null, zero, of another length than most, or that hold null or non-finite components take no part. A query's
    own id is never its neighbour. All lists that are needed to reach `k` candidates are searched, so a query has
    fewer rows only if there are fewer candidates. Equal vectors are one class of which the k + 1 smallest ids are
    kept, which is all that k neighbours can need. An empty table gives no rows.
    """
    s, spark = settings, vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        return df.where(F.col(id).isNotNull() & usable(vec)).select(F.col(id).cast("long").alias("id"), F.transform(F.col(vec).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v"))

    sized = clean(vectors).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sized is None:
        return empty
    dim = int(sized["d"])
    rows = clean(vectors).where(F.size("v") == dim).withColumn("h", F.xxhash64("v"))
    few = rows.withColumn("r", F.row_number().over(W.partitionBy("h", "v").orderBy("id"))).where(F.col("r") <= k + 1)
    classes = checkpointed(few.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    n = classes.count()
    lists = max(1, min(s.lists, int(np.sqrt(n))))
    sample = classes.orderBy("h", F.col("ids")[0]).select("v").limit(min(s.sample, 64 * lists))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = np.concatenate([_matrix(b.column(0), dim) for b in batches if b.num_rows])
        centres = _centroids(points, min(lists, len(points)), s.rounds, s.seed)
        yield pa.RecordBatch.from_arrays([pa.array([centres.tobytes()], pa.binary()), pa.array([_probes(points, centres, k, s)], pa.int32())], ["centres", "probes"])

    fitted = sample.repartition(1).mapInArrow(fit, "centres binary, probes int").first()
    centres = np.frombuffer(fitted["centres"]).reshape(-1, dim)
    shared = spark.sparkContext.broadcast((centres, rotation(dim, s.seed)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, _ = shared.value
        for b in batches:
            if b.num_rows:
                own = _squared(_matrix(b.column(1), dim), c).argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int64))], ["h", "v", "ids", "list"])

    listed = checkpointed(classes.mapInArrow(assign, "h long, v array<double>, ids array<long>, list long"))
    sizes = np.zeros(len(centres), np.int64)
    for r in listed.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    blocks = spark.createDataFrame([(i, int(-(-x // s.block))) for i, x in enumerate(sizes.tolist())], "list long, blocks int")
    dealt = listed.join(F.broadcast(blocks), "list").withColumn("block", F.pmod("h", F.col("blocks")).cast("int")).select("list", "block", "v", "ids")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, turn = shared.value
        for g in sorted_groups(batches, ["list", "block"]):
            own = _matrix(g.column("v").combine_chunks(), dim)
            ids = g.column("ids").to_pylist()
            columns = np.ascontiguousarray((own @ turn).T.astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array([g.column("list")[0].as_py()], pa.int64()), pa.array([columns.tobytes()], pa.binary()), pa.array([own.tobytes()], pa.binary()), pa.array([ids], pa.list_(pa.list_(pa.int64())))], ["list", "columns", "originals", "ids"])

    index = keyed(dealt, ["list", "block"], ["ids"], pack, "list long, columns binary, originals binary, ids array<array<long>>")
    asked = clean(queries).where(F.size("v") == dim).dropDuplicates(["id"])
    probes = min(len(centres), max(s.least, fitted["probes"]))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, _ = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            order = _squared(_matrix(b.column(1), dim), c).argsort(1, kind="stable")
            enough = (sizes[order].cumsum(1) >= k + 1).argmax(1) + 1
            enough[sizes.sum() < k + 1] = len(c)
            chosen = [o[: max(probes, e)].tolist() for o, e in zip(order, enough.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(chosen, pa.list_(pa.int64()))], ["id", "v", "lists"])

    probed = asked.mapInArrow(probe, "id long, v array<double>, lists array<long>").select("id", "v", F.explode("lists").alias("list"))
    probed = checkpointed(probed)
    counts = probed.groupBy("list").agg(F.ceil(F.count("*") / s.pack).cast("int").alias("packs"))
    probed = probed.join(F.broadcast(counts), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("packs")).cast("int")).select("list", "part", "id", "v")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, ["list", "part"]):
            own = _matrix(g.column("v").combine_chunks(), dim)
            yield pa.RecordBatch.from_arrays([pa.array([g.column("list")[0].as_py()], pa.int64()), pa.array([g.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([own.tobytes()], pa.binary())], ["list", "query_ids", "queries"])

    bundles = keyed(probed, ["list", "part"], ["id"], bundle, "list long, query_ids array<long>, queries binary")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, turn = shared.value
        for b in batches:
            for i in range(b.num_rows):
                columns, originals, ids, asks, points = (b.column(j)[i] for j in range(5))
                columns = np.frombuffer(columns.as_py(), np.float32).reshape(dim, -1).astype(np.float64)
                originals = np.frombuffer(originals.as_py()).reshape(-1, dim)
                points, asks, ids = np.frombuffer(points.as_py()).reshape(-1, dim), asks.as_py(), ids.as_py()
                out: tuple[list, list, list] = ([], [], [])
                for q, rows_, exact in search_block(columns, originals, points, points @ turn, k + 1, s):
                    found = sorted((d, v) for d, r in zip(exact.tolist(), rows_.tolist(), strict=True) for v in ids[r] if v != asks[q])[:k]
                    out[0].extend([asks[q]] * len(found))
                    out[1].extend(v for _, v in found)
                    out[2].extend(d for d, _ in found)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    pairs = index.join(bundles, "list").select("columns", "originals", "ids", "query_ids", "queries")
    found = pairs.mapInArrow(scan, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest of every vector whose id is divisible by 100, among all others."""
    from .common import table

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))
