"""Variable-capacity best-fit packing of texts into sequences.

Only the histogram of lengths, bounded by the largest permitted sequence, decides how bins are filled: equal lengths
are interchangeable, so best-fit decreasing runs over lengths with their counts, on groups of bins that hold the same.
An item goes to the fullest bin that has room for it; where none has, a bin of the size with the least cost for its
content is opened. That is done for every choice among the permitted sizes, each bin is downsized to the smallest
permitted size that holds its content, and the cheapest plan is taken. Texts find their bins by their rank among those
of the same length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, longs


@dataclass(frozen=True)
class Settings:
    """Permitted sequence lengths and the cost of one: `fixed` + s + s**2 / `square`."""

    sizes: tuple[int, ...] = (1024, 2048, 4096, 8192)
    fixed: float = 16.0
    square: float = 32_768.0

    def cost(self, size: int) -> float:
        return self.fixed + size + size * size / self.square


@dataclass
class Plan:
    """`segments`: (length, first rank, items, first bin, items per bin, place in the bin) of items of one length;
    `bins`: (first bin, bins, content, size); `cost` of all bins."""

    segments: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    bins: list[tuple[int, int, int, int]] = field(default_factory=list)
    cost: float = 0.0


def _fill(counts: dict[int, int], open_sizes: tuple[int, ...], s: Settings) -> Plan:
    plan, next_bin = Plan(), 0
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, int, int]]] = {}

    def put(first: int, n: int, content: int, size: int) -> None:
        room = size - content
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((first, n, content))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def place(first: int, n: int, content: int, size: int, each: int) -> None:
            nonlocal left, rank
            plan.segments.append((length, rank, n * each, first, each, content))
            put(first, n, content + each * length, size)
            left -= n * each
            rank += n * each

        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n, content = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
                each = room // length
                full = min(n, left // each)
                if full:
                    place(first, full, content, content + room, each)
                if full < n and 0 < left < each:
                    place(first + full, 1, content, content + room, left)
                    full += 1
                if full < n:
                    put(first + full, n - full, content, content + room)
                continue
            fits = [x for x in open_sizes if x >= length]
            size = min(fits, key=lambda x: (s.cost(x) / (min(x // length, left) * length), x))
            each = size // length
            if left >= each:
                n = left // each
                first, next_bin = next_bin, next_bin + n
                place(first, n, 0, size, each)
            else:
                first, next_bin = next_bin, next_bin + 1
                place(first, 1, 0, size, left)
    for some in groups.values():
        for first, n, content in some:
            size = next(x for x in s.sizes if x >= content)
            plan.bins.append((first, n, content, size))
            plan.cost += n * s.cost(size)
    plan.bins.sort()
    return plan


def best_plan(counts: dict[int, int], settings: Settings = Settings()) -> Plan:
    """The cheapest plan over all choices of sizes that bins may be opened with; ties to the first choice."""
    s = Settings(tuple(sorted(settings.sizes)), settings.fixed, settings.square)
    longest = max(counts, default=0)
    choices = [c for n in range(len(s.sizes), 0, -1) for c in combinations(s.sizes, n) if c[-1] >= longest]
    return min((_fill(counts, c, s) for c in choices), key=lambda p: p.cost)


def pack(docs: DataFrame, text: str = "text", id: str = "doc_id", length=None, settings: Settings = Settings()) -> DataFrame:
    """`id`, piece, first, length, bin_id, capacity, place: where each piece of each row of `docs` goes.

    `length` is a column expression for the tokens of a row; by default its words and one token that ends it. A row
    longer than the largest size is cut into pieces of that size and a rest, `first` being where a piece starts.
    `place` is where it starts in its bin. Null and empty texts have length 1 and are packed like any other; nothing
    is dropped. Rows with equal ids each have their own pieces. An empty table gives no rows.
    """
    s = settings
    most = max(s.sizes)
    spark = docs.sparkSession
    length = length if length is not None else F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+")) + 1
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("tie"), length.cast("long").alias("n"))
    cut = F.explode(F.sequence(F.lit(0), F.ceil(F.greatest(F.col("n"), F.lit(1)) / most).cast("int") - 1)).alias("piece")
    pieces = rows.select("id", "tie", F.greatest("n", F.lit(1)).alias("n"), cut)
    pieces = pieces.select("id", "tie", "piece", (F.col("piece") * F.lit(most).cast("long")).alias("first"), F.least(F.lit(most).cast("long"), F.col("n") - F.col("piece") * F.lit(most).cast("long")).alias("length"))
    dealt = pieces.repartitionByRange("length", "id", "tie", "piece").withColumn("part", F.spark_partition_id())
    dealt = checkpointed(dealt)
    counts = dealt.groupBy("length", "part").count()
    before = F.sum("count").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    counts = checkpointed(counts.withColumn("before", F.coalesce(before, F.lit(0))))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = best_plan(histogram, s)
    segments = np.array(sorted(plan.segments), dtype=np.int64).reshape(-1, 6)
    bins = np.array(plan.bins, dtype=np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast((segments, bins))
    within = F.row_number().over(W.partitionBy("part", "length").orderBy("id", "tie", "piece")) - 1
    ranked = dealt.withColumn("rank", within).join(counts.drop("count"), ["length", "part"])
    ranked = ranked.select("id", "piece", "first", "length", (F.col("rank") + F.col("before")).alias("rank"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, bins = shared.value
        keys = segments[:, 0] * (1 << 48) + segments[:, 1]
        for b in batches:
            if not b.num_rows:
                continue
            size, rank = longs(b, "length"), longs(b, "rank")
            own = segments[np.searchsorted(keys, size * (1 << 48) + rank, side="right") - 1]
            step = rank - own[:, 1]
            bin_id = own[:, 3] + step // own[:, 4]
            place = own[:, 5] + step % own[:, 4] * size
            capacity = bins[np.searchsorted(bins[:, 0], bin_id, side="right") - 1, 3]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(bin_id), pa.array(capacity), pa.array(place)], ["id", "piece", "first", "length", "bin_id", "capacity", "place"])

    kind = docs.schema[id].dataType.simpleString()
    return ranked.mapInArrow(work, f"id {kind}, piece int, first long, length long, bin_id long, capacity long, place long").withColumnRenamed("id", id)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """Sequences of 1024 to 8192 words for all documents."""
    from .common import table

    return pack(table(spark, sf_dir, "documents"))
