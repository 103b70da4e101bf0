"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are made in Arrow batches. Distinct fingerprints are dealt to buckets in which a choice of bit blocks is
equal (with d differing bits over d + c blocks, c blocks at least are equal, so no pair is lost). Inside a bucket they
are sorted by Gray rank, runs of neighbours become nodes that hold the bits all of them share, and pairs of nodes
whose shared bits already differ in more than d places are pruned, level by level, before single fingerprints are
compared. A bucket gives a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, checkpointed, column, components, keyed, lean, merge_labels, pieces, sorted_groups
from .paragraphs import Settings, _bands, _identity, _shingles, met, verified

LEAF, FAN = 32, 8
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
CHUNK = 200_000


def _shingle_hashes(raw: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each run of `words` words of a text, in chunks; a shorter text is one shingle, none gives none."""
    text = b" ".join(raw.lower().split())
    if not text:
        return
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(text)]))
    if len(starts) > words:
        starts, ends = starts[: len(starts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        spans = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        yield np.array([digest(text[lo:hi], 42) for lo, hi in spans], dtype=np.uint64)


def _majority(texts: list[bytes | None], words: int, sketch: int = 0) -> tuple[np.ndarray, list[bytes]]:
    """The fingerprint of each text as uint64, and its `sketch` least different hashes (upper halves) in order."""
    least = [np.zeros(0, np.uint32) for _ in texts] if sketch else []
    counts = np.zeros((len(texts), 64), dtype=np.int64)
    total = np.zeros(len(texts), dtype=np.int64)
    held: list[np.ndarray] = []
    of: list[int] = []

    def flush() -> None:
        if not held:
            return
        hashes = np.concatenate(held)
        lo = of[0]
        docs = np.repeat(np.array(of) - lo, [len(x) for x in held])
        n = of[-1] - lo + 1
        rows = hashes.view(np.uint8).reshape(-1, 8)
        for j in range(8):
            seen = np.bincount(docs * 256 + rows[:, j], minlength=n * 256).reshape(n, 256)
            counts[lo : lo + n, 8 * j : 8 * j + 8] += seen @ BITS
        held.clear()
        of.clear()

    size = 0
    for i, raw in enumerate(texts):
        for hashes in _shingle_hashes(raw or b"", words):
            if sketch:
                least[i] = np.union1d(least[i], (hashes >> np.uint64(32)).astype(np.uint32))[:sketch]
            held.append(hashes)
            of.append(i)
            total[i] += len(hashes)
            size += len(hashes)
            if size >= CHUNK:
                flush()
                size = 0
    flush()
    ones = counts * 2 > total[:, None]
    return np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel(), [x.tobytes() for x in least]


def fingerprints(docs: DataFrame, text: str = "text", words: int = 4, keep: list[str] | None = None, sketch: int = 0) -> DataFrame:
    """`keep` columns of `docs` (default doc_id) with `fp`, the 64-bit fingerprint as a signed long, and, if `sketch`
    is not 0, a binary column of that name with so many least shingle hashes.

    Words are split at ASCII white space after lower-casing A-Z; shingles of `words` words count as often as they
    occur. A null or empty text, or one without words, has fingerprint 0. Every row of `docs` gives one row.
    """
    keep = keep or ["doc_id"]
    source = lean(docs).select(*keep, F.col(text).cast("binary").alias("__text"))
    names = ["fp", "sketch"] if sketch else ["fp"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fp, least = _majority(batch.column(len(keep)).to_pylist(), words, sketch)
                made = [pa.array(fp.view(np.int64)), *([pa.array(least, pa.binary())] if sketch else [])]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], [*keep, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return source.mapInArrow(work, f"{fields}, fp long" + ", sketch binary" * bool(sketch))


def masks(n: int, distance: int, per_bucket: int = 4096) -> list[int]:
    """Bit masks of which two fingerprints within `distance` share one at least; more bits for more rows."""
    for equal in range(1, 5):
        blocks = np.array_split(np.arange(64), distance + equal)
        chosen = [sum(1 << int(b) for k in some for b in blocks[k]) for some in combinations(range(len(blocks)), equal)]
        if n / 2 ** (64 * equal / (distance + equal)) <= per_bucket:
            break
    return chosen


def sampled_masks(n: int, sure: int = 10, miss: float = 0.02, seed: int = 42) -> list[int]:
    """Masks of random bits, about as many as tell `n` rows apart (12 at least), and so many masks that a pair `sure`
    bits apart agrees in none of them with probability `miss` at most, whatever `n`."""
    bits = max(12, round(np.log2(max(n, 1))) - 3)
    alike = np.prod([(64 - sure - i) / (64 - i) for i in range(bits)])
    random = np.random.default_rng(seed)
    return [sum(1 << int(b) for b in random.choice(64, bits, replace=False)) for _ in range(int(np.ceil(np.log(miss) / np.log1p(-alike))))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _levels(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(shared pattern, mask of shared bits) of the nodes over Gray-sorted fingerprints, leaves first."""
    cuts = np.arange(0, len(fps), LEAF)
    every, some = np.bitwise_and.reduceat(fps, cuts), np.bitwise_or.reduceat(fps, cuts)
    out = [(every, ~(every ^ some))]
    while len(every) > FAN:
        cuts = np.arange(0, len(every), FAN)
        every, some = np.bitwise_and.reduceat(every, cuts), np.bitwise_or.reduceat(some, cuts)
        out.append((every, ~(every ^ some)))
    return out


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Component labels (index of one member each) of Gray-sorted fingerprints linked within `distance`, and the
    nearest linked member of each (-1: none; ties to the lowest index)."""
    n, labels = len(fps), np.arange(len(fps))
    nearest = np.full(n, 65 << 32, np.int64)
    if n <= LEAF:
        apart = np.bitwise_count(fps[:, None] ^ fps[None]).astype(np.int64)
        u, v = np.nonzero(np.triu(apart <= distance, 1))
        np.fill_diagonal(apart, 65)
        at = apart.argmin(1)
        return merge_labels(labels, u, v), np.where(apart[labels, at] <= distance, at, -1)
    levels = _levels(fps)
    top = np.arange(len(levels[-1][0]))
    x, y = (z.ravel() for z in np.meshgrid(top, top, indexing="ij"))
    x, y = x[x <= y], y[x <= y]
    for depth in range(len(levels) - 1, -1, -1):
        pattern, mask = levels[depth]
        near = np.bitwise_count((pattern[x] ^ pattern[y]) & mask[x] & mask[y]) <= distance
        x, y = x[near], y[near]
        if not depth:
            break
        below = len(levels[depth - 1][0])
        step = np.arange(FAN)
        cx = (x[:, None, None] * FAN + step[None, :, None] + 0 * step[None, None, :]).ravel()
        cy = (y[:, None, None] * FAN + step[None, None, :] + 0 * step[None, :, None]).ravel()
        good = (cx < below) & (cy < below) & (cx <= cy)
        x, y = cx[good], cy[good]
    padded = np.concatenate((fps, np.zeros(-n % LEAF, dtype=np.uint64))).reshape(-1, LEAF)
    order = np.argsort(y - x, kind="stable")
    for at in range(0, len(x), 512):
        i, j = x[order[at : at + 512]], y[order[at : at + 512]]
        apart = np.bitwise_count(padded[i][:, :, None] ^ padded[j][:, None, :])
        k, p, q = np.nonzero(apart <= distance)
        u, v, d = i[k] * LEAF + p, j[k] * LEAF + q, apart[k, p, q].astype(np.int64) << 32
        good = (u < v) & (v < n)
        u, v, d = u[good], v[good], d[good]
        np.minimum.at(nearest, u, d | v)
        np.minimum.at(nearest, v, d | u)
        labels = merge_labels(labels, u, v)
    return labels, np.where(nearest >> 32 <= distance, nearest & 0xFFFFFFFF, -1)


def links(fps: DataFrame, distance: int = 4, most: int = 16_384, tables: list[int] | None = None, nearest: bool = False) -> DataFrame:
    """Links (a, b) between nodes of `fps` (columns node, fp) whose fingerprints differ in at most `distance` bits.

    With the masks of `masks`, which are the default, every linked pair is in one component of the result; other
    `tables` find a pair if it agrees in all bits of one of them. Each bucket gives a spanning forest and, if asked,
    each member's `nearest`. A bucket of more than `most` rows is dealt out as pairs of blocks, each compared in a
    task of its own, so none grows without bound.
    """
    tables = masks(fps.count(), distance) if tables is None else tables
    cells = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(tables)]))
    rows = fps.select("node", "fp", cells.alias("c")).select("node", "fp", "c.t", "c.k")
    crowded = checkpointed(rows.groupBy("t", "k").count().where(F.col("count") > most).select("t", "k", F.ceil(F.col("count") / most).cast("int").alias("blocks")))
    if crowded.isEmpty():
        rows = rows.select("*", F.lit(0).alias("p"))
    else:
        block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(F.col("block"), j) * F.col("blocks") + F.greatest(F.col("block"), j))
        rows = rows.join(crowded, ["t", "k"], "left").withColumn("block", block)
        rows = rows.select("node", "fp", "t", "k", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("p"))
    gray = F.col("fp")
    for shift in (1, 2, 4, 8, 16, 32):
        gray = gray.bitwiseXOR(F.shiftrightunsigned(gray, shift))
    rows = rows.withColumn("gray", gray)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        held = 0
        for group in sorted_groups(batches, ["t", "k", "p"]):
            if group.num_rows < 2:
                continue
            own = group.column("node").to_numpy()
            labels, near = forest(group.column("fp").to_numpy().view(np.uint64), distance)
            moved = np.flatnonzero(labels != np.arange(len(own)))
            if not len(moved):
                continue
            a.append(own[moved])
            b.append(own[labels[moved]])
            if nearest:
                some = np.flatnonzero(near >= 0)
                a.append(own[some])
                b.append(own[near[some]])
            held += len(moved)
            if held > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                a, b, held = [], [], 0
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return keyed(rows, ["t", "k", "p"], ["gray", "node"], work, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", words: int = 4, distance: int = 4) -> DataFrame:
    """One row per row of `docs`: `id`, `fp`, `component_id` (the smallest id reachable over links, its own included).

    Rows with equal ids each keep their row. Null ids keep their rows and never name a component; one in which all ids
    are null has a null component_id. Empty texts (fingerprint 0) link like any other. An empty table gives no rows.
    """
    fp = checkpointed(fingerprints(docs.select(F.col(id).alias("__id"), F.col(text).alias("__body")), "__body", words, ["__id"]))
    owners = fp.groupBy("fp").agg(F.min("__id").alias("least"))
    nodes = components(links(owners.select(F.col("fp").alias("node"), "fp"), distance))
    grouped = owners.join(nodes, owners["fp"] == nodes["node"], "left").select(owners["fp"], "least", F.coalesce("component", owners["fp"]).alias("component"))
    named = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.select(apart("component").alias("key"), "component_id")
    label = grouped.select("fp", "component").join(named, F.col("component") == F.col("key")).select(apart("fp").alias("key"), "component_id")
    return fp.join(label, F.col("fp") == F.col("key")).select(F.col("__id").alias(id), "fp", "component_id")


#: Words of a shingle of a fingerprint.
FINGERPRINT = 4


def _signed_texts(docs: DataFrame, s: Settings) -> DataFrame:
    """(id, row, node, fp, bands) of `docs` (id, row, text binary): a hash of the words in order, the fingerprint, MinHash band keys (none without words)."""
    kind = docs.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 128):
            raw = column(batch, "text").to_pylist()
            if not raw:
                continue
            fp, _ = _majority(raw, FINGERPRINT)
            own = [(x or b"").lower().split() for x in raw]
            sizes = [s.bands if x else 0 for x in own]
            some = [x for x in own if x]
            keys = _bands(*_shingles(some, s.words), s).ravel().view(np.int64) if some else np.zeros(0, np.int64)
            ends = pa.array(np.cumsum([0, *sizes]).astype(np.int32))
            made = [pa.array(list(map(_identity, own)), pa.int64()), pa.array(fp.view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(keys))]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "row"), *made], ["id", "row", "node", "fp", "bands"])

    return docs.select("id", "row", "text").mapInArrow(work, f"id {kind}, row long, node long, fp long, bands array<long>")


def _sets(docs: DataFrame, s: Settings) -> DataFrame:
    """(paragraph, shingles): the whole shingle set of each text of `docs` (paragraph, text binary)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            own = [x.lower().split() for x in column(batch, "text").to_pylist()]
            if own:
                hashes, starts = _shingles(own, s.words)
                sets = [np.unique(x).view(np.int64) for x in np.split(hashes, starts[1:])]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([column(batch, "paragraph"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["paragraph", "shingles"])

    return docs.select("paragraph", "text").mapInArrow(work, "paragraph long, shingles array<long>")


def _near(made: DataFrame, distance: int) -> DataFrame:
    """(band, paragraph): the nodes of `made` (node, fp) by the component of their fingerprint, where it has others."""
    fps = made.select("fp").distinct()
    same = components(links(fps.select(F.col("fp").alias("node"), "fp"), distance))
    nodes = made.select("node", "fp").distinct()
    named = nodes.join(same.select(apart("node").alias("key"), "component"), F.col("fp") == F.col("key"), "left")
    return named.select(F.xxhash64(F.lit("fp"), F.coalesce("component", "fp")).alias("band"), F.col("node").alias("paragraph"))


def deduplicate(docs: DataFrame, text: str = "text", id: str = "doc_id", words: int = 5, similar: float = 0.8, distance: int = 4) -> DataFrame:
    """`docs` with one row of each group of near-duplicates: that of the smallest id (null ids come last).

    Texts are linked if the Jaccard similarity of their `words`-word shingle sets is `similar` or more. Candidates are
    the components of fingerprints within `distance` bits, found by the Gray-order index as in `near_duplicates`, and,
    for pairs further apart, MinHash bands (`paragraphs.Settings`: a pair at 0.8 shares one with probability 0.9994).
    In a component and in a band every pair is compared by the whole sets, and only such links make groups. Texts of
    equal words are one node; those without words are equal to each other. Equal rows count as one.
    """
    s = Settings(words=words, similar=similar)
    key = docs.withColumn("__row", F.xxhash64(F.col(id), F.col(text)))
    rows = lean(key).select(F.col(id).alias("id"), F.col("__row").alias("row"), F.col(text).cast("binary").alias("text"))
    made = checkpointed(_signed_texts(rows, s))
    nodes = made.groupBy(F.col("node").alias("paragraph")).agg(F.first("bands").alias("bands"), F.min("row").alias("row"))
    banded = nodes.select(F.explode("bands").alias("band"), "paragraph")
    hits = checkpointed(met(banded.union(_near(made.where(F.size("bands") > 0), distance))))
    wanted = nodes.select("paragraph", "row").join(hits.select("paragraph").distinct(), "paragraph")
    texts = rows.select("row", "text").join(wanted, "row").dropDuplicates(["row"])
    same = components(verified(hits, _sets(texts, s), s))
    grouped = made.join(same, "node", "left").select("id", F.col("row").alias("__row"), F.coalesce("component", "node").alias("group"))
    best = grouped.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "__row")).alias("best"))
    stay = best.select(F.col("best.__row").alias("__row"))
    return key.join(stay, "__row", "left_semi").dropDuplicates(["__row"]).drop("__row")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 4-word shingles, 4 differing bits."""
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
