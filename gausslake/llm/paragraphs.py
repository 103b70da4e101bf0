"""Substring de-duplication by paragraph MinHash banding.

A paragraph is a line of a text that is long enough, or a piece of a run of shorter lines, cut where the lines' own
content says so, whatever stands around them. Its words (lower-cased A-Z, split at ASCII white space) give five-word
shingles. MinHash bands are tuned for recall; paragraphs that collide in a band are compared by exact Jaccard
similarity, and the verified links are clustered by connected components. Of each cluster the first place stays.

Passages that begin or end inside a line are no paragraphs of their own: every run of 50 words that stands, word for
word, in more than one place of what the paragraphs leave is found, too.

Buckets with the same members are compared once. A crowded bucket is dealt out as pairs of blocks. Comparisons give a
spanning forest of the verified links, never all pairs. All places are counted in words of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import among, apart, checkpointed, column, components, keyed, lean, longs, merge_labels, pieces, sorted_groups

MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """Shingles of `words` words, links from Jaccard `similar` on. Lines of `least` words are paragraphs; a run of
    shorter ones is cut after a line whose hash says so, one in `cut`, once the piece has `least` words.

    `bands` bands of `rows` minima: a pair at similarity 0.8 collides with probability 1 - (1 - 0.8**4)**14 = 0.9994.
    Equal runs of `passage` words are found wherever they stand. A bucket of more than `crowd` paragraphs is dealt out
    in blocks. Up to `few` keys or spans (counted) are sent to all tasks to spare texts a shuffle; more are joined.
    """

    words: int = 5
    similar: float = 0.8
    least: int = 20
    cut: int = 4
    passage: int = 50
    bands: int = 14
    rows: int = 4
    crowd: int = 1000
    few: int = 1_000_000
    seed: int = 42


class WordHasher(dict):
    """Word (bytes) to its 64-bit hash; forgets everything beyond a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = xxhash.xxh64_intdigest(word, 11)
        if len(word) <= 64:
            self[word] = value
        return value


HASHED = WordHasher()


def _paragraphs(text: bytes, s: Settings) -> tuple[list[bytes], list[tuple[int, int]]]:
    """The words of a text, and (first word, end) of its paragraphs."""
    words, out, begin = [], [], 0
    for line in text.lower().split(b"\n"):
        own = line.split()
        if not own:
            continue
        at = len(words)
        words += own
        if len(own) >= s.least:
            if at - begin >= s.least:
                out.append((begin, at))
            out.append((at, len(words)))
            begin = len(words)
        elif len(words) - begin >= s.least and xxhash.xxh32_intdigest(b" ".join(own), 3) % s.cut == 0:
            out.append((begin, len(words)))
            begin = len(words)
    if len(words) - begin >= s.least:
        out.append((begin, len(words)))
    return words, out


def _identity(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), 5) - (1 << 63)


def _shingles(paragraphs: list[list[bytes]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of some paragraphs, one after another, and where each paragraph starts."""
    sizes = np.array([len(p) for p in paragraphs])
    words = np.fromiter(map(HASHED.__getitem__, chain.from_iterable(paragraphs)), np.uint64, int(sizes.sum()))
    counts = np.maximum(sizes - k + 1, 1)
    starts = np.cumsum(sizes) - sizes
    at = np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    ends = np.repeat(starts + sizes, counts)
    out = words[at].copy()
    for j in range(1, k):
        inside = at + j < ends
        out = out * MULTIPLY + np.where(inside, words[np.minimum(at + j, len(words) - 1)], np.uint64(1))
    out ^= out >> np.uint64(31)
    return out * MULTIPLY, np.cumsum(counts) - counts


def _bands(hashes: np.ndarray, starts: np.ndarray, s: Settings) -> np.ndarray:
    """Band keys (paragraphs x bands) of MinHash signatures; a band's number is part of its key."""
    random = np.random.default_rng(s.seed).integers(1, 1 << 63, size=(s.bands * s.rows, 2), dtype=np.uint64)
    out = np.empty((len(starts), s.bands), np.uint64)
    for b in range(s.bands):
        key = np.full(len(starts), b + 1, np.uint64)
        for r in range(s.rows):
            a, c = random[b * s.rows + r]
            least = np.minimum.reduceat((hashes * (a | np.uint64(1)) + c) >> np.uint64(16), starts)
            key = key * MULTIPLY + least
            key ^= key >> np.uint64(29)
        out[:, b] = key * MULTIPLY
    return out


def places(docs: DataFrame, s: Settings) -> DataFrame:
    """(id, row, first, end, paragraph): every paragraph place of `docs` (columns id, row, text binary)."""
    kind = docs.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 128):
            at, first, end, own = [], [], [], []
            for i, text in enumerate(column(batch, "text").to_pylist()):
                words, spans = _paragraphs(text, s)
                for a, b in spans:
                    at.append(i)
                    first.append(a)
                    end.append(b)
                    own.append(_identity(words[a:b]))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([column(batch, "id").take(take), column(batch, "row").take(take), pa.array(first, pa.int64()), pa.array(end, pa.int64()), pa.array(own, pa.int64())], ["id", "row", "first", "end", "paragraph"])

    return docs.select("id", "row", "text").mapInArrow(work, f"id {kind}, row long, first long, end long, paragraph long")


def collisions(docs: DataFrame, s: Settings) -> DataFrame:
    """(bucket, size, paragraph): different paragraphs that share a band; buckets with the same members are one."""

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what a task has sent it doesn't send again, so a line that most texts hold is a few rows
        sent: set[int] = set()
        for batch in pieces(batches, 128):
            own: dict[int, list[bytes]] = {}
            for text in column(batch, "text").to_pylist():
                words, spans = _paragraphs(text, s)
                for a, b in spans:
                    if (i := _identity(words[a:b])) not in sent:
                        sent.add(i)
                        own[i] = words[a:b]
            if len(sent) > 200_000:
                sent.clear()
            if own:
                keys = _bands(*_shingles(list(own.values()), s.words), s)
                ids = np.repeat(np.array(list(own), np.int64), s.bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], ["band", "paragraph"])

    banded = docs.select("text").mapInArrow(band, "band long, paragraph long")
    return met(banded)


def met(banded: DataFrame) -> DataFrame:
    """(bucket, size, paragraph) of `banded` (band, paragraph): the bands that different paragraphs share, once for each set of members."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sift(key: np.ndarray, own: np.ndarray) -> pa.RecordBatch | None:
            fresh = np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]))
            key, own = key[fresh], own[fresh]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(first, len(key)))
            mixed = own.view(np.uint64) * MULTIPLY
            mixed ^= mixed >> np.uint64(32)
            name = np.add.reduceat(mixed * MULTIPLY, first) * MULTIPLY + size.astype(np.uint64)
            keep = np.repeat(size > 1, size)
            if not keep.any():
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(name.view(np.int64), size)[keep]), pa.array(np.repeat(size, size)[keep]), pa.array(own[keep])], ["bucket", "size", "paragraph"])

        key, own = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                key, own = np.concatenate((key, longs(batch, "band"))), np.concatenate((own, longs(batch, "paragraph")))
                last = int(np.searchsorted(key, key[-1]))
                if last and (made := sift(key[:last], own[:last])) is not None:
                    yield made
                key, own = key[last:], own[last:]
        if len(key) and (made := sift(key, own)) is not None:
            yield made

    return keyed(banded, ["band"], ["paragraph"], meet, "bucket long, size long, paragraph long").distinct()


def _similar(sets: list[np.ndarray], similar: float) -> np.ndarray:
    """Component labels of shingle sets linked from Jaccard `similar` on."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.repeat(np.arange(n), size)
    labels = np.arange(n)
    if n <= 64:
        has = np.zeros((n, ids.max() + 1), np.float32)
        has[of, ids] = 1
        both = has @ has.T
        u, v = np.nonzero(np.triu(both >= similar * (size[:, None] + size[None] - both) - 1e-4, 1))
        return merge_labels(labels, u, v)
    order = np.argsort(ids, kind="stable")
    postings, start = of[order], np.searchsorted(ids[order], np.arange(ids.max() + 2))
    ends = np.cumsum(size)
    for i in range(n):
        if not labels.any():  # one component already
            break
        own = ids[ends[i] - size[i] : ends[i]]
        both = np.bincount(np.concatenate([postings[start[k] : start[k + 1]] for k in own.tolist()]), minlength=n)
        v = np.flatnonzero(both >= similar * (size[i] + size - both) - 1e-9)
        v = v[labels[v] != labels[i]]
        if len(v):
            labels = merge_labels(labels, np.full(len(v), i), v)
    return labels


def links(docs: DataFrame, found: DataFrame, s: Settings) -> DataFrame:
    """Verified links (a, b) between different paragraphs that share a bucket: a forest for each bucket."""
    hits = checkpointed(collisions(docs, s))
    wanted = found.join(hits.select("paragraph").distinct(), "paragraph").groupBy("paragraph").agg(F.min(F.struct("row", "first", "end")).alias("p"))
    wanted = checkpointed(wanted.groupBy(F.col("p.row").alias("row")).agg(F.collect_list(F.struct(F.col("p.first").alias("first"), F.col("p.end").alias("end"), "paragraph")).alias("wanted")))
    once = among(docs, wanted, "row", s.few).groupBy("row").agg(F.first("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 128):
            ids, own = [], []
            for text, some in zip(column(batch, "text").to_pylist(), column(batch, "wanted").to_pylist(), strict=True):
                words = text.lower().split()
                for w in some:
                    ids.append(w["paragraph"])
                    own.append(words[w["first"] : w["end"]])
            if own:
                hashes, starts = _shingles(own, s.words)
                sets = [np.unique(x).view(np.int64) for x in np.split(hashes, starts[1:])]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["paragraph", "shingles"])

    return verified(hits, wanted.join(once, "row").mapInArrow(cut, "paragraph long, shingles array<long>"), s)


def verified(hits: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) between members of the buckets `hits` by exact similarity of their `sets` (paragraph, shingles): a
    forest for each bucket, in which every pair is compared."""
    block = F.pmod(F.xxhash64("paragraph"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(F.col("block"), j) * F.col("blocks") + F.greatest(F.col("block"), j))
    dealt = hits.withColumn("blocks", F.ceil(F.col("size") / s.crowd).cast("int")).withColumn("block", block)
    dealt = dealt.select("bucket", "paragraph", F.explode(pairs).alias("part"))
    rows = dealt.join(sets, "paragraph").select("bucket", "part", *sets.columns)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        for group in sorted_groups(batches, ["bucket", "part"]):
            if group.num_rows > 1:
                own = group.column("paragraph").to_numpy()
                values = group.column("shingles").combine_chunks()
                flat, ends = values.flatten().to_numpy(), np.cumsum(values.value_lengths().to_numpy())
                labels = _similar(np.split(flat, ends[:-1]), s.similar)
                moved = np.flatnonzero(labels != np.arange(len(own)))
                if len(moved):
                    a.append(own[moved])
                    b.append(own[labels[moved]])
            if len(a) > 2000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return keyed(rows, ["bucket", "part"], ["paragraph"], verify, "a long, b long")


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of `k` words at every place, from prefix sums modulo 2**64."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(words) - 1, MULTIPLY)))
    back = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(words) - k, np.uint64(pow(int(MULTIPLY), -1, 1 << 64)))))
    sums = np.append(np.uint64(0), np.cumsum(words * powers, dtype=np.uint64))
    out = (sums[k:] - sums[:-k]) * back
    out ^= out >> np.uint64(31)
    return out * MULTIPLY


def _hashed(text: bytes) -> np.ndarray:
    return np.array([HASHED[w] for w in text.lower().split()], np.uint64)


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` neighbours the place of the least (of equal ones the first)."""
    best, span = np.arange(len(values)), 1

    def lesser(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[b] < values[a], b, a)

    while span * 2 <= width:
        best = lesser(best[: len(best) - span], best[span:])
        span *= 2
    return lesser(best[: len(best) - (width - span)], best[width - span :]) if span < width else best


def _shared(batches: Iterator[pa.RecordBatch], key: str, times: str) -> Iterator[pa.Table]:
    """Batches, sorted by `key`, without the rows whose key stands alone and whose `times` is 1; those of a key are never
    split."""
    rest: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None and batch.num_rows:
            rest.append(batch)
            keys = longs(batch, key)
            cut = int(np.searchsorted(keys, keys[-1]))
            if not cut and len(rest) > 1 and longs(rest[-2], key)[-1] == keys[-1]:
                continue
            ready = pa.Table.from_batches([*rest[:-1], batch.slice(0, cut)])
            rest = [batch.slice(cut)]
        elif batch is None and rest:
            ready = pa.Table.from_batches(rest)
        else:
            continue
        keys = ready.column(key).to_numpy()
        same = keys[1:] == keys[:-1]
        keep = np.append(False, same) | np.append(same, False) | (ready.column(times).to_numpy() > 1)
        if keep.any():
            yield ready.filter(pa.array(keep))


def passages(rows: DataFrame, s: Settings, gone: DataFrame | None = None) -> DataFrame:
    """(id, row, first, end, cluster, copies, kept): runs of words that stand, exactly, in more than one place of `rows`
    (id, row, text binary), wherever lines begin or end. Every run of `passage` words counts.

    The first place of each such run stays (`kept`); `cluster` is the row in which it stands. `gone` (row, gone) has
    spans of words that are taken out: a place with such a word never is the one that stays, and runs of nothing but
    such words are not looked at. Runs of half the size, least by hash among as many as fill a passage, are looked up
    first (equal passages have equal ones, so none is lost); around those that meet, all runs are compared.
    """
    n, k = s.passage, s.passage // 2
    kind = rows.schema["id"].dataType.simpleString()
    if gone is None:
        near = rows.withColumn("gone", F.lit(None).cast("array<struct<first:bigint,end:bigint>>"))
    else:
        spans = gone.agg(F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()[0]
        near = rows.join(F.broadcast(gone) if spans <= s.few else gone, "row", "left")

    def covered(n_words: int, gone: list | None) -> np.ndarray:
        """How many words before each place are gone."""
        out = np.zeros(n_words + 1, np.int64)
        for x in gone or ():
            out[x["first"] + 1 : x["end"] + 1] = 1
        return np.cumsum(out)

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 128):
            own, times, size = [], [], []
            for text, out in zip(column(batch, "text").to_pylist(), column(batch, "gone").to_pylist(), strict=True):
                words = _hashed(text)
                grams = _grams(words, k)
                some = np.zeros(0, np.int64)
                if len(grams) > n - k:
                    some = least_places(grams, n - k + 1)
                    if out:
                        lost = covered(len(words), out)
                        some = some[(lost[n:] - lost[:-n])[: len(some)] < n]
                # a run that comes again and again in a text is one row
                each, count = np.unique(grams[np.unique(some)], return_counts=True)
                own.append(each)
                times.append(count)
                size.append(len(each))
            if own:
                row = column(batch, "row").take(pa.array(np.repeat(np.arange(len(size)), size)))
                yield pa.RecordBatch.from_arrays([row, pa.array(np.concatenate(own).view(np.int64)), pa.array(np.concatenate(times).astype(np.int64))], ["row", "gram", "times"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _shared(batches, "gram", "times"):
            yield from some.select(["row", "gram"]).to_batches()

    found = keyed(near.select("row", "text", "gone").mapInArrow(anchor, "row long, gram long, times long"), ["gram"], ["row"], meet, "row long, gram long")
    hits = checkpointed(found.groupBy("row").agg(F.collect_set("gram").alias("hits")))
    texts = among(near, hits, "row", s.few).join(hits, "row").dropDuplicates(["row"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            size, made = [], []
            for text, hit, out in zip(column(batch, "text").to_pylist(), column(batch, "hits").to_pylist(), column(batch, "gone").to_pylist(), strict=True):
                words = _hashed(text)
                grams, short = _grams(words, n), _grams(words, k)
                lost = covered(len(words), out)
                at = np.unique(least_places(short, n - k + 1))
                at = at[np.isin(short[at].view(np.int64), np.array(hit, np.int64))]
                here = np.unique(at[:, None] - np.arange(n - k + 1))
                here = here[(here >= 0) & (here < len(grams))]
                here = here[lost[here + n] - lost[here] < n]
                size.append(len(here))
                made.append((here, grams[here].view(np.int64), lost[here + n] > lost[here]))
            if sum(size):
                take = pa.array(np.repeat(np.arange(len(size)), size))
                cols = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*made, strict=True)]
                yield pa.RecordBatch.from_arrays([column(batch, "id").take(take), column(batch, "row").take(take), *cols], ["id", "row", "at", "gram", "lost"])

    runs = checkpointed(texts.select("id", "row", "text", "hits", "gone").mapInArrow(expand, f"id {kind}, row long, at long, gram long, lost long"))
    order = F.struct("lost", F.col("id").isNull().alias("none"), "id", "row", "at")
    first = runs.groupBy("gram").agg(F.min(order).alias("f"), F.count("*").alias("copies")).where("copies > 1 and f.lost = 0")
    first = first.select(apart("gram").alias("key"), "copies", F.col("f.row").alias("home"), F.col("f.at").alias("from"))
    placed = runs.drop("lost").join(first, F.col("gram") == F.col("key")).drop("key").withColumn("shift", F.col("at") - F.col("from"))
    # runs that follow each other and have their first places one after another are one passage
    island = F.col("at") - F.row_number().over(W.partitionBy("row", "home", "shift").orderBy("at"))
    spans = placed.withColumn("island", island).groupBy("row", "home", "shift", "island").agg(F.first("id").alias("id"), F.min("at").alias("first"), (F.max("at") + n).alias("end"), F.max("copies").alias("copies"))
    return spans.select("id", "row", "first", "end", F.col("home").alias("cluster"), "copies", ((F.col("home") == F.col("row")) & (F.col("shift") == 0)).alias("kept"))


def _without(text: str, out: list, stay: list) -> tuple[str, int]:
    """A text without the words of the spans `out` that are not in `stay`, and how many are gone. Lines of which no
    word is left are gone; the others keep what stands before their first word."""
    words = np.zeros(max(x["end"] for x in [*out, *stay]), bool)
    for flag, some in ((True, out), (False, stay)):
        for x in some:
            words[x["first"] : x["end"]] = flag
    kept, at = [], 0
    for line in text.encode().split(b"\n"):
        found = [m.start() for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", line)]
        flags = words[at : at + len(found)]
        at += len(found)
        if flags.any():
            if len(flags) == len(found) and flags.all():
                continue
            ends = [*found[1:], len(line)]
            line = line[: found[0]] + b"".join(line[a:b] for j, (a, b) in enumerate(zip(found, ends, strict=True)) if j >= len(flags) or not flags[j])
        kept.append(line)
    return b"\n".join(kept).decode(), int(words.sum())


def _rows(docs: DataFrame, text: str, id: str) -> DataFrame:
    return lean(docs).select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), F.xxhash64(F.col(id), F.col(text)).alias("row"))


def _repeated(rows: DataFrame, s: Settings) -> DataFrame:
    found = checkpointed(places(rows, s))
    same = components(links(rows, found, s))
    named = found.join(same, found["paragraph"] == same["node"], "left").select("id", "row", "first", "end", F.coalesce("component", "paragraph").alias("cluster"))
    named = named.distinct()
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row", "first")
    lead = named.groupBy("cluster").agg(F.count("*").alias("copies"), F.min(order).alias("lead")).where("copies > 1")
    kept = (F.col("row") == F.col("lead.row")) & (F.col("first") == F.col("lead.first"))
    return named.join(lead, "cluster").select("id", "row", "first", "end", "cluster", "copies", kept.alias("kept"))


def repeated(docs: DataFrame, text: str = "text", id: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """(id, row, first, end, cluster, copies, kept): the places, from word `first` up to `end`, of paragraphs that stand
    in more than one place.

    `row` is a hash of id and text, which ties a place to its row; rows that are equal in both count as one place and
    are treated alike. `cluster` names a component of paragraphs, `copies` counts its places, `kept` marks the one
    that stays: that of the smallest id (null ids come last), then the first word. Null and empty texts have no
    paragraphs; an empty table gives no rows.
    """
    return _repeated(_rows(docs, text, id), settings).withColumnRenamed("id", id)


def everything(docs: DataFrame, text: str = "text", id: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """`repeated` and the passages that it leaves, in one table with `kind`: paragraph or passage. Checkpointed."""
    rows = _rows(docs, text, id)
    lines = checkpointed(_repeated(rows, settings))
    gone = checkpointed(lines.where("not kept").groupBy("row").agg(F.collect_list(F.struct("first", "end")).alias("gone")))
    runs = passages(rows, settings, gone)
    return checkpointed(lines.withColumn("kind", F.lit("paragraph")).union(runs.withColumn("kind", F.lit("passage"))).withColumnRenamed("id", id))


def remove_repeats(docs: DataFrame, text: str = "text", id: str = "doc_id", settings: Settings = Settings(), count: str = "n_removed") -> DataFrame:
    """`docs` with the words of every repeated paragraph and passage taken out of `text` but in the place that stays,
    and `count`, the number of words gone. A word of a passage that stays is never taken out by another that holds it;
    a paragraph that stays can lose a passage of which the place that stays is elsewhere.

    Texts without such a paragraph or passage stay as they are, byte for byte; null texts stay null. Equal rows are
    treated alike. Other columns are untouched, whatever their names.
    """
    found = everything(docs, text, id, settings)
    span = F.struct("first", "end")
    by = found.groupBy(F.col("row").alias("__row")).agg(F.collect_list(F.when(~F.col("kept"), span)).alias("__out"), F.collect_list(F.when(F.col("kept") & (F.col("kind") == "passage"), span)).alias("__stay"))
    by = checkpointed(by.where(F.size("__out") > 0))
    spans = by.agg(F.coalesce(F.sum(F.size("__out") + F.size("__stay")), F.lit(0))).first()[0]
    joined = docs.withColumn("__row", F.xxhash64(F.col(id), F.col(text))).join(F.broadcast(by) if spans <= settings.few else by, "__row", "left")
    cut = F.udf(lambda text, *spans: None if text is None else _without(text, *spans), "text string, words int")
    joined = joined.withColumn("__cut", cut(F.when(F.col("__out").isNotNull(), F.col(text)), "__out", "__stay"))
    changed = F.when(F.col("__out").isNull(), F.col(text)).otherwise(F.col("__cut.text"))
    n = F.when(F.col("__out").isNull(), 0).otherwise(F.col("__cut.words"))
    return joined.withColumns({text: changed, count: n}).drop("__row", "__out", "__stay", "__cut")


def op3_paragraphs(spark, sf_dir: str) -> DataFrame:
    """Places of the paragraphs that repeat, exactly or nearly, and of the equal runs of 50 words that they leave, across
    or within documents, from `first_word` up to `end_word`."""
    from .common import table

    found = everything(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "kind", F.col("first").alias("first_word"), F.col("end").alias("end_word"), F.col("cluster").alias("cluster_id"), "copies", "kept")
