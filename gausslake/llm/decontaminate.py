"""Benchmark decontamination by embedded edit distance.

Items and texts are sequences of words. Both are cut into windows of a few lengths, powers of two up to the size of an
item: items at every place, texts at every three eighths of a window, so that each occurrence of an item lies on several pairs
of windows. The CGK random walk embeds a window so that edit distance becomes Hamming distance; a table samples a few
places of an embedding, and windows of which some table agrees in all its places are candidates. Repeated walks and
tables, and the several windows of an item, bring the recall to its target; exact edit distance of the whole item
verifies.

The benchmark stays a table: its keys are joined, and only a filter of bounded size goes to the tasks that read texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, column, keyed, lean, longs, pieces

#: Fixed value: a word.
WORD = re.compile(r"[^\W_]+")
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Multipliers that place the five bits of a key in the filter.
SPOTS = tuple(np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F], np.uint64))


@dataclass(frozen=True)
class Settings:
    """Edits up to the share `edits` of an item's words; `walks` embeddings, each sampled by `tables` of `places`.

    Measured over random edits (a third each replaced, inserted, deleted): 0.98 and more of the items of 10 to 200 words
    are found at 20 % edits, 0.9 of those of 5 words, all with fewer. `filter_bits` bounds the filter of keys that goes to all tasks: 2**28 bits are 32 MB. A benchmark with more keys
    than it tells apart lets more windows through to the join, which decides; nothing is lost. Up to `few` texts that
    match are sent to all tasks when rows are looked up; more are joined.
    """

    edits: float = 0.2
    walks: int = 3
    tables: int = 8
    places: int = 4
    filter_bits: int = 28
    salts: int = 8
    few: int = 500_000
    seed: int = 42


class WordHasher(dict):
    """Word to its 64-bit hash; forgets everything beyond a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 13) | 1
        if len(word) <= 64:
            self[word] = value
        return value


HASHED = WordHasher()


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text, none of them 0."""
    found = WORD.findall(text.lower())
    return np.fromiter(map(HASHED.__getitem__, found), np.uint64, len(found))


def stride(width: int) -> int:
    """How far apart windows of a text start."""
    return max(1, 3 * width // 8)


def width_of(sizes: np.ndarray) -> np.ndarray:
    """Window length for items of some sizes: the largest power of two such that an unchanged copy, wherever it starts,
    holds two whole windows of the text (one where windows start at every word)."""
    out = np.ones(len(sizes), np.int64)
    width = 2
    while len(sizes) and width <= sizes.max():
        step = stride(width)
        out[width + (2 * step - 1 if step > 1 else 0) <= sizes] = width
        width *= 2
    return out


def sampled(width: int, walk: int, s: Settings) -> np.ndarray:
    """Steps that the tables of a walk look at (tables x places). The first table of each walk looks at places which no
    walk can have left the window for."""
    random = np.random.default_rng((s.seed, width, walk))
    places = min(s.places, width - 1 if width > 2 else width)
    steps = np.sort(random.integers(0, max(1, int(1.6 * width)), (s.tables, places)), axis=1)
    steps[0] = np.minimum(np.arange(places) * (width // 4), width - 1)
    return steps


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= K2
    x ^= x >> np.uint64(29)
    return x


def embedded_keys(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int, walk: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Table keys (tables x windows) of the windows from `starts` on, and whether all sampled places lay before `ends`.

    The CGK walk: at each step a random bit of the word under the pointer, chosen anew for each step, says whether the
    pointer moves on. Bits of 64 steps come from one mixture of the word. A table never looks at a word twice: where the
    pointer has not moved on since its last place, the next word counts; a key of one frequent word would say nothing.
    """
    steps = sampled(width, walk, s)
    most = int(steps.max())
    salts = np.random.default_rng((s.seed, width, walk, 1)).integers(0, 1 << 63, most // 64 + 1, dtype=np.uint64)
    names = np.arange(s.tables, dtype=np.uint64) + np.uint64((width * 64 + walk) * 4096)
    keys = np.repeat(_mixed(names * K1)[:, None], len(starts), axis=1)
    # pointers may run past the last word, where there are zeros
    words = np.concatenate((words, np.zeros(most + s.places + 2, np.uint64)))
    at, last, seen = starts.astype(np.int64), np.repeat(starts[None] - 1, s.tables, axis=0), np.empty(len(starts), np.uint64)
    looks: dict[int, list[int]] = {}
    for t, row in enumerate(steps.tolist()):
        for j in row:
            looks.setdefault(j, []).append(t)
    bits = np.zeros(0, np.uint64)
    for j in range(most + 1):
        if j % 64 == 0:
            bits = _mixed(words ^ salts[j // 64])
        for t in looks.get(j, ()):
            spot, key = last[t], keys[t]
            spot += 1
            np.maximum(spot, at, out=spot)
            key += words.take(spot, out=seen, mode="clip")
            key *= K1
        bits.take(at, out=seen, mode="clip")
        seen >>= np.uint64(j % 64)
        seen &= np.uint64(1)
        at += seen.view(np.int64)
    return _mixed(keys), last < ends


def edit_distances(items: np.ndarray, sizes: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least edits, place after the match) of each item (row, its first `sizes` words) against any part of its region."""
    n, width = regions.shape
    across = np.arange(width + 1, dtype=np.int32)
    row = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(int(sizes.max())):
        new = row + 1
        new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + (regions != items[:, i : i + 1]))
        row = np.minimum.accumulate(new - across, axis=1) + across
        done = sizes == i + 1
        if done.any():
            best[done], end[done] = row[done].min(1), row[done].argmin(1)
    return best, end


def benchmark_items(benchmark: DataFrame, text: str, id: str) -> DataFrame:
    """(item, words, size) of the items with an id and with words: word hashes as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 512):
            rows = [(i, w) for i, w in zip(longs(batch, "item").tolist(), map(word_hashes, column(batch, "body").to_pylist()), strict=True) if len(w)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([w.tobytes() for _, w in rows], pa.binary()), pa.array([len(w) for _, w in rows], pa.int64())], ["item", "words", "size"])

    rows = benchmark.where(F.col(id).isNotNull() & F.col(text).isNotNull()).select(F.col(id).cast("long").alias("item"), F.col(text).alias("body"))
    return lean(rows).mapInArrow(work, "item long, words binary, size long").distinct().withColumn("own", F.xxhash64("item", "words"))


def item_keys(items: DataFrame, s: Settings) -> DataFrame:
    """(key, own, offset): table keys of all windows of all items."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            all_words = [np.frombuffer(w, np.uint64) for w in column(batch, "words").to_pylist()]
            sizes = np.array([len(w) for w in all_words])
            widths, base = width_of(sizes), np.cumsum(sizes) - sizes
            words, own = np.concatenate(all_words), longs(batch, "own")
            for width in np.unique(widths).tolist():
                some = np.flatnonzero(widths == width)
                of = np.repeat(some, sizes[some] - width + 1)
                offset = np.concatenate([np.arange(sizes[k] - width + 1) for k in some])
                for walk in range(s.walks):
                    keys, inside = embedded_keys(words, base[of] + offset, (base + sizes)[of], width, walk, s)
                    for t in range(s.tables):
                        good = inside[t]
                        yield pa.RecordBatch.from_arrays([pa.array(keys[t][good].view(np.int64)), pa.array(own[of][good]), pa.array(offset[good])], ["key", "own", "offset"])

    return items.mapInArrow(work, "key long, own long, offset long")


def key_filter(keys: DataFrame, bits: int, rows: int = 1 << 17) -> list[tuple[int, bytes]]:
    """Five bits of each key set in a field of 2**bits, as blocks of bytes: what reaches the driver is bounded by `bits`."""
    block = min(bits, 20)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, rows):
            spots = np.unique(_spots(longs(batch, "key").view(np.uint64), bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(spots >> block), pa.array(spots & ((1 << block) - 1))], ["block", "spot"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, at = np.zeros(1 << block, bool), -1
        for batch in batches:
            own, spots = longs(batch, "block"), longs(batch, "spot")
            for k in np.unique(own).tolist():
                if k != at:
                    if at >= 0:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(field, bitorder="little").tobytes()], pa.binary())], ["block", "field"])
                    field, at = np.zeros(1 << block, bool), k
                field[spots[own == k]] = True
        if at >= 0:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(field, bitorder="little").tobytes()], pa.binary())], ["block", "field"])

    spots = keys.select("key").mapInArrow(spread, "block long, spot long").distinct()
    return [tuple(r) for r in keyed(spots, ["block"], [], gather, "block long, field binary").collect()]


def _spots(keys: np.ndarray, bits: int) -> np.ndarray:
    """Five bit numbers of each key, one after another."""
    shift = np.uint64(64 - bits)
    return np.concatenate([(keys * c) >> shift for c in SPOTS])


def _passes(field: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Places of the keys whose five bits are all set in a packed field."""
    shift, left = np.uint64(64 - bits), None
    for c in SPOTS:
        spot = keys * c if left is None else keys[left] * c
        spot >>= shift
        byte = field.take((spot >> np.uint64(3)).view(np.int64), mode="clip")
        byte >>= (spot & np.uint64(7)).astype(np.uint8)
        byte &= 1
        found = np.flatnonzero(byte)
        left = found if left is None else left[found]
        if not len(left):
            break
    return left


def window_hits(texts: DataFrame, widths: list[int], shared, bits: int, s: Settings, chunk: int = 1 << 14) -> DataFrame:
    """(hit, tid, more, at, region, first, keys) for windows of `texts` (tid, more, text) of which a key passes the filter.

    `region` holds the word hashes around the window, in which an occurrence of an item of that class lies wholly,
    `first` the place in the text of the first of them, `at` that of the window. Windows start at multiples of their
    stride from the first word of a text, so what is found does not depend on how rows are dealt out.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.frombuffer(b"".join(shared.value), np.uint8)
        for batch in pieces(batches, 256):
            # copies of a text in a batch are one; the others meet again when candidates are made distinct
            names = list(zip(longs(batch, "tid").tolist(), longs(batch, "more").tolist(), strict=True))
            batch = batch.take(pa.array(list({name: i for i, name in enumerate(names)}.values()), pa.int64()))
            all_words = list(map(word_hashes, column(batch, "text").to_pylist()))
            sizes = np.array([len(w) for w in all_words])
            if not sizes.sum():
                continue
            words, base = np.concatenate(all_words), np.cumsum(sizes) - sizes
            tid, more = longs(batch, "tid"), longs(batch, "more")
            for width in widths:
                counts = -(-sizes // stride(width))
                of = np.repeat(np.arange(len(sizes)), counts)
                starts = base[of] + (np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)) * stride(width)
                ends = (base + sizes)[of]
                for lo in range(0, len(starts), chunk):
                    own, own_of, own_ends = starts[lo : lo + chunk], of[lo : lo + chunk], ends[lo : lo + chunk]
                    first = int(own[0])
                    near = words[first : int(own[-1]) + 2 * width + 1]
                    window, key = [], []
                    for walk in range(s.walks):
                        keys, inside = embedded_keys(near, own - first, own_ends - first, width, walk, s)
                        for t in range(s.tables):
                            hit = _passes(field, keys[t], bits)
                            hit = hit[inside[t][hit]]
                            if len(hit):
                                window.append(hit)
                                key.append(keys[t][hit])
                    if not window:
                        continue
                    at, key = np.concatenate(window), np.concatenate(key).view(np.int64)
                    order = np.lexsort((key, at))
                    at, key = at[order], key[order]
                    cut = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                    each = at[cut]
                    text, spot = own_of[each], own[each]
                    begin = np.maximum(spot - 2 * width - 4, base[text])
                    stop = np.minimum(spot + 3 * width + 4, own_ends[each])
                    regions = [words[a:b].tobytes() for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
                    lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(key)).astype(np.int32)), pa.array(key))
                    yield pa.RecordBatch.from_arrays([pa.array(tid[text]), pa.array(more[text]), pa.array(spot - base[text]), pa.array(regions, pa.binary()), pa.array(begin - base[text]), lists], ["tid", "more", "at", "region", "first", "keys"])

    found = texts.select("tid", "more", "text").mapInArrow(work, "tid long, more long, at long, region binary, first long, keys array<long>")
    return found.withColumn("hit", F.xxhash64("tid", "more", "at", "region"))


def verify(candidates: DataFrame, s: Settings) -> DataFrame:
    """(tid, more, item, size, edits, last) of candidates (tid, more, at, region, first, offset, item, words, size) that
    hold their item with the permitted edits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1024):
            at, first, offset, size = (longs(batch, c) for c in ("at", "first", "offset", "size"))
            around = [np.frombuffer(r, np.uint64) for r in column(batch, "region").to_pylist()]
            items = [np.frombuffer(w, np.uint64) for w in column(batch, "words").to_pylist()]
            allowed = (s.edits * size).astype(np.int64)
            begin = np.maximum(at - first - offset - allowed, 0)
            end = np.minimum(at - first - offset + size + allowed, [len(r) for r in around])
            regions = np.zeros((len(size), max(1, int((end - begin).max()))), np.uint64)
            padded = np.ones((len(size), int(size.max())), np.uint64)
            for k in range(len(size)):
                regions[k, : end[k] - begin[k]] = around[k][begin[k] : end[k]]
                padded[k, : size[k]] = items[k]
            edits, stop = edit_distances(padded, size, regions)
            good = np.flatnonzero(edits <= allowed)
            if len(good):
                take = pa.array(good)
                ids = [column(batch, c).take(take) for c in ("tid", "more", "item", "size")]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(edits[good].astype(np.int64)), pa.array((first + begin + stop)[good])], ["tid", "more", "item", "size", "edits", "last"])

    return candidates.mapInArrow(work, "tid long, more long, item long, size long, edits long, last long")


def _identified(docs: DataFrame, text: str) -> DataFrame:
    """`docs` with two hashes of the text, which together name it."""
    return docs.withColumns({"__tid": F.xxhash64(F.col(text)), "__more": F.xxhash64(F.col(text), F.lit(1))})


def occurrences(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", settings: Settings = Settings()) -> DataFrame:
    """(tid, more, item_id, edits, last_word, n_words): the best match (fewest edits, then the first) of each item in
    each text that holds it with at most the permitted edits; a text is named by two hashes of it, equal texts are one.

    Null and empty texts and items hold nothing. A text of which a third of all rows are copies is one text here; an
    item that stands in a third of all different texts is dealt out by the hash of the window.
    """
    s, spark = settings, docs.sparkSession
    items = checkpointed(benchmark_items(benchmark, item_text, item_id))
    sized = [r["size"] for r in items.groupBy("size").count().select("size").collect()]
    schema = "tid long, more long, item_id long, edits long, last_word long, n_words long"
    if not sized:
        return spark.createDataFrame([], schema)
    keys = checkpointed(item_keys(items, s).distinct())
    bits = min(s.filter_bits, max(16, int(np.ceil(np.log2(64 * keys.count())))))
    size = 1 << (min(bits, 20) - 3)
    made = dict(key_filter(keys, bits))
    shared = spark.sparkContext.broadcast([made.get(k, bytes(size)) for k in range(1 << max(0, bits - 20))])
    widths = np.unique(width_of(np.array(sized))).tolist()
    texts = lean(_identified(docs.select(F.col(text).alias("text")).where("text is not null"), "text")).select(F.col("__tid").alias("tid"), F.col("__more").alias("more"), "text")
    hits = checkpointed(window_hits(texts, widths, shared, bits, s))
    salt = F.pmod(F.col("hit"), F.lit(s.salts))
    copies = F.explode(F.sequence(F.lit(0), F.lit(s.salts - 1)).cast("array<bigint>")).alias("salt")
    asked = hits.select("hit", salt.alias("salt"), F.explode("keys").alias("key"))
    met = asked.join(keys.select("*", copies), ["key", "salt"]).select("hit", "salt", "own", "offset").distinct()
    near = met.join(items.select("own", "item", "words", "size", copies), ["own", "salt"]).drop("salt")
    # a window of an occurrence is enough once: of neighbouring ones those that expect the item at the same place are one
    near = near.join(hits.drop("keys"), "hit").withColumn("from", F.col("at") - F.col("offset")).dropDuplicates(["tid", "more", "item", "own", "from"])
    verified = verify(near, s)
    best = verified.groupBy("tid", "more", "item").agg(F.min(F.struct("edits", "last", "size")).alias("b"))
    return best.select("tid", "more", F.col("item").alias("item_id"), F.col("b.edits").alias("edits"), F.col("b.last").alias("last_word"), F.col("b.size").alias("n_words"))


def matches(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text: str = "text", item_text: str = "text", item_id: str = "item_id", settings: Settings = Settings(), name: str = "matches") -> DataFrame:
    """`keep` columns of `docs` (default doc_id) with `name`, an array of (item_id, edits, last_word, n_words).

    One entry for each item that stands in the text with at most the permitted edits, by item_id; `last_word` is the
    place after its last word. Null and empty texts, and an empty benchmark, give empty arrays. Every row keeps its
    row. Items with a null id, a null text or no word are left out; of items with equal ids the best match counts.
    """
    keep = keep or ["doc_id"]
    found = occurrences(docs, benchmark, text, item_text, item_id, settings)
    per = found.groupBy("tid", "more").agg(F.array_sort(F.collect_list(F.struct("item_id", "edits", "last_word", "n_words"))).alias("__found"))
    rows = _identified(docs, text).select(*keep, "__tid", "__more")
    joined = rows.join(per.withColumnsRenamed({"tid": "__tid", "more": "__more"}), ["__tid", "__more"], "left")
    none = F.array().cast("array<struct<item_id:bigint,edits:bigint,last_word:bigint,n_words:bigint>>")
    return joined.select(*keep, F.coalesce("__found", none).alias(name))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of `docs` in whose text no item stands; all columns, whatever their names; null and empty texts stay.

    Up to `settings.few` matching texts (counted) are sent to all tasks, so the texts aren't shuffled; more are joined.
    """
    found = checkpointed(occurrences(docs, benchmark, text, settings=settings).select(F.col("tid").alias("__tid"), F.col("more").alias("__more")).distinct())
    if found.limit(settings.few + 1).count() <= settings.few:
        found = F.broadcast(found)
    return _identified(docs, text).join(found, ["__tid", "__more"], "left_anti").select(*docs.columns)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, and which."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    found = occurrences(docs, table(spark, sf_dir, "benchmark"))
    rows = _identified(docs, "text").select("doc_id", F.col("__tid").alias("tid"), F.col("__more").alias("more"))
    return rows.join(found, ["tid", "more"]).select("doc_id", "item_id", "edits", "last_word", "n_words")
