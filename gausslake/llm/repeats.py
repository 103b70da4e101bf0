"""Repeated byte strings by bucket-pointer refinement.

A position's bucket at some depth is the class of positions whose next bytes agree that far. Buckets of short q-grams
are refined to twice the depth by pairing a position's bucket with that of a later offset, and the refined buckets are
used again for the next depth, up to the wanted length L. Bucket identifiers are 64-bit mixtures of content, so they
agree between tasks without a global renaming.

Only few positions are sorted across the cluster. Each window of L bytes points at the position with the least bucket
of depth ceil(L/2) in it; equal windows point at equal buckets at the same place. Windows in a row that share their
pointer form a run. Runs are shuffled by that bucket, sorted by the buckets at their two ends, and
- runs whose ends fall into the same buckets are equal as a whole: all their windows are repeated;
- where a bucket holds different runs, one run of each kind brings its bytes, and the windows are refined to depth L.
Equal runs of one batch are combined before the shuffle, so a passage that most texts share sends few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, column, lean, longs, portions

K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
S29, S32 = np.uint64(29), np.uint64(32)
#: Bytes that a worker refines at once, and different runs of one bucket that one task compares.
SEGMENT, CROWD = 1 << 19, 4096
#: Bytes of texts among which equal runs are combined before the shuffle.
COMBINE = 1 << 23
RUN = "kind int, key long, ctx long, tid long, lo long, hi long, at long, done boolean"
SPAN = "kind int, key long, tid long, lo long, hi long, at long, need boolean"


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One identifier for each pair of identifiers."""
    x = a * K1
    x += b
    x ^= x >> S29
    x *= K2
    x ^= x >> S32
    return x


def depths(length: int) -> list[int]:
    """Depths from the initial q-grams (at most 7 bytes, held exactly) to `length`, each at most twice the one before."""
    out = [length]
    while out[-1] > 7:
        out.append(-(-out[-1] // 2))
    return out[::-1]


def refine(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all positions at depth ceil(length/2) and at depth `length` (each as long as there are bytes for)."""
    steps = depths(length)
    q = steps[0]
    n = len(data) - q + 1
    own = data[:n].astype(np.uint64)
    for j in range(1, q):
        own <<= np.uint64(8)
        own |= data[j : j + n]
    half = own
    for depth, deeper in zip(steps, steps[1:]):
        offset = deeper - depth
        half, own = own, mix(own[: len(own) - offset], own[offset:])
    return half, own


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each `width` neighbours."""
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    if span < width:
        out = np.minimum(out[: len(out) - (width - span)], out[width - span :])
    return out


def segments(texts: list[bytes], tids: list[int], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined to about SEGMENT bytes: (bytes, start of each part, its text id, its place in the text).

    A longer text is cut into parts that overlap by length - 1 bytes, so each window is in exactly one part.
    """
    parts: list[tuple[bytes, int, int]] = []
    size = 0

    def joined():
        starts = np.cumsum([0, *(len(p[0]) for p in parts)])
        return np.frombuffer(b"".join(p[0] for p in parts), np.uint8), starts, np.array([p[1] for p in parts], np.int64), np.array([p[2] for p in parts], np.int64)

    for text, tid in zip(texts, tids, strict=True):
        for at in range(0, len(text) - length + 1, SEGMENT):
            part = text[at : at + SEGMENT + length - 1]
            parts.append((part, tid, at))
            size += len(part)
            if size >= SEGMENT:
                yield joined()
                parts, size = [], 0
    if parts:
        yield joined()


def runs(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(part, first window, last window, pointer, bucket of the pointer, bucket of the run) of the runs of windows."""
    half, full = refine(data, length)
    depth = -(-length // 2)
    spots = np.arange(len(half), dtype=np.uint64)
    pointer = (sliding_least((half & np.uint64(0xFFFFFFFF00000000)) | spots, length - depth + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    part = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(full)]
    valid = np.arange(len(full)) + length <= starts[part + 1]
    windows = np.flatnonzero(valid)
    fresh = np.ones(len(windows), bool)
    fresh[1:] = (pointer[windows[1:]] != pointer[windows[:-1]]) | (part[windows[1:]] != part[windows[:-1]])
    first = np.flatnonzero(fresh)
    lo, hi = windows[first], windows[np.append(first[1:], len(windows)) - 1] if len(first) else windows
    at = pointer[lo]
    shape = ((at - lo) * (length + 1) + (hi - lo)).astype(np.uint64)
    return part[lo], lo, hi, at, half[at], mix(mix(full[lo], full[hi]), shape)


def _spans(tid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half-open spans merged where they touch in the same text."""
    if not len(tid):
        return tid, lo, hi
    order = np.lexsort((lo, tid))
    tid, lo, hi = tid[order], lo[order], hi[order]
    # ends only grow within a text once they are accumulated; shift texts apart to do all of them at once
    group = np.cumsum(np.append(True, tid[1:] != tid[:-1])) - 1
    width = int(hi.max()) + 2
    reach = np.maximum.accumulate(hi + group * width) - group * width
    fresh = np.append(True, (tid[1:] != tid[:-1]) | (lo[1:] > reach[:-1]))
    first = np.flatnonzero(fresh)
    return tid[first], lo[first], reach[np.append(first[1:], len(tid)) - 1]


def _changes(*cols: np.ndarray) -> np.ndarray:
    out = np.ones(len(cols[0]), bool)
    if len(out):
        out[1:] = False
        for c in cols:
            out[1:] |= c[1:] != c[:-1]
    return out


def _batch(schema: list[str], *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema)


RUN_NAMES = [x.split()[0] for x in RUN.split(", ")]
SPAN_NAMES = [x.split()[0] for x in SPAN.split(", ")]


def _find(length: int):
    """Runs of each batch of texts, one of each kind; spans of kinds that the batch already holds twice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", COMBINE):
            found: list[tuple[np.ndarray, ...]] = []
            texts, tids = column(batch, "text").to_pylist(), longs(batch, "tid").tolist()
            for data, starts, own, base in segments(texts, tids, length):
                part, lo, hi, at, key, ctx = runs(data, starts, length)
                place = base[part] - starts[part]
                found.append((own[part], lo + place, hi + place, at + place, key.view(np.int64), ctx.view(np.int64)))
            if not found:
                continue
            tid, lo, hi, at, key, ctx = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((ctx, key))
            fresh = _changes(key[order], ctx[order])
            group = np.cumsum(fresh) - 1
            several = np.bincount(group)[group] > 1
            twice = order[several]
            if len(twice):
                t, a, b = _spans(tid[twice], lo[twice], hi[twice] + length)
                zero = np.zeros(len(t), np.int64)
                yield _batch(RUN_NAMES, np.zeros(len(t), np.int32), t, zero, t, a, b, zero, np.ones(len(t), bool))
            one = order[fresh]
            yield _batch(RUN_NAMES, np.ones(len(one), np.int32), key[one], ctx[one], tid[one], lo[one], hi[one], at[one], several[fresh])

    return work


def _meet(length: int):
    """From runs sorted by bucket: spans (kind 0) of runs that are equal as a whole, and one run of each kind (kind 1)
    of buckets that hold different ones. `need` marks kinds that are still single."""

    def sift(t: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        ready = t["kind"] == 0
        if ready.any():
            t0 = {k: v[ready] for k, v in t.items()}
            yield _batch(SPAN_NAMES, t0["kind"], t0["key"], t0["tid"], t0["lo"], t0["hi"], t0["at"], t0["done"])
            t = {k: v[~ready] for k, v in t.items()}
        if not len(t["key"]):
            return
        by_key, by_run = _changes(t["key"]), _changes(t["key"], t["ctx"])
        run = np.cumsum(by_run) - 1
        size, done = np.bincount(run), np.bincount(run, weights=t["done"]) > 0
        repeated = (size > 1) | done
        tell = repeated[run] & ~t["done"]
        if tell.any():
            tid, lo, hi = _spans(t["tid"][tell], t["lo"][tell], t["hi"][tell] + length)
            zero = np.zeros(len(tid), np.int64)
            yield _batch(SPAN_NAMES, np.zeros(len(tid), np.int32), zero, tid, lo, hi, zero, np.ones(len(tid), bool))
        bucket = (np.cumsum(by_key) - 1)[by_run]
        mixed = np.bincount(bucket)[bucket] > 1
        # a bucket all of whose kinds are repeated asks for nothing more
        asked = np.bincount(bucket, weights=~repeated)[bucket] > 0
        pick = np.flatnonzero(by_run)[mixed & asked]
        if len(pick):
            yield _batch(SPAN_NAMES, np.ones(len(pick), np.int32), t["key"][pick], t["tid"][pick], t["lo"][pick], t["hi"][pick], t["at"][pick], ~repeated[mixed & asked])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # pieces of the last bucket so far; they are put together once, however many batches it fills
        rest: list[dict[str, np.ndarray]] = []

        def whole() -> dict[str, np.ndarray]:
            return {k: np.concatenate([t[k] for t in rest]) for k in RUN_NAMES}

        for batch in batches:
            if not batch.num_rows:
                continue
            t = {k: column(batch, k).to_numpy(zero_copy_only=False) for k in RUN_NAMES}
            last = int(np.flatnonzero(_changes(t["kind"], t["key"]))[-1])
            if rest and not last and all(rest[-1][k][-1] == t[k][0] for k in ("kind", "key")):
                rest.append(t)
                continue
            rest.append({k: v[:last] for k, v in t.items()})
            yield from sift(whole())
            rest = [{k: v[last:] for k, v in t.items()}]
        if rest:
            yield from sift(whole())

    return work


def _cut(length: int):
    """The bytes of the runs that a text has to bring."""
    names = ["key", "tid", "lo", "hi", "need", "bytes"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", COMBINE):
            out: list[tuple] = []
            for text, tid, wanted in zip(column(batch, "text").to_pylist(), longs(batch, "tid").tolist(), column(batch, "wanted").to_pylist(), strict=True):
                out += [(w["key"], tid, w["lo"], w["hi"], w["need"], text[w["lo"] : w["hi"] + length]) for w in wanted]
            if out:
                kinds = [pa.int64()] * 4 + [pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return work


def _windows(rows: list[tuple[np.ndarray, ...]], length: int) -> tuple[np.ndarray, ...]:
    """(identifier, row, window start) of all windows of some runs; the identifier holds the bucket key."""
    key, lo, hi, texts = rows
    sizes = np.array([len(x) for x in texts])
    starts = np.cumsum(np.append(0, sizes))
    _, full = refine(np.frombuffer(b"".join(texts), np.uint8), length)
    each = hi - lo + 1
    row = np.repeat(np.arange(len(key)), each)
    step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    return mix(full[starts[row] + step], key[row].view(np.uint64)), row, lo[row] + step


def _compare(length: int):
    """Spans of single runs whose windows occur in other runs of their bucket; whole buckets, sorted by key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(tables: list[pa.Table]) -> pa.RecordBatch | None:
            t = pa.concat_tables(tables)
            key, tid, lo, hi, need = (t.column(c).to_numpy() for c in ("key", "tid", "lo", "hi", "need"))
            ids, row, start = _windows((key, lo, hi, t.column("bytes").to_pylist()), length)
            _, back, n = np.unique(ids, return_inverse=True, return_counts=True)
            hit = (n[back] > 1) & need[row]
            if not hit.any():
                return None
            a, b, c = _spans(tid[row[hit]], start[hit], start[hit] + length)
            zero = np.zeros(len(a), np.int64)
            return _batch(SPAN_NAMES, np.zeros(len(a), np.int32), zero, a, b, c, zero, np.ones(len(a), bool))

        rest: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            key = t.column("key").to_numpy()
            last = int(np.flatnonzero(_changes(key))[-1])
            same = bool(rest) and rest[-1].column("key")[-1].as_py() == key[0]
            if last or (rest and not same):
                if last:
                    rest.append(t.slice(0, last))
                if (made := solve(rest)) is not None:
                    yield made
                rest = [t.slice(last)]
            else:
                rest.append(t)
        if rest and (made := solve(rest)) is not None:
            yield made

    return work


def _crowded(length: int):
    """All windows of runs, one row each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                b = batch.slice(k, 2048)
                ids, row, start = _windows((longs(b, "key"), longs(b, "lo"), longs(b, "hi"), column(b, "bytes").to_pylist()), length)
                yield _batch(["id", "tid", "lo", "need"], ids.view(np.int64), longs(b, "tid")[row], start, column(b, "need").to_numpy(zero_copy_only=False)[row])

    return work


def repeated_spans(texts: DataFrame, length: int = 200) -> DataFrame:
    """(tid, spans) for a table (tid long, text binary): half-open byte spans covered by a string of `length` bytes
    that also starts elsewhere in the table, in the same text or another. Texts without one are absent.

    Rows with the same tid must hold the same text; each of them counts as a place of its own.
    """
    found = texts.mapInArrow(_find(length), RUN)
    met = found.repartition("key").sortWithinPartitions("kind", "key", "ctx").mapInArrow(_meet(length), SPAN)
    met = checkpointed(met)
    wanted = met.where("kind = 1").groupBy("tid").agg(F.collect_list(F.struct("key", "lo", "hi", "need")).alias("wanted"))
    once = texts.groupBy("tid").agg(F.first("text").alias("text"))
    cut = wanted.join(once, "tid").mapInArrow(_cut(length), "key long, tid long, lo long, hi long, need boolean, bytes binary")
    crowds = checkpointed(met.where("kind = 1").groupBy("key").count().where(F.col("count") > CROWD).select("key"))
    if crowds.isEmpty():
        compared = cut.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(length), SPAN).select("tid", "lo", "hi")
    else:
        cut = checkpointed(cut)
        few = cut.join(crowds, "key", "left_anti").repartition("key").sortWithinPartitions("key")
        windows = cut.join(crowds, "key", "left_semi").mapInArrow(_crowded(length), "id long, tid long, lo long, need boolean")
        again = windows.groupBy("id").count().where("count > 1").select("id")
        many = windows.where("need").join(again, "id").select("tid", "lo", (F.col("lo") + length).alias("hi"))
        compared = few.mapInArrow(_compare(length), SPAN).select("tid", "lo", "hi").union(many)
    return met.where("kind = 0").select("tid", "lo", "hi").union(compared).groupBy("tid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def remove_repeats(docs: DataFrame, text: str = "text", id: str = "doc_id", length: int = 200) -> DataFrame:
    """One row per row of `docs`: `id`, n_bytes, n_removed, n_spans, spans (merged, half-open), kept (the bytes left).

    Texts are UTF-8 bytes; a null text is empty. Strings are judged on the input, overlaps count, matches never cross
    texts. Repeated rows hold each other's strings and lose them. Null ids keep their rows.
    """
    rows = lean(docs).select(F.col(id).alias("__id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text")).withColumn("tid", F.xxhash64("text"))
    spans = repeated_spans(rows.where(F.octet_length("text") >= length).select("tid", "text"), length)
    joined = rows.join(spans, "tid", "left").select("__id", "text", "spans")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", COMBINE):
            sizes, merged, kept = [], [], []
            for own, some in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                sizes.append(len(own))
                if not some.is_valid:
                    merged.append([])
                    kept.append(own)
                    continue
                lo, hi = (some.values.field(k).to_numpy() for k in (0, 1))
                _, lo, hi = _spans(np.zeros(len(lo), np.int64), lo, hi)
                merged.append([{"lo": a, "hi": b} for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
                cuts = [0, *np.stack((lo, hi), 1).ravel().tolist(), len(own)]
                kept.append(b"".join(own[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
            removed = [s - len(k) for s, k in zip(sizes, kept, strict=True)]
            kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(m) for m in merged], pa.int64()), pa.array(merged, kind), pa.array(kept, pa.binary())], ["__id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    kind = docs.schema[id].dataType.simpleString()
    return joined.mapInArrow(work, f"__id {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<lo:long,hi:long>>, kept binary").withColumnRenamed("__id", id)


def oracle(length: int = 200) -> str:
    """SQL (DuckDB) for `op6_repeats`: every string of `length` bytes in hexadecimal digits, two a byte."""
    return f"""with h as materialized (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
 p as (select doc_id, x, unnest(range(0, greatest(0, length(x) // 2 - {length - 1}))) as k from h),
 g as materialized (select doc_id, k, hash(substring(x, 2 * k + 1, {2 * length})) as g from p),
 r as (select doc_id, k from g where g in (select g from g group by g having count(*) > 1)),
 i as (select doc_id, k, case when k <= lag(k) over (partition by doc_id order by k) + {length} then 0 else 1 end as fresh from r),
 n as (select doc_id, k, sum(fresh) over (partition by doc_id order by k) as n from i),
 s as (select doc_id, n, min(k) as lo, max(k) + {length} as hi from n group by doc_id, n),
 c as (select doc_id, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as done from s),
 t as (select doc_id, sum(hi - lo)::bigint as n_removed, count(*) as n_spans, max(hi) as last, string_agg(substring(x, 2 * done + 1, 2 * (lo - done)), '' order by lo) as kept from c join h using (doc_id) group by doc_id)
 select h.doc_id, length(x) // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept || substring(x, 2 * last + 1), x))) as kept_sha256 from h left join t using (doc_id)"""


def op6_repeats(spark, sf_dir: str) -> DataFrame:
    """Bytes of every document that 200-byte strings starting elsewhere cover, and the digest of what is left."""
    from .common import table

    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
