"""The stages of the corpus pipeline, each on what the one before it kept."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gausslake.llm import common, decontaminate, paragraphs, simhash
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.checkpointed(stage(spark, docs, SF))
        kept[name] = docs
    first = spark.read.parquet(f"{SF}/documents.parquet")
    for name in list(kept)[:-1]:
        assert kept[name].columns == first.columns
    quality = {r.doc_id: r.text for r in kept["quality"].collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(i in quality for i, q in labels.items() if q == 1)
    single = {r.doc_id: r.text for r in kept["near_duplicates"].collect()}
    assert len(set(single.values())) == len(single) and set(single) <= set(quality)
    sets = {i: brute.shingles((t or "").encode().lower().split()) for i, t in quality.items()}
    for i in set(quality) - set(single):
        assert max(brute.jaccard(sets[i], sets[j]) for j in quality if j != i) >= 0.8
    lines = {r.doc_id: (r.text, r.n_chars) for r in kept["repeated_passages"].collect()}
    for i, (t, n) in lines.items():
        assert t == single[i] or n == len(t) < len(single[i])
    before = brute.runs(list(single.items()), 50)
    assert before and len(set(brute.runs([(i, t) for i, (t, _) in lines.items()], 50)) & set(before)) <= 0.01 * len(before)
    clean = {r.doc_id for r in kept["benchmark_leaks"].collect()}
    items = [" ".join(decontaminate.WORD.findall(r.text.lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i, (t, _) in lines.items():
        plain = f" {' '.join(decontaminate.WORD.findall(t.lower()))} "
        if any(f" {x} " in plain for x in items):
            assert i not in clean
    packed = kept["packing"].collect()
    assert {r.doc_id for r in packed} == clean


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def odd(spark):
    """Documents with nulls in every column, empty, repeated and very long texts, and columns whose names stages use."""
    words = iter(f"w{k}x" for k in range(10**6))
    some = lambda n: " ".join(next(words) for _ in range(n))
    long = some(60_000)
    rows = [(1, some(80), "en", "s", 1), (None, some(70), None, None, None), (2, None, "en", None, 0), (3, "", "de", "s", 0), (4, "  \n ", "de", "s", 4), (5, long, "en", "s", len(long)), (6, some(90), "fr", "t", 9)]
    rows += [(7, some(60), "en", "s", 5)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("id", "row", "key", "gone", "node", "fp", "first", "end", "score", "tid", "more", "matches", "rank", "length", "n", "size"):
        df = df.withColumn(c, F.lit(3))
    return df


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    docs = odd(spark)
    got = stage(spark, docs, SF).collect()
    none = stage(spark, docs.where("doc_id < 0"), SF)
    assert none.count() == 0
    if name == "packing":
        assert sorted({(r.doc_id is None, r.doc_id or 0) for r in got}) == [(False, k) for k in range(1, 8)] + [(True, 0)]
        assert sum(r.length for r in got) == 80 + 70 + 60_000 + 90 + 3 * 60 + 10
        return
    assert none.columns == docs.columns
    kept = sorted((r.doc_id or 0, r.text or "") for r in got)
    want = sorted((r.doc_id or 0, r.text or "") for r in docs.collect())
    if name == "quality":
        assert set(kept) <= set(want)
    elif name == "near_duplicates":
        # texts without words are one group, equal rows another
        assert [i for i, _ in kept] == [0, 1, 2, 5, 6, 7]
    elif name == "repeated_passages":
        # equal rows are treated alike, which keeps them; a row left blank goes only if words were taken out of it
        assert kept == want
    else:
        assert kept == want
    assert all(r.id == 3 and r.size == 3 for r in got)


def test_near_duplicate_stage_keeps_one_of_each_component(spark):
    """Groups around a centre whose members are no copies of each other: what is left are the exact components."""
    rng, rows = random.Random(5), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    for g in range(25):
        base = [word() for _ in range(200)]
        for k in range(6):
            w = list(base)
            for p in rng.sample(range(0, 200, 5), 0 if k == 0 else 4):
                w[p] = word()
            rows.append((len(rows), " ".join(w), "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sets = [brute.shingles(t.encode().split()) for _, t, *_ in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if i // 6 == j // 6 and brute.jaccard(sets[i], sets[j]) >= 0.8]
    label = brute.groups(len(rows), pairs)
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert got == sorted(set(label))


def test_near_duplicate_stage_takes_candidates_of_the_fingerprint_index(spark, monkeypatch):
    """Bands that hardly any pair shares leave the candidates to the Gray-order index: near copies go all the same."""
    rng, rows = random.Random(6), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    for _ in range(20):
        base = [word() for _ in range(400)]
        rows += [" ".join(base), " ".join([*base[:-1], word()]), " ".join(base[:40])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(simhash, "Settings", lambda **k: paragraphs.Settings(**k, bands=1, rows=400))
    linked = {r.doc_id for r in simhash.near_duplicates(docs).collect() if r.component_id != r.doc_id}
    assert len(linked) > 10 and all(i % 3 == 1 for i in linked)
    left = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    assert not left & linked and left >= {i for i in range(60) if i % 3 != 1}
