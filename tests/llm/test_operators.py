"""The ten operators against brute force, with nulls, empty tables, ties, repeated rows and clashing columns."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gausslake.llm import common, decontaminate, licenses, neighbours, packing, pages, paragraphs, quality, repeats, simhash, tokens
from tests.llm import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(4)
WORDS = [f"{a}{b}" for a in "ba ce di fo gu ka le mi no pu ra se".split() for b in "la ne ri to su".split()]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def edited(text, share):
    w = text.split()
    for _ in range(int(len(w) * share)):
        w[R.randrange(len(w))] = R.choice(WORDS)
    return " ".join(w)


def table(spark, rows, schema="doc_id long, text string", **more):
    """Rows with columns whose names operators might use themselves."""
    df = spark.createDataFrame(rows, schema)
    for c in ("id", "fp", "row", "score", "label", "matches", "spans", "node", "hash", "rank"):
        df = df.withColumn(c, F.lit(7))
    return df


ODD = [(None, "some words without any id here"), (90, None), (91, ""), (92, " \n\t "), (93, "one"), (93, "one"), (94, "!!! ???"), (95, "日本語 テキスト é ñ ü")]


@pytest.fixture(scope="module")
def real(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df, [(r.doc_id, r.text) for r in df.collect()]


def empty(spark):
    return table(spark, [], "doc_id long, text string")


# ---- components ---------------------------------------------------------------------------------------------------


def test_components(spark):
    edges = [(R.randrange(400), R.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1100)] + [(None, 3), (5, 5)]
    label = brute.groups(1101, [(a, b) for a, b in edges if a is not None])
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: label[v] for a, b in edges if a is not None and a != b for v in (a, b)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1 ------------------------------------------------------------------------------------------------------------


def expected_components(docs, distance=4):
    fp = [brute.fingerprint(t) for _, t in docs]
    pairs = [(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if (fp[i] ^ fp[j]).bit_count() <= distance]
    label, least = brute.groups(len(fp), pairs), {}
    for i, g in enumerate(label):
        if docs[i][0] is not None:
            least[g] = min(least.get(g, docs[i][0]), docs[i][0])
    return sorted((d is None, d, format(fp[i], "016x"), least.get(label[i])) for i, (d, _) in enumerate(docs))


def test_simhash_real(spark, real):
    got = sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in simhash.op1_simhash(spark, SF).collect())
    assert got == expected_components(real[1])


def test_simhash_odd(spark):
    base = prose(60)
    rows = ODD + [(k, edited(base, 0.02)) for k in range(30, 0, -1)] + [(5, base), (5, base)]
    found = simhash.near_duplicates(table(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id, format(r.fp & (1 << 64) - 1, "016x"), r.component_id) for r in found) == expected_components(rows)
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize(("n", "most"), [(300, 16_384), (300, 20), (20, 5)])
def test_hamming_links_lose_nothing(spark, n, most):
    centre = [R.getrandbits(64) for _ in range(8)]
    fps = list({c ^ sum(1 << b for b in R.sample(range(64), R.randrange(6))) for c in centre for _ in range(n // 8)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(s, s) for s in signed], "node long, fp long"), 4, most).collect()
    at = {s: i for i, s in enumerate(signed)}
    want = brute.groups(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert brute.groups(len(fps), [(at[e.a], at[e.b]) for e in edges]) == want


def test_masks_cover_every_pair():
    for n in (10, 10**8, 10**11):
        chosen = simhash.masks(n, 4)
        for _ in range(200):
            flips = sum(1 << b for b in R.sample(range(64), 4))
            assert any(not flips & m for m in chosen)


def test_deduplicate_keeps_one_of_each_group(spark):
    base, other = prose(200), prose(200)
    rows = [(k, base) for k in (9, 4, 7)] + [(20 + k, edited(base, 0.01)) for k in range(5)] + [(40, other), (40, other), (41, prose(200))] + ODD
    out = simhash.deduplicate(table(spark, rows))
    assert out.columns == table(spark, rows).columns
    kept = sorted((r.doc_id is None, r.doc_id) for r in out.collect())
    assert kept == [(False, 4), (False, 40), (False, 41), (False, 90), (False, 93), (False, 94), (False, 95), (True, None)]
    assert simhash.deduplicate(empty(spark)).count() == 0


def test_deduplicate_finds_pairs_among_nearer_relatives(spark):
    """A family of texts just under 0.8 of each other hides no pair above it."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    base = [word() for _ in range(330)]

    def changed(words, n):
        out = list(words)
        for p in range(0, 5 * n, 5):
            out[p] = word()
        return out

    family = [changed(base[:330], 9) for _ in range(60)]
    rows = [(k, " ".join(w)) for k, w in enumerate(family)]
    rows += [(1000 + k, " ".join([*w[:-27], *(word() for _ in range(27))])) for k, w in enumerate(family[:20])]
    sets = [brute.shingles(t.encode().split()) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if brute.jaccard(sets[i], sets[j]) >= 0.8]
    assert {(i, j) for i, j in pairs if i >= 60} >= {(60 + k, k) for k in range(20)} and len(pairs) < 200
    label = brute.groups(len(rows), pairs)
    assert sorted(r.doc_id for r in simhash.deduplicate(table(spark, rows)).collect()) == sorted(rows[g][0] for g in set(label))


# ---- 2 ------------------------------------------------------------------------------------------------------------


def test_pages_real(spark):
    for r in pages.extract(spark.read.parquet(f"{SF}/pages.parquet"), keep=["page_id", "url", "html"]).collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        import html

        want = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", inner)]
        assert r.text == "\n\n".join(w for w in want if w) and r.n_chars == len(r.text)


BOILER = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>The site</h1><p>A slogan of the site that has quite a few words in it.</p></header>
<div class="cookie-banner"><p>We use cookies for many reasons that are told at great length in this notice of ours.</p></div>
<main><article><h1>Title</h1><p>First &amp; foremost,&nbsp;a   paragraph<br>with a break.<p>Second.</p><div class="advert"><p>Buy this thing now, it is cheap and good and you will like it.</p></div>
<form><p>Your address, please, so that we can write to you every day.</p><input type="submit"></form><ul><li>Item one</li><li>Item two</li></ul></article>
<section id="comments"><article><p>I have read all of this and I must say that I do not agree with any of it.</p></article></section></main>
<aside><p>Related stories that are long enough to look like a part of the article.</p></aside><script>if (a < b) { document.write("<p>no</p>"); }</script><footer><p>All rights are reserved by the owner of this page and site.</p></footer></body></html>"""


def test_pages_boilerplate_and_odd():
    assert pages.main_text(BOILER).split("\n\n") == ["Title", "First & foremost, a paragraph with a break.", "Second.", "Item one", "Item two"]
    assert pages.main_text("") == "" and pages.main_text("<p") == "" and pages.main_text("<!-- never closed <p>x</p>") == ""
    assert pages.main_text("just text that has no markup at all") == "just text that has no markup at all"
    assert pages.main_text('<article><a title="never closed>x</a><p>Some words that stay here.</p></article>').endswith("Some words that stay here.")
    deep = "<article>" + "<div>" * 3000 + "<p>Deep but here.</p>" + "</div>" * 3000 + "</article>"
    assert pages.main_text(deep) == "Deep but here."
    assert len(pages.main_text("<article><p>" + "word " * 200_000 + "</p></article>")) == 999_999


ARTICLE = "<h1>Title of it</h1><p>An ordinary article with a first paragraph that says quite a lot of things about a subject.</p><p>And then a second paragraph, which goes on with it for some more words than that.</p><p>Short.</p>"
AROUND = [("<body>", ""), ('<body class="has-sidebar">', ""), ('<body class="no-comments single-post">', ""), ('<body class="layout-search">', ""), ('<body><form id="aspnetForm">', "</form>"), ('<body><div class="widget">', "</div>"), ('<body><div id="skip-target">', "</div>"), ('<body><div class="with-comments page has-footer">', "</div>")]
OUTSIDE = [
    ('<nav><ul><li><a href="#">Home</a></li><li><a href="#">About us</a></li></ul></nav>', "<footer>&copy; us</footer>"),
    ('<div class="cookie-notice"><p>We use cookies for many reasons that are told at great length in this notice of ours, and you must agree.</p></div>', '<div id="comments"><p>I have read all of this and I must say that I do not agree with any of it, not at all, and I say it at length.</p><p>Me, too.</p></div>'),
    ('<div class="ad"><p>Buy one of our things today, as they are cheap and good and you will like them.</p></div>', '<form><p>Leave us your address here, please, so that we can write to you.</p><input></form><div class="sidebar"><h3>More</h3><p>A story that you might want to read after this one, too.</p></div>'),
]


@pytest.mark.parametrize("outside", [("", ""), *OUTSIDE])
@pytest.mark.parametrize("around", AROUND)
def test_pages_of_many_layouts(around, outside):
    """What marks the whole page, and what stands beside the article."""
    found = pages.main_text(around[0] + outside[0] + ARTICLE + outside[1] + around[1])
    assert found == "\n\n".join(re.findall(r"<(?:h1|p)>(.*?)</", ARTICLE))


def test_pages_classifier_on_new_layouts():
    """Generated pages that the fit has not seen: 99 % of the blocks are right."""
    rng, right = random.Random(123), []
    for _ in range(60):
        page = pages._generated(rng)
        kept = set(pages.main_text(page).split("\n\n"))
        right += [(text in kept) == (text.lstrip("© ")[:1] == "k") for _, text in pages._texts(page)[0]]
    assert np.mean(right) > 0.99


def test_minimum_cut_is_minimal():
    for _ in range(60):
        n = R.randrange(1, 7)
        scores = [R.uniform(-3, 3) for _ in range(n)]
        links = [(i, j, R.uniform(0, 2)) for i in range(n) for j in range(i) if R.random() < 0.6]

        def cost(side, scores=scores, links=links):
            return sum(s for s, x in zip(scores, side, strict=True) if s > 0 and not x) - sum(s for s, x in zip(scores, side, strict=True) if s < 0 and x) + sum(c for u, v, c in links if side[u] != side[v])

        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert cost(pages.minimum_cut(scores, links, n).tolist()) == pytest.approx(best, abs=1e-6)


def test_pages_table(spark):
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<article><p>Hello there, world.</p></article>")]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "Hello there, world.", 19), (1, "", 0), (1, "", 0)]


# ---- 3 ------------------------------------------------------------------------------------------------------------


def clusters(found):
    first = {}
    for r in found:
        first[r.cluster] = min(first.get(r.cluster, (10**9, 0, 0)), (r.doc_id, r.first, r.end))
    return {(r.doc_id, r.first, r.end): (first[r.cluster], r.copies, r.kept) for r in found}


def test_paragraphs_real(spark, real):
    assert clusters(paragraphs.repeated(real[0]).collect()) == brute.similar_paragraphs(real[1])


@pytest.mark.parametrize("crowd", [1000, 3])
def test_paragraphs_near_copies(spark, crowd):
    base = [prose(60) for _ in range(3)]
    rows = [(k, "\n".join([prose(30), edited(R.choice(base), 0.03), "short line"])) for k in range(60)] + [(200, base[0] + "\n" + base[0]), (201, None), (202, "")]
    got = clusters(paragraphs.repeated(table(spark, rows), settings=paragraphs.Settings(crowd=crowd)).collect())
    assert got == brute.similar_paragraphs(rows)


def test_paragraphs_are_taken_out(spark):
    p, q = prose(60), prose(60)
    rows = [(1, f"{p}\nmine"), (2, f"yours\n{p}\n\n  last "), (3, q), (3, q), (None, p), (5, None), (6, "")]
    for few in (10**6, 0):
        out = paragraphs.remove_repeats(table(spark, rows), settings=paragraphs.Settings(few=few)).collect()
        assert sorted((r.doc_id or 0, r.text, r.n_removed) for r in out if r.text is not None) == [(0, "", 60), (1, f"{p}\nmine", 0), (2, "yours\n\n  last ", 60), (3, q, 0), (3, q, 0), (6, "", 0)]
    assert paragraphs.remove_repeats(empty(spark)).count() == 0


def test_passages_of_short_lines(spark):
    passage = "\n".join(prose(n) for n in (9, 12, 1, 15, 8, 11))
    rows = [(1, f"{prose(30)}\n{passage}\n{prose(7)}"), (2, f"{prose(5)}\n{passage}\n{prose(40)}"), (3, "\n".join([prose(10)] * 2 + ["same short line of words that comes again"] * 40)), (4, "\n".join(prose(12) for _ in range(9)))]
    assert clusters(paragraphs.repeated(table(spark, rows)).collect()) == brute.similar_paragraphs(rows)
    out = {r.doc_id: r.text for r in paragraphs.remove_repeats(table(spark, rows)).collect()}
    assert out[1] == rows[0][1] and out[4] == rows[3][1]
    assert out[2].split("\n") == [rows[1][1].split("\n")[k] for k in (0, -1)]
    assert "same short line" in out[3] and len(out[3]) < len(rows[2][1])


def test_lists_of_different_lines_stay(spark):
    """A list of different short lines stays whole; of two copies of one the first does."""
    words = iter(f"w{k}" for k in range(10_000))
    lines = lambda n: "\n".join(" ".join(next(words) for _ in range(3)) for _ in range(n))
    shared = lines(100)
    rows = [(1, lines(100)), (2, shared), (3, f"{lines(30)}\n{shared}")]
    out = {r.doc_id: r.text for r in paragraphs.remove_repeats(table(spark, rows)).collect()}
    assert out[1] == rows[0][1] and out[2] == rows[1][1]
    assert out[3] == "\n".join(rows[2][1].split("\n")[:30])


def test_passages_inside_other_lines(spark):
    """52 equal words inside longer lines, and in lines of 15, 25 and 15 words, are found; 49 are not."""
    words = iter(f"v{k}" for k in range(10_000))
    some = lambda n: [next(words) for _ in range(n)]
    text = lambda *parts: " ".join(w for p in parts for w in p)
    p, q, short, own = some(52), some(55), some(49), [some(60) for _ in range(9)]
    split = "\n".join([text(q[:15]), text(q[15:40]), text(q[40:])])
    rows = [(1, text(own[0], p, own[1])), (2, text(own[2], p) + "\nend"), (3, text(own[3]) + "\n" + split), (4, split + "\n" + text(own[4])), (5, text(own[5], short)), (6, text(short, own[6])), (7, None), (8, "")]
    out = {r.doc_id: r.text for r in paragraphs.remove_repeats(table(spark, rows)).collect()}
    assert [out[k] for k in (1, 3, 5, 6, 7, 8)] == [dict(rows)[k] for k in (1, 3, 5, 6, 7, 8)]
    assert out[2].split() == [*own[2], "end"] and out[4].split() == own[4]


def test_passages_wrapped_anew_everywhere(spark):
    """Passages of 50 to 90 words in many documents, wrapped and surrounded differently: one place of each stays, and
    what stands around them does."""
    rng, words = random.Random(2), iter(f"u{k}" for k in range(100_000))
    some = lambda n: [next(words) for _ in range(n)]
    wrapped = lambda w: "".join(x + rng.choice([" "] * 9 + ["\n"]) for x in w)
    shared = [some(rng.randrange(50, 91)) for _ in range(12)]
    rows, own = [], {}
    for d in range(60):
        parts = [p for k in range(3) for p in (some(rng.randrange(1, 40)), shared[rng.randrange(12)])]
        own[d] = [w for p in parts[::2] for w in p]
        rows.append((d, wrapped([w for p in parts for w in p])))
    out = {r.doc_id: (r.text.split(), r.n_removed) for r in paragraphs.remove_repeats(table(spark, rows)).collect()}
    assert not brute.runs([(d, " ".join(w)) for d, (w, _) in out.items()], 50)
    every = [x for w, _ in out.values() for x in w]
    assert all(every.count(x) == 1 for p in shared for x in p[::7])
    assert all(len(w) + n == len(dict(rows)[d].split()) for d, (w, n) in out.items())
    # pieces that are near copies as a whole take the few words of their own along
    lost = [len(set(own[d]) - set(w)) for d, (w, _) in out.items()]
    assert max(lost) <= 16 and sum(lost) <= 0.05 * sum(map(len, own.values()))


def test_passages_of_real_documents(spark):
    """Of all runs of 50 words that stand in several documents of sf0.01 at most one place is left."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = brute.runs([(r.doc_id, r.text) for r in docs.collect()], 50)
    left = brute.runs([(r.doc_id, r.text) for r in paragraphs.remove_repeats(docs).collect()], 50)
    assert len(before) > 1000 and len(set(left) & set(before)) <= 0.01 * len(before)


# ---- 4 ------------------------------------------------------------------------------------------------------------


def base_scan(text):
    w = licenses.WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at = [(k, label) for label, p in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    places = [k for k, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in at}))


def test_licenses(spark, real, monkeypatch):
    monkeypatch.setattr(licenses, "CHUNK", 50)
    permission = next(t for label, t in licenses.TEMPLATES if t.endswith("documentation files"))
    rows = real[1] + ODD + [(500, "MIT License mit license, mit-license! Apache LICENSE"), (501, prose(47) + " gnu general public license " + prose(120)), (502, prose(40) + " " + permission.replace("any person", "every person") + " " + prose(10)), (503, "Licensed under CC BY-SA 4.0.")]
    found = licenses.scan(table(spark, rows)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *map(str, x[1:]))
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found), key=key)
    assert got == sorted(((i, *base_scan(t)) for i, t in rows), key=key)
    by = {r.doc_id: r for r in found}
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in found)
    assert by[502].labels == "mit" and by[502].n_base == 0 and 0.8 <= by[502].score < 1 and by[502].spans[0].first == 40
    assert by[503].labels == "cc-by,cc-by-sa-4.0"
    assert licenses.scan(empty(spark)).count() == 0


def test_license_texts_changed_and_wrapped(spark):
    """Whole texts with words changed, added and missing, wrapped anew, and each template as it is."""
    rng, rows, want = random.Random(8), [], {}
    for k, (label, text) in enumerate(licenses.TEMPLATES):
        rows.append((k, f"{prose(9)} {text} {prose(9)}"))
        want[k] = label
        n = len(licenses.WORD.findall(text))
        if n >= 40:
            w = text.split()
            for p in sorted(rng.sample(range(len(w)), n // 25), reverse=True):
                w[p : p + 1] = rng.choice([[], [rng.choice(WORDS)], [w[p], rng.choice(WORDS)]])
            rows.append((100 + k, "".join(x + rng.choice([" ", " ", "\n"]) for x in w).upper()))
            want[100 + k] = label
    rows.append((900, " ".join(rng.sample(rows[4][1].split(), len(rows[4][1].split())))))
    found = {r.doc_id: r for r in licenses.scan(table(spark, rows)).collect()}
    assert all(label in found[k].labels.split(",") for k, label in want.items())
    assert not found[900].spans


@pytest.mark.parametrize("name", ["op4_licenses", "op6_repeats"])
def test_same_rows_as_sql(spark, name):
    from gausslake.llm import registry
    from tests.oracle import connection

    got = registry.QUERIES[name](spark, SF)
    want = connection(SF).execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    rounded = lambda rows: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)
    key = lambda rows: sorted(map(repr, rounded(rows)))
    assert key([(r[0], *map(str, r[1:])) for r in got.select(*names).collect()]) == key([(r[0], *map(str, r[1:])) for r in want.fetchall()])


# ---- 5 ------------------------------------------------------------------------------------------------------------


def check_neighbours(spark, rows, k=10):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("v", F.lit(2))
    got = neighbours.nearest(df, df.where("vec_id % 100 = 0"), k=k).collect()
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    hits = total = 0
    for q in [i for i in good if i % 100 == 0]:
        d = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)[:k]
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, len(d) + 1))
        assert [(s, i) for _, i, s in own] == sorted((s, i) for _, i, s in own)
        for _, i, s in own:
            assert s == pytest.approx(float(np.sqrt(((good[q] - good[i]) ** 2).sum())), abs=1e-12)
        hits += len({i for _, i in d} & {i for _, i, _ in own})
        total += len(d)
    return hits / total if total else 1.0


def test_neighbours_recall(spark):
    g = np.random.default_rng(0)
    centres = g.normal(size=(20, 32))
    rows = [(i, (centres[i % 20] + 0.3 * g.normal(size=32)).tolist()) for i in range(3000)]
    assert check_neighbours(spark, rows) >= 0.95
    assert check_neighbours(spark, [(i, g.normal(size=16).tolist()) for i in range(1500)]) >= 0.9


def test_neighbours_copies_odd_and_few(spark):
    same = [(i, [1.0, 2.0, 3.0]) for i in range(0, 400)]
    odd = [(1000, None), (1100, []), (1200, [0.0, 0.0, 0.0]), (1300, [float("nan"), 1.0, 1.0]), (1400, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    assert check_neighbours(spark, same + odd + [(2000, [1.0, 2.0, 3.5])]) == 1.0
    assert check_neighbours(spark, [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (3, [1.0, 1.0])]) == 1.0
    assert check_neighbours(spark, odd) == 1.0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(none, none).count() == 0


# ---- 6 ------------------------------------------------------------------------------------------------------------


def check_repeats(spark, texts, length):
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(i, t.decode()) for i, t in docs], "doc_id long, text string").withColumn("spans", F.lit(1)).repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.digest) for r in repeats.remove_repeats(df, length=length).withColumn("digest", F.sha2("kept", 256)).collect()}
    assert got == brute.repeated_bytes(docs, length)


def test_repeats_real(spark, real):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.op6_repeats(spark, SF).collect()}
    assert got == brute.repeated_bytes([(i, (t or "").encode()) for i, t in real[1]], 200)


@pytest.mark.parametrize(("length", "crowd", "segment"), [(20, 4096, 1 << 19), (33, 3, 100), (8, 2, 64), (200, 4096, 1 << 19)])
def test_repeats_small(spark, monkeypatch, length, crowd, segment):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    monkeypatch.setattr(repeats, "COMBINE", 500)
    texts = [bytes(R.choice(b"ab") for _ in range(R.randint(0, 60))) + b"passage of shared words that is long" * R.randint(0, 8) + bytes(R.choice(b"abc") for _ in range(R.randint(0, 40))) for _ in range(150)]
    check_repeats(spark, [*texts, b"", b"x" * 50, b"x" * 50, b"ab" * 150, "é".encode() * 120], length)


def test_repeats_odd(spark):
    rows = [(1, None), (None, "y" * 30), (2, "z" * 30), (2, "z" * 30), (3, "short")]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in repeats.remove_repeats(table(spark, rows), length=25).collect())
    assert got == [(0, 30, 30), (1, 0, 0), (2, 30, 30), (2, 30, 30), (3, 5, 0)]
    assert repeats.remove_repeats(empty(spark)).count() == 0


# ---- 7 ------------------------------------------------------------------------------------------------------------


def test_decontamination_finds_edited_items(spark):
    items = [(k, prose(R.randrange(12, 50))) for k in range(40)]
    rows, want = [], set()
    for k, t in items:
        w = t.split()
        for _ in range(int(0.15 * len(w))):
            p = R.randrange(len(w))
            if R.random() < 0.5:
                w[p] = R.choice(WORDS)
            elif R.random() < 0.5:
                w.insert(p, R.choice(WORDS))
            else:
                del w[p]
        rows.append((k, f"{prose(50)}. {' '.join(w).upper()}!! {prose(50)}"))
        want.add((k, k))
    clean = [(100 + k, prose(200)) for k in range(40)]
    bench = spark.createDataFrame([*items, (900, None), (None, "a b c d e f"), (901, ""), (902, "...")], "item_id long, text string")
    docs = table(spark, rows + clean + ODD)
    got = {(r.doc_id, m.item_id): m.edits for r in decontaminate.matches(docs, bench).collect() for m in r.matches}
    assert want <= set(got)
    for d, k in got:
        words = [w.lower() for w in decontaminate.WORD.findall(dict(rows + clean)[d])]
        item = dict(items)[k].split()
        assert min(brute.edits(item, words[s : s + n]) for s in range(len(words)) for n in range(len(item) - got[d, k], len(item) + got[d, k] + 1)) <= got[d, k]
    out = decontaminate.clean(docs, bench)
    assert out.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in out.collect()) == sorted([i for i, _ in clean if not any(d == i for d, _ in got)] + [i or 0 for i, _ in ODD])
    assert decontaminate.clean(docs, bench.where("item_id < 0")).count() == docs.count()


def planted(spark, shares, kinds):
    """Documents that hold an edited item each, and the items: sizes from 3 words to 80."""
    rng, rows, items = random.Random(9), [], []
    for k, n in enumerate([3, 4, 5, 6, 7, 9, 12, 15, 18, 19, 24, 33, 39, 47, 59, 80] * 4):
        item = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]
        w = list(item)
        for _ in range(int(shares[k % len(shares)] * n)):
            p, kind = rng.randrange(len(w)), rng.choice(kinds)
            w[p : p + (kind != "insert")] = [] if kind == "delete" else [rng.choice(WORDS)]
        items.append((k, " ".join(item)))
        rows.append((k, " ".join([prose(rng.randrange(40)), *w, prose(rng.randrange(40))])))
    return rows, items


@pytest.mark.parametrize("kinds", [("replace",), ("insert",), ("delete",), ("replace", "insert", "delete")])
def test_decontamination_recall_over_all_pairs(spark, kinds):
    """All (document, item) pairs by exact edit distance: at least 0.95 are found, and nothing else."""
    rows, items = planted(spark, (0.0, 0.05, 0.1, 0.2), kinds)
    found = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, m.item_id): m.edits for r in found for m in r.matches}
    want = {}
    for d, text in rows:
        words = decontaminate.word_hashes(text)
        for i, item in items:
            own = decontaminate.word_hashes(item)
            edits, _ = decontaminate.edit_distances(own[None], np.array([len(own)]), words[None])
            if edits[0] <= int(0.2 * len(own)):
                want[d, i] = int(edits[0])
    assert set(got) <= set(want) and all(got[p] >= want[p] for p in got)
    assert len(got) >= 0.95 * len(want) and len(want) >= len(rows)
    assert all(p in got for p, e in want.items() if e == 0)


def test_decontamination_long_texts_and_many_keys(spark):
    """An item deep in a long text, in the middle of others; a filter that is too small changes nothing."""
    items = [(k, prose(20)) for k in range(9)]
    long = prose(30_000) + " " + items[4][1] + " " + prose(500)
    bench = spark.createDataFrame(items + [(4, prose(7))], "item_id long, text string")
    docs = table(spark, [(1, long), (2, items[3][1]), (2, items[3][1])])
    for bits in (28, 8):
        got = sorted((r.doc_id, [(m.item_id, m.edits, m.last_word, m.n_words) for m in r.matches]) for r in decontaminate.matches(docs, bench, settings=decontaminate.Settings(filter_bits=bits)).collect())
        assert got == [(1, [(4, 0, 30_020, 20)]), (2, [(3, 0, 20, 20)]), (2, [(3, 0, 20, 20)])]
    assert decontaminate.clean(docs, bench, settings=decontaminate.Settings(few=0)).count() == 0


def test_filter_lets_all_keys_through(spark):
    keys = [R.getrandbits(64) - (1 << 63) for _ in range(5000)]
    for bits in (16, 22):
        made = dict(decontaminate.key_filter(spark.createDataFrame([(k,) for k in keys], "key long"), bits))
        size = 1 << (min(bits, 20) - 3)
        field = np.frombuffer(b"".join(made.get(k, bytes(size)) for k in range(1 << max(0, bits - 20))), np.uint8)
        assert len(field) == 1 << (bits - 3)
        assert len(decontaminate._passes(field, np.array(keys, np.int64).view(np.uint64), bits)) == len(keys)
        other = np.random.default_rng(5).integers(0, 1 << 63, 5000, dtype=np.uint64)
        assert len(decontaminate._passes(field, other, bits)) < (200 if bits > 20 else 2500)


def test_embedding_of_equal_and_far_strings():
    """The more edits, the fewer tables agree; equal windows agree in all, unrelated ones in none."""
    g, s = np.random.default_rng(0), decontaminate.Settings()
    agree = []
    for edits in (0, 1, 6, 64):
        a = g.integers(1, 5000, (20, 64)).astype(np.uint64)
        b = a.copy()
        for row in b:
            row[g.choice(24 if edits < 64 else 64, edits, replace=False)] = g.integers(6000, 9000, edits).astype(np.uint64)
        one, two = ([decontaminate.embedded_keys(x.ravel(), np.arange(20) * 64, np.arange(1, 21) * 64, 32, w, s)[0] for w in range(s.walks)] for x in (a, b))
        agree.append(float(np.mean([x == y for x, y in zip(one, two, strict=True)])))
    assert agree[0] == 1 > agree[1] > agree[2] >= agree[3] == 0


# ---- 8 ------------------------------------------------------------------------------------------------------------


def check_packing(rows, found, sizes):
    lengths = sorted((i is None, i or 0, len((t or "").split()) + 1) for i, t in rows)
    own = {}
    for r in found:
        own.setdefault(r.bin_id, []).append(r)
    for some in own.values():
        some.sort(key=lambda r: r.place)
        assert some[0].place == 0 and all(a.place + a.length == b.place for a, b in zip(some, some[1:]))
        end = some[-1].place + some[-1].length
        assert {r.capacity for r in some} == {min(s for s in sizes if s >= end)}
    assert sorted(own) == list(range(len(own)))
    assert sum(r.length for r in found) == sum(n for _, _, n in lengths)
    return own


def test_packing(spark):
    rows = [(k, prose(R.randrange(0, 300))) for k in range(400)] + ODD + [(700, prose(999))] * 3
    s = packing.Settings(sizes=(64, 128, 256))
    found = packing.pack(table(spark, rows), settings=s).collect()
    own = check_packing(rows, found, s.sizes)
    long = sorted((r.piece, r.first, r.length) for r in found if r.doc_id == 700)
    assert long == sorted([(p, 256 * p, 256 if p < 3 else 232) for p in range(4)] * 3)
    assert sum(r.length for r in found) / sum(own[b][0].capacity for b in own) > 0.97
    assert packing.pack(empty(spark)).count() == 0


def test_packing_real(spark, real):
    check_packing(real[1], packing.op8_packing(spark, SF).collect(), packing.Settings().sizes)


def test_packing_is_best_fit_decreasing_item_by_item():
    s = packing.Settings(sizes=(10,))
    for _ in range(30):
        items = sorted((R.randrange(1, 11) for _ in range(40)), reverse=True)
        rooms = []
        for x in items:
            fits = [i for i, room in enumerate(rooms) if room >= x]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= x
            else:
                rooms.append(10 - x)
        plan = packing.best_plan({x: items.count(x) for x in set(items)}, s)
        assert sum(n for _, n, _, _ in plan.bins) == len(rooms)


@pytest.mark.parametrize("sizes", [(8, 16), (7, 12, 20), (16,)])
def test_packing_of_several_sizes_item_by_item(sizes):
    """The plan over lengths with counts costs what plain best fit costs, over all choices of sizes to open bins with."""
    from itertools import combinations

    s = packing.Settings(sizes=sizes, fixed=1.0, square=200.0)

    def plain(items, opened):
        bins = []
        for n, x in enumerate(items):
            fits = [b for b in bins if b[0] - b[1] >= x]
            if fits:
                min(fits, key=lambda b: b[0] - b[1])[1] += x
            else:
                left = items[n:].count(x)
                size = min((o for o in opened if o >= x), key=lambda o: (s.cost(o) / (min(o // x, left) * x), o))
                bins.append([size, x])
        return sum(s.cost(min(z for z in sizes if z >= b[1])) for b in bins)

    for _ in range(40):
        items = sorted((R.randrange(1, max(sizes) + 1) for _ in range(R.randrange(1, 50))), reverse=True)
        choices = [c for n in range(1, len(sizes) + 1) for c in combinations(sizes, n) if c[-1] >= items[0]]
        plan = packing.best_plan({x: items.count(x) for x in set(items)}, s)
        assert plan.cost <= min(plain(items, c) for c in choices) * 1.1 + 1e-9
        assert sum(n * content for _, n, content, _ in plan.bins) == sum(items)
        assert all(content <= size for _, _, content, size in plan.bins)


# ---- 9 ------------------------------------------------------------------------------------------------------------


def test_quality_learns_and_scores(spark):
    good = [(k, prose(R.randrange(30, 90)).capitalize() + ".") for k in range(300)]
    bad = [(1000 + k, " ".join(w.upper() + "!!" for w in prose(40).split()) if k % 2 else " | ".join(prose(40).split())) for k in range(200)]
    docs = table(spark, good + bad + ODD)
    labels = spark.createDataFrame([(i, 1 if i < 1000 else 0) for i, _ in good + bad] + [(90, 1), (None, 0), (3, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    found = quality.score(docs, model, keep=["doc_id", "id"]).withColumn("held", quality.held_out()).collect()
    assert len(found) == len(good + bad + ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    held = [r for r in found if r.held and r.doc_id is not None and (r.doc_id < 90 or r.doc_id >= 100)]
    assert np.mean([r.predicted == int(r.doc_id < 1000) for r in held]) > 0.95
    assert model[1] == quality.fit(docs.repartition(7), labels)[1]
    none = quality.fit(docs, labels.where("doc_id < 0"))
    assert not none[0].any() and {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(empty(spark), model).count() == 0


def test_follow_the_leader_by_hand():
    """The vectorised passes equal the rule written out weight by weight."""
    s = quality.Settings(bits=5, epochs=3, alpha=0.4, beta=0.7, l1=0.05, l2=0.2)
    rng = random.Random(1)
    rows = [(rng.randrange(2), np.sort(rng.sample(range(32), 6)), np.array([rng.random() for _ in range(6)])) for _ in range(30)]
    z, n = [0.0] * 32, [0.0] * 32
    good = sum(y for y, _, _ in rows)
    bias = np.log((good + 1) / (len(rows) - good + 1))

    def weight(k):
        return 0.0 if abs(z[k]) <= s.l1 else -(z[k] - np.sign(z[k]) * s.l1) / ((s.beta + n[k] ** 0.5) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for y, index, value in rows:
            w = {k: weight(k) for k in index}
            p = 1 / (1 + np.exp(-(bias + sum(w[k] * x for k, x in zip(index, value, strict=True)))))
            for k, x in zip(index, value, strict=True):
                g = (p - y) * x
                sigma = ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / s.alpha
                z[k] += g - sigma * w[k]
                n[k] += g * g
    got, own = quality.follow(rows, s)
    assert own == pytest.approx(bias)
    np.testing.assert_allclose(got, [weight(k) for k in range(32)], rtol=1e-5, atol=1e-7)


def test_results_never_share_a_name(spark):
    docs = table(spark, [(1, "some words")])
    with pytest.raises(ValueError, match="score"):
        quality.score(docs, quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int")), keep=docs.columns)
    with pytest.raises(ValueError, match="n_tokens"):
        tokens.count_tokens(docs.withColumn("n_tokens", F.lit(1)), tokens.vocabulary_path(), keep=["doc_id", "n_tokens"])


def test_quality_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality.op9_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in found]) > 0.9
    assert quality.op9_quality(spark, "/root/testdata/sf0.01").count() == docs.count()


def test_features_do_not_depend_on_chunks(monkeypatch):
    text = prose(500) + " !! " + prose(30)
    a = quality.features(text, 18)
    monkeypatch.setattr(quality, "CHUNK", 7)
    b = quality.features(text, 18)
    np.testing.assert_array_equal(a[0], b[0])
    np.testing.assert_allclose(a[1], b[1])


# ---- 10 -----------------------------------------------------------------------------------------------------------


def test_tokens_as_the_library_counts(spark, real):
    c = tokens.counter(tokens.vocabulary_path())
    parts = ["<|endoftext|>", " ", "  ", "\n", "\n\n", "it's", "'S", "word", "!!", "%%%", "é", "日本", "\t", " \n", "12", "a1", "\x1c", "\x85", "\u00a0", "’s", "👍", "x" * 200]
    texts = ["".join(R.choice(parts) for _ in range(R.randint(0, 14))) for _ in range(3000)] + [t or "" for _, t in real[1]] + ["a" * 20_000, " " * 5000]
    want = [len(e.ids) for e in c.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert c.count(texts) == want
    assert c.count(texts) == want


def test_tokens_table(spark):
    rows = [*ODD, (7, "word " * 600)]
    got = {(r.doc_id, r.n_bytes): (r.n_tokens, r.over_limit) for r in tokens.count_tokens(table(spark, rows), tokens.vocabulary_path()).collect()}
    assert got[90, 0] == (0, False) and got[91, 0] == (0, False) and got[7, 3000][1]
    assert tokens.count_tokens(empty(spark), tokens.vocabulary_path()).count() == 0
