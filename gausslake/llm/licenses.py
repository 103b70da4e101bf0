"""License scans by diagonal voting.

Texts and license templates are sequences of words. Every rolling k-gram of words is hashed; the hashes of all
documents are joined to the template positions of the same hash; a pair votes for the diagonal (place in the document
minus place in the template); votes on neighbouring diagonals of one template are merged into a span; a span counts
when the template words that it matched word for word make up enough of the template.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_text

#: A word, the phrases that carry base labels.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {
    "gpl": "gnu general public license",
    "apache": "apache license",
    "cc-by": "cc by",
    "mit": "mit license",
}
#: Public license wording, as label and template: notices, headers and whole texts.
TEMPLATES = [
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-2-clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("all-rights-reserved", "All rights reserved."),
]
#: Share of a template's k-grams that verifies a span, for templates of so many k-grams and more.
SHARES = ((0, 1.0), (15, 0.75), (60, 0.6))
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
REMEMBER, CHUNK, FEW = 200_000, 200_000, 200_000


def lower_ascii(text: str) -> str:
    """`text` with A-Z, and nothing else, in lower case."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


class WordHasher(dict):
    """Word to its 64-bit hash; forgets everything beyond a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBER:
            self.clear()
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7)
        if len(word) <= 64:
            self[word] = value
        return value


HASHED = WordHasher()


def word_hashes(text: str, overlap: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the first, hashes) of the words of a text in chunks that overlap by `overlap` words."""
    found = WORD.finditer(lower_ascii(text))
    at, tail = 0, np.zeros(0, np.uint64)
    while words := [HASHED[m[0]] for m in islice(found, CHUNK)]:
        both = np.concatenate((tail, np.array(words, dtype=np.uint64)))
        yield at - len(tail), both
        at += len(words)
        tail = both[len(both) - min(overlap, len(both)) :] if overlap else both[:0]


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of all runs of k word hashes."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - k + 1].copy()
    for j in range(1, k):
        out = out * MULTIPLY + words[j : len(words) - k + 1 + j]
    return out


def _hashes(text: str) -> np.ndarray:
    return np.array([HASHED[w] for w in WORD.findall(lower_ascii(text))], dtype=np.uint64)


def places(words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the words of `phrase` stand one after another in `words`."""
    n = len(words) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(words[:n] == phrase[0])
    for j in range(1, len(phrase)):
        at = at[words[at + j] == phrase[j]]
    return at


def template_grams(k: int, templates: list[tuple[str, str]]) -> list[tuple[int, int, int, int]]:
    """(template, hash, position, grams of the template) of each k-gram of each template."""
    rows = []
    for t, (_, text) in enumerate(templates):
        own = grams(_hashes(text), k).view(np.int64).tolist()
        rows += [(t, h, p, len(own)) for p, h in enumerate(own)]
    return rows


def scan(docs: DataFrame, text: str = "text", id: str = "doc_id", k: int = 3, templates: list[tuple[str, str]] = TEMPLATES, shares: tuple = SHARES) -> DataFrame:
    """One row per row of `docs`: `id`, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    A template counts where so much of its k-grams stands on one merged diagonal as `shares` asks for its length: a
    notice of a few words must stand whole, of a long text words can be changed, missing or added.
    `score` is the largest share of a template's k-grams found on one merged diagonal, 1 where a base phrase stands.
    `spans` lists (label, first word, last word, matched share) of the verified template spans. Null and empty texts
    have no words, null places, empty labels and score 0. Rows with equal ids each keep their own row.
    """
    spark = docs.sparkSession
    rows = template_grams(k, templates)
    table = spark.createDataFrame(rows, "template int, hash long, position int, grams int")
    wanted = np.unique(np.array([h for _, h, _, _ in rows], dtype=np.int64).view(np.uint64))
    phrases = [(label, _hashes(text)) for label, text in PHRASES.items()]
    longest = max([k, *(len(p) for _, p in phrases)])

    def work(texts: list[str]) -> list[pa.Array]:
        n_words, n_base, first, last, base, hits = [], [], [], [], [], []
        for t in texts:
            n, total, lo, hi, labels, found = 0, 0, None, None, set(), []
            for at, words in word_hashes(t, longest - 1):
                old = max(0, n - at)
                n = at + len(words)
                for label, phrase in phrases:
                    own = places(words, phrase)
                    own = own[own + len(phrase) > old]
                    if len(own):
                        total += len(own)
                        labels.add(label)
                        lo = int(own[0]) + at if lo is None else min(lo, int(own[0]) + at)
                        hi = int(own[-1]) + at if hi is None else max(hi, int(own[-1]) + at)
                rolled = grams(words, k)
                near = np.searchsorted(wanted, rolled)
                own = np.flatnonzero(wanted[np.minimum(near, len(wanted) - 1)] == rolled)
                own = own[own + k > old]
                found += [{"hash": h, "place": p} for h, p in zip(rolled[own].view(np.int64).tolist(), (own + at).tolist(), strict=True)]
            n_words.append(n)
            n_base.append(total)
            first.append(lo)
            last.append(hi)
            base.append(",".join(sorted(labels)))
            hits.append(found)
        kind = pa.list_(pa.struct([("hash", pa.int64()), ("place", pa.int64())]))
        return [pa.array(n_words, pa.int64()), pa.array(n_base, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base, pa.string()), pa.array(hits, kind)]

    fields = [("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("hits", "array<struct<hash:long,place:long>>")]
    read = map_text(docs.select(F.col(id).alias("__id"), F.col(text).alias("__body")), "__body", ["__id"], work, fields)
    read = read.withColumn("__row", F.monotonically_increasing_id())
    names = F.array(*[F.lit(label) for label, _ in templates])
    # the templates came as a list; beyond so many k-grams they are joined like any table
    return _vote(read, F.broadcast(table) if len(rows) <= FEW else table, names, k, shares).withColumnRenamed("__id", id)


def _vote(read: DataFrame, table: DataFrame, names, k: int, shares: tuple) -> DataFrame:
    from .common import checkpointed

    read = checkpointed(read)
    hit = read.where(F.size("hits") > 0).select("__row", F.explode("hits").alias("h")).select("__row", "h.hash", "h.place")
    votes = hit.join(table, "hash").withColumn("diagonal", F.col("place") - F.col("position"))
    lines = votes.groupBy("__row", "template", "grams", "diagonal").agg(F.collect_set("position").alias("positions"), F.min("place").alias("lo"), F.max("place").alias("hi"))
    order = W.partitionBy("__row", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > 2, F.lit(True)).cast("int")
    merged = lines.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    spans = merged.groupBy("__row", "template", "grams", "run").agg(F.size(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("matched"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    spans = spans.withColumn("part", F.col("matched") / F.col("grams"))
    spans = spans.withColumn("label", F.element_at(names, F.col("template") + 1))
    asked = F.lit(float(shares[0][1]))
    for least, share in shares[1:]:
        asked = F.when(F.col("grams") >= least, float(share)).otherwise(asked)
    per = spans.groupBy("__row").agg(
        F.max("part").alias("part"),
        F.array_sort(F.collect_list(F.when(F.col("part") >= asked, F.struct("label", F.col("lo").alias("first"), (F.col("hi") + k - 1).alias("last"), F.col("part").alias("share"))))).alias("spans"),
    )
    base = F.when(F.col("base_labels") == "", F.array().cast("array<string>")).otherwise(F.split("base_labels", ","))
    spans_or = F.coalesce("spans", F.array().cast("array<struct<label:string,first:bigint,last:bigint,share:double>>"))
    labels = F.array_join(F.array_sort(F.array_distinct(F.concat(base, spans_or["label"]))), ",")
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("part", F.lit(0.0)))
    out = read.join(per, "__row", "left")
    return out.select("__id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"), spans_or.alias("spans"))


def oracle(templates: list[tuple[str, str]] = TEMPLATES, shares: tuple = SHARES) -> str:
    """SQL (DuckDB) for `op4_licenses`: words, phrases and votes by words instead of hashes."""
    words = lambda text: WORD.findall(lower_ascii(text))
    values = lambda rows: ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)
    phrases = [(label, len(words(p)), i, w) for label, p in PHRASES.items() for i, w in enumerate(words(p))]
    grams3 = [(t, p, len(w) - 2, *w[p : p + 3]) for t, (_, text) in enumerate(templates) for w in [words(text)] for p in range(len(w) - 2)]
    asked = "case " + " ".join(f"when grams >= {n} then {s}" for n, s in sorted(shares, reverse=True)) + " end"
    return f"""with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents),
 w as materialized (select doc_id, unnest(ws) as w, unnest(range(len(ws))) as p from d),
 ph(label, n, i, w) as (values {values(phrases)}),
 b as (select doc_id, label, w.p - ph.i as start from w join ph using (w) group by doc_id, label, n, w.p - ph.i having count(*) = n),
 b2 as (select doc_id, count(*) as n_base, min(start) as first_word, max(start) as last_word, list_sort(list(distinct label)) as base from b group by doc_id),
 tg(template, position, grams, a, b, c) as (values {values(grams3)}),
 tl(template, label) as (values {values((t, label) for t, (label, _) in enumerate(templates))}),
 g as materialized (select * from (select doc_id, p, w as a, lead(w) over (partition by doc_id order by p) as b, lead(w, 2) over (partition by doc_id order by p) as c from w) where c is not null),
 v as (select distinct doc_id, template, grams, p - position as diagonal, position from g join tg using (a, b, c)),
 l as (select doc_id, template, grams, diagonal, list(position) as ps from v group by doc_id, template, grams, diagonal),
 f as (select *, case when diagonal - lag(diagonal) over o <= 2 then 0 else 1 end as fresh from l window o as (partition by doc_id, template order by diagonal)),
 r as (select *, sum(fresh) over (partition by doc_id, template order by diagonal) as run from f),
 s as (select doc_id, template, grams, len(list_distinct(flatten(list(ps)))) / grams as part from r group by doc_id, template, grams, run),
 k as (select doc_id, max(part) as part, list(distinct label) filter (part >= {asked}) as found from s join tl using (template) group by doc_id)
 select d.doc_id, len(ws) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, array_to_string(coalesce(base, []), ',') as base_labels,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ',') as labels, case when n_base > 0 then 1.0::double else coalesce(part, 0.0)::double end as score
 from d left join b2 using (doc_id) left join k using (doc_id)"""


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    """License phrases and template spans of every document."""
    from .common import table

    return scan(table(spark, sf_dir, "documents")).drop("spans")


