"""Token counts with a whole-token shortcut.

A vocabulary string is a whole token if it is one pre-token by itself and the tokenizer encodes it alone as exactly
one token; that is established once per vocabulary, before any text is read. A text is cut into pre-tokens; whole
ones count one each by a set lookup and only the rest goes through the merges.

Pieces between single spaces are counted once and remembered: where every space of a text stands before a non-space,
a pre-token always ends before a space, so a piece with its leading space is counted by itself. Other texts are cut
by the pattern as one piece.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text

#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
LOOSE = regex.compile(r" (?!\S)")
#: Distinct pieces and merged strings a worker remembers, and the longest of them in characters.
REMEMBER, LONGEST = 500_000, 64


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The letters with which byte-level vocabularies write bytes: printable ones as they are, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Counter:
    """Counts tokens of texts as the tokenizers library does for one byte-level BPE file."""

    def __init__(self, content: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(content)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.whole = self._prove()
        self.known: dict[str, int] = {}
        self.merged: dict[str, int] = {}

    def _prove(self) -> frozenset[str]:
        letters = _byte_letters()
        texts = []
        for token in self.tokenizer.get_vocab(with_added_tokens=False):
            try:
                text = bytes(letters[c] for c in token).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if text not in self.special and PATTERN.findall(text) == [text]:
                texts.append(text)
        return frozenset(t for t, e in zip(texts, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True) if len(e.ids) == 1)

    def _merged(self, texts: list[str]) -> list[int]:
        """Tokens of each text, cut by the pattern; what is no whole token is merged, each distinct string once."""
        whole, out, rest, of = self.whole, [], {}, []
        for i, text in enumerate(texts):
            n = 0
            for at in PATTERN.finditer(text):
                if (token := at[0]) in whole:
                    n += 1
                else:
                    of.append((i, rest.setdefault(token, len(rest))))
            out.append(n)
        if rest:
            merged = self.merged
            if len(merged) > REMEMBER:
                merged.clear()
            sizes = list(map(merged.get, rest))
            new = [t for t, n in zip(rest, sizes, strict=True) if n is None]
            for token, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
                n = sizes[rest[token]] = len(e.ids)
                if len(token) <= LONGEST:
                    merged[token] = n
            for i, k in of:
                out[i] += sizes[k]
        return out

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; special strings count as the one token that the library makes of them."""
        out = [0] * len(texts)
        parts: list[tuple[int, list[str]]] = []
        loose: list[tuple[int, str]] = []
        for i, text in enumerate(texts):
            spans = [text]
            if self.split and any(s in text for s in self.special):
                spans = self.split.split(text)
                out[i] += len(spans) - 1
            for span in spans:
                if not span:
                    continue
                if LOOSE.search(span):
                    loose.append((i, span))
                    continue
                first, *others = span.split(" ")
                if first:
                    loose.append((i, first))
                if others:
                    parts.append((i, others))
        known = self.known
        if len(known) > REMEMBER:
            known.clear()
        new = {p for _, some in parts for p in some if p not in known}
        once = {}
        if new:
            order = list(new)
            for p, n in zip(order, self._merged([" " + p for p in order]), strict=True):
                (known if len(p) <= LONGEST else once)[p] = n
        for i, some in parts:
            if once:
                out[i] += sum(known[p] if p in known else once[p] for p in some)
            else:
                out[i] += sum(map(known.__getitem__, some))
        for (i, _), n in zip(loose, self._merged([t for _, t in loose]), strict=True):
            out[i] += n
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The counter for a vocabulary file of this machine."""
    return Counter(Path(path).read_bytes())


#: Counters of a worker process by the digest of their vocabulary.
COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, limit: int = 512, rows: int = 256) -> DataFrame:
    """`keep` columns (default doc_id) with n_bytes, n_tokens and over_limit (more than `limit` tokens).

    A null text counts as empty: 0 bytes, 0 tokens, not over the limit. Repeated rows each keep their row; an empty
    table gives no rows. `path` is a byte-level BPE file that the driver can read; its bytes, a few MB whatever the
    table, go to the executors.
    """
    keep = keep or ["doc_id"]
    if "over_limit" in keep:
        raise ValueError("the column over_limit of the table has the name of a result; leave it out or rename it")
    content = Path(path).read_bytes()
    digest, shared = hashlib.sha256(content).hexdigest(), docs.sparkSession.sparkContext.broadcast(content)

    def work(texts: list[str]) -> list[pa.Array]:
        if digest not in COUNTERS:
            COUNTERS[digest] = Counter(shared.value)
        return [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(COUNTERS[digest].count(texts), pa.int64())]

    found = map_text(docs, text, keep, work, [("n_bytes", "long"), ("n_tokens", "long")], rows)
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document under byte_bpe_50k.json."""
    from .common import table

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path())
