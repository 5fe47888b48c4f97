"""Operator 2, token counts by byte-pair merging with a heap and a linked list.

A word's symbols form a linked list; a heap holds its neighbouring pairs that have a merge. The pair of
lowest rank (leftmost first) is popped and merged until the heap is empty. The count is the number of
symbols less the merges: no identifiers are made. Words repeat, so each task counts a word once.

Null texts count as empty (0 bytes, 0 tokens); repeated rows, empty tables and extra columns change
nothing else.
"""
from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attraudit.llm.common import text_or_empty

CACHED, CACHED_CHARS = 600_000, 64
_PAIR = lambda a, b: a << 32 | b


class PairMerger:
    """Counts the tokens of words of a BPE whose merges are given in order of rank."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.first = {c: i for c, i in vocab.items() if len(c) == 1}
        self.last = {c: vocab[c + suffix] for c in self.first if c + suffix in vocab}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.made = [vocab[a + b] for a, b in pairs]
        self.rank = {vocab[a] << 32 | vocab[b]: r for r, (a, b) in enumerate(pairs)}

    def count(self, word: str) -> int:
        """Tokens of one word, spelt in the tokenizer's byte letters."""
        n = len(word)
        sym = [self.first[c] for c in word]
        sym[-1] = self.last[word[-1]]
        rank_of, made = self.rank.get, self.made
        ranks = map(rank_of, map(_PAIR, sym, sym[1:]))
        heap = [r << 32 | i for i, r in enumerate(ranks) if r is not None]  # rank, then place, in one integer
        if not heap:
            return n
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            top = heappop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            if j >= n or sym[i] < 0 or rank_of(sym[i] << 32 | sym[j]) != r:
                continue  # one of the two has been merged meanwhile
            new = sym[i] = made[r]
            sym[j] = -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                r = rank_of(new << 32 | sym[k])
                if r is not None:
                    heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0:
                r = rank_of(sym[h] << 32 | new)
                if r is not None:
                    heappush(heap, r << 32 | h)
        return left


class _Known(dict):
    """Counts by string, made where they are missing; long strings are not kept."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> int:
        n = self.make(key)
        if len(key) <= CACHED_CHARS:
            self[key] = n
        return n


def _latin(t: str) -> bool:
    try:
        t.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Counter:
    """Token counts of whole texts, special strings taken as the tokenizer does by default."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.tok = Tokenizer.from_file(path)
        self.merger = PairMerger(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        # for letters below U+0100, where all versions of Unicode agree, the word pattern runs here
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        codes = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in codes]
        self.letters = {b: chr(b) for b in codes} | {b: chr(256 + k) for k, b in enumerate(rest)}  # the byte alphabet
        self.by_word, self.by_chunk = _Known(self.word), _Known(self.rare)

    def word(self, w: str) -> int:
        return self.merger.count(w if w.isascii() and w.isprintable() else "".join(map(self.letters.__getitem__, w.encode())))

    def rare(self, chunk: str) -> int:
        pieces = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(chunk))
        return sum(self.merger.count(p) for p, _ in pieces)

    def plain(self, t: str) -> int:
        """Tokens of a text without special strings. Blanks always part words, so rare letters cost only their chunks."""
        if _latin(t):
            return sum(map(self.by_word.__getitem__, self.words.findall(t.lower())))
        total, common = 0, []
        for c in t.split(" "):
            if _latin(c):
                common.append(c)
            else:
                total += self.by_chunk[c]
        return total + sum(map(self.by_word.__getitem__, self.words.findall(" ".join(common).lower())))

    def text(self, t: str) -> int:
        for known in (self.by_word, self.by_chunk):
            if len(known) > CACHED:
                known.clear()
        if self.special is None or not self.special.search(t):
            return self.plain(t)
        return len(self.special.findall(t)) + sum(self.plain(p) for p in self.special.split(t))


def count_tokens(text: Column | str, path: str) -> Column:
    """Tokens of each whole text (long)."""
    @F.arrow_udf(T.LongType())
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(path)
        for b in batches:
            yield pa.array([counter.text(t.as_py()) for t in b], pa.int64())

    return counts(text_or_empty(text))


def token_report(df: DataFrame, path: str, limit: int = 2048, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the tokens are more than ``limit``."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"), count_tokens(text, path).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
