"""Operator 13, alignment of two tokenizers by galloping intersection of their token ends.

A is a byte-level BPE over a blank and the text, B a sentencepiece BPE that adds the blank itself. Token ends
are byte offsets in the blank and the text. The shorter list of ends is searched in the longer one: from the
start of a value's chunk in steps that double, then by bisection, all values at once. Ends that both have cut the tokens into groups; the ranks of
a token's start and end among the other's ends give the tokens whose bytes it overlaps, its links.

A blank between two characters that aren't white space always starts a token of both (``chunks``): A's
pattern takes it with what follows, and no piece of B has a blank inside. So a text falls into chunks that are
encoded and aligned by themselves, and a chunk that repeats is done once per task. Files for which this isn't
proven are refused.

One pass over the texts stores each document's distinct pairs of linked ids with their numbers. Counts over the
corpus are summed per task before the shuffle, then added up over each document's pairs. The table of pairs is broadcast if a count
proves it short; else the documents' pairs are joined with it in a shuffle, which gives the same.

Null and empty texts, and texts whose joined tokens don't give back their bytes, have no tokens: zeros and ''.
Repeated rows count each for themselves, null doc_ids are kept, other columns are not read, empty tables give
empty results.
"""
from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attraudit.llm.common import stored, text_or_empty, tidy

CACHED_CHUNKS, CACHED_CHARS, SLICE_ROWS = 400_000, 48, 128
SECTION = 50_000  # chunks aligned at once
_WIDE = re.compile(r" \s|\s |\A\s|\s\Z")  # a blank beside white space, or such at an end
CACHED_PAIRS = 1_000_000  # pairs a task holds before it hands them on
BROADCAST_PAIRS = 2_000_000  # 16 bytes each


def check_files(byte_level: str, pieces: str) -> None:
    """Refuse files for which chunks may not be parted. Called on the driver."""
    from sentencepiece import SentencePieceProcessor

    with open(byte_level, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"] or {}
    if spec["normalizer"] is not None or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
        raise ValueError("expected a byte-level BPE with its usual pattern")
    sp = SentencePieceProcessor(model_file=pieces)
    if any("▁" in sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size())):
        raise ValueError("a piece has a blank inside: words can't be parted")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 as itself, the rest from U+0100 on."""
    same = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in same]
    return {chr(b): b for b in same} | {chr(256 + k): b for k, b in enumerate(rest)}


def gallop(shorter: np.ndarray, longer: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each value of an ascending list, the place of the first value in the longer one that isn't smaller.

    All values search at once, each from its own ``start``, a place not beyond what it looks for: steps double
    until a value isn't smaller, then the last step is bisected.
    """
    n, lo, hi = len(longer), start.copy(), start.copy()
    step, open_ = 1, np.flatnonzero(start < n)
    while True:
        open_ = open_[longer[hi[open_]] < shorter[open_]]
        if not len(open_):
            break
        lo[open_] = hi[open_] + 1
        hi[open_] += step
        step *= 2
        open_ = open_[hi[open_] < n]
    np.minimum(hi, n, out=hi)
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) >> 1
        less = longer[mid] < shorter[open_]
        lo[open_] = np.where(less, mid + 1, lo[open_])
        hi[open_] = np.where(less, hi[open_], mid)
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def overlaps(shorter: np.ndarray, longer: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two lists of ends with the same last end: for each token of the shorter the first and last token of the
    longer that it overlaps, and whether both end together."""
    last = gallop(shorter, longer, start)
    common = longer[last] == shorter
    first = np.zeros(len(last), "<i8")
    first[1:] = last[:-1] + common[:-1]  # after a common end the next token, else the one that is cut
    return first, last, common


def chunks(text: str) -> list[str]:
    """The text cut at blanks between characters that aren't white space; the blanks are left out."""
    parts = text.split(" ")
    if not _WIDE.search(text):
        return parts
    out, open_ = [parts[0]], parts[0] == "" or parts[0][-1].isspace()
    for p in parts[1:]:
        if open_ or p == "" or p[0].isspace():
            out[-1] += " " + p
        else:
            out.append(p)
        open_ = p == "" or p[-1].isspace()
    return out


class Aligner:
    """Texts under both tokenizers; the ids of chunks are kept while they are short."""

    def __init__(self, byte_level: str, pieces: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True  # their strings inside texts are plain text
        self.b = SentencePieceProcessor(model_file=pieces)
        letter = byte_letters()
        self.of_a = [b""] * self.a.get_vocab_size()
        for word, i in self.a.get_vocab().items():
            self.of_a[i] = bytes(letter[c] for c in word) if all(c in letter for c in word) else word.encode()
        self.of_b = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
            for i in range(self.b.get_piece_size())
        ]
        self.len_a, self.len_b = (np.array(list(map(len, x)), "<i8") for x in (self.of_a, self.of_b))
        ids = range(max(len(self.of_a), len(self.of_b)))
        self.written = {sep: np.array([f"{i}{sep}" for i in ids], object) for sep in ",|;"}
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.odd: set[str] = set()  # chunks whose tokens don't give them back

    def learn(self, new: list[str]) -> None:
        led = [" " + c for c in new]
        ids_a = [e.ids for e in self.a.encode_batch_fast(led, add_special_tokens=False)]
        ids_b = self.b.encode(new, num_threads=1)
        for c, t, x, y in zip(new, led, ids_a, ids_b):
            if b"".join(map(self.of_a.__getitem__, x)) == t.encode() == b"".join(map(self.of_b.__getitem__, y)):
                self.known[c] = array("i", x).tobytes(), array("i", y).tobytes()
            else:
                self.known[c] = b"", b""
                self.odd.add(c)

    def texts(self, texts: Sequence[str]) -> list["Aligned"]:
        """Each text's alignment; empty if the text is, or if its tokens don't give it back."""
        if len(self.known) > CACHED_CHUNKS:
            self.known, self.odd = {}, set()
        parts = [chunks(t) if t else [] for t in texts]
        new = list(set().union(*parts).difference(self.known))
        self.learn(new)
        for k, (t, p) in enumerate(zip(texts, parts)):
            if self.odd and not self.odd.isdisjoint(p):
                self.learn([t])  # the whole text decides
                parts[k] = [] if t in self.odd else [t]
                new.append(t)
        out = [Aligned() for _ in texts]
        held: list[tuple[int, list[str]]] = []
        for k, p in enumerate(parts):
            for i in range(0, len(p), SECTION):
                held.append((k, p[i:i + SECTION]))
                if sum([len(x) for _, x in held]) >= SECTION:
                    self.sections(held, out)
                    held = []
        self.sections(held, out)
        for c in new:
            if len(c) > CACHED_CHARS and self.known.pop(c, None):
                self.odd.discard(c)
        return out

    def sections(self, held: list[tuple[int, list[str]]], out: list["Aligned"]) -> None:
        """Align sections of texts, laid one after another, and add them to their texts' alignments."""
        if not held:
            return
        got = [self.known[c] for _, p in held for c in p]
        ids = [np.frombuffer(b"".join([x[k] for x in got]), "<i4") for k in (0, 1)]
        sizes = [np.fromiter([len(x[k]) for x in got], "<i8", len(got)) // 4 for k in (0, 1)]
        ends = [np.cumsum(n[i]) for n, i in zip((self.len_a, self.len_b), ids)]
        s, l = (0, 1) if len(ids[0]) <= len(ids[1]) else (1, 0)
        begins = [np.cumsum(n) - n for n in sizes]
        first, last, common = overlaps(ends[s], ends[l], np.repeat(begins[l], sizes[s]))
        counts = last - first + 1
        up = np.cumsum(counts)
        linked = [None, None]
        linked[s] = np.repeat(ids[s], counts)
        linked[l] = ids[l][np.arange(up[-1]) - np.repeat(up - counts, counts) + np.repeat(first, counts)]
        # per section: tokens of A and B, groups, links
        chunk_ends = np.cumsum([len(p) for _, p in held])
        token_ends = [np.cumsum(n)[chunk_ends - 1] for n in sizes]
        hits = np.cumsum(common)
        cuts = [token_ends[0], token_ends[1], hits[token_ends[s] - 1], up[token_ends[s] - 1]]
        # tokens in the order of groups, A before B, written with what follows them
        at = np.flatnonzero(common)
        group_ends = [None, None]
        group_ends[s], group_ends[l] = at + 1, last[at] + 1
        (ga, gb), text = group_ends, np.empty(len(ids[0]) + len(ids[1]), object)
        place_a = np.arange(len(ids[0])) + np.repeat(np.concatenate([[0], gb[:-1]]), np.diff(ga, prepend=0))
        place_b = np.arange(len(ids[1])) + np.repeat(ga, np.diff(gb, prepend=0))
        text[place_a], text[place_b] = self.written[","][ids[0]], self.written[","][ids[1]]
        text[place_a[ga - 1]], text[place_b[gb - 1]] = self.written["|"][ids[0][ga - 1]], self.written[";"][ids[1][gb - 1]]
        # distinct pairs of a section with their numbers
        section = np.repeat(np.arange(len(held)), np.diff(cuts[3], prepend=0))
        keys, times = np.unique(section << 48 | linked[0].astype("<i8") << 24 | linked[1], return_counts=True)
        key_ends = np.searchsorted(keys, np.arange(1, len(held) + 1) << 48)
        pairs = (keys >> 24 & 0xFFFFFF) << 32 | keys & 0xFFFFFF
        numbers = np.stack([np.diff(c, prepend=0) for c in cuts], 1).tolist()
        written = text.tolist()
        w, q = 0, 0
        for (k, _), n, w1, q1 in zip(held, numbers, (token_ends[0] + token_ends[1]).tolist(), key_ends.tolist()):
            out[k].add(n, "".join(written[w:w1]), pairs[q:q1], times[q:q1])
            w, q = w1, q1


class Aligned:
    """Sums, digest of the groups, and linked pairs of one text, section by section."""

    def __init__(self) -> None:
        self.sums, self.digest, self.found = [0, 0, 0, 0], hashlib.sha256(), []

    def add(self, numbers: list[int], text: str, pairs: np.ndarray, times: np.ndarray) -> None:
        self.sums = [x + y for x, y in zip(self.sums, numbers)]
        if self.found:
            self.digest.update(b";")
        self.digest.update(text[:-1].encode())  # without the mark after the last group
        self.found.append((pairs, times))

    def groups_sha256(self) -> str:
        return self.digest.hexdigest() if self.found else ""

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.found) == 1:
            return self.found[0]
        if not self.found:
            return np.zeros(0, "<i8"), np.zeros(0, "<i8")
        keys, at = np.unique(np.concatenate([p for p, _ in self.found]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in self.found]), len(keys)).astype("<i8")


_SUMS = ["n_a", "n_b", "n_groups", "n_links"]
_ALIGNED = T.StructType([*[T.StructField(c, T.LongType()) for c in _SUMS], T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.BinaryType()), T.StructField("times", T.BinaryType())])


def align(text: Column | str, byte_level: str, pieces: str) -> Column:
    """Sums, digest of the groups, and the distinct linked pairs of a text: (A id << 32 | B id) and their numbers, packed."""
    @F.arrow_udf(_ALIGNED)
    @tidy
    def align_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        al = Aligner(byte_level, pieces)
        for b in batches:
            for k in range(0, len(b), SLICE_ROWS):
                rows = al.texts(b.slice(k, SLICE_ROWS).to_pylist())
                out = [pa.array([r.sums[j] for r in rows], pa.int64()) for j in range(len(_SUMS))]
                out.append(pa.array([r.groups_sha256() for r in rows], pa.string()))
                found = [r.pairs() for r in rows]
                out += [pa.array([x[j].astype(d).tobytes() for x in found], pa.binary()) for j, d in ((0, "<i8"), (1, "<i4"))]
                yield pa.StructArray.from_arrays(out, _ALIGNED.names)

    return align_texts(text_or_empty(text))


def _flat(packed: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, and how many each row has."""
    rows = [np.frombuffer(x, kind) for x in packed.to_pylist()]
    return np.concatenate(rows) if rows else np.zeros(0, kind), np.array([len(r) for r in rows], "<i8")


@tidy
def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, links = np.zeros(0, "<i8"), np.zeros(0, "<i8")
    for b in batches:
        more, times = _flat(b.column(0), "<i8")[0], _flat(b.column(1), "<i4")[0]
        key, at = np.unique(np.concatenate([key, more]), return_inverse=True)
        links = np.bincount(at, np.concatenate([links, times]), len(key)).astype("<i8")
        if len(key) > CACHED_PAIRS:
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(links)], ["pair", "links"])
            key, links = key[:0], links[:0]
    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(links)], ["pair", "links"])


def pair_counts(aligned_docs: DataFrame) -> DataFrame:
    """(a, b, pair, links, best) of each linked pair of ids; best: no pair of the same b has more links."""
    some = aligned_docs.select("pairs", "times").mapInArrow(_pair_sums, "pair long, links long")
    counts = some.groupBy("pair").agg(F.sum("links").alias("links"))
    counts = stored(counts.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "pair", "links"), "pair-counts")
    top = counts.groupBy("b").agg(F.max("links").alias("top"))  # as many rows as B has ids
    return stored(counts.join(top, "b").select("a", "b", "pair", "links", (F.col("links") == F.col("top")).alias("best")), "pairs")


def _looked_up(table) -> Column:
    """n_best and count_sum of documents, where the pairs' counts fit into memory."""
    @F.arrow_udf(T.StructType([T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())]))
    def look_up(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        keys, links, best = table.value
        for packed, times in pairs:
            key, sizes = _flat(packed, "<i8")
            n, at = _flat(times, "<i4")[0].astype("<i8"), np.searchsorted(keys, key)
            ends = np.cumsum(sizes)
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])]) for x in (n * best[at], n * links[at])]
            yield pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in sums], ["n_best", "count_sum"])

    return look_up("pairs", "times")


def _unpacked() -> Column:
    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())])))
    def unpack(pairs: pa.Array, times: pa.Array) -> pa.Array:
        (key, sizes), (n, _) = _flat(pairs, "<i8"), _flat(times, "<i4")
        rows = pa.StructArray.from_arrays([pa.array(key), pa.array(n.astype("<i8"))], ["pair", "n"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), rows)

    return unpack("pairs", "times")


def report(docs: DataFrame, byte_level: str, pieces: str, text: str = "text", doc_id: str = "doc_id", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document."""
    check_files(byte_level, pieces)
    rows = docs.select(F.col(doc_id).alias("doc_id"), align(text, byte_level, pieces).alias("s"))
    rows = stored(rows.select("doc_id", "s.*"), "aligned")  # texts are read once
    counts = pair_counts(rows)
    names = ["doc_id", *_SUMS, "n_best", "count_sum", "groups_sha256"]
    if counts.limit(broadcast_pairs + 1).count() <= broadcast_pairs:
        table = counts.orderBy("pair").toArrow()
        held = docs.sparkSession.sparkContext.broadcast((table["pair"].to_numpy(), table["links"].to_numpy(), table["best"].to_numpy()))
        return rows.withColumn("s", _looked_up(held)).select("*", "s.*").select(*names)
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    pairs = rows.select("row", F.inline(_unpacked())).join(counts.hint("merge"), "pair")
    sums = pairs.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("links")).alias("count_sum"))
    out = rows.join(sums, "row", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")}).select(*names)
