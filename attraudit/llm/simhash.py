"""Operator 7, SimHash near-duplicates by anchor-point covering.

Fingerprint: A-Z in lower case, words parted by ASCII white space, four-word shingles with repeats (all
words if there are fewer), XXH64 with seed 42; a bit is set if more than half of the hashes have it. No
words or a null text give zero, which is linked like any other fingerprint.

Links are pairs of fingerprints that differ in at most four bits. The 64 bits fall into three segments of
21, 21 and 22 bits; of two linked fingerprints, one segment differs in at most one bit. The anchors of a
segment are a covering code: the perfect Hamming code on its first 15 bits and every value on the others,
so that each value lies within radius 1 of exactly one anchor, its home. A fingerprint is copied to every
anchor within radius + 1 = 2 of its segment (14 to 29 anchors), hence it meets each fingerprint linked to
it at that one's home: no link is missed. At an anchor, homes are compared with all that came, and only a
spanning forest of the links is handed on, never all pairs. Equal fingerprints are one row from the start.
Anchors with very many visitors are cut into a grid of blocks of homes and visitors, each compared once.

Components follow from the forest's edges by star contraction. Rows that repeat a document join its
component. Null doc_ids get a fingerprint and a component; a component's id is its smallest doc_id that
isn't null. Empty tables give empty results; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attraudit.llm.common import bounded, fresh, stored, text_or_empty
from attraudit.llm.components import components

WORDS, SEED, DIFFER = 4, 42, 4
SEGMENTS = ((0, 21), (21, 21), (42, 22))  # first bit and width
HAMMING = 15  # bits of a segment in the perfect code
BLOCK = 4096  # rows of an anchor that are compared in one go
PAIRS = 2_000_000  # pairs compared at once in memory


def fingerprint_of(text: str) -> int:
    """The fingerprint of one text, unsigned."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # both are ASCII-only on bytes
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "<i8", len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(WORDS, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist())
    h = np.fromiter((xxh64_intdigest(flat[a:b], SEED) for a, b in spans), "<u8", len(words) - k + 1)
    ones = np.zeros(64, "<i8")
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i:i + 8192].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="<i8")
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: Column | str) -> Column:
    """The fingerprints of texts as signed 64-bit integers."""
    @F.arrow_udf(T.LongType())
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array(np.array([fingerprint_of(t.as_py()) for t in b], "<u8").view("<i8"))

    return of(text_or_empty(text))


def anchor_masks() -> list[list[np.ndarray]]:
    """By segment and syndrome of its first 15 bits: what to flip to get each anchor within radius 2, the home first."""
    out = []
    for _, width in SEGMENTS:
        flips = {0: [0], 1: [1 << i for i in range(HAMMING, width)]}
        flips[2] = [a | b for k, a in enumerate(flips[1]) for b in flips[1][k + 1:]]
        by_syndrome = []
        for s in range(HAMMING + 1):
            codes = [(0, 0)] if s == 0 else [(1 << (s - 1), 1)] + [(1 << (i - 1) | 1 << ((i ^ s) - 1), 2) for i in range(1, 16) if i < i ^ s]
            near = sorted((w + d, e | f) for e, w in codes for d in range(3 - w) for f in flips[d])
            by_syndrome.append(np.array([m for _, m in near], "<i8"))
        out.append(by_syndrome)
    return out


def _syndromes(values: np.ndarray) -> np.ndarray:
    s = np.zeros(len(values), "<i8")
    for i in range(HAMMING):
        s ^= np.where(values >> i & 1, i + 1, 0)
    return s


def anchors_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, fingerprint, home) of signed fingerprints: every anchor that each is copied to."""
    keys, fps, homes = [], [], []
    for k, ((first, width), masks) in enumerate(zip(SEGMENTS, anchor_masks())):
        value = (fp >> first) & ((1 << width) - 1)
        syndrome = _syndromes(value)
        for s in range(HAMMING + 1):
            own = np.flatnonzero(syndrome == s)
            m = masks[s]
            keys.append(((value[own][:, None] ^ m) | k << 32).ravel())
            fps.append(np.repeat(fp[own], len(m)))
            homes.append(np.tile(np.arange(len(m)) == 0, len(own)))
    return np.concatenate(keys), np.concatenate(fps), np.concatenate(homes)


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        for i in range(0, len(fp), 2048):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in anchors_of(fp[i:i + 2048])], ["key", "fp", "home"])


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of rows a[i] and b[i]; label holds a forest whose roots are smallest."""
    while True:
        while not np.array_equal(up := label[label], label):
            label[:] = up
        x, y = label[a], label[b]
        if np.array_equal(x, y):
            return
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))


def _forest(block: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the links within each block of equal ids; rows come sorted by block."""
    begin = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    size = np.diff(np.concatenate([begin, [len(block)]]))
    group = np.repeat(np.arange(len(begin)), size)
    left = np.flatnonzero(home & (size[group] > 1))
    pairs = np.cumsum(size[group[left]])
    label = np.arange(len(block))
    at = 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + PAIRS, "right")))
        own = left[at:to]
        n = size[group[own]]
        a = np.repeat(own, n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[group[own]], n)
        near = np.bitwise_count((fp[a] ^ fp[b]).view("<u8")) <= DIFFER
        _unite(label, a[near], b[near])
        at = to
    linked = np.flatnonzero((label != np.arange(len(label))) & (fp[label] != fp))
    return fp[linked], fp[label[linked]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor and block; a batch's last block waits for the next batch."""
    rest: list[np.ndarray] | None = None

    def edges(cols: list[np.ndarray]) -> pa.RecordBatch:
        u, v = _forest(cols[0], cols[1], cols[2])
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    waiting: list[list[np.ndarray]] = []
    for b in batches:
        key, ch, cv, fp, home = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        if not len(key):
            continue
        new = np.concatenate([[False], (key[1:] != key[:-1]) | (ch[1:] != ch[:-1]) | (cv[1:] != cv[:-1])])
        ident = (key[0], ch[0], cv[0])
        block = np.cumsum(new)
        if rest is not None and rest == ident:
            waiting.append([np.zeros(int((block == 0).sum()), "<i8"), fp[block == 0], home[block == 0]])
            done = block > 0
            if not done.any():
                continue
            block, fp, home, key, ch, cv = block[done], fp[done], home[done], key[done], ch[done], cv[done]
        if waiting:
            yield edges([np.concatenate(c) for c in zip(*waiting)])
        last = block == block[-1]
        waiting = [[np.zeros(int(last.sum()), "<i8"), fp[last], home[last]]]
        rest = (key[-1], ch[-1], cv[-1])
        if not last.all():
            yield edges([block[~last], fp[~last], home[~last]])
    if waiting:
        yield edges([np.concatenate(c) for c in zip(*waiting)])


def links(fingerprints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that connect exactly the distinct fingerprints (fp) that links connect."""
    fps = fingerprints.select("fp")
    copies = fps.mapInArrow(_copies, "key long, fp long, home boolean")
    load = copies.groupBy("key").agg(F.count("*").alias("visitors"), F.sum(F.col("home").cast("long")).alias("homes"))
    full = stored(load.where(F.col("visitors") > block), "full_anchors")
    zero = F.lit(0).cast("long")
    if full.isEmpty():
        rows = copies.select("key", zero.alias("ch"), zero.alias("cv"), "fp", "home")
    else:
        cuts = full.select("key", F.ceil(F.col("homes") / block).alias("nh"), F.ceil(F.col("visitors") / block).alias("nv"))
        wide = copies.join(cuts, "key", "left").fillna(1, ["nh", "nv"])
        own_h, own_v = F.pmod(F.xxhash64("fp"), F.greatest("nh", F.lit(1))), F.pmod(F.xxhash64("fp", F.lit(1)), F.col("nv"))
        # a visitor meets each block of homes; a home each block of visitors, where it isn't a visitor itself
        met = F.transform(F.sequence(zero, F.greatest("nh", F.lit(1)) - 1), lambda i: F.struct(i.alias("ch"), own_v.alias("cv"), (F.col("home") & (i == own_h)).alias("home")))
        led = F.transform(F.sequence(zero, F.col("nv") - 1), lambda j: F.struct(own_h.alias("ch"), j.alias("cv"), F.lit(True).alias("home")))
        led = F.when(F.col("home"), F.filter(led, lambda x: x["cv"] != own_v)).otherwise(F.array().cast(T.ArrayType(T.StructType([T.StructField("ch", T.LongType()), T.StructField("cv", T.LongType()), T.StructField("home", T.BooleanType())]))))
        rows = wide.select("key", "fp", F.explode(F.concat(met, led)).alias("x")).select("key", "x.ch", "x.cv", "fp", "x.home")
    dealt = rows.repartition("key", "ch", "cv").sortWithinPartitions("key", "ch", "cv")
    return dealt.mapInArrow(_compare, "u long, v long")


def _classes(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, th, fp, root, component_id): th is the text's hash, root a fingerprint that names the component."""
    docs = stored(df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("th"), fingerprint(text).alias("fp")), "fingerprints")
    fps = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    return rooted(docs, fps, links(fps))


def rooted(docs: DataFrame, fps: DataFrame, edges: DataFrame) -> DataFrame:
    """The documents with root and component_id, given the distinct fingerprints (fp, first doc_id) and their edges."""
    roots = components(edges).withColumnRenamed("u", "fp")
    known = stored(fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = stored(known.groupBy("root").agg(F.min("first").alias("component_id")), "least")  # stored, so that a frequent root is split in the join
    by_fp = stored(known.join(least, "root").select("fp", "root", "component_id"), "components")
    return docs.join(by_fp, "fp")


def report(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, fingerprint in 16 hexadecimal digits, component_id."""
    return _classes(df, text, doc_id).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, text: str = "text", doc_id: str = "doc_id", classes: Callable[[DataFrame, str, str], DataFrame] = _classes) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id.

    If several rows of a component bear that id, the one with the smallest text hash stays, once. Rows
    without a doc_id all stay.
    """
    th, n, id_, row = fresh(df, "__th", "__n", "__id", "__r")
    named = classes(df, text, doc_id).where(F.col("doc_id").isNotNull())
    own = named.where(F.col("doc_id") == F.col("component_id")).groupBy("root", "doc_id").agg(F.min("th").alias(th), F.count("*").alias(n))
    own = stored(own.select(F.col("doc_id").alias(id_), th, n), "firsts")
    lost = named.select(F.col("doc_id").alias(id_), F.col("th").alias(th)).distinct().join(own, [id_, th], "left_anti")
    here = (F.col(doc_id) == F.col(id_)) & (F.xxhash64(text_or_empty(text)) == F.col(th))
    kept = df.join(bounded(stored(lost, "lost")), here, "left_anti")  # what goes is short or near it: texts stay where they are
    twice = bounded(stored(own.where(F.col(n) > 1).drop(n), "repeated"))
    again = kept.join(twice, here, "left_semi").groupBy(doc_id, F.xxhash64(text_or_empty(text)).alias(th)).agg(F.first(F.struct(*df.columns)).alias(row))
    return kept.join(twice, here, "left_anti").unionByName(again.select(f"{row}.*"))
