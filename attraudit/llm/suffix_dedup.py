"""Operator 12, removal of repeated passages by a hash-compared suffix sort.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a smaller doc_id, or before
in the same text. Every such string is a suffix, cut at LENGTH, of some place, and equal ones must meet in a sort.

* Buckets. The least hash among the ``GRAM``-byte grams of a string, and the leftmost place of it, depend on the
  string alone. Neighbouring strings share them, so a text falls into runs of strings with one anchor gram, each
  run a context of at most 2 * LENGTH - GRAM bytes. Equal strings lie in runs of equal anchors, at equal offsets.
* Candidates. Anchors of all texts are counted by their hash; an anchor in one text only, once, has no partner.
  Only the contexts of repeated anchors are moved, equal ones once per batch of texts: the later owners go whole.
* Suffix sort. The strings of one anchor and offset are sorted by merging. Of two suffixes, prefix polynomial
  hashes and a binary search give the common extension in seven steps, and the byte after it decides. Neighbours
  in that order whose extension reaches LENGTH are equal; their bytes are compared to exclude collisions, and a
  slice with a collision is grouped by its bytes. All but the earliest of equal strings are removed.
* Hot anchors. Where more than ``HOT`` texts share an anchor, its contexts are cut anew into runs by grams of
  LENGTH - 8 bytes, which spread over the buckets by what surrounds the anchor.

Exact copies are settled before: of equal texts, the one with the smallest doc_id stays in, the others go whole if
they have LENGTH bytes. Null texts are empty; a null doc_id counts as the largest. Different texts under one
doc_id are ordered by a hash of the text; equal rows are one occurrence, and none of them removes the other.
Empty tables give empty results; other columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attraudit.llm.common import bounded, stored, text_or_empty, tidy

LENGTH, GRAM = 100, 32
HOT = 20_000  # texts that share an anchor
PLACE = 20  # bits of a place within a piece; anchors keep the other 44 bits of their hash
PIECE = 1 << PLACE
BATCH = 8 << 20  # bytes of text between two hand-overs
BUCKET = 48 << 20  # bytes of text per bucket
SLICE = 2 << 20  # bytes of contexts sorted at a time
BROADCAST_TEXTS = 100_000
_MASK = np.uint64(PIECE - 1)
HEAD = np.dtype([("value", "<u8"), ("key", "<i8"), ("tid", "<i8"), ("start", "<i4"), ("off", "u1"), ("count", "u1")])
DONE = np.dtype([("tid", "<i8"), ("lo", "<i4"), ("hi", "<i4")])


class Hashes:
    """Prefix polynomial hashes modulo 2**64, a random value for each byte."""

    def __init__(self, size: int = PIECE):
        rng = np.random.default_rng(12)
        self.letter = rng.integers(0, 1 << 63, 256, dtype="<u8") * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1 << 40, 1 << 62)) * 2 + 1
        self.power = np.full(size, base, "<u8")
        self.inverse = np.full(size, pow(base, -1, 1 << 64), "<u8")
        self.power[0] = self.inverse[0] = 1
        np.multiply.accumulate(self.power, out=self.power)
        np.multiply.accumulate(self.inverse, out=self.inverse)

    def prefix(self, x: np.ndarray, place: np.ndarray | slice) -> np.ndarray:
        out = np.zeros(len(x) + 1, "<u8")
        np.cumsum(self.letter[x] * self.power[place], out=out[1:])
        return out

    def grams(self, x: np.ndarray, k: int) -> np.ndarray:
        """A mixed hash of the k bytes from each place on."""
        p = self.prefix(x, slice(0, len(x)))
        h = (p[k:] - p[:-k]) * self.inverse[:len(x) - k + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    out, size = h, 1
    while size * 2 <= w:
        out = np.minimum(out[:len(out) - size], out[size:])
        size *= 2
    return out if size == w else np.minimum(out[:len(h) - w + 1], out[w - size:])


def runs(texts: Sequence[bytes], hashes: Hashes, length: int, gram: int) -> np.ndarray:
    """Runs of strings with one anchor: text, start, count, offset of the anchor in the first string, value."""
    found, held, size = [], [], 0

    def flush() -> None:
        nonlocal held, size
        if not held:
            return
        x = np.frombuffer(b"".join([p for _, _, p in held]), "u1")
        sizes = np.array([len(p) for _, _, p in held], "<i8")
        ends = np.cumsum(sizes)
        h = hashes.grams(x, gram)
        h &= ~_MASK
        h |= np.arange(len(h), dtype="<u8")
        least = sliding_min(h, length - gram + 1)
        valid = np.ones(len(x) + 1, "?")
        for e in ends.tolist():
            valid[e - length + 1:e] = False
        valid = valid[:len(least) + 1]
        valid[len(least)] = False
        same = np.zeros(len(least) + 1, "?")  # string s has the anchor of s - 1
        same[1:-1] = least[1:] == least[:-1]
        before = np.concatenate([[False], valid[:-1]])
        first = np.flatnonzero(valid & ~(before & same))
        last = np.flatnonzero(valid[:-1] & ~(valid[1:] & same[1:]))
        piece = np.searchsorted(ends, first, "right")
        out = np.empty(len(first), [("text", "<i8"), ("start", "<i4"), ("count", "u1"), ("off", "u1"), ("value", "<u8")])
        out["text"] = np.array([t for t, _, _ in held], "<i8")[piece]
        out["start"] = first - (ends - sizes)[piece] + np.array([s for _, s, _ in held], "<i8")[piece]
        out["count"] = last - first + 1
        out["off"] = (least[first] & _MASK).astype("<i8") - first
        out["value"] = least[first] >> np.uint64(PLACE)
        found.append(out)
        held, size = [], 0

    for t, text in enumerate(texts):
        for s in range(0, len(text) - length + 1, PIECE - length + 1):
            part = text[s:s + PIECE]
            if size + len(part) > PIECE:
                flush()
            held.append((t, s, part))
            size += len(part)
    flush()
    return np.concatenate(found) if found else np.empty(0, [("text", "<i8"), ("start", "<i4"), ("count", "u1"), ("off", "u1"), ("value", "<u8")])


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every run, one after another."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(start, count)


class Suffixes:
    """Suffixes of contexts, compared through prefix hashes and a binary search for their common extension."""

    def __init__(self, x: np.ndarray, local: np.ndarray, hashes: Hashes, length: int):
        self.x, self.local, self.power, self.length = x, local, hashes.power, length
        self.prefix = hashes.prefix(x, local)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common bytes from two places on, LENGTH at most."""
        lo, hi = np.zeros(len(a), "<i8"), np.full(len(a), self.length)
        at_a, at_b = self.power[self.local[a]], self.power[self.local[b]]
        pa_, pb_ = self.prefix[a], self.prefix[b]
        for _ in range(int(self.length).bit_length()):
            mid = (lo + hi + 1) >> 1
            equal = (self.prefix[a + mid] - pa_) * at_b == (self.prefix[b + mid] - pb_) * at_a
            lo, hi = np.where(equal, mid, lo), np.where(equal, hi, np.maximum(mid - 1, lo))
        return lo

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as a's string is less than, equal to or greater than b's."""
        n = self.extension(a, b)
        whole = n == self.length
        n[whole] = 0
        return np.where(whole, 0, np.sign(self.x[a + n].astype("<i2") - self.x[b + n]))

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The order of places ascending by string within each group (groups lie together): merges of runs of 1, 2, 4, ..."""
        n = len(at)
        order = np.arange(n)
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.concatenate([heads, [n]]))
        lo_of, hi_of = np.repeat(heads, sizes), np.repeat(heads + sizes, sizes)
        size, most = 1, int(sizes.max(initial=0))
        while size < most:
            place = np.arange(n) - lo_of
            run = place // size
            lo = lo_of + (run ^ 1) * size
            active = np.flatnonzero(lo < hi_of)
            lo = lo[active]
            hi, odd, mine = np.minimum(lo + size, hi_of[active]), (run[active] & 1).astype("?"), at[order[active]]
            start, low = lo_of[active] + (run[active] >> 1) * 2 * size, lo.copy()
            open_ = np.flatnonzero(low < hi)
            while len(open_):
                mid = (low[open_] + hi[open_]) >> 1
                c = self.compare(at[order[mid]], mine[open_])
                goes_first = (c < 0) | ((c == 0) & odd[open_])  # equal strings keep the order of their runs
                low[open_] = np.where(goes_first, mid + 1, low[open_])
                hi[open_] = np.where(goes_first, hi[open_], mid)
                open_ = open_[low[open_] < hi[open_]]
            merged = order.copy()
            merged[start + (place[active] - run[active] * size) + low - lo] = order[active]
            order, size = merged, size * 2
        return order

    def strings(self, at: np.ndarray) -> np.ndarray:
        """The bytes of strings, a row each."""
        return np.lib.stride_tricks.sliding_window_view(self.x, self.length)[at]

    def classes(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """A number for each place, equal for equal strings of a group."""
        order = self.sort(at, group)
        a, b = at[order[:-1]], at[order[1:]]
        equal = (group[order[:-1]] == group[order[1:]]) & (self.extension(a, b) == self.length)
        out = np.empty(len(at), "<i8")
        out[order] = np.concatenate([[0], np.cumsum(~equal)])
        pairs = np.flatnonzero(equal)
        for k in range(0, len(pairs), 1 << 16):
            some = pairs[k:k + (1 << 16)]
            if not (self.strings(a[some]) == self.strings(b[some])).all():  # a collision: let the bytes decide
                numbers: dict[tuple[int, bytes], int] = {}
                return np.array([numbers.setdefault((g, self.x[p:p + self.length].tobytes()), len(numbers)) for g, p in zip(group.tolist(), at.tolist())], "<i8")
        return out


def earliest(label: np.ndarray, heads: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether an occurrence is later than the first one with its label; equal occurrences are both first."""
    order = np.lexsort((start, heads["tid"], heads["key"], label))
    l, k, t, s = label[order], heads["key"][order], heads["tid"][order], start[order]
    new = np.concatenate([[True], l[1:] != l[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(len(l)), 0))
    later = (k != k[first]) | (t != t[first]) | (s != s[first])
    out = np.empty(len(l), "?")
    out[order] = later
    return out


def repeated(heads: np.ndarray, x: np.ndarray, hashes: Hashes, length: int) -> Iterator[np.ndarray]:
    """DONE rows: what of each context goes, from contexts (heads in order of value, bytes one after another)."""
    sizes = heads["count"].astype("<i8") + length - 1
    base = np.cumsum(sizes) - sizes
    cuts = np.flatnonzero(np.concatenate([[True], heads["value"][1:] != heads["value"][:-1], [True]]))
    k = 0
    while k < len(cuts) - 1:
        j = k + 1
        while j < len(cuts) - 1 and base[cuts[j + 1] - 1] + sizes[cuts[j + 1] - 1] - base[cuts[k]] <= SLICE:
            j += 1
        lo, hi = int(cuts[k]), int(cuts[j])
        k = j
        h, n, b = heads[lo:hi], sizes[lo:hi], base[lo:hi] - base[lo]
        part = Suffixes(x[base[lo]:base[lo] + int(n.sum())], spread(np.zeros(len(n), "<i8"), n), hashes, length)
        counts = h["count"].astype("<i8")
        ctx, j_ = np.repeat(np.arange(hi - lo), counts), spread(np.zeros(len(h), "<i8"), counts)
        anchor = np.cumsum(np.concatenate([[0], h["value"][1:] != h["value"][:-1]]))
        group = anchor[ctx] * 256 + (h["off"][ctx] - j_)
        order = np.argsort(group, kind="stable")
        g = group[order]
        alone = np.concatenate([[True], g[1:] != g[:-1]]) & np.concatenate([g[1:] != g[:-1], [True]])
        order = order[~alone]
        if not len(order):
            continue
        ctx, j_, g = ctx[order], j_[order], group[order]
        start = h["start"][ctx].astype("<i8") + j_
        gone = np.flatnonzero(earliest(part.classes(b[ctx] + j_, g), h[ctx], start))
        if len(gone):  # strings of one context overlap: their union is one range
            lo_, hi_ = np.full(len(h), 1 << 40), np.full(len(h), -1)
            np.minimum.at(lo_, ctx[gone], start[gone])
            np.maximum.at(hi_, ctx[gone], start[gone] + length)
            has = np.flatnonzero(hi_ >= 0)
            out = np.empty(len(has), DONE)
            out["tid"], out["lo"], out["hi"] = h["tid"][has], lo_[has], hi_[has]
            yield out


def _by_bucket(values: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by (bucket, value), and the bucket of each value."""
    mixed = values * np.uint64(0x9E3779B97F4A7C15)
    bucket = ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype("<i4")
    return np.lexsort((values, bucket)), bucket


def _texts_of(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of batches of about BATCH bytes."""
    for b in batches:
        ends = np.cumsum(pa.compute.binary_length(b.column(text)).to_numpy())
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BATCH, "right")))
            part = b.slice(lo, hi - lo)
            yield part, part.column(text).cast(pa.binary()).to_pylist()
            lo = hi


def _anchors(length: int, gram: int, buckets: int):
    """(bucket, packed (value, tid)) of distinct anchors of texts; a tid of 0 after a value that one text holds twice."""
    @tidy
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = Hashes(), set()
        for part, texts in _texts_of(batches, 1):
            tids = part.column(0).to_pylist()
            new = [k for k, t in enumerate(tids) if t not in seen and not seen.add(t)]  # copies are read once a task
            r = runs([texts[k] for k in new], hashes, length, gram)
            rec = np.stack([r["value"], np.array([tids[k] for k in new], "<i8")[r["text"]].view("<u8")], 1) if len(r) else np.zeros((0, 2), "<u8")
            order, bucket = _by_bucket(rec[:, 0], buckets)
            rec, bucket = rec[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            groups = np.split(rec, cuts)
            ids = bucket[np.concatenate([[0], cuts])] if len(rec) else bucket
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([g.tobytes() for g in groups if len(g)], pa.binary())], ["bucket", "records"])

    return sample


def _candidates(hot: int):
    """(tid, anchor) of anchors that two texts hold, or one text twice; anchor: value * 2, plus 1 if hot."""
    def find(table: pa.Table) -> pa.Table:
        rec = np.concatenate([np.frombuffer(x.as_py(), "<u8").reshape(-1, 2) for c in table["records"].chunks for x in c])
        rec = rec[np.lexsort((rec[:, 1], rec[:, 0]))]
        same_value = np.concatenate([[False], rec[1:, 0] == rec[:-1, 0]])
        cuts = np.flatnonzero(~same_value)
        sizes = np.diff(np.concatenate([cuts, [len(rec)]]))
        new_text = ~(same_value & np.concatenate([[False], rec[1:, 1] == rec[:-1, 1]]))
        texts = np.add.reduceat(new_text.astype("<i8"), cuts)
        keep = np.repeat(sizes > 1, sizes) & new_text
        anchor = (rec[:, 0] << np.uint64(1)) | np.repeat(texts > hot, sizes)
        return pa.table({"tid": pa.array(rec[keep, 1].view("<i8")), "anchor": pa.array(anchor[keep].view("<i8"))})

    return find


def _pieces_of(texts: list[bytes], heads: np.ndarray, owner: np.ndarray, length: int) -> list[bytes]:
    return [texts[t][s:s + c + length - 1] for t, s, c in zip(owner.tolist(), heads["start"].tolist(), heads["count"].tolist())]


def _contexts(length: int, gram: int, buckets: int):
    """(bucket, heads, contexts, done): contexts of candidates, of equal ones in a part the earliest; done: what later owners lose."""
    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, near = Hashes(), max(gram, length - 8)
        for part, texts in _texts_of(batches, 2):
            keys, tids = (np.array(part.column(k).to_pylist(), "<i8") for k in (0, 1))
            r = runs(texts, hashes, length, gram)
            anchors = [np.frombuffer(a.values.to_numpy(), "<i8").view("<u8") for a in part.column(3)]
            sizes = np.array([len(a) for a in anchors])
            all_ = np.concatenate(anchors)
            mine = np.sort(np.unique(np.stack([np.repeat(np.arange(len(texts), dtype="<u8"), sizes), all_ >> np.uint64(1)], 1), axis=0).view([("t", "<u8"), ("v", "<u8")]).ravel())
            want = np.empty(len(r), mine.dtype)
            want["t"], want["v"] = r["text"].astype("<u8"), r["value"]
            r = r[np.isin(_one(want), _one(mine))]
            hot_values = np.unique(all_[(all_ & np.uint64(1)) == 1] >> np.uint64(1))
            hot = np.isin(r["value"], hot_values)
            owner, heads = r["text"], np.empty(len(r), HEAD)
            for c in ("value", "start", "off", "count"):
                heads[c] = r[c]
            heads["key"], heads["tid"] = keys[owner], tids[owner]
            pieces = _pieces_of(texts, heads, owner, length)
            if hot.any():
                at = np.flatnonzero(hot)
                sub = runs([pieces[k] for k in at.tolist()], hashes, length, near)
                more = heads[at[sub["text"]]]
                more["start"] += sub["start"]
                more["value"] = (more["value"] * np.uint64(0x9E3779B97F4A7C15) ^ sub["value"] * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1 << 63)
                more["off"], more["count"] = sub["off"], sub["count"]
                pieces = [pieces[k] for k in np.flatnonzero(~hot).tolist()] + _pieces_of(texts, more, owner[at[sub["text"]]], length)
                heads = np.concatenate([heads[~hot], more])
            yield _packed(heads, pieces, length, buckets)

    return cut


def _one(rows: np.ndarray) -> np.ndarray:
    """Rows of two numbers as one comparable value each."""
    return rows["t"] << np.uint64(44) | rows["v"]  # values have 44 bits, a part far fewer than 2**20 texts


def _packed(heads: np.ndarray, pieces: list[bytes], length: int, buckets: int) -> pa.RecordBatch:
    label: dict[tuple[int, int, bytes], int] = {}
    labels = np.array([label.setdefault(x, len(label)) for x in zip(heads["value"].tolist(), heads["off"].tolist(), pieces)], "<i8")
    later = earliest(labels, heads, heads["start"]) if len(heads) else np.zeros(0, "?")
    seen = np.zeros(len(label), "?")
    first = np.zeros(len(heads), "?")
    for k in np.flatnonzero(~later).tolist():  # equal occurrences (repeated rows) go once
        first[k], seen[labels[k]] = not seen[labels[k]], True
    done = np.empty(int(later.sum()), DONE)
    done["tid"], done["lo"] = heads["tid"][later], heads["start"][later]
    done["hi"] = heads["start"][later] + heads["count"][later] + length - 1
    kept = np.flatnonzero(first)
    order, bucket = _by_bucket(heads["value"][kept], buckets)
    kept, bucket = kept[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    cols: list[list] = [[], [], [], []]
    for group in np.split(kept, cuts) if len(kept) else []:
        cols[1].append(heads[group].tobytes())
        cols[2].append(b"".join([pieces[k] for k in group.tolist()]))
        cols[3].append(b"")
    cols[0] = bucket[np.concatenate([[0], cuts])].tolist() if len(kept) else []
    if len(done):
        cols[0].append(int(done["tid"][0]) % buckets)
        for k, v in ((1, b""), (2, b""), (3, done.tobytes())):
            cols[k].append(v)
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["bucket", "heads", "contexts", "done"])


def _sorted(length: int):
    """(tid, lo, hi): what of the contexts of a bucket goes."""
    held: list[Hashes] = []

    def remove(table: pa.Table) -> pa.Table:
        hashes = held[0] if held else held.append(Hashes()) or held[0]
        flat = {c: [x.as_py() for p in table[c].chunks for x in p] for c in ("heads", "contexts", "done")}
        heads = np.frombuffer(b"".join(flat["heads"]), HEAD)
        x = np.frombuffer(b"".join(flat["contexts"]), "u1")
        out = [np.frombuffer(b"".join(flat["done"]), DONE)]
        sizes = heads["count"].astype("<i8") + length - 1
        base = np.cumsum(sizes) - sizes
        order = np.argsort(heads["value"], kind="stable")
        v = heads["value"][order]
        alone = np.concatenate([[True], v[1:] != v[:-1]]) & np.concatenate([v[1:] != v[:-1], [True]]) if len(v) else np.zeros(0, "?")
        order = order[~alone]
        if len(order):
            out += list(repeated(heads[order], x[spread(base[order], sizes[order])], hashes, length))
        done = np.concatenate(out)
        return pa.table({c: pa.array(done[c]) for c in DONE.names})

    return remove


def _removed(length: int):
    """Of a text and the ranges that go: (n_removed, n_spans, kept_sha256)."""
    @F.arrow_udf(T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]))
    def remove(texts: pa.Array, los: pa.Array, his: pa.Array) -> pa.Array:
        rows = []
        for t, a, b in zip(texts, los, his):
            text = t.as_py().encode()
            lo, hi = a.values.to_numpy(), b.values.to_numpy()
            order = np.argsort(lo, kind="stable")
            lo, upto = lo[order], np.maximum.accumulate(hi[order])
            new = np.flatnonzero(np.concatenate([[True], lo[1:] > upto[:-1]]))
            starts, ends = lo[new].tolist(), upto[np.concatenate([new[1:] - 1, [len(lo) - 1]])].tolist()
            kept = b"".join([text[e:s] for e, s in zip([0, *ends], [*starts, len(text)])])
            rows.append((len(text) - len(kept), len(starts), hashlib.sha256(kept).hexdigest()))
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], ["n_removed", "n_spans", "kept_sha256"])

    return remove


def removed_ranges(rows: DataFrame, firsts: DataFrame, total: int, length: int, gram: int, hot: int) -> DataFrame:
    """(tid, key, los, his) of the texts that lose something, from rows (key, tid, text) and the first key of each tid."""
    spark = rows.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-total // BUCKET))
    records = rows.select("tid", "t").mapInArrow(_anchors(length, gram, buckets), "bucket int, records binary")
    found = records.groupBy("bucket").applyInArrow(_candidates(hot), "tid long, anchor long")
    found = found.groupBy("tid").agg(F.collect_set("anchor").alias("anchors"))  # no longer than the text
    found = stored(found.join(firsts.select("tid", "key"), "tid"), "anchors")
    wanted = rows.join(bounded(found.select("tid", "key"), BROADCAST_TEXTS), ["tid", "key"], "left_semi")
    held = wanted.join(found.hint("merge"), ["tid", "key"]).select("key", "tid", "t", "anchors")
    cut = held.mapInArrow(_contexts(length, gram, buckets), "bucket int, heads binary, contexts binary, done binary")
    gone = cut.groupBy("bucket").applyInArrow(_sorted(length), "tid long, lo int, hi int")
    gone = gone.groupBy("tid").agg(F.collect_list(F.struct("lo", "hi")).alias("r"))
    gone = gone.join(firsts.select("tid", "key"), "tid")
    return stored(gone.select("tid", "key", F.col("r.lo").alias("los"), F.col("r.hi").alias("his")), "ranges")


def report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    if not 0 < gram <= length <= 200:
        raise ValueError("expected 0 < gram <= length <= 200")
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1))
    rows = docs.select(F.col(doc_id).alias("doc_id"), key.alias("key"), text_or_empty(text).alias("t")).withColumn("tid", F.xxhash64("t"))
    sha = F.sha2(F.col("t").cast("binary"), 256)
    base = stored(rows.select("doc_id", "key", "tid", F.octet_length("t").cast("long").alias("n_bytes"), sha.alias("sha")), "texts")
    firsts = stored(base.groupBy("sha", "tid").agg(F.min("key").alias("key")), "first-texts")
    total = base.agg(F.sum("n_bytes")).first()[0] or 0
    gone = removed_ranges(rows, firsts, total, length, gram, hot)
    wanted = rows.join(bounded(gone.select("tid", "key"), BROADCAST_TEXTS), ["tid", "key"], "left_semi").join(gone.hint("merge"), ["tid", "key"])
    cleaned = wanted.withColumn("r", _removed(length)("t", "los", "his")).select(sha.alias("sha"), "r.*").dropDuplicates(["sha"])
    out = base.join(firsts.select("sha", F.col("key").alias("first")), "sha").join(cleaned, "sha", "left")
    copy = (F.col("key") > F.col("first")) & (F.col("n_bytes") >= length)
    return out.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
