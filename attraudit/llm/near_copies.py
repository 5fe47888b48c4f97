"""Near copies for the pipeline: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Shingles: A-Z in lower case, words parted by ASCII white space, five words (all words if there are fewer),
each distinct one once, as 64-bit hashes. Texts of equal sets are one node. Texts without words are one
node, too.

Candidates come from operator 7's SimHash links first: fingerprints that differ in at most four bits, found by
anchors, one link per edge of its forest. Near copies at 0.8 mostly differ in 5 to 13 bits, so its links alone
would lose them; the others share one of ``BANDS`` bands of ``WIDTH`` MinHash values: a pair at 0.8 is missed
with probability (1 - 0.8 ** 4) ** 32 = 4e-8, less above. Every candidate is judged by its exact sets. Then each
node meets the hub (smallest node) of each of its bands' buckets, which is linear in the nodes: first in
``FIRST`` bands, then in the others, always where node and hub aren't joined yet. Last, in
buckets whose members aren't all joined yet, all members of different components meet in a grid of blocks,
within which joined components aren't compared again. Only confirmed links are handed on. Sets are made
for candidates alone and never stored for the others.

Null and empty texts are the node without words. Rows with the same text, or the same set, are one node and
join its component, whatever their ids; a component is named by its smallest doc_id that isn't null. Empty
tables give empty results. Columns keep their names and values, those named as helper columns here, too.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attraudit.llm import simhash
from attraudit.llm.common import bounded, stored, text_or_empty, tidy
from attraudit.llm.components import components

WORDS, SEED, SIMILAR = 5, 42, 0.8
BANDS, WIDTH, FIRST = 32, 4, 4
BLOCK = 512  # members of a bucket on each side of a block

_rng = np.random.default_rng(5)
TIMES, PLUS = (_rng.integers(0, 2**64, BANDS * WIDTH, "<u8") | np.uint64(1) for _ in range(2))
MIX = _rng.integers(0, 2**64, (BANDS, WIDTH), "<u8") | np.uint64(1)
MARK = _rng.integers(0, 2**64, BANDS, "<u8")


def shingles_of(text: str) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, "<u8")
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "<i8", len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(WORDS, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist())
    return np.unique(np.fromiter((xxh64_intdigest(flat[a:b], SEED) for a, b in spans), "<u8", len(words) - k + 1))


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """The bucket of each band."""
    least = np.full(BANDS * WIDTH, 2**64 - 1, "<u8")
    for i in range(0, len(shingles), 512):
        np.minimum(least, (shingles[i:i + 512, None] * TIMES + PLUS).min(axis=0), out=least)
    return (least.reshape(BANDS, WIDTH) * MIX).sum(axis=1, dtype="<u8") + MARK


def node_of(shingles: np.ndarray) -> int:
    """A set's hash, signed; zero for the empty one."""
    from xxhash import xxh64_intdigest

    return int(np.array([xxh64_intdigest(shingles.tobytes(), SEED)], "<u8").view("<i8")[0]) if len(shingles) else 0


def is_similar(a: np.ndarray, b: np.ndarray, similar: float) -> bool:
    """Whether two sorted sets have at least that Jaccard similarity."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or len(small) < similar * len(large) - 1e-9:
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return both >= similar * (len(a) + len(b) - both) - 1e-9


_NODE = T.StructType([T.StructField("fp", T.LongType()), T.StructField("sim", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def _sketched(text: Column) -> Column:
    @F.arrow_udf(_NODE)
    @tidy
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            nodes, sims, bands, ends = [], [], [np.zeros(0, "<u8")], [0]
            for t in b:  # one text's shingles at a time
                s = shingles_of(t.as_py())
                nodes.append(node_of(s))
                sims.append(simhash.fingerprint_of(t.as_py()))
                if len(s):
                    bands.append(bands_of(s))
                ends.append(BANDS * (len(bands) - 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(bands).view("<i8")))
            yield pa.StructArray.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.array(sims, "<u8").view("<i8")), lists], ["fp", "sim", "bands"])

    return of(text)


def _spelt(text: Column) -> Column:
    @F.arrow_udf(T.ArrayType(T.LongType()))
    @tidy
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([shingles_of(t.as_py()).view("<i8") for t in b], pa.list_(pa.int64()))

    return of(text)


def _meet(rows: list[tuple], similar: float) -> list[tuple[int, int]]:
    """Confirmed links between the components of a block's rows (node, root, set), one for each join."""
    joined: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := joined.get(x, x)) != x:
            x = up
        return x

    out = []
    rows = sorted(rows, key=lambda x: len(x[2]))
    for i, (n, r, s) in enumerate(rows):
        for m, q, t in rows[i + 1:]:
            if len(s) < similar * len(t) - 1e-9:
                break
            x, y = top(r), top(q)
            if x != y and is_similar(s, t, similar):
                joined[x] = y
                out.append((n, m))
    return out


def _blocks(similar: float):
    @tidy
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket and block."""
        def done(rows):
            links = _meet(rows, similar)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])

        last, rows = None, []
        for b in batches:
            for key, p, q, node, root, own in zip(*(c.to_pylist() for c in b.columns[:5]), b.column(5)):
                if (key, p, q) != last:
                    if len(rows) > 1:
                        yield done(rows)
                    last, rows = (key, p, q), []
                rows.append((node, root, own.values.to_numpy().view("<u8").copy()))
        if len(rows) > 1:
            yield done(rows)

    return blocks


def _confirmed(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Links (u, v) of the pairs (fp, hub) whose sets are similar enough."""
    pairs = bounded(pairs)  # pairs go to the sets; only sets of pairs are moved
    own = sets.join(pairs, "fp").select("fp", "hub", "own")
    others = sets.toDF("hub", "others").join(pairs, "hub").select("fp", "hub", "others")
    met = own.hint("merge").join(others, ["fp", "hub"])
    both, sizes = F.size(F.array_intersect("own", "others")), F.size("own") + F.size("others")
    return met.where(both >= similar * (sizes - both) - 1e-9).select(F.col("fp").alias("u"), F.col("hub").alias("v"))


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (fp, hub) of the nodes (fp, sim) that operator 7 links: nodes of one fingerprint with its smallest, and these along its forest."""
    named = nodes.where(F.col("fp") != 0).groupBy("sim").agg(F.min("fp").alias("hub"), F.count("*").alias("n"))
    named = stored(named, "fingerprints")
    same = nodes.join(named.where("n > 1").select("sim", "hub"), "sim").where(F.col("fp") != F.col("hub")).select("fp", "hub")
    edges = simhash.links(named.select(F.col("sim").alias("fp")))
    ends = [named.select(F.col("sim").alias(c), F.col("hub").alias(f"{c}_hub")) for c in "uv"]
    far = edges.join(ends[0], "u").join(ends[1], "v").select(F.col("u_hub").alias("fp"), F.col("v_hub").alias("hub"))
    return stored(same.where("fp != 0").unionByName(far).distinct(), "simhash_pairs")


def links(df: DataFrame, nodes: DataFrame, text: str = "text", similar: float = SIMILAR, block: int = BLOCK, near: DataFrame | None = None) -> DataFrame:
    """Confirmed links (u, v) that connect the nodes (fp, th of one text, bands) as all pairs of that similarity do.

    `near` holds pairs (fp, hub) that are judged before those of the bands.
    """
    posted = nodes.select("fp", F.posexplode("bands").alias("band", "key"))
    buckets = stored(posted.groupBy("key").agg(F.min("fp").alias("hub"), F.max("fp").alias("top")).where("hub < top").select("key", "hub"), "buckets")
    members = stored(posted.join(buckets, "key").select("band", "key", "fp", "hub"), "members")
    met = members.select("fp") if near is None else members.select("fp").unionByName(near.select("fp")).unionByName(near.select(F.col("hub").alias("fp")))
    wanted = stored(met.distinct().join(nodes.select("fp", "th"), "fp"), "candidates")
    texts = df.select(F.xxhash64(text_or_empty(text)).alias("th"), text_or_empty(text).alias("t"))
    texts = texts.join(bounded(wanted), "th").groupBy("fp").agg(F.min("t").alias("t"))
    sets = stored(texts.select("fp", _spelt(F.col("t")).alias("own")), "sets")
    roots = None
    banded = members.where(F.col("fp") != F.col("hub"))
    for pairs in ([] if near is None else [near]) + [banded.where(band).select("fp", "hub").distinct() for band in (F.col("band") < FIRST, F.col("band") >= FIRST)]:
        if roots is not None:
            pairs = pairs.join(roots, "fp", "left").join(roots.toDF("hub", "hub_root"), "hub", "left")
            pairs = pairs.where(F.coalesce("root", "fp") != F.coalesce("hub_root", "hub")).select("fp", "hub")
        found = stored(_confirmed(stored(pairs, "hub_pairs"), sets, similar), "hub_links")
        sure = found if roots is None else sure.unionByName(found)
        roots = stored(components(sure), "hub_roots").withColumnRenamed("u", "fp")
    rest = members.where(F.col("fp") != F.col("hub")).select("key", "fp")  # all have met their hub
    named = stored(rest.join(roots, "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root")), "named")
    open_ = named.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where("x < y")
    open_ = stored(open_.select("key", F.ceil(F.col("n") / block).cast("int").alias("nb")), "open_buckets")
    own = F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int")
    dealt = named.join(open_, "key").select("key", "fp", "root", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"))
    dealt = stored(dealt.select("key", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "fp", "root"), "dealt")
    dealt = sets.join(bounded(dealt), "fp").select("key", "p", "q", "fp", "root", "own")
    more = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(_blocks(similar), "u long, v long")
    return sure.unionByName(more)


def classes(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, th, fp, root, component_id) of near copies, as simhash names them."""
    docs = stored(df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("th"), _sketched(text_or_empty(text)).alias("s")).select("doc_id", "th", "s.*"), "sketches")
    nodes = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min("th").alias("th"), F.min("sim").alias("sim"), F.min("bands").alias("bands")), "nodes")
    return simhash.rooted(docs.drop("sim", "bands"), nodes.select("fp", "first"), links(df, nodes, text, near=simhash_pairs(nodes.select("fp", "sim"))))


def keep_first(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group of near copies, with all its columns: that of the smallest doc_id."""
    return simhash.keep_first(df, text, doc_id, classes)
