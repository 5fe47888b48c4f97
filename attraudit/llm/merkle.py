"""Operator 11, a Merkle manifest of a dataset by lag and lead windows.

Each row is a leaf: SHA-256 of its columns, each `-` if null, else its UTF-8 length, `:` and its value. The
leaves of a group ascend by the key; on each level every ``arity`` consecutive nodes (the last run: fewer, even
one) become the digest of their hex texts, until one is left, the group's subroot. The subroots, ordered by
group (null first), form one more tree up to the root.

A node sits in the row of its first leaf. On each level lag and lead columns of fixed offsets, masked by the
node's slot and the length of its run, hold its siblings, and the row of a first child hashes the parent. Groups
of any size stay apart in blocks of ``BLOCK`` leaves: one window partition is one block, all levels inside a
block share one shuffle and sort, and the tops of the blocks go to the next round, a thousandth of the rows.
Positions come from one global sort by (group, key, leaf), so that a group or key with a third of all rows is
spread like any other.

Every leaf gets the path of its siblings; the proof is their digest, and folding a leaf through its path must
give the root. With ``tampered``, a second digest of the row is folded through the untouched path.

Nulls: a null key comes first, a null group is a group of its own. Rows with the same key are ordered by
their leaf; equal rows are leaves each. An empty table gives an empty manifest. Other columns are not read.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attraudit.llm.common import bounded, stored

BLOCK = 1024  # leaves of a window partition
BROADCAST_BLOCKS = 20_000  # tops of blocks with their paths, a kilobyte each
STEP = T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())])


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of concatenated texts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def row_digest(*values: Column) -> Column:
    """The leaf of a row of integers and texts."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows of (g, ...) with `at`, their place in g by ``order``, and `n`, the size of g; stored.

    A range-partitioned sort; the place is that in the partition plus what came before, from one count per
    partition and group.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    by = ["g", *order, "__tie"]
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())  # equal rows may part anywhere
    line = tied.repartitionByRange(n, *by).sortWithinPartitions(*by).drop("__tie")
    line = stored(line.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftrightunsigned("__id", 33)), "merkle-order")
    parts = line.groupBy("g", "__part").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    group = W.partitionBy("g")
    before = F.coalesce(F.sum("__rows").over(group.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("g", "__part", "__first", before.alias("__before"), F.sum("__rows").over(group).alias("n"))
    at = F.col("__id") - F.col("__first") + F.col("__before")
    return line.join(bounded(parts), ["g", "__part"]).withColumn("at", at).drop("__id", "__part", "__first", "__before", "__rows")


def _levels(arity: int) -> int:
    """Levels inside a block."""
    m = 1
    while arity ** (m + 1) <= BLOCK:
        m += 1
    return m


def climb(rows: DataFrame, arity: int, levels: int) -> DataFrame:
    """Rows (g, at, n, node, ...) with the steps of their path inside their block, and in a block's first row its top."""
    w = W.partitionBy("g", F.floor(F.col("at") / arity**levels)).orderBy("at")
    out = rows.withColumn("steps", F.array().cast(T.ArrayType(STEP)))
    for level in range(levels):
        size = arity**level
        place = F.floor(F.col("at") / size)
        slot, nodes = place % arity, F.ceil(F.col("n") / size)
        run = F.least(F.lit(arity), nodes - (place - slot))
        more, head = nodes > 1, F.col("at") % size == 0
        lags = [F.lag("node", j * size).over(w) for j in range(arity - 1, 0, -1)]
        leads = [F.lead("node", j * size).over(w) for j in range(1, arity)]
        before = F.concat(*[F.when(slot >= j, v).otherwise("") for j, v in zip(range(arity - 1, 0, -1), lags)])
        after = F.concat(*[F.when(slot + j < run, v).otherwise("") for j, v in zip(range(1, arity), leads)])
        out = out.withColumns({"__before": before, "__after": after})
        step = F.when(head, F.struct(F.col("__before").alias("before"), F.col("__after").alias("after")))
        parent = F.when(head & (slot == 0), F.when(more, digest(F.col("node"), F.col("__after"))).otherwise(F.col("node")))
        spread = F.last(step, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
        out = out.withColumns({"steps": F.when(more, F.concat("steps", F.array(spread))).otherwise(F.col("steps")), "node": parent})
    return out.drop("__before", "__after")


def trees(rows: DataFrame, arity: int) -> tuple[DataFrame, DataFrame]:
    """From numbered rows (g, at, n, node, ...): the rows with `steps`, their path to the group's top; and (g, node), the tops.

    Rounds of blocks: as many as the largest group needs, each over the tops of the one before.
    """
    levels = _levels(arity)
    size = arity**levels
    most = rows.agg(F.max("n")).first()[0] or 0
    rounds = [stored(climb(rows, arity, levels), "merkle-round")]
    while most > size:
        most = -(-most // size)
        tops = rounds[-1].where(F.col("at") % size == 0)
        tops = tops.select("g", (F.col("at") / size).cast("long").alias("at"), F.ceil(F.col("n") / size).alias("n"), "node")
        rounds.append(stored(climb(tops, arity, levels), "merkle-round"))
    roots = rounds[-1].where("at = 0").select("g", "node")
    above = rounds.pop()
    while rounds:
        below = rounds.pop()
        top = above.select("g", F.col("at").alias("__block"), F.col("steps").alias("__above"))
        joined = below.withColumn("__block", F.floor(F.col("at") / size)).join(bounded(top, BROADCAST_BLOCKS), ["g", "__block"])
        above = joined.withColumn("steps", F.concat("steps", "__above")).drop("__block", "__above")
    return above, roots


def fold(leaf: Column | str, steps: Column | str) -> Column:
    """The root that a leaf and its path give."""
    leaf = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.aggregate(steps, leaf, lambda acc, s: digest(s["before"], acc, s["after"]))


def proof(steps: Column | str) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""))


def manifest(rows: DataFrame, key: str, group: str, columns: Sequence[str], tampered: dict[str, Column] | None = None, arity: int = 2) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    ``tampered`` replaces columns before the leaf that is folded is made.
    """
    changed = [(tampered or {}).get(c, F.col(c)) for c in columns]
    g = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit(""))  # keeps the order of bytes, null first
    leaves = rows.select(g.alias("g"), F.col(key).alias("key"), row_digest(*map(F.col, columns)).alias("leaf"), row_digest(*changed).alias("shown"))
    leaves = stored(leaves, "merkle-leaves")  # texts are read and hashed once; sorting samples what it sorts
    paths, subroots = trees(numbered(leaves, ["key", "leaf"]).withColumn("node", F.col("leaf")), arity)
    names = numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "node"), ["name"])
    upper, root = trees(names.withColumn("subroot", F.col("node")), arity)
    top = upper.select(F.col("name").alias("g"), "subroot", F.col("steps").alias("__upper"))
    all_ = paths.select("g", "key", "leaf", "shown", "steps").join(bounded(top, BROADCAST_BLOCKS), "g")
    steps = F.concat("steps", "__upper")
    out = all_.select(F.col("key").alias(key), "leaf", "subroot", root.select("node").scalar().alias("root"), proof(steps).alias("proof_sha256"), fold("shown", steps).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_counts(doc_id: str = "doc_id", n_chars: str = "n_chars", every: int = 7) -> Column:
    """n_chars, one more where the CRC-32 of doc_id's digits is a multiple of ``every``."""
    hit = F.crc32(F.col(doc_id).cast("string").cast("binary")) % every == 0
    return F.when(hit, F.col(n_chars) + 1).otherwise(F.col(n_chars))


def report(docs: DataFrame) -> DataFrame:
    """The manifest of documents by language, folded from tampered rows."""
    return manifest(docs, "doc_id", "lang", ["doc_id", "source", "lang", "n_chars", "text"], {"n_chars": tampered_counts()})
