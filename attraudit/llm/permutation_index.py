"""Operator 10, approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors (``PIVOTS`` distinct ones, by hash of their ids). A vector is
represented by its ``PREFIX`` nearest pivots in order, and posted under each of them, with its place there,
in the inverted file of that pivot. The index is cut by vector into shards of about ``SHARD`` rows, each
with all its inverted files; queries come in blocks. A query walks the files of its own nearest pivots,
which gives the footrule distance of its order to that of every posted vector; the ``RERANK`` share of a
shard with the smallest footrule (``LEAST`` rows at least, and all that tie with the last) is ranked anew by Euclidean distance in double
precision. Each shard hands on its best k, of which the best k of all shards stay.

Every row is indexed; the stated query set meets all rows, in blocks. Recall is measured in the tests.

Vectors that are null, zero, or hold null or non-finite components take no part, neither do vectors whose
length isn't the most frequent one (the larger, if two are). Ties go to the smaller id. A query leaves out
the rows that bear its own id; a repeated id is a candidate once for each of its rows, and as a query is
taken once (the first of its vectors in order). Null ids take no part. Empty tables give no rows; extra
columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attraudit.llm.common import stored

PIVOTS, PREFIX = 512, 64
SHARD, QUERIES = 4096, 512
RERANK, LEAST = 0.3, 1024


def usable(v: Column) -> Column:
    """Neither null nor zero, all components finite."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def vectors_of(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    rows = df.where(F.col(vec_id).isNotNull() & usable(F.col(vector))).select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    top = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("v") == (top["d"] if top else 0))


def pick_pivots(rows: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """A bounded sample, the same for the same table: distinct vectors by the hash of an id."""
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * pivots).select("v").collect()  # bounded by the parameter
    seen = dict.fromkeys(tuple(r["v"]) for r in got)
    return np.array(list(seen)[:pivots], "f8")


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of each row's nearest pivots, nearest first."""
    k = min(prefix, len(pivots))
    d = (pivots * pivots).sum(1) - 2 * x @ pivots.T
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    return np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(1, kind="stable"), 1)


class InvertedFiles:
    """For each pivot, the rows that have it among their nearest, and its place in their order."""

    def __init__(self, order: np.ndarray, pivots: int):
        self.n, self.k = order.shape
        flat = order.ravel()
        by = flat.argsort(kind="stable")
        self.row, self.place = by // self.k, by % self.k
        self.at = np.searchsorted(flat[by], np.arange(pivots + 1))

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """Distance of a query's order to every row's; a pivot that is missing from an order has place k."""
        k = self.k
        total = np.full(self.n, k * (k + 1), "<i8")  # both orders against an empty one
        for place, p in enumerate(query.tolist()):
            own = slice(self.at[p], self.at[p + 1])
            other = self.place[own]
            total[self.row[own]] += np.abs(other - place) - (k - place) - (k - other)
        return total


def _search(k: int, pivots: np.ndarray, prefix: int, share: float, least: int):
    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = []
        if len(left) and len(right):
            ids, x = left["vec_id"].to_numpy(), np.array(left["v"].tolist(), "f8")
            files = InvertedFiles(orders(x, pivots, prefix), len(pivots))
            qx = np.array(right["v"].tolist(), "f8")
            keep = max(least, int(np.ceil(share * len(ids))))
            for q, v, order in zip(right["query_id"].tolist(), qx, orders(qx, pivots, prefix)):
                foot = files.footrule(order)
                foot[ids == q] = np.iinfo("<i8").max
                some = np.flatnonzero(foot <= np.partition(foot, keep - 1)[keep - 1]) if keep < len(ids) else np.arange(len(ids))
                some = some[ids[some] != q]
                d = np.sqrt(((x[some] - v) ** 2).sum(axis=1))
                best = np.lexsort((ids[some], d))[:k]
                out.append((np.full(len(best), q), ids[some][best], d[best]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0)]
        return pd.DataFrame({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    return search


def nearest(df: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, shard: int = SHARD, share: float = RERANK, least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which ``is_query`` holds (of vec_id)."""
    rows = stored(vectors_of(df, vec_id, vector), "vectors")
    n, asked = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    points = pick_pivots(rows, pivots)
    shards, blocks = max(1, -(-n // shard)), max(1, -(-asked // QUERIES))
    own = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("long").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    ask = rows.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    ask = ask.select("query_id", "v", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    found = own.groupBy("shard", "block").cogroup(ask.groupBy("shard", "block")).applyInPandas(
        _search(k, points, prefix, share, least), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))  # k rows a shard
    out = best.select("query_id", F.posexplode("best").alias("p", "b"))
    return out.select("query_id", (F.col("p") + 1).alias("rank"), "b.vec_id", "b.score")
