"""Operator 3, benchmark decontamination by size-partitioned MinHash containment search. DataFrame functions only.

Items are short and documents long, so their Jaccard similarity says nothing; what counts is the share of
an item's word shingles that a document holds. Items are partitioned by the number of their shingles. Each
item is sketched by its smallest shingle hashes (MinHash), as many as its partition needs: an item held to
at least ``threshold`` lacks at most floor((1 - threshold) n) of its n shingles, so a sketch of that many
and ``SPARE`` more must show ``SPARE`` of its values (all but the lacking ones, for small items) in the
document. Hence no item is missed, and nearly no other document becomes a candidate. Candidates are
verified by the exact containment of the shingles' text.

Words are runs of letters, marks and digits of the lower-cased text; a shingle is five words. Repeated
shingles count once. Texts or items that are null or have fewer than five words match nothing. Rows that
repeat a doc_id with the same text count as one document; the same doc_id with different texts as several,
reported by their best containment. Null ids are kept as ids. Extra columns are not read.

A document never meets another one: documents' shingles meet only the sketch, which is broadcast if a
count shows it to be short and joined by a shuffle otherwise.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attraudit.llm.common import bounded, fresh, stored

WORDS = 5
THRESHOLD = 0.8
SPARE = 4
NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def _starts(words: Column, k: int) -> Column:
    return F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))


def shingle_texts(words: Column, k: int = WORDS) -> Column:
    return F.transform(_starts(words, k), lambda i: F.array_join(F.slice(words, i + 1, k), " "))


def shingle_hashes(word_hashes: Column, k: int = WORDS) -> Column:
    return F.transform(_starts(word_hashes, k), lambda i: F.xxhash64(*[F.get(word_hashes, i + j) for j in range(k)]))


def items_of(items: DataFrame, text: str, item_id: str, k: int = WORDS) -> DataFrame:
    """(item, s, h, n): the distinct shingles of each item, their hashes and their number."""
    words = items.where(F.col(text).isNotNull()).select(F.col(item_id).alias("item"), F.xxhash64(text).alias("th"), words_of(F.col(text)).alias("w"))
    rows = words.dropDuplicates(["item", "th"]).select("item", F.array_distinct(shingle_texts(F.col("w"), k)).alias("ss"))
    rows = rows.where(F.size("ss") > 0).select("item", F.size("ss").alias("n"), F.explode("ss").alias("s"))
    hashed = F.transform(F.split("s", " "), lambda w: F.xxhash64(w))
    return rows.select("item", "n", "s", F.xxhash64(*[F.get(hashed, j) for j in range(k)]).alias("h"))


def sketches_of(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item, h, need): each item's smallest hashes and how many of them a document must hold."""
    top = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1  # the largest n of the item's partition
    lack = F.floor((1 - threshold) * top + 1e-9)
    sized = items.groupBy("item", "n").agg(F.array_sort(F.collect_list("h")).alias("hs")).withColumn("lack", lack)  # one item's shingles
    kept = F.slice("hs", 1, (F.col("lack") + SPARE).cast("int"))
    rows = sized.select("item", kept.alias("kept"), F.greatest(F.lit(1), F.size(kept) - F.floor((1 - threshold) * F.col("n") + 1e-9)).alias("need"))
    return rows.select("item", "need", F.explode("kept").alias("h"))


def contained(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", threshold: float = THRESHOLD, k: int = WORDS) -> DataFrame:
    """(doc_id, th, item_id, shared, shingles, containment) for items held to at least ``threshold``; th is the text's hash."""
    known = stored(items_of(items, item_text, item_id, k), "items")
    base = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    hashes = F.transform(words_of(F.col("t")), lambda w: F.xxhash64(w))
    marks = base.select("doc_id", "th", hashes.alias("wh")).select("doc_id", "th", F.explode(F.array_distinct(shingle_hashes(F.col("wh"), k))).alias("h"))
    sketch = bounded(stored(sketches_of(known, threshold), "sketch"))
    hits = marks.join(sketch, "h").groupBy("doc_id", "th", "item", "need").agg(F.countDistinct("h").alias("hits"))
    pairs = stored(hits.where(F.col("hits") >= F.col("need")).select("doc_id", "th", "item"), "candidates")
    docs_in = bounded(stored(pairs.select("doc_id", "th").distinct(), "suspects"))
    texts = base.join(docs_in, base.doc_id.eqNullSafe(docs_in.doc_id) & (base.th == docs_in.th), "left_semi").dropDuplicates(["doc_id", "th"])
    spelt = texts.select("doc_id", "th", words_of(F.col("t")).alias("w"))
    shown = spelt.select("doc_id", "th", F.explode(F.array_distinct(shingle_texts(F.col("w"), k))).alias("s"))
    found = shown.join(bounded(known.select("item", "n", "s")), "s").groupBy("doc_id", "th", "item", "n").agg(F.count("*").alias("shared"))
    p = pairs.toDF("p_doc", "p_th", "p_item")
    sure = found.join(p, found.doc_id.eqNullSafe(p.p_doc) & (found.th == p.p_th) & found.item.eqNullSafe(p.p_item), "left_semi")
    out = sure.select("doc_id", "th", F.col("item").alias("item_id"), "shared", F.col("n").cast("long").alias("shingles"), (F.col("shared") / F.col("n")).alias("containment"))
    return out.where(F.col("shared") >= threshold * F.col("shingles") - 1e-9)


def report(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, shared, shingles, containment."""
    return contained(docs, items, **kw).groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "shared", "shingles")).alias("b")).select(
        "doc_id", "item_id", "b.shared", "b.shingles", "b.containment")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", **kw) -> DataFrame:
    """The rows whose text holds no item, all columns kept."""
    own, th = fresh(docs, "__doc", "__th")
    bad = bounded(stored(contained(docs, items, text=text, doc_id=doc_id, **kw).select(F.col("doc_id").alias(own), F.col("th").alias(th)).distinct(), "leaks"))
    return docs.join(bad, F.col(doc_id).eqNullSafe(F.col(own)) & (F.xxhash64(text) == F.col(th)), "left_anti")
