"""Rows that every operator must take: nulls everywhere, empty and long texts, repeats, clashing column names."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LONG = "the quick brown fox jumps over the lazy dog " * 2000 + "x" * 70_000
#: Column names that operators use inside.
CLASHES = ["t", "h", "w", "n", "fp", "key", "home", "row", "kept", "ids", "leaf", "leaf_no", "s", "site", "a", "b", "total", "th", "root", "u", "v", "item", "p", "page", "body", "digest", "bytes", "last", "shard", "block", "query_id", "score", "__row", "n_tokens", "component_id"]
ROWS = [
    (1, "Hello world, this is a text.\nAnd a line.\n\nAnd a line.", "en", "a", 5),
    (1, "Hello world, this is a text.\nAnd a line.\n\nAnd a line.", "en", "a", 5),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (None, "Ein Text ohne Nummer, aber mit Wörtern genug.", "de", None, 9),
    (4, "  \n\t ", "de", "b", 3),
    (5, "12345 !!! 678", None, "b", 3),
    (6, LONG, "en", "b", None),
    (7, "it's ́é Iİ Σς \U0001f600 <|endoftext|> 日本語", "ja", "c", 1),
    (8, "Hello world, this is a text.\nAnd a line.\n\nAnd a line.", "en", "a", 5),
    (1, "another text under the same number, long enough to have shingles", "en", "a", 5),
]


def documents(spark: SparkSession, rows=None) -> DataFrame:
    rows = ROWS if rows is None else rows
    extra = [(None if k % 2 else k) for k in range(len(CLASHES))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in CLASHES)
    return spark.createDataFrame([r + tuple(extra) for r in rows], schema)


def plain(spark: SparkSession, rows=None) -> DataFrame:
    return documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
