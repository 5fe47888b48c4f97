"""Operator 5, line dedup by site-relative frequency. DataFrame functions only.

A line is boilerplate of a site if the share of the site's pages that hold it exceeds ``ratio`` and at
least ``min_pages`` do. Lines are compared without blanks at their ends; blank lines are never boilerplate.
A page that repeats a line counts once. Counting moves a line's hashes, not its text, and is summed in
each task before the shuffle, so that a frequent line or a large site is a few rows to any task.

A null text stays null and counts as a page; a text all of whose lines go becomes empty. Pages without a
site form one site. Repeated rows are pages of their own, unless ``copies`` is False: then the rows of a site
that share their whole text are one page, in a line's pages and in the total alike, and a group of copies
makes no boilerplate of its own text. Only the rows of such groups move for that. The columns of the input are kept as they are,
but for the text; nothing is dropped but lines.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attraudit.llm.common import BROADCAST_ROWS, bounded, fresh, stored

RATIO = 0.1
MIN_PAGES = 3


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, as a site."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def _key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(bare, F.lit(1)).alias("b")))


def boilerplate(df: DataFrame, site: str, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """(site, a, b, pages, total): the hashes of each site's boilerplate lines."""
    rows = df.select(F.col(site).alias("site"), F.col(text).alias("t"))
    keys = F.filter(F.array_distinct(F.transform(F.split("t", "\n"), _key)), lambda k: k.isNotNull())
    if copies:
        totals = rows.groupBy("site").agg(F.count("*").alias("total"))
        pages = rows.select("site", keys.alias("ks"))
    else:
        rows = rows.withColumn("th", F.xxhash64("t"))
        texts = stored(rows.groupBy("site", "th").agg(F.count("*").alias("n")), "page_texts")
        totals = texts.groupBy("site").agg(F.count("*").alias("total"))
        again = bounded(stored(texts.where("n > 1").select(F.col("site").alias("s1"), F.col("th").alias("th1")), "copied_texts"))
        here = F.col("site").eqNullSafe(F.col("s1")) & (F.col("th") == F.col("th1"))
        once = rows.join(again, here, "left_anti").select("site", keys.alias("ks"))
        pages = once.unionByName(rows.join(again, here, "left_semi").groupBy("site", "th").agg(F.min("t").alias("t")).select("site", keys.alias("ks")))
    lines = pages.select("site", F.explode("ks").alias("k")).groupBy("site", "k.a", "k.b").agg(F.count("*").alias("pages"))
    often = lines.where(F.col("pages") >= min_pages)
    both = often.join(totals.withColumnRenamed("site", "s2"), F.col("site").eqNullSafe(F.col("s2"))).drop("s2")
    return both.where(F.col("pages") > ratio * F.col("total"))


def drop_boilerplate(df: DataFrame, site: str, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True, counts: bool = True) -> DataFrame:
    """All rows and columns, the text without its site's boilerplate lines; adds n_lines and n_dropped if ``counts``.

    A site has at most (distinct lines a page) / ratio boilerplate lines, as their shares sum up to no more
    than the lines of a page: they travel as one short array a site, and texts are not shuffled while the
    arrays of all sites are proven short enough to broadcast.
    """
    site_, keys, rest = fresh(df, "__site", "__keys", "__kept")
    found = stored(boilerplate(df, site, text, ratio, min_pages, copies).select("site", "a", "b"), "boilerplate")
    short = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sets = found.groupBy(F.col("site").alias(site_)).agg(F.collect_list(F.struct("a", "b")).alias(keys))
    joined = df.join(F.broadcast(sets) if short else sets, F.col(site).eqNullSafe(F.col(site_)), "left").drop(site_)
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(keys, _key(x)), F.lit(False)))
    out = joined.withColumn(rest, F.when(F.col(keys).isNotNull(), kept).otherwise(lines))
    if counts:
        out = out.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long")).withColumn("n_dropped", F.coalesce(F.size(lines) - F.size(rest), F.lit(0)).cast("long"))
    return out.withColumn(text, F.when(F.col(text).isNotNull(), F.array_join(rest, "\n"))).drop(rest, keys)
