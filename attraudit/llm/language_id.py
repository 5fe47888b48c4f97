"""Operator 4, language identification by multinomial naive Bayes over hashed character n-grams.

Features are the pairs and triples of characters of the lower-cased text, hashed to ``BUCKETS`` columns.
Training counts (language, bucket) over all labelled rows: each task sums its rows, Spark sums the tasks.
The log-probability matrix (languages x buckets, at most ``MAX_LANGS`` rows) is broadcast; a batch of texts
is scored text by text, a long text in slices. The score is the posterior of the best language.

A null text, or one without a letter, is ``und`` with score 0, and so is every text if nothing is labelled.
Ties go to the language that sorts first. Rows without a label don't train; labels are plain strings.
Repeated rows count as often as they stand there. Empty tables give empty results; other columns are not
read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attraudit.llm.common import fresh, tidy

BUCKETS = 1 << 15
MAX_LANGS = 1000
SMOOTH = 0.5
IN_MEMORY = 64  # languages whose counts a task keeps before handing them on
FEATURES = 1 << 20  # characters x languages whose weights are gathered at once, whatever a text's length
SLICE_ROWS = 256  # texts of a batch that are taken out of Arrow at once


def features(text: str) -> np.ndarray:
    """Bucket numbers of the text's character pairs and triples."""
    return np.concatenate(list(sliced(text, max(1, len(text)))))


def sliced(text: str, step: int) -> Iterator[np.ndarray]:
    """The same, of the pairs and triples that start in `step` characters at a time."""
    low = text.lower()
    for lo in range(0, max(1, len(low)), step):
        a = np.frombuffer(low[lo:lo + step + 2].encode("utf-32-le"), "<u4")
        two = a[:-1] * np.uint32(0x9E3779B1) + a[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + a[2:] * np.uint32(0x27D4EB2F)
        h = np.concatenate([two[:step], three])
        h ^= h >> np.uint32(15)
        yield (h * np.uint32(0x2C1B3C6D)) >> np.uint32(17)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])
        sums.clear()

    for b in batches:
        for text, lang in zip(b.column(0), b.column(1)):
            n = sums.setdefault(lang.as_py(), np.zeros(BUCKETS, "<i8"))
            n += np.bincount(features(text.as_py()), minlength=BUCKETS)
            if len(sums) > IN_MEMORY:
                yield from out()
    yield from out()


class Model:
    """Languages in order and their log-probabilities by bucket."""

    def __init__(self, langs: list[str], weights: np.ndarray, prior: np.ndarray):
        self.langs, self.weights, self.prior = langs, weights, prior

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        step = max(1, FEATURES // max(1, len(self.langs)))
        for i, t in enumerate(texts):
            if not self.langs or not has_letter(t):
                continue
            total = self.prior.copy()
            for some in sliced(t, step):
                total += self.weights[some].sum(axis=0)
            best = total.argmax()
            names[i], scores[i] = self.langs[best], 1 / np.exp(total - total[best]).sum()
        return names, scores


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Fit on every row that has a text and a label."""
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    sums = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    docs = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(docs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages; their matrix would not be bounded")
    langs = sorted(docs)
    table = sums.toArrow()  # at most MAX_LANGS x BUCKETS sums
    counts = np.full((len(langs), BUCKETS), SMOOTH)
    if table.num_rows:
        at = {name: k for k, name in enumerate(langs)}
        counts[[at[x] for x in table["lang"].to_pylist()], table["bucket"].to_numpy()] += table["n"].to_numpy()
    weights = np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))
    prior = np.log(np.array([docs[x] for x in langs], "f8") / max(1, sum(docs.values())))
    return Model(langs, np.ascontiguousarray(weights.T), prior)


def predict(text: Column | str, model: Model, df: DataFrame) -> Column:
    """struct<lang_pred, score> of each whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(kind)
    @tidy
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            for k in range(0, len(b), SLICE_ROWS):
                names, scores = shared.value.predict(b.slice(k, SLICE_ROWS).to_pylist())
                yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang_pred", "score"])

    return scored(text)


def held_out(doc_id: Column | str) -> Column:
    """The fold that never trains: CRC-32 of the id as text leaves 1 when divided by 3 (a null id counts as empty text)."""
    return F.crc32(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """Fit on the folds that aren't held out; doc_id, held_out, lang_pred and score of every row."""
    model = train(df.where(~held_out(doc_id)), text, lang)
    out = df.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), predict(text, model, df).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def accept(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", least: float = 0.5) -> DataFrame:
    """The rows whose language is told with a score of at least ``least``; ``und`` never is. All columns are kept."""
    model = train(df.where(~held_out(doc_id)), text, lang)
    (told,) = fresh(df, "__p")
    p = df.withColumn(told, predict(text, model, df))
    return p.where((F.col(f"{told}.lang_pred") != "und") & (F.col(f"{told}.score") >= least)).drop(told)
