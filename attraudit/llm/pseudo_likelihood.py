"""Operator 9, language-model scoring by masked pseudo-likelihood.

A small network predicts each token from the two tokens before and the two after it. Tokens are words
(white space parts them, A-Z in lower case), hashed to ``CLASSES`` x ``INNER`` ids; an id is predicted in
two steps, its class from the hidden layer, then its place within the class from the hidden layer and the
class, so that probabilities sum to one over all ids. A document's score is the sum of the logarithms of
the conditional probabilities of all its tokens; the mean per token and the perplexity follow.

The biases of the ids are the logarithms of their frequencies in the whole corpus, counted first; the rest
is trained. Training is data-parallel: in each of ``ROUNDS`` rounds every task starts from the common weights and walks
over all its documents by stochastic gradient descent; a round predicts the tokens of one residue of their
places by ``ROUNDS`` (the first one varies with the document), so that the rounds together predict every
token of every document once. Steps take ``STEP`` tokens, across documents; only a task's last one may be shorter. The tasks' weights are then averaged, weighted by their numbers of predicted tokens. The sums grow with the corpus and are added by Spark; only the average, whose size is
fixed, reaches the driver. Each round's weights are written to the shared folder, so that a lost executor
cannot change them later. Scoring covers every token of every document.

A null or blank text has no tokens: score 0, mean and perplexity null. Beyond the ends stands a token of its
own. Repeated rows train and score as often as they stand there. An empty table gives an empty result; other
columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attraudit.llm.common import stored, text_or_empty

CLASSES, INNER = 64, 64
IDS = CLASSES * INNER
EDGE = IDS  # the token beyond either end
SIDE = 2  # tokens seen on each side
AROUND = np.array([i for i in range(-SIDE, SIDE + 1) if i])
EMBED, HIDDEN = 16, 32
ROUNDS, RATE = 2, 0.75
CHUNK = 4096  # tokens predicted at once in scoring
STEP = 256  # tokens of a gradient step
REACH = 80  # exponentials of logits within it, and their sums, neither overflow nor vanish in single precision

SHAPES = {"embed": (IDS + 1, EMBED), "w": (2 * SIDE * EMBED, HIDDEN), "b": (HIDDEN,), "cls": (HIDDEN, CLASSES), "cls_b": (CLASSES,), "given": (CLASSES, HIDDEN), "inner": (HIDDEN, INNER), "inner_b": (INNER,), "id_b": (CLASSES, INNER)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def initial(counts: np.ndarray | None = None, seed: int = 17) -> np.ndarray:
    """Random weights; the biases say how often each id stands in the corpus, if counts are given."""
    rng = np.random.default_rng(seed)
    scale = {"embed": 0.3, "w": 0.15, "cls": 0.15, "given": 0.15, "inner": 0.15}
    flat = np.concatenate([rng.normal(0, scale[k], s).ravel() if k in scale else np.zeros(s).ravel() for k, s in SHAPES.items()]).astype("f4")
    if counts is not None:
        table = counts.reshape(CLASSES, INNER) + 0.5
        p = layers(flat)
        p["cls_b"][:] = np.log(table.sum(1) / table.sum())
        p["id_b"][:] = np.log(table / table.sum(1, keepdims=True))
    return flat


def layers(weights: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the flat weights by layer."""
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = weights[at:at + n].reshape(s)
        at += n
    return out


class Ids:
    """Token ids of texts. Each word is hashed anew: a table of seen words costs more than the hash."""

    def text(self, t: str) -> np.ndarray:
        from xxhash import xxh64_intdigest

        words = t.encode().lower().split()
        return (np.fromiter(map(xxh64_intdigest, words, repeat(7)), "<u8", len(words)) % IDS).astype("<u2")


def _joined(docs: list[np.ndarray]) -> np.ndarray:
    """The documents' tokens one after the other, edges before, between and behind them."""
    gap = np.full(SIDE, EDGE, "<u2")
    return np.concatenate([gap] + [part for d in docs for part in (d, gap)])


def _around(wide: np.ndarray, at: np.ndarray) -> np.ndarray:
    return wide.take(at[:, None] + AROUND)


def contexts(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The tokens on both sides of each place."""
    return _around(_joined([ids]), at + SIDE)


def _rows(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return table.take(at, axis=0, mode="clip")  # ids lie within; the other modes copy once more


def _softmax(z: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of the probability at each row's wanted (flat) place, and the sums of the exponentials, which z becomes."""
    if not -REACH < z.min() <= z.max() < REACH:
        z -= z.max(axis=1, keepdims=True)
    got = z.reshape(-1).take(want)
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    return got - np.log(total), total


def forward(p: dict[str, np.ndarray], ctx: np.ndarray, target: np.ndarray):
    """Log-probability of each target, and what its gradient needs."""
    n = len(ctx)
    x = _rows(p["embed"], ctx).reshape(n, -1)
    h = x @ p["w"]
    h += p["b"]
    np.tanh(h, out=h)
    c, j = np.divmod(target, INNER)
    at_c, at_j = np.arange(0, n * CLASSES, CLASSES) + c, np.arange(0, n * INNER, INNER) + j
    ec = h @ p["cls"]
    ec += p["cls_b"]
    log_c, sum_c = _softmax(ec, at_c)
    g = _rows(p["given"], c)
    g += h
    np.tanh(g, out=g)
    ej = g @ p["inner"]
    ej += _rows(p["inner_b"] + p["id_b"], c)
    log_j, sum_j = _softmax(ej, at_j)
    return log_c + log_j, (x, h, c, at_c, at_j, ec, sum_c, g, ej, sum_j)


def _take(table: np.ndarray, at: np.ndarray, moves: np.ndarray) -> None:
    """Subtract each move from its row; moves of the same row add up."""
    pair = np.result_type(table.dtype, np.complex64)  # numpy is fast here on flat arrays; two numbers at a time halve the places
    width = table.shape[1] // 2
    places = at.reshape(-1, 1).astype(np.intp) * width + np.arange(width)
    np.subtract.at(table.view(pair).reshape(-1), places.reshape(-1), moves.view(pair).reshape(-1))


def step(p: dict[str, np.ndarray], ctx: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One step of gradient descent on the mean negative log-probability, in place."""
    _, (x, h, c, at_c, at_j, dc, sum_c, g, dj, sum_j) = forward(p, ctx, target)
    n, ones = len(ctx), np.ones(len(ctx), dc.dtype)
    r = dc.dtype.type(rate / n)  # all moves below are gradients times r
    dc *= (r / sum_c)[:, None]
    dj *= (r / sum_j)[:, None]
    dc.reshape(-1)[at_c] -= r
    dj.reshape(-1)[at_j] -= r
    dg = dj @ p["inner"].T
    p["inner"] -= g.T @ dj
    p["inner_b"] -= ones @ dj
    dg *= np.subtract(1, np.square(g, out=g), out=g)
    _take(p["given"], c, dg)
    dh = dg
    dh += dc @ p["cls"].T
    p["cls"] -= h.T @ dc
    p["cls_b"] -= ones @ dc
    dh *= np.subtract(1, np.square(h, out=h), out=h)
    # an id's row is moved by its own examples alone: no division by the step's size, but by the square root of it
    dx = dh @ (p["w"].T * dc.dtype.type(np.sqrt(n)))
    p["w"] -= x.T @ dh
    p["b"] -= ones @ dh
    _take(p["embed"], ctx, dx)


def _walk(weights, rate: float, turn: int, turns: int):
    """Train on the tokens of one turn; all turns together cover every token."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = weights.value.copy()
        p, seen = layers(flat), 0
        ctx, target = np.empty((0, 2 * SIDE), "<u2"), np.empty(0, "<u2")  # what fills no step waits for more
        docs: list[np.ndarray] = []
        places: list[np.ndarray] = []  # of targets within the joined documents
        waiting, end = 0, SIDE
        for b in batches:
            for t in b.column(0):
                tokens = np.frombuffer(t.as_py(), "<u2")
                if not len(tokens):
                    continue
                at = np.arange((turn + int(tokens[0])) % turns, len(tokens), turns)
                if not len(at):
                    continue
                docs.append(tokens)
                places.append(at + end)
                end += len(tokens) + SIDE
                waiting += len(at)
                if waiting >= 8 * STEP:
                    ctx, target = _next(docs, places, ctx, target)
                    waiting = len(target) % STEP
                    whole = len(target) - waiting
                    seen += whole
                    _steps(p, [ctx[:whole]], [target[:whole]], rate)
                    ctx, target, docs, places, end = ctx[whole:].copy(), target[whole:].copy(), [], [], SIDE
        if waiting:
            ctx, target = _next(docs, places, ctx, target)
            seen += len(target)
            _steps(p, [ctx], [target], rate)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE, dtype="<i4")), pa.array(flat.astype("f8") * seen), pa.array(np.full(SIZE, seen, "<i8"))], ["at", "total", "n"])

    return walk


def _next(docs: list[np.ndarray], places: list[np.ndarray], ctx: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and targets that wait, with those of some more documents behind them."""
    if not docs:
        return ctx, target
    wide, at = _joined(docs), np.concatenate(places)
    return np.concatenate([ctx, _around(wide, at)]), np.concatenate([target, wide[at]])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(IDS, "<i8")
    for b in batches:
        for t in b.column(0):
            n += np.bincount(np.frombuffer(t.as_py(), "<u2"), minlength=IDS)
    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n), pa.int32()), pa.array(n[n > 0])], ["id", "n"])


def _steps(p, ctx: list[np.ndarray], target: list[np.ndarray], rate: float) -> None:
    x, y = np.concatenate(ctx), np.concatenate(target)
    for k in range(0, len(y), STEP):
        step(p, x[k:k + STEP].astype(np.intp), y[k:k + STEP].astype(np.intp), rate)


def tokens_of(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids): the token ids of each whole text, two bytes each; stored, as every pass below reads them."""
    @F.arrow_udf(T.BinaryType())
    def tokenized(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids = Ids()
        for b in batches:
            yield pa.array([ids.text(t.as_py()).tobytes() for t in b], pa.binary())

    return stored(df.select(F.col(doc_id).alias("doc_id"), tokenized(text_or_empty(text)).alias("ids")), "tokens")


def train(tokens: DataFrame, rounds: int = ROUNDS, rate: float = RATE) -> np.ndarray:
    """The averaged weights after some rounds over the token ids of all documents."""
    spark = tokens.sparkSession
    rows = tokens.select("ids")
    table = rows.mapInArrow(_tally, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # IDS rows
    counts = np.zeros(IDS)
    counts[table["id"].to_numpy()] = table["n"].to_numpy()
    weights = initial(counts)
    for k in range(rounds):
        start = spark.sparkContext.broadcast(weights)
        parts = rows.mapInArrow(_walk(start, rate / (k + 1), k, rounds), "at int, total double, n long")
        mean = stored(parts.groupBy("at").agg((F.sum("total") / F.sum("n")).alias("w")), "weights").toArrow()  # SIZE rows
        if not mean.num_rows:
            continue
        weights = weights.copy()
        weights[mean["at"].to_numpy()] = mean["w"].to_numpy()
    return weights


_SCORE = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType())])


def score(tokens: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, score (summed log-probabilities), mean_log_prob, perplexity."""
    shared = tokens.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf(_SCORE)
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        p = layers(shared.value)
        for b in batches:
            docs = [np.frombuffer(t.as_py(), "<u2") for t in b]
            sizes = np.array([len(t) for t in docs], "<i8")
            totals, k = np.zeros(len(docs)), 0
            while k < len(docs):  # some documents at a time, the last of them whole
                m, n = k, 0
                while m < len(docs) and n < CHUNK:
                    n += sizes[m]
                    m += 1
                if n:
                    wide = _joined(docs[k:m])
                    at = np.flatnonzero(wide != EDGE)
                    logs = np.concatenate([forward(p, _around(wide, at[i:i + CHUNK]), wide[at[i:i + CHUNK]])[0] for i in range(0, len(at), CHUNK)])
                    totals[k:m] = np.bincount(np.repeat(np.arange(m - k), sizes[k:m]), logs, minlength=m - k)
                k = m
            yield pa.StructArray.from_arrays([pa.array(sizes), pa.array(totals)], ["n_tokens", "score"])

    rows = tokens.select("doc_id", scored("ids").alias("s")).select("doc_id", "s.n_tokens", "s.score")
    mean = F.when(F.col("n_tokens") > 0, F.col("score") / F.col("n_tokens"))
    return rows.withColumn("mean_log_prob", mean).withColumn("perplexity", F.exp(-F.col("mean_log_prob")))


def report(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Train on all documents, then score each."""
    tokens = tokens_of(df, text, doc_id)
    return score(tokens, train(tokens))
