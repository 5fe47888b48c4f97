"""Operator 1, BPE encoding and decoding by tree concatenation.

A text of up to ``LEAF_CHARS`` characters is encoded where it lies. A longer one is halved until its
pieces are that short; the pieces are shuffled, encoded in parallel and joined pairwise up the tree.
At a join a window around the seam is encoded anew and doubled until it agrees with both sides.

Why the result is exact, for a BPE with an end-of-word suffix and the word pattern of ``WORD_RULE``:

* Pieces and windows end only at *clean cuts*: no composing character follows, no special string is
  cut, no apostrophe stands within reach, so that contractions are whole. Words found in a piece are
  then those of the whole text, but for the words that a cut shortens.
* A window agrees with a side if two neighbouring tokens have the same ids and places in both. If the
  first token ends a word, what follows doesn't depend on what came before. Else both tokens lie in
  one word; a sequence of tokens is the encoding of a word if and only if each neighbouring pair is
  the encoding of that pair (a first merge across a boundary would happen in the pair, too), and every
  pair of the spliced sequence stands in one of the spliced encodings.
* A window that has grown to both ends is the plain encoding.

Null texts count as empty and give no ids. Empty tables give empty results; repeated rows are encoded
each by itself. Ids are returned packed, four bytes each, little-endian; ``unpack_ids`` makes arrays.
"""
from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attraudit.llm.common import stored, text_or_empty, tidy

LEAF_CHARS = 65_536  # encoding a leaf takes well under a second; moving smaller ones costs more than it saves
FIRST_WINDOW = 64
CACHED_CHUNKS, CACHED_CHARS, SLICE_ROWS, LINE = 250_000, 64, 128, 128
TEXT_ROWS = 512  # whole texts that Python is handed at a time: 10,000 take 30 MB on either side of the pipe, and more while buffers grow
#: The word pattern for which clean cuts are proven; fixed value of the public tokenizer.
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CHUNK = re.compile(r"[^ \t\n\r]+")


def _flat(text: str) -> str:
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ")


def special_strings(path: str) -> list[str]:
    """The special strings of a tokenizer file that joins are proven for; others are refused. Called on the driver."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not spec["model"].get("end_of_word_suffix") or WORD_RULE not in json.dumps(spec["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\"):
        raise ValueError("joins are proven only for BPE with word ends and the known word pattern")
    return [t["content"] for t in spec["added_tokens"]]


def _library(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return tok


class Encoder:
    """The library's encoding of pieces, with one entry per blank-separated chunk kept in memory."""

    def __init__(self, path: str, special: Sequence[str] | None = None):
        self.tok = _library(path)
        self.special = special_strings(path) if special is None else list(special)
        self.ids: dict[str, bytes] = {"": b""}
        self.places: dict[str, tuple[bytes, bytes, bytes]] = {}

    def fresh(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts and ends of blank-separated chunks, encoded a line at a time, and each chunk's first token."""
        lines = [" ".join(chunks[k:k + LINE]) for k in range(0, len(chunks), LINE)]
        got = self.tok.encode_batch(lines, add_special_tokens=False)
        at = [np.array(e.offsets, "<i8").reshape(-1, 2) for e in got]
        ids = [np.array(e.ids, "<u4") for e in got]
        base = np.cumsum([0] + [len(x) + 1 for x in lines])
        at = np.concatenate([x + y for x, y in zip(at, base)]) if at else np.zeros((0, 2), "<i8")
        lengths = np.fromiter(map(len, chunks), "<i8", len(chunks)) + 1
        begins = np.cumsum(lengths) - lengths
        owner = np.searchsorted(begins, at[:, 0], "right") - 1
        first = np.searchsorted(owner, np.arange(len(chunks) + 1))
        shift = begins[owner] if len(chunks) else at[:, 0]
        return np.concatenate(ids) if ids else np.zeros(0, "<u4"), at[:, 0] - shift, at[:, 1] - shift, first

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Packed ids of whole texts. Blanks always part words, so chunks are encoded once each."""
        parts = [_flat(t).split(" ") for t in texts]
        if len(self.ids) > CACHED_CHUNKS:
            self.ids = {"": b""}
        new = list(set().union(*parts).difference(self.ids))
        ids, _, _, first = self.fresh(new)
        packed, cuts = ids.tobytes(), (first * 4).tolist()
        found = {c: packed[a:b] for c, a, b in zip(new, cuts, cuts[1:])}
        self.ids.update(found)
        out = [b"".join(map(self.ids.__getitem__, p)) for p in parts]
        for c in found:
            if len(c) > CACHED_CHARS:
                del self.ids[c]
        return out

    def placed(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts and ends (in characters) of a piece."""
        spans = [m.span() for m in _CHUNK.finditer(text)]
        chunks = [text[a:b] for a, b in spans]
        if len(self.places) > CACHED_CHUNKS // 3:
            self.places = {}
        new = list(set(chunks).difference(self.places))
        ids, starts, ends, first = self.fresh(new)
        got = {c: (ids[a:b].tobytes(), starts[a:b].tobytes(), ends[a:b].tobytes()) for c, a, b in zip(new, first.tolist(), first[1:].tolist())}
        self.places.update((c, v) for c, v in got.items() if len(c) <= CACHED_CHARS)
        rows = [self.places[c] if c in self.places else got[c] for c in chunks]
        ids, starts, ends = (np.frombuffer(b"".join(r[k] for r in rows), d) for k, d in ((0, "<u4"), (1, "<i8"), (2, "<i8")))
        shift = np.repeat(np.array([a for a, _ in spans], "<i8"), [len(r[0]) // 4 for r in rows])
        return ids, starts + shift, ends + shift

    def clean(self, text: str, p: int) -> bool:
        o = ord(text[p])
        starts = o < 0x300 or 0x4E00 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7A3 or unicodedata.category(text[p]) in ("Lu", "Ll", "Nd")
        if not starts or "'" in text[max(0, p - 2):p + 1]:
            return False
        return all(text.find(s, max(0, p - len(s) + 1), p + len(s) - 1) < 0 for s in self.special)

    def cut(self, text: str, p: int, step: int) -> int:
        """The nearest clean cut at or after p (step 1) or at or before it (step -1); an end if there is none."""
        while 0 < p < len(text) and not self.clean(text, p):
            p += step
        return min(max(p, 0), len(text))


def leaves(text: str, enc: Encoder, size: int = LEAF_CHARS) -> list[str]:
    """Halves of halves, in order, cut at clean cuts only."""
    if len(text) <= size:
        return [text]
    p = enc.cut(text, len(text) // 2, 1)
    if p == len(text):
        p = enc.cut(text, len(text) // 2, -1)
    if p in (0, len(text)):
        return [text]
    return leaves(text[:p], enc, size) + leaves(text[p:], enc, size)


Piece = tuple[str, np.ndarray, np.ndarray, np.ndarray]


def _agree(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], last: bool) -> tuple[int, int] | None:
    """Places (i, j) of neighbours a[i], a[i+1] = b[j], b[j+1] that meet between characters; the last or first such."""
    where = {x: j for j, x in enumerate(zip(b[0].tolist(), b[1].tolist(), b[2].tolist()))}
    rows = list(zip(a[0].tolist(), a[1].tolist(), a[2].tolist()))
    for i in range(len(rows) - 2, -1, -1) if last else range(len(rows) - 1):
        j = where.get(rows[i])
        if j is not None and where.get(rows[i + 1]) == j + 1 and rows[i][2] <= rows[i + 1][1]:
            return i, j
    return None


def join(a: Piece, b: Piece, enc: Encoder, window: int = FIRST_WINDOW) -> Piece:
    """The encoding of two neighbouring pieces' text."""
    n = len(a[0])
    while True:
        left, right = enc.cut(a[0], max(0, n - window), -1), enc.cut(b[0], min(len(b[0]), window), 1)
        ids, st, en = enc.placed(a[0][left:] + b[0][:right])
        st, en = st + left, en + left
        k = int(np.searchsorted(a[1 + 1], left))  # tokens of a inside the window
        tail = tuple(x[k:] for x in a[1:])
        m = int(np.searchsorted(b[2], right))
        head = (b[1][:m], b[2][:m] + n, b[3][:m] + n)
        in_a, in_b = int(np.searchsorted(en, n, "right")), int(np.searchsorted(st, n))
        l = (-1, -1) if left == 0 else _agree(tail, tuple(x[:in_a] for x in (ids, st, en)), last=True)
        r = (m - 1, len(ids) - 1) if right == len(b[0]) else _agree(head, tuple(x[in_b:] for x in (ids, st, en)), last=False)
        if l is not None and r is not None:
            keep_a = 0 if left == 0 else k + l[0] + 1
            from_w = l[1] + 1
            to_w, from_b = (len(ids), len(b[1])) if right == len(b[0]) else (in_b + r[1] + 1, r[0] + 1)
            if from_w <= to_w:
                out = [np.concatenate([a[c][:keep_a], w[from_w:to_w], b[c][from_b:] + (n if c > 1 else 0)]) for c, w in ((1, ids), (2, st), (3, en))]
                return a[0] + b[0], out[0].astype("<u4"), out[1], out[2]
        window *= 2


def tree(pieces: list[Piece], enc: Encoder) -> Piece:
    while len(pieces) > 1:
        pieces = [join(*pieces[i:i + 2], enc) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0]


def _encode_udf(path: str, special: Sequence[str]):
    @F.arrow_udf(T.BinaryType())
    @tidy
    def encode_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = Encoder(path, special)
        for b in batches:
            for k in range(0, len(b), SLICE_ROWS):
                yield pa.array(enc.encode(b.slice(k, SLICE_ROWS).to_pylist()), pa.binary())

    return encode_texts


def _leaves_udf(path: str, special: Sequence[str], size: int):
    @F.arrow_udf(T.ArrayType(T.StringType()))
    @tidy
    def split_leaves(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = Encoder(path, special)
        for b in batches:
            for t in b:
                yield pa.array([leaves(t.as_py(), enc, size)], pa.list_(pa.string()))

    return split_leaves


_PLACED = ["ids", "starts", "ends"]


def _placed_udf(path: str, special: Sequence[str]):
    @F.arrow_udf(T.StructType([T.StructField(n, T.BinaryType()) for n in _PLACED]))
    @tidy
    def encode_leaves(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = Encoder(path, special)
        for b in batches:
            for t in b:
                yield pa.StructArray.from_arrays([pa.array([x.astype("<u4").tobytes()], pa.binary()) for x in enc.placed(t.as_py())], _PLACED)

    return encode_leaves


def _tree_of(path: str, special: Sequence[str]):
    held: list[Encoder] = []  # one for all documents of a task

    def join_leaves(leaves_of_one: pa.Table) -> pa.Table:
        enc = held[0] if held else held.append(Encoder(path, special)) or held[0]
        rows = sorted(leaves_of_one.select(["leaf_no", "leaf", *_PLACED]).to_pylist(), key=lambda r: r["leaf_no"])
        pieces = [(r["leaf"], *(np.frombuffer(r[c], "<u4").astype("<u4" if c == "ids" else "<i8") for c in _PLACED)) for r in rows]
        kept = leaves_of_one.filter(pa.compute.equal(leaves_of_one["leaf_no"], 0)).select(["kept"])
        return kept.append_column("ids", pa.array([tree(pieces, enc)[1].tobytes()], pa.binary()))

    return join_leaves


def encode(df: DataFrame, path: str, text: str = "text", keep: Sequence[str] = ("doc_id",), leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """The columns of ``keep`` and ``ids``, packed token ids of the whole text (a ``keep`` column named ids gives way)."""
    special = special_strings(path)
    keep = [c for c in keep if c != "ids"]
    rows = df.select(F.struct(*keep).alias("kept"), text_or_empty(text).alias("t"))
    short = rows.where(F.length("t") <= leaf_chars).select("kept", _encode_udf(path, special)("t").alias("ids"))
    cut = rows.where(F.length("t") > leaf_chars).withColumn("row", F.monotonically_increasing_id())
    pieces = cut.select("row", "kept", F.posexplode(_leaves_udf(path, special, leaf_chars)("t")).alias("leaf_no", "leaf"))
    pieces = pieces.select("row", "leaf_no", "leaf", F.when(F.col("leaf_no") == 0, F.col("kept")).alias("kept"))
    encoded = pieces.repartition("row", "leaf_no").withColumn("enc", _placed_udf(path, special)("leaf")).select("row", "leaf_no", "leaf", "kept", "enc.*")
    schema = T.StructType([rows.schema["kept"], T.StructField("ids", T.BinaryType())])
    long = encoded.groupBy("row").applyInArrow(_tree_of(path, special), schema)  # one document's leaves at a time
    return short.unionByName(long).select("kept.*", "ids")


def decode(ids: Column | str, path: str) -> Column:
    """The text of packed ids, special tokens included; null for null."""
    @F.arrow_udf(T.StringType())
    @tidy
    def decode_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tok = _library(path)
        for b in batches:
            for k in range(0, len(b), SLICE_ROWS):
                some = b.slice(k, SLICE_ROWS).to_pylist()
                yield pa.array([None if x is None else tok.decode(np.frombuffer(x, "<u4").tolist(), skip_special_tokens=False) for x in some], pa.string())

    return decode_ids(ids)


def unpack_ids(ids: Column | str) -> Column:
    """Packed ids as array<int>."""
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def unpack(b: pa.Array) -> pa.Array:
        return pa.array([None if x is None else np.frombuffer(x, "<i4") for x in b.to_pylist()], pa.list_(pa.int32()))

    return unpack(ids)


_DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def _digest(ids: bytes, tok) -> tuple[int, str, str]:
    back = tok.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def _digests_udf(path: str, special: Sequence[str], encoded: bool):
    """Digests of texts, or of packed ids if they are ``encoded``; one tokenizer and one worker for both ways."""
    @F.arrow_udf(_DIGESTS)
    @tidy
    def digest_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = Encoder(path, special)
        for b in batches:
            for k in range(0, len(b), SLICE_ROWS):
                some = b.slice(k, SLICE_ROWS).to_pylist()
                rows = [_digest(x, enc.tok) for x in (some if encoded else enc.encode(some))]
                yield pa.StructArray.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int64(), pa.string(), pa.string()))], _DIGESTS.names)

    return digest_texts


def digests(df: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the packed ids and of the text decoded from them."""
    special = special_strings(path)
    rows = df.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("t"))
    short = rows.where(F.length("t") <= LEAF_CHARS).select("doc_id", _digests_udf(path, special, False)("t").alias("d"))
    long = encode(rows.where(F.length("t") > LEAF_CHARS), path, "t", keep=["doc_id"])
    long = stored(long, "joined", TEXT_ROWS).select("doc_id", _digests_udf(path, special, True)("ids").alias("d"))  # few texts
    return stored(short.unionByName(long).select("doc_id", "d.*"), "digests", TEXT_ROWS)
