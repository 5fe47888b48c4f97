"""Operators 1 and 2 against the library."""
import hashlib
import random
from collections.abc import Iterator

import edges
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attraudit.llm import bpe, token_counts
from attraudit.llm.common import ARROW_ROWS
from attraudit.llm.queries import tokenizer_path

ALPHABET = ["abcdefgh", "the", "ing", "'", "'s", "'re", "'LL", " ", "\n", "\t", " ", "é", "é", "́", "ß", "İ", "Σ", "<|endoftext|>", "<|startoftext|>", "<|end", "日本", "한국", "한", "😀", "12", "!!", "...", "\0", "\x1c", "\x85", "K", "ſ", "ŉ", "Ǆ", "क्षि", "‍", "a" * 30, "ab" * 20]


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def texts(n, longest, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) if rng.random() < 0.7 else rng.choice("abcdetion") for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_joined_leaves_equal_the_whole_encoding(lib):
    enc = bpe.Encoder(tokenizer_path())
    for t in texts(600, 60):
        want = lib.encode(t, add_special_tokens=False)
        parts = bpe.leaves(t, enc, 16)
        assert "".join(parts) == t
        got = bpe.tree([(x, *enc.placed(x)) for x in parts], enc)
        assert got[1].tolist() == want.ids
        assert list(zip(got[2].tolist(), got[3].tolist())) == [tuple(o) for o in want.offsets]


@pytest.mark.parametrize("text", ["a" * 5000, "abracadabra" * 700, "!?" * 3000, "é" * 4000, "'" * 900 + "s" * 900, "́" * 500, "<|endoftext|>" * 300])
def test_unsplit_text(lib, text):
    enc = bpe.Encoder(tokenizer_path())
    got = bpe.tree([(x, *enc.placed(x)) for x in bpe.leaves(text, enc, 100)], enc)
    assert got[1].tolist() == lib.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("leaf_chars", [50, bpe.LEAF_CHARS])
def test_encode_and_decode_of_odd_rows(spark, lib, leaf_chars):
    got = bpe.encode(edges.documents(spark), tokenizer_path(), keep=["doc_id", "text", "row"], leaf_chars=leaf_chars)
    assert got.columns == ["doc_id", "text", "row", "ids"]
    rows = got.withColumn("back", bpe.decode("ids", tokenizer_path())).withColumn("arr", bpe.unpack_ids("ids")).collect()
    assert len(rows) == len(edges.ROWS)
    for r in rows:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.arr == ids == np.frombuffer(r.ids, "<u4").tolist()
        assert r.back == lib.decode(ids, skip_special_tokens=False)


def test_digests_hand_python_few_texts_at_a_time(spark, monkeypatch):
    def sizes(path, special, encoded):
        @F.arrow_udf(bpe._DIGESTS)
        def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for b in batches:
                size, text = pa.array([len(b)] * len(b), pa.int64()), pa.array(["x"] * len(b), pa.string())
                yield pa.StructArray.from_arrays([size, text, text], bpe._DIGESTS.names)

        return count

    monkeypatch.setattr(bpe, "_digests_udf", sizes)
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "'a b' AS text")
    before = spark.conf.get(ARROW_ROWS)
    rows = bpe.digests(docs, tokenizer_path()).selectExpr("count(1) AS n", "max(n_tokens) AS most").first()
    assert rows["n"] == 3000 and rows["most"] <= bpe.TEXT_ROWS < 3000 and spark.conf.get(ARROW_ROWS) == before


def test_digests(spark, lib):
    rows = {r.doc_id: r for r in bpe.digests(edges.documents(spark), tokenizer_path()).collect()}
    ids = lib.encode(edges.LONG, add_special_tokens=False).ids
    assert rows[6].n_tokens == len(ids)
    assert rows[6].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert rows[6].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert rows[2].ids_sha256 == rows[3].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.digests(edges.documents(spark, []), tokenizer_path()).collect() == []


def test_counts_by_merging(lib):
    counter = token_counts.Counter(tokenizer_path())
    for t in texts(600, 60, seed=4) + ["a" * 5000, "ab" * 3000]:
        assert counter.text(t) == len(lib.encode(t, add_special_tokens=False).ids)


def test_report_of_odd_rows(spark, lib):
    rows = token_counts.token_report(edges.documents(spark), tokenizer_path(), limit=5).collect()
    want = sorted((r[0] or 0, len((r[1] or "").encode()), n := len(lib.encode(r[1] or "", add_special_tokens=False).ids), n > 5) for r in edges.ROWS)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want
    assert token_counts.token_report(edges.documents(spark, []), tokenizer_path()).collect() == []
