"""Operator 13 against plain pairwise overlap of the libraries' tokens."""
import hashlib
import random
from collections import Counter

import edges
import numpy as np
import pytest

from attraudit.llm import alignment
from attraudit.llm.queries import byte_bpe_path, piece_bpe_path

ALPHABET = ["abc", "the", " the", " ", "  ", "\n", "\t", " \n", "é", " é", "日本", "\U0001f600", " ", "\xa0", "\x1c", " \x1c", "▁", "<|endoftext|>", "<s>", "'s", " don't", "123", " 45", "!!", " ...", "\x85", "a" * 40, "Ω", "​", "﻿", "\r\n", "\0", "ﬁ"]


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(byte_bpe_path(), piece_bpe_path())


def brute(al, text):
    """Ids, links by comparing all pairs, groups by common ends; None without tokens."""
    if not text:
        return None
    ids_a, ids_b = al.a.encode(" " + text, add_special_tokens=False).ids, al.b.encode(text)
    parts = [[al.of_a[i] for i in ids_a], [al.of_b[i] for i in ids_b]]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return None
    spans = []
    for p in parts:
        at, out = 0, []
        for x in p:
            out.append((at, at + len(x)))
            at += len(x)
        spans.append(out)
    links = [(ids_a[i], ids_b[j]) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if max(s, u) < min(e, v)]
    groups, last = [], 0
    for end in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
        groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, sp) if last <= s and e <= end) for ids, sp in zip((ids_a, ids_b), spans)))
        last = end
    return len(ids_a), len(ids_b), groups, links


def test_gallop_finds_the_first_value_not_smaller():
    rng = random.Random(2)
    for _ in range(500):
        a, b = (np.array(sorted(rng.sample(range(200), rng.randint(1, 60)))) for _ in range(2))
        want = np.searchsorted(b, a)
        start = np.array([rng.randint(0, w) for w in want.tolist()])
        assert alignment.gallop(a, b, start).tolist() == want.tolist()


@pytest.mark.parametrize("section", [alignment.SECTION, 2])
def test_chunks_equal_whole_texts(aligner, monkeypatch, section):
    monkeypatch.setattr(alignment, "SECTION", section)
    rng = random.Random(5)
    texts = ["".join(rng.choice(ALPHABET) if rng.random() < 0.7 else rng.choice("abcdetion ") for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    for k in range(0, len(texts), 20):
        for t, got in zip(texts[k:k + 20], aligner.texts(texts[k:k + 20])):
            want = brute(aligner, t)
            if want is None:
                assert got.sums == [0, 0, 0, 0] and got.groups_sha256() == "" and len(got.pairs()[0]) == 0
                continue
            assert got.sums == [want[0], want[1], len(want[2]), len(want[3])]
            assert got.groups_sha256() == hashlib.sha256(";".join(want[2]).encode()).hexdigest()
            keys, times = got.pairs()
            assert {(p >> 32, p & 0xFFFFFFFF): n for p, n in zip(keys.tolist(), times.tolist())} == Counter(want[3])


@pytest.mark.parametrize("broadcast_pairs", [alignment.BROADCAST_PAIRS, 0])
def test_report_equals_brute_force(spark, aligner, broadcast_pairs):
    rows = list(edges.ROWS) + [(20, "a▁b", "en", "a", 1), (21, "<|endoftext|> and <s> stay </s> text", "en", "a", 1), (22, "unheard-of wörds… again, unheard-of wörds…", "de", "b", 2)]
    rows = [(r[0], "the quick brown fox jumps over the lazy dog " * 20 + "x" * 900, *r[2:]) if r[1] == edges.LONG else r for r in rows]
    docs = edges.documents(spark, rows).withColumnRenamed("row", "pairs").withColumnRenamed("t", "times")
    want = [(r[0], brute(aligner, r[1])) for r in rows]
    links = Counter(p for _, w in want if w for p in w[3])
    best = {}
    for (_, b), n in links.items():
        best[b] = max(best.get(b, 0), n)
    expected = sorted(str((
        d, *((w[0], w[1], len(w[2]), len(w[3]), sum(links[p] == best[p[1]] for p in w[3]), sum(links[p] for p in w[3]), hashlib.sha256(";".join(w[2]).encode()).hexdigest()) if w else (0, 0, 0, 0, 0, 0, "")),
    )) for d, w in want)
    got = alignment.report(docs, byte_bpe_path(), piece_bpe_path(), broadcast_pairs=broadcast_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(str(tuple(r)) for r in got.collect()) == expected
    assert alignment.report(edges.documents(spark, []), byte_bpe_path(), piece_bpe_path(), broadcast_pairs=broadcast_pairs).collect() == []


def test_long_text_without_blanks(spark, aligner):
    text = "abcdefghij" * 30_000
    got = alignment.report(spark.createDataFrame([(1, text)], "doc_id long, text string"), byte_bpe_path(), piece_bpe_path()).first()
    assert got.n_a == len(aligner.a.encode(" " + text, add_special_tokens=False).ids) and got.n_b == len(aligner.b.encode(text)) and got.n_links >= max(got.n_a, got.n_b)


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        from attraudit.llm.queries import tokenizer_path

        alignment.check_files(tokenizer_path(), piece_bpe_path())
