"""Operator 12 against a plain search of all strings."""
import hashlib
import random

import edges
import numpy as np
import pytest

from attraudit.llm import suffix_dedup as sd

NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def brute(rows, length):
    """Rows (doc_id, text) with distinct doc_ids; None counts as the largest."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    seen, out = set(), []
    for k in order:
        t = (rows[k][1] or "").encode()
        hit = np.zeros(len(t), "?")
        for s in range(len(t) - length + 1):
            w = t[s:s + length]
            if w in seen:
                hit[s:s + length] = True
            seen.add(w)
        spans = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        kept = bytes(b for b, h in zip(t, hit) if not h)
        out.append((rows[k][0], len(t), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def made(spark, rows, **kw):
    docs = spark.createDataFrame([(d, t, "en", 1, 2, 3) for d, t in rows], "doc_id long, text string, lang string, key int, tid int, t int").repartition(3)
    got = sd.report(docs, **kw)
    assert got.columns == NAMES
    return sorted(str(tuple(r)) for r in got.collect())


def texts(seed, n, alphabet, longest):
    rng = random.Random(seed)
    passages = ["".join(rng.choices(alphabet, k=rng.randint(5, 60))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choices(alphabet, k=rng.randint(0, longest))) for _ in range(rng.randint(0, 6))]
        out.append("".join(parts))
    return [(k * 3 % 997, t) for k, t in enumerate(out + out[:5] + [None, "", "x" * 300, "ab" * 200, "xx" * 150])]


@pytest.mark.parametrize("length,gram,hot", [(10, 3, sd.HOT), (10, 10, sd.HOT), (12, 2, 1), (20, 5, 0), (1, 1, sd.HOT)])
@pytest.mark.parametrize("alphabet", ["ab", "abcdefghijklmnop", "äö\U0001f600x"])
def test_equals_brute_force(spark, length, gram, hot, alphabet):
    rows = texts(length, 40, alphabet, 40) + [(None, "abcdefgh" * 9)]
    assert made(spark, rows, length=length, gram=gram, hot=hot) == brute(rows, length)


@pytest.mark.parametrize("hot", [sd.HOT, 5])
def test_production_lengths_and_slices(spark, monkeypatch, hot):
    rng = random.Random(8)
    words = [f"word{k}" for k in range(400)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    passage, other = say(60), say(17)
    rows = [(k, " ".join([say(rng.randint(0, 30)), passage[k % 7:], say(20), other, say(5)])) for k in range(60)]
    rows += [(100 + k, rows[k][1].replace("word7", "WORD7")) for k in range(20)] + [(200, "line of a page, again\n" * 3000), (201, "x" * 99), (202, "x" * 99), (203, "y" * 100), (204, "y" * 100)]
    assert made(spark, rows, hot=hot) == brute(rows, sd.LENGTH)


def test_long_texts_are_cut_into_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    t = rng.integers(97, 123, 5000, dtype="u1").tobytes()
    h = sd.Hashes()
    whole = sd.runs([t], h, 30, 8)
    monkeypatch.setattr(sd, "PIECE", 777)
    parts = sd.runs([b"", t, t[:29], t[:30]], h, 30, 8)
    flat = lambda r: sorted((s + k, o - k, v) for s, c, o, v in zip(r["start"].tolist(), r["count"].tolist(), r["off"].tolist(), r["value"].tolist()) for k in range(c))
    assert flat(whole) == flat(parts[parts["text"] == 1]) and len(flat(whole)) == 5000 - 29
    assert set(parts["text"].tolist()) == {1, 3}


def test_sort_is_the_order_of_strings_and_collisions_are_found():
    rng = np.random.default_rng(4)
    x = rng.integers(97, 100, 4000, dtype="u1")
    at = rng.permutation(3900)[:1500]
    group = np.sort(rng.integers(0, 7, len(at)))
    local = np.arange(len(x))
    s = sd.Suffixes(x, local, sd.Hashes(), 12)
    order = s.sort(at, group)
    keys = [(int(g), x[p:p + 12].tobytes()) for g, p in zip(group[order], at[order])]
    assert keys == sorted(keys)
    want = [(int(g), x[p:p + 12].tobytes()) for g, p in zip(group, at)]
    number = lambda c: [c.tolist().index(v) for v in c]
    assert number(s.classes(at, group)) == [want.index(k) for k in want]
    s.prefix[:] = 0  # every hash collides
    assert number(s.classes(at, group)) == [want.index(k) for k in want]


def test_odd_rows(spark):
    got = {}
    for r in sd.report(edges.documents(spark)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(edges.ROWS)
    assert got[2][0].n_bytes == got[3][0].n_removed == 0 and got[6][0].n_removed > 80_000
    repeat = "the same long text, twice under one number and once later " * 4
    rows = [(1, repeat), (1, repeat), (2, repeat)]
    out = sorted((r.doc_id, r.n_removed) for r in sd.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = len(repeat)
    assert out[0] == out[1] and out[2] == (2, n)
    assert sd.report(edges.documents(spark, [])).collect() == []
