"""Operator 11 against a plain recursive tree."""
import hashlib
import zlib

import edges
import pytest

from attraudit.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    d, text, lang, source, n = row
    n = n if n is None else n + more
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)])


def tree(nodes, arity):
    """Top and, for every leaf, its runs as (siblings before, siblings after)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, k in zip(paths, at):
            lo = k // arity * arity
            p.append((nodes[lo:k], nodes[k + 1:lo + arity]))
        nodes = [h(*nodes[k:k + arity]) for k in range(0, len(nodes), arity)]
        at = [k // arity for k in at]
    return nodes[0], paths


def brute(rows, arity=2):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, paths, order = [], {}, {}
    for g in names:
        order[g] = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        top, paths[g] = tree([leaf_of(r) for r in order[g]], arity)
        tops.append(top)
    root, upper = tree(list(tops), arity)
    out = []
    for g, top, up in zip(names, tops, upper):
        for r, p in zip(order[g], paths[g]):
            path = p + up
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = leaf_of(r, 1 if hit else 0)
            for before, after in path:
                folded = h(*before, folded, *after)
            out.append((r[0], leaf_of(r), top, root, h(*[s for b, a in path for s in b + a]), folded, folded == root))
    return sorted(map(str, out))


def made(docs, **kw):
    got = merkle.manifest(docs, "doc_id", "lang", ["doc_id", "source", "lang", "n_chars", "text"], {"n_chars": merkle.tampered_counts()}, **kw)
    return sorted(str(tuple(r)) for r in got.collect())


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest_of_odd_rows(spark, arity):
    assert made(edges.documents(spark), arity=arity) == brute(edges.ROWS, arity)
    assert made(edges.documents(spark, []), arity=arity) == []
    one = [(7, "alone", None, "a", None)]
    assert made(edges.documents(spark, one), arity=arity) == brute(one, arity)


@pytest.mark.parametrize("arity,block", [(2, 4), (3, 27), (5, 5)])
def test_rounds_of_blocks(spark, monkeypatch, arity, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = [((k * 37) % 301, f"text {k}", "en" if k % 3 else f"l{k % 11}", "s", k) for k in range(150)] + [(5, "same", "en", "s", 1)] * 60
    docs = edges.plain(spark, rows).repartition(5)
    assert made(docs, arity=arity) == brute(rows, arity)


def test_tampering_is_seen_where_it_happens(spark):
    rows = [(k, "x", "en", "s", None if k % 2 else k) for k in range(40)]
    got = merkle.report(edges.plain(spark, rows)).collect()
    assert {r.doc_id for r in got if not r.verified} == {k for k in range(0, 40, 2) if zlib.crc32(str(k).encode()) % 7 == 0}
    assert len({r.root for r in got}) == 1
