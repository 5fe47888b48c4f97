"""Operator 7 against brute force over all pairs, operator 10 against exact search."""
import random

import edges
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from attraudit.llm import permutation_index, simhash
from attraudit.llm.components import components


def brute_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hs = [xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(fps):
    """Smallest index reachable by links of at most four bits."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def near_fingerprints(rng, groups, n):
    out = []
    for _ in range(groups):
        x = rng.getrandbits(64)
        for _ in range(n):
            out.append(x)
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
    return out


def test_each_value_has_one_home_and_linked_values_meet_there():
    rng = random.Random(1)
    for _ in range(2000):
        u = rng.getrandbits(64)
        v = u
        for b in rng.sample(range(64), rng.randint(0, 4)):
            v ^= 1 << b
        key, fp, home = simhash.anchors_of(np.array([u, v], "<u8").view("<i8"))
        mine, other = fp == np.array([u], "<u8").view("<i8")[0], fp == np.array([v], "<u8").view("<i8")[0]
        assert home[mine].sum() == 3 or u == v
        assert set(key[mine & home]) & set(key[other])


@pytest.mark.parametrize("block", [simhash.BLOCK, 7])
def test_links_connect_what_brute_force_connects(spark, block):
    rng = random.Random(block)
    fps = list(dict.fromkeys(near_fingerprints(rng, 30, 12) + [0, 1, 3, (1 << 64) - 1] + [1 << k for k in range(64)]))
    signed = np.array(fps, "<u8").view("<i8").tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    got = {r.u: r.root for r in components(simhash.links(df, block)).collect()}
    want = brute_components(fps)
    by_root = {}
    for s, w in zip(signed, want):
        by_root.setdefault(w, set()).add(got.get(s, s))
    assert all(len(v) == 1 for v in by_root.values())
    assert len({next(iter(v)) for v in by_root.values()}) == len(by_root)
    assert len(by_root) < len(fps)


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    fps = [brute_fingerprint(t) for _, t in rows]
    want = {d: (f"{f:016x}", rows[c][0]) for (d, _), f, c in zip(rows, fps, brute_components(fps))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.report(docs).collect()}
    assert got == want


def test_copies_of_odd_rows(spark):
    docs = edges.documents(spark)
    got = simhash.report(docs).collect()
    assert len(got) == len(edges.ROWS)
    zero = {r.component_id for r in got if r.fingerprint == "0" * 16}
    assert zero == {2} and sum(r.fingerprint == "0" * 16 for r in got) == 3
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:8]) for r in rows) == sorted([(0, "Ein Text"), (1, "Hello wo"), (1, "another "), (2, ""), (5, "12345 !!"), (6, "the quic"), (7, "it's ́é")])
    assert simhash.report(edges.documents(spark, [])).collect() == []
    assert simhash.keep_first(edges.documents(spark, [])).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    rng = random.Random(2)
    nodes = rng.sample(range(10_000), 200)
    path = list(zip(nodes[:100], nodes[1:100])) + [(nodes[100], x) for x in nodes[101:150]] + [(5, 5)]
    got = {r.u: r.root for r in components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert {got.get(x, x) for x in nodes[:100]} == {min(nodes[:100])}
    assert {got.get(x, x) for x in nodes[100:150]} == {min(nodes[100:150])}


def exact(ids, x, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    near = [j for j in np.lexsort((ids, d)) if ids[j] != ids[q]][:k]
    return [(int(ids[j]), float(d[j])) for j in near]


def test_recall_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = permutation_index.nearest(df, F.col("vec_id") % 100 == 0, shard=500, least=50).collect()
    rows = sorted((r.vec_id, r.embedding) for r in df.collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], "f8")
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == ids[q])
        assert [m[0] for m in mine] == list(range(1, 11))
        want = dict(exact(ids, x, q, len(ids)))
        assert all(want[v] == s for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & {v for v, _ in exact(ids, x, q, 10)})
        total += 10
    assert hits / total >= 0.9


def test_footrule_by_inverted_files():
    rng = np.random.default_rng(3)
    x, piv = rng.normal(size=(50, 8)), rng.normal(size=(20, 8))
    o = permutation_index.orders(x, piv, 6)
    d = ((x[:, None] - piv) ** 2).sum(2)
    assert (o == d.argsort(1)[:, :6]).all()
    place = np.full((50, 20), 6)
    np.put_along_axis(place, o, np.arange(6)[None], 1)
    assert (permutation_index.InvertedFiles(o, 20).footrule(o[7]) == np.abs(place - place[7]).sum(1)).all()


def test_vectors_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, []), (None, [2.0, 2.0]), (10, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, shard int, query_id int")
    got = permutation_index.nearest(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 10), (10, 1, 2), (10, 2, 0), (10, 3, 0), (10, 4, 1)]
    assert got[1].score == 2 ** 0.5
    assert permutation_index.nearest(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert permutation_index.nearest(df, F.col("vec_id") == -1).collect() == []


def test_the_smallest_ids_of_a_large_tied_group_are_found():
    rng = np.random.default_rng(4)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 8)), 700, 0), rng.normal(size=(1300, 8))])
    ids = rng.permutation(len(x))
    points, group = rng.normal(size=(64, 8)), np.sort(ids[:700])
    left = pd.DataFrame({"vec_id": ids, "v": list(x)})
    right = pd.DataFrame({"query_id": group[:3], "v": [x[0]] * 3})
    got = permutation_index._search(10, points, 16, 0.3, 100)(left, right)
    for q in group[:3]:
        assert got[got.query_id == q].vec_id.tolist() == [i for i in group.tolist() if i != q][:10]
