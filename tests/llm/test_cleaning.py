"""Operators 3, 4 and 5 against brute force."""
import random
import re
from collections import Counter, defaultdict

import edges
import pytest

from attraudit.llm import decontaminate, language_id, line_dedup


def shingles(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {" ".join(w[i:i + 5]) for i in range(len(w) - 4)}


def brute_leaks(docs, items, threshold=0.8):
    out = {}
    for d, t in docs:
        for i, x in items:
            s = shingles(x)
            if s and len(s & shingles(t)) >= threshold * len(s) - 1e-9:
                out[d, i] = (len(s & shingles(t)), len(s))
    return out


def words(rng, n):
    return [rng.choice(["ab", "cd", "ef", "gh", "ij", "kl", "mn", "op", "qr", "st"]) + str(rng.randint(0, 40)) for _ in range(n)]


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_containment_equals_brute_force(spark, threshold):
    rng = random.Random(5)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([3, 5, 6, 9, 14, 15, 20, 33, 60, 130, 400])]
    items += [(50, None), (51, ""), (52, items[6][1]), (None, items[4][1])]
    docs = []
    for d in range(120):
        body = words(rng, rng.randint(0, 300))
        w = (items[d % 11][1] or "").split()
        gone = set(rng.sample(range(len(w)), k=min(len(w), rng.randint(0, 1 + len(w) // 12))))
        w = [("zz" if k in gone else x) for k, x in enumerate(w)]
        at = rng.randint(0, len(body))
        docs.append((d, (", " if d % 3 else "\n").join(body[:at] + [x.upper() for x in w] + body[at:])))
    docs += [(500, None), (501, ""), (502, items[8][1]), (502, items[8][1])]
    df = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in docs], "doc_id long, text string, h int, item int, s int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, h int")
    got = {(r.doc_id, r.item_id): (r.shared, r.shingles) for r in decontaminate.report(df, bench, threshold=threshold).collect()}
    want = brute_leaks(docs, items, threshold)
    assert got == want and len(want) > 50
    left = decontaminate.decontaminate(df, bench, threshold=threshold)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, _ in docs if d not in {x for x, _ in want})


def test_decontaminate_odd_rows(spark):
    bench = spark.createDataFrame([(1, "another text under the same number"), (2, "the quick brown fox jumps over the lazy dog")], "item_id long, text string")
    docs = edges.documents(spark)
    left = decontaminate.decontaminate(docs, bench)
    assert left.count() == len(edges.ROWS) - 2 and left.columns == docs.columns
    assert decontaminate.decontaminate(edges.documents(spark, []), bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(edges.ROWS)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_equals_plain_bayes(spark):
    import numpy as np

    docs = [(i, t, g) for i, (t, g) in enumerate([("der die das und", "de"), ("the and of it", "en"), ("und nicht aber", "de"), ("with this or that", "en"), ("les des une", "fr"), ("et la le", "fr")] * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language_id.train(df)
    counts = {g: Counter() for g in ("de", "en", "fr")}
    for _, t, g in docs:
        counts[g].update(language_id.features(t).tolist())
    for t in ("und das", "the that", "une la le"):
        total = {g: np.log(1 / 3) + sum(np.log((c[b] + 0.5) / (sum(c.values()) + 0.5 * language_id.BUCKETS)) for b in language_id.features(t).tolist()) for g, c in counts.items()}
        best = max(total, key=total.get)
        names, scores = model.predict([t])
        assert names == [best]
        assert abs(scores[0] - 1 / sum(np.exp(v - total[best]) for v in total.values())) < 1e-9


def test_a_long_text_is_scored_in_slices(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    model = language_id.Model(["a", "b"], rng.normal(size=(language_id.BUCKETS, 2)), np.zeros(2))
    text = "".join(chr(c) for c in rng.integers(97, 700, 3001).tolist())
    whole = model.weights[language_id.features(text)].sum(0)
    for size in (7, 2 * 3001, 1 << 20):
        monkeypatch.setattr(language_id, "FEATURES", size)
        assert sorted(np.concatenate(list(language_id.sliced(text, max(1, size // 2)))).tolist()) == sorted(language_id.features(text).tolist())
        names, scores = model.predict([text, "x", None])
        assert names[0] == model.langs[int(whole.argmax())] and abs(scores[0] - 1 / (1 + np.exp(-abs(whole[0] - whole[1])))) < 1e-9


def test_language_odd_rows(spark):
    docs = edges.documents(spark)
    rows = language_id.identify(docs).collect()
    assert len(rows) == len(edges.ROWS)
    for r in rows:
        text = next(x[1] for x in edges.ROWS if x[0] == r.doc_id)
        if not language_id.has_letter(text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    kept = language_id.accept(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()}.isdisjoint({2, 3, 4, 5})
    assert language_id.identify(edges.documents(spark, [])).collect() == []
    unlabelled = language_id.identify(docs.drop("lang").selectExpr("*", "cast(null as string) lang")).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def brute_lines(rows, ratio, least):
    total, pages = Counter(r[3] for r in rows), defaultdict(int)
    for r in rows:
        for line in {x.strip(" \t\r") for x in (r[1] or "").split("\n")} - {""} if r[1] is not None else ():
            pages[r[3], line] += 1
    bad = {k for k, n in pages.items() if n >= least and n > ratio * total[k[0]]}
    return [None if r[1] is None else "\n".join(x for x in r[1].split("\n") if (r[3], x.strip(" \t\r")) not in bad) for r in rows]


@pytest.mark.parametrize("ratio,least", [(0.1, 3), (0.05, 2)])
def test_lines_equal_brute_force(spark, ratio, least):
    rng = random.Random(6)
    rows = [(i, "\n".join(rng.choice(["menu", " menu ", "footer\r", "", "x y"] + [f"line {k}" for k in range(60)]) for _ in range(rng.randint(1, 8))), "en", rng.choice(["a", "a", "a", "b", None]), 1) for i in range(150)]
    rows += edges.ROWS
    docs = edges.documents(spark, rows)
    got = line_dedup.drop_boilerplate(docs, "source", ratio=ratio, min_pages=least)
    assert got.columns == docs.columns + ["n_lines", "n_dropped"]
    want = brute_lines(rows, ratio, least)
    order = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=order) == sorted([(r[0], t) for r, t in zip(rows, want)], key=order)
    assert sum(t != r[1] for r, t in zip(rows, want)) > 50
    assert line_dedup.drop_boilerplate(edges.documents(spark, []), "source").count() == 0


def test_host_as_site(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("HTTP://A.example/x?y=1",), ("https://a.example:80/",), (None,), ("not a url",)], "url string")
    assert [r[0] for r in df.select(line_dedup.host_of(F.col("url"))).collect()][:3] == ["a.example", "a.example", None]


def test_pipeline_keeps_the_text_of_copied_documents(spark):
    import corpus_pipeline

    page = "a page that was copied as a whole\nwith a second line"
    rows = [(k, page, "en", "a", 1) for k in range(5)] + [(k, None, "en", None, None) for k in range(5, 10)]
    rows += [(k, f"page {k}\nmenu of the site" if k < 15 else f"page {k}", "en", "a", 1) for k in range(10, 30)]
    got = {r.doc_id: r.text for r in corpus_pipeline.without_boilerplate(spark, edges.plain(spark, rows).repartition(4), "").collect()}
    assert got == {r[0]: r[1] and r[1].replace("\nmenu of the site", "") for r in rows}
