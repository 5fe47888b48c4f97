"""The pipeline against a brute-force version, and the queries against their SQL twins."""
import edges
import pytest
from compare import compare, duck
from pyspark.sql import functions as F
from test_cleaning import brute_leaks, brute_lines
from test_near_copies import brute_groups, brute_sets

import corpus_pipeline
from attraudit.llm import language_id, queries

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(corpus_pipeline.COLUMNS)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = sorted(tuple(r) for r in docs.collect())
    model = language_id.train(docs.where(~language_id.held_out("doc_id")))
    names, scores = model.predict([r[1] for r in rows])
    rows = [r for r, n, s in zip(rows, names, scores) if n != "und" and s >= 0.5]
    rows = [(r[0], t, *r[2:]) for r, t in zip(rows, brute_lines(rows, 0.1, 3))]
    rows = [r for k, (r, c) in enumerate(zip(rows, brute_groups(brute_sets([r[1] for r in rows])))) if k == c]
    leaks = {d for d, _ in brute_leaks([(r[0], r[1]) for r in rows], bench)}
    rows = [r for r in rows if r[0] not in leaks]
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.tokenizer_path())
    assert {r.doc_id: r.n_tokens for r in got} == {r[0]: len(lib.encode(r[1], add_special_tokens=False).ids) for r in rows}


def test_stages_take_odd_rows(spark):
    for rows in (edges.ROWS, []):
        docs = edges.documents(spark, rows).withColumns({c: F.lit(1) for c in ("n_lines", "n_dropped", "__n", "__th", "__id", "__r", "bands", "hub")})
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), duck(SF), queries.SQL[name]) == []


def test_all_queries_and_the_pipeline_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)} and set(queries.QUERIES) <= names
