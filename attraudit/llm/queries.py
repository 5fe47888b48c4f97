"""The registered queries of the corpus operators and their SQL twins."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attraudit.llm import alignment, bpe, decontaminate, language_id, line_dedup, merkle, permutation_index, pseudo_likelihood, secret_scan, simhash, suffix_dedup, token_counts, warc
from attraudit.llm.common import read, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def byte_bpe_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def piece_bpe_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


@register("op1_tree_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), tokenizer_path())


@register("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_report(read(spark, sf_dir, "documents"), tokenizer_path())


_WORDS_SQL = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '')"


@register("op3_decontamination", f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents), i AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM d),
its AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM i),
n AS (SELECT item_id, count(*) AS shingles FROM its GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, shingles, count(*) / shingles::DOUBLE AS containment
FROM ds JOIN its USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, shingles
HAVING count(*) >= 0.8::DOUBLE * shingles - 1e-9::DOUBLE""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@register("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


@register("op5_line_dedup", r"""
WITH l AS (SELECT doc_id, source, trim(u.line, E' \t\r') AS line FROM documents, unnest(string_split(text, chr(10))) AS u(line)),
p AS (SELECT source, line, count(DISTINCT doc_id) AS pages FROM l WHERE line <> '' GROUP BY source, line),
t AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
b AS (SELECT source, list(line) AS lines FROM p JOIN t USING (source) WHERE pages >= 3 AND pages > 0.1::DOUBLE * total GROUP BY source),
k AS (SELECT doc_id, source, string_split(text, chr(10)) AS has,
  list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(lines, []::VARCHAR[]), trim(x, E' \t\r'))) AS kept
  FROM documents LEFT JOIN b USING (source))
SELECT doc_id, source, array_to_string(kept, chr(10)) AS text, len(has) AS n_lines, len(has) - len(kept) AS n_dropped FROM k""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return line_dedup.drop_boilerplate(docs, "source").select("doc_id", "source", "text", "n_lines", "n_dropped")


@register("op6_warc", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM m""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(read(spark, sf_dir, "pages"), scratch_path(spark, "warc"))


@register("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(read(spark, sf_dir, "documents"))


@register("op8_secret_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(read(spark, sf_dir, "documents"))


@register("op9_pseudo_likelihood")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.report(read(spark, sf_dir, "documents"))


@register("op10_permutation_index")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


_FIELDS = ["doc_id", "source", "lang", "{n}", "text"]


def _leaf_sql(n: str) -> str:
    parts = [f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in (f.format(n=n) for f in _FIELDS)]
    return f"sha256({' || '.join(parts)})"


def _tree_sql(name: str, first: str) -> str:
    return f"""{name} AS ({first} UNION ALL
 SELECT g, lvl + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY g, lvl, pos // 2)"""


_BITS = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_BITS}), lambda c, x: xor(xor(c, x) >> 1, 3988292384::BIGINT * (xor(c, x) & 1))), 4294967295::BIGINT)"


@register("op11_merkle", f"""
WITH RECURSIVE d AS (SELECT *, n_chars + ({_CRC} % 7 = 0)::INT AS shown_chars, coalesce('=' || lang, '') AS g FROM documents),
l AS (SELECT doc_id, g, {_leaf_sql('n_chars')} AS leaf, {_leaf_sql('shown_chars')} AS shown FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM l),
{_tree_sql('t', "SELECT g, 0 AS lvl, pos, n, leaf AS node FROM o")},
s AS (SELECT g, node AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
{_tree_sql('u', "SELECT '' AS g, 0 AS lvl, pos, n, subroot AS node FROM s")},
low AS (SELECT g, lvl, pos, n, lead(node) OVER w AS nxt, lag(node) OVER w AS prv FROM t WINDOW w AS (PARTITION BY g, lvl ORDER BY pos)),
up AS (SELECT lvl, pos, n, lead(node) OVER w AS nxt, lag(node) OVER w AS prv FROM u WINDOW w AS (PARTITION BY lvl ORDER BY pos)),
p AS (SELECT o.g, o.pos, lvl, CASE WHEN low.pos % 2 = 1 THEN 'L' || prv WHEN nxt IS NULL THEN 'N' ELSE 'R' || nxt END AS step FROM o JOIN low ON o.g = low.g AND low.pos = o.pos >> lvl AND low.n > 1
 UNION ALL SELECT o.g, o.pos, 1000 + lvl, CASE WHEN up.pos % 2 = 1 THEN 'L' || prv WHEN nxt IS NULL THEN 'N' ELSE 'R' || nxt END FROM o JOIN s ON o.g = s.g JOIN up ON up.pos = s.pos >> lvl AND up.n > 1),
c AS (SELECT g, pos, list(step ORDER BY lvl) AS steps FROM p GROUP BY g, pos),
r AS (SELECT doc_id, leaf, subroot, (SELECT node FROM u WHERE n = 1) AS root, sha256(list_aggregate(list_transform(coalesce(steps, []), lambda x: x[2:]), 'string_agg', '')) AS proof_sha256,
 list_reduce(list_prepend(shown, coalesce(steps, [])), lambda acc, x: CASE x[1] WHEN 'L' THEN sha256(x[2:] || acc) WHEN 'R' THEN sha256(acc || x[2:]) ELSE sha256(acc) END) AS folded_root
 FROM o JOIN s USING (g) LEFT JOIN c ON c.g = o.g AND c.pos = o.pos)
SELECT *, folded_root = root AS verified FROM r""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(read(spark, sf_dir, "documents"))


@register("op12_suffix_dedup", """
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, n, q, substr(h, q * 1000 + 1, 1200) AS part FROM d, unnest(range(0, n // 500 + 1)) AS u(q)),
w AS (SELECT doc_id, q * 500 + o AS p, md5(substr(part, 2 * o + 1, 200)) AS k FROM s, unnest(range(0, 500)) AS v(o) WHERE q * 500 + o + 100 <= n),
g AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS nth FROM w) WHERE nth > 1),
r AS (SELECT doc_id, min(p) AS lo, max(p) + 100 AS hi FROM (SELECT *, sum((before IS NULL OR p > before + 100)::INT) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM g) GROUP BY doc_id, span),
b AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS was FROM r),
k AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * was + 1, 2 * (lo - was)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS kept FROM b JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(read(spark, sf_dir, "documents"))


@register("op13_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(read(spark, sf_dir, "documents"), byte_bpe_path(), piece_bpe_path())
