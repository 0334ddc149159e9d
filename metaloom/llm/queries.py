"""One query for each operator of this folder, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.llm import ann, html_text, lexical, mixing, ngram_join, packing, quality, sharding, spotsigs, substring_dedup, suffix_dedup, toxicity, whitening
from metaloom.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup(docs)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, *quality.train(docs))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 100 = 0"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), [1.0] * 24)


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.search(lexical.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=10)
    return found.selectExpr("item AS item_id", "rank", "doc AS doc_id", "score")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("cut_lengths", F.lit(0).cast("long"), lambda a, b: a + b)
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("cut_starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_ngram_join, op3_packing, op4_toxicity, op5_quality, op6_html_text, op7_nearest, op8_mixing, op9_sharding, op10_spotsigs,
        op11_lexical, op12_whitening, op13_suffix_dedup,
    )
}
# Hashes, token ids, trained models and packings have no SQL; tests/llm compares those queries with brute force.
ORACLES: dict[str, str] = {
    "op2_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z_\x{80}-\x{10FFFF}]+') ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) g FROM w),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
c AS (SELECT x.doc_id a, y.doc_id b, count(*) k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, k = p.n AND k = q.n AS same FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 5 * k >= 4 * (p.n + q.n - k)),
e AS (SELECT a, b, same FROM l UNION ALL SELECT b, a, same FROM l),
r AS (SELECT doc_id AS node, doc_id AS lead_id FROM documents UNION SELECT e.b, r.lead_id FROM r JOIN e ON e.a = r.node),
class AS (SELECT node, min(lead_id) class_id FROM r GROUP BY node),
copy AS (SELECT d.doc_id, least(d.doc_id, coalesce(min(e.b) FILTER (e.same), d.doc_id)) copy_id FROM documents d LEFT JOIN e ON e.a = d.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, class_id, y.copy_id, count(e.b) n_links, count(DISTINCT CASE WHEN NOT e.same THEN z.copy_id END) n_text_links
FROM documents d JOIN class ON node = d.doc_id JOIN copy y ON y.doc_id = d.doc_id LEFT JOIN e ON e.a = d.doc_id LEFT JOIN copy z ON z.doc_id = e.b GROUP BY 1, 2, 3""",
    # for pages as these are: one article of h1, p, b and br elements
    "op6_html_text": r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?b>', '', 'g') x FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(x, '</?(?:p|h1)>|<br>'), lambda t: trim(regexp_replace(
  replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))) ls FROM a)
SELECT page_id, url, array_to_string(list_filter(ls, lambda t: t <> ''), chr(10)) AS text, length(array_to_string(list_filter(ls, lambda t: t <> ''), chr(10))) n_chars FROM b""",
    "op11_lexical": r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') x FROM documents),
t AS (SELECT row_number() OVER () k, doc_id, regexp_extract_all(x, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') ts FROM d),
g AS (SELECT count(*) n_docs, sum(len(ts))::BIGINT total FROM t WHERE len(ts) > 0),
p AS (SELECT k, doc_id, len(ts)::BIGINT n, unnest(ts) term FROM t),
f AS (SELECT k, doc_id, n, term, count(*)::BIGINT tf FROM p GROUP BY 1, 2, 3, 4),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT w FROM f, g GROUP BY term, n_docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term FROM benchmark),
s AS (SELECT item_id, k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // total))))::BIGINT score FROM q JOIN w USING (term) JOIN f USING (term), g GROUP BY 1, 2, 3)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) rank FROM s WHERE score > 0) WHERE rank <= 10""",
}
