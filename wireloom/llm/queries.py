"""Registered queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from wireloom.llm import centroids, contamination, extract, near_dup, pieces, pii, quality, rules, secrets, suffix, suffix_tree, toxicity, trie
from wireloom.llm.sql import CONVERSATION_TRIE, centroid_rounds
from wireloom.llm.store import documents_of
from wireloom.session import ship


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "labels.parquet"))


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet"))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_dup.near_duplicates(documents_of(spark, sf_dir))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(documents_of(spark, sf_dir))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return suffix.repeated(documents_of(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rules(documents_of(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = documents_of(spark, sf_dir)
    return toxicity.toxicity(docs, toxicity.train(docs, _labels(spark, sf_dir)))


def op6_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(documents_of(spark, sf_dir), _benchmark(spark, sf_dir))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogated(documents_of(spark, sf_dir))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return pieces.encoded(documents_of(spark, sf_dir))


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = documents_of(spark, sf_dir)
    return suffix_tree.score(docs, suffix_tree.train(docs))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = documents_of(spark, sf_dir)
    return quality.quality(docs, quality.train(docs, _labels(spark, sf_dir)))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return centroids.clusters(spark.read.parquet(os.path.join(sf_dir, "embeddings.parquet")))


def op12_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    pages = spark.read.parquet(os.path.join(sf_dir, "pages.parquet"))
    return extract.extracted(pages, extract.train(pages))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return trie.conversation_trie(spark.read.parquet(os.path.join(sf_dir, "conversations.parquet")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_duplicates, op2_secrets, op3_repeated_passages, op4_quality_rules, op5_toxicity, op6_contamination, op7_surrogates, op8_pieces, op9_suffix_tree, op10_quality,
        op11_centroids, op12_extraction, op13_trie,
    )
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_GRAMS = """(SELECT {id}, CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g
    FROM (SELECT {id}, {words} AS ws FROM {table}) WHERE len(ws) > 0)"""

ORACLES = {
    "op1_near_duplicates": f"""
WITH RECURSIVE sets AS {_GRAMS.format(id="doc_id", words=_WORDS, table="documents")},
grams AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b),
comps AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(len(s.g), 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sets s USING (doc_id) JOIN comps c ON c.doc_id = d.doc_id""",
    "op11_centroids": centroid_rounds(),
    "op13_trie": CONVERSATION_TRIE,
    "op6_contamination": f"""
WITH docs AS {_GRAMS.format(id="doc_id", words=_WORDS, table="documents")}, items AS {_GRAMS.format(id="item_id", words=_WORDS, table="benchmark")},
d AS (SELECT doc_id, unnest(g) AS x FROM docs), i AS (SELECT item_id, len(g) AS n_item, unnest(g) AS x FROM items)
SELECT doc_id, item_id, n_item::BIGINT AS n_item, count(*)::BIGINT AS n_shared FROM d JOIN i USING (x)
GROUP BY doc_id, item_id, n_item HAVING count(*) * 10 >= n_item * 8""",
}
