"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (attribution, bpe, chat, collocations, decontaminate, langid, licenses, personal, secrets, simhash, trie, vectors,
               warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
MULTI_RANKS = "byte_bpe_multi_50k.tiktoken"


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_license_scan", licenses.oracle_sql())
def op1(spark, sf_dir):
    """Own or inherited licence of every document, documents laid out as files."""
    return licenses.license_table(table(spark, sf_dir, "documents"))


@register("op2_decontamination")
def op2(spark, sf_dir):
    """Benchmark passages in every document: one row per document and item."""
    return decontaminate.leak_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op3_language_id")
def op3(spark, sf_dir):
    """Language of every document, learned from the documents that are not held out."""
    return langid.language_table(table(spark, sf_dir, "documents"))


@register("op4_vector_dedup", """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER () AS r FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.r AS a, b.r AS b, b.vec_id AS other FROM good a JOIN good b
    ON a.label = b.label AND len(a.v) = len(b.v) AND a.r <> b.r
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT r AS a, r AS b FROM good UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), named AS (
  SELECT reach.a AS r, min(good.vec_id) AS component_id FROM reach JOIN good ON good.r = reach.b GROUP BY 1
), degree AS (SELECT a AS r, count(*) AS n FROM links GROUP BY 1), found AS (
  SELECT vec_id, coalesce(n, 0) AS n_links, component_id FROM good JOIN named USING (r) LEFT JOIN degree USING (r)
  UNION ALL
  SELECT vec_id, 0, vec_id FROM embeddings
  WHERE NOT coalesce(label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false)
)
SELECT vec_id, CAST(n_links AS BIGINT) AS n_links, component_id,
       component_id IS NOT DISTINCT FROM vec_id AS kept FROM found
""")
def op4(spark, sf_dir):
    """Links, component and representative of every vector."""
    return vectors.vector_links(table(spark, sf_dir, "embeddings"))


@register("op5_secret_scan")
def op5(spark, sf_dir):
    """Secret spans of every document."""
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


@register("op6_simhash_dedup")
def op6(spark, sf_dir):
    """SimHash fingerprint and near-duplicate group of every document."""
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@register("op7_personal_data")
def op7(spark, sf_dir):
    """Personal data in every document: checked formats and what their contexts lead to."""
    return personal.personal_digest(table(spark, sf_dir, "documents"))


@register("op8_byte_bpe")
def op8(spark, sf_dir):
    """Token ids of every document and their decoding, as digests."""
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(MULTI_RANKS), public_tokenizers.PATTERN)


@register("op9_warc_derivatives")
def op9(spark, sf_dir):
    """Metadata and conversion record of every page."""
    return warc.derivative_table(table(spark, sf_dir, "pages"))


@register("op10_token_counts")
def op10(spark, sf_dir):
    """Tokens of every line of every document, each document encoded as a whole."""
    return attribution.line_table(table(spark, sf_dir, "documents"), public_tokenizers.path(MULTI_RANKS),
                                  public_tokenizers.PATTERN)


@register("op11_conversation_trie", trie.oracle_sql())
def op11(spark, sf_dir):
    """Prefix trie of the rebuilt conversations, with the totals of every subtree."""
    return trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


@register("op12_chat_formatting", chat.oracle_sql())
def op12(spark, sf_dir):
    """Every conversation formatted with a loss mask, and read back, as digests."""
    return chat.chat_digest(table(spark, sf_dir, "conversations"))


@register("op13_collocations", collocations.oracle_sql())
def op13(spark, sf_dir):
    """The 2000 strongest phrases of two and three words in each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))
