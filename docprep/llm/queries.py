"""The registered queries of this package: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL where there is one."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers

from . import ann, bpe, cotraining, divergence, langid, lexical, line_rules, lines, minmax, packing, simhash, substring, url_rules
from .common import table


def op1_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark, sf_dir):
    return lines.line_digest(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark, sf_dir):
    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.round_trip_digest(table(spark, sf_dir, "documents"), vocabulary)


def op4_quality_classifier(spark, sf_dir):
    return cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_length_buckets(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op7_substring_dedup(spark, sf_dir):
    return substring.removal_digest(table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    return line_rules.quality(table(spark, sf_dir, "documents"))


def op10_url_rules(spark, sf_dir):
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op11_minmax_near_dedup(spark, sf_dir):
    return minmax.near_duplicates(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_line_dedup, op3_byte_bpe, op4_quality_classifier, op5_length_buckets, op6_nearest_neighbours, op7_substring_dedup,
        op8_simhash_near_dedup, op9_quality_rules, op10_url_rules, op11_minmax_near_dedup, op12_lexical_search, op13_source_divergence,
    )
} | {"pipeline": corpus_pipeline.run}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL = {
    "op2_line_dedup": lines.ORACLE_SQL,
    "op5_length_buckets": packing.oracle_sql(),
    "op9_quality_rules": line_rules.ORACLE_SQL,
    "op11_minmax_near_dedup": minmax.ORACLE_SQL,
    "op12_lexical_search": lexical.ORACLE_SQL,
    "op13_source_divergence": divergence.ORACLE_SQL,
    "op7_substring_dedup": rf"""
        WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS seq
                FROM w, unnest(range(1, len(ws) - 11)) AS t(i)),
        later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY seq) AS first FROM win) WHERE first < doc_id),
        gone AS (SELECT DISTINCT doc_id, i + j AS i FROM later, unnest(range(0, 13)) AS t(j)),
        word AS (SELECT doc_id, i, ws[i] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(i)),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS txt, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
}
