"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordergate.llm import (chat_hmm, collocations, conversation_repair, decontaminate, exact_dedup, html_wrapper, license_scan, ngram_join, packing,
                           quality_crf, token_counts, token_shards, warc_zstd)
from ordergate.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


@query
def op7_decontaminate(spark, sf_dir):
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op7_decontaminate"] = r"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id,
                  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
k AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, s,
             array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS win
      FROM i, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS u(s) WHERE len(w) > 0),
d AS (SELECT doc_id, coalesce(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
lens AS (SELECT DISTINCT n FROM k),
p AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
      FROM d, lens, unnest(range(1, greatest(len(w) - n, -1) + 2)) AS u(s)),
m AS (SELECT p.doc_id, p.s, p.n, k.item_id FROM p JOIN k ON p.win = k.win AND p.n = k.n),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
      FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id COLLATE "C") AS ids
       FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)"""


@query
def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


SQL["op10_exact_dedup"] = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t"""


@query
def op3_quality_crf(spark, sf_dir):
    return quality_crf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_ngram_join(spark, sf_dir):
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


@query
def op1_html_wrapper(spark, sf_dir):
    return html_wrapper.extract(table(spark, sf_dir, "pages"))


@query
def op5_warc_zstd(spark, sf_dir):
    return warc_zstd.archive_round_trip(table(spark, sf_dir, "pages")).drop("url")


SQL["op5_warc_zstd"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
r AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS hex,
             max(page_id) OVER (PARTITION BY payload) AS keep FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(hex, ''),
                 lambda d: lpad(bin(instr('0123456789abcdef', d) - 1), 4, '0')), '') AS bits FROM r)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + list_sum(list_transform(range(5), lambda k: CAST(substr(bits, CAST(5 * i + k + 1 AS INT), 1) AS INT) * (16 >> k::INT)))::INT,
           1)), '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM b"""


@query
def op6_token_shards(spark, sf_dir):
    return token_shards.shard_round_trip(table(spark, sf_dir, "documents"))


@query
def op9_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query
def op4_chat_hmm(spark, sf_dir):
    """Raw transcripts made from all conversations; the model is counted on those whose id has an even crc32."""
    raw = chat_hmm.raw_transcripts(table(spark, sf_dir, "conversations"))
    model = chat_hmm.train(raw.where(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 2 == 0))
    return chat_hmm.parse(raw.drop("role"), model)


@query
def op11_license_templates(spark, sf_dir):
    return license_scan.digest(license_scan.scan(table(spark, sf_dir, "documents")))


SQL["op11_license_templates"] = license_scan.sql()


@query
def op12_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


SQL["op12_collocations"] = collocations.SQL


@query
def op13_conversation_repair(spark, sf_dir):
    return conversation_repair.repair_conversations(table(spark, sf_dir, "conversations"))


SQL["op13_conversation_repair"] = conversation_repair.sql()
