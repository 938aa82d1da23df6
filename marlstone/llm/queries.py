"""One query for each corpus operator, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import ann, bpe, dac, html_extract, media, mixing, neardup, quality, toxicity, warc
from marlstone.llm._shared import table

TOKENIZER = "byte_bpe_50k.json"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.store_and_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=2)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest_media(media.store_texts(table(spark, sf_dir, "documents")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "documents"), k=3, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_token_files": op4_token_files,
    "op5_media": op5_media,
    "op6_mixing": op6_mixing,
    "op7_html": op7_html,
    "op8_ann": op8_ann,
    "op9_quality": op9_quality,
    "op10_neardup": op10_neardup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, CAST(CAST(unhex(sha1(encode(coalesce(html, '')))) AS BIT) AS VARCHAR) AS bits FROM pages),
  f AS (SELECT page_id, octet_length(body) AS payload_bytes, bits, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(5), lambda j: CAST(substr(bits, CAST(5 * i + j + 1 AS BIGINT), 1) AS INT) * (16 >> CAST(j AS INT)))) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
    "op10_neardup": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
  e AS (SELECT doc_id, unnest(s) AS g FROM s),
  c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
  l AS (SELECT x, y FROM c JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * n >= 85 * (len(a.s) + len(b.s) - n)),
  b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
  r AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT r.doc_id, b.y FROM r JOIN b ON b.x = r.root)
SELECT doc_id, CAST(any_value(len(s)) AS BIGINT) AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM s JOIN r USING (doc_id) GROUP BY doc_id""",
}
