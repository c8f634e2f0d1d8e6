"""The jobs as queries: each runs twice into a folder of its own and returns the output as it then stands."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkwright.plans.queries import EDGES
from sparkwright.plans.scratch import shared_folder

from . import fact_sheets, ingest_chunks


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "job1")
    for _ in range(2):
        ingest_chunks.run(spark, f"{sf_dir}/documents.parquet", f"{at}/out", f"{at}/checkpoint")
    return ingest_chunks.current(spark, f"{at}/out").select("chunk_id", "chunk_index", "section_path", "lang", "tokens", "content_hash")


def job2_fact_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "job2")
    for _ in range(2):
        fact_sheets.run(spark, sf_dir, f"{at}/out")
    return fact_sheets.read(spark, f"{at}/out")


QUERIES = {f.__name__: f for f in (job1_ingest_chunks, job2_fact_sheets)}
SQL = {
    "job1_ingest_chunks": r"""
WITH s AS (SELECT doc_id, lang, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS sp, unnest(string_split(text, chr(10))) AS x FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT doc_id, lang, sp, regexp_extract_all(regexp_replace(x, '^\s+|\s+$', '', 'g'), '\s*\S+') AS k FROM s),
w AS (SELECT doc_id, lang, sp, k, unnest(range(CASE WHEN len(k) = 0 THEN 0 WHEN len(k) <= 800 THEN 1 ELSE CAST(ceil((len(k) - 100) / 700.0) AS BIGINT) END)) AS i FROM t),
p AS (SELECT doc_id, lang, sp, i, least(len(k) - i * 700, 800) AS n, regexp_replace(array_to_string(list_slice(k, i * 700 + 1, i * 700 + 800), ''), '^\s+|\s+$', '', 'g') AS text FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sp, i) - 1 AS c FROM p WHERE text <> '')
SELECT printf('%s_%05d', CAST(doc_id AS VARCHAR), c) AS chunk_id, CAST(c AS INT) AS chunk_index, 'p' || sp AS section_path, lang, CAST(n AS INT) AS tokens, sha256(text) AS content_hash FROM r""",
    "job2_fact_sheets": f"""
WITH {EDGES}, verbs(rel_type, verb) AS (VALUES ('SUPPLIES', 'supplies'), ('HAS_SEGMENT', 'has the business segment'), ('REGULATED_BY', 'is regulated by')),
told AS (SELECT b.*, e.confidence FROM both_ways b JOIN edges e ON b.e = e.src_type || e.src || e.rel_type || e.dst_type || e.dst)
SELECT a_type AS entity_type, a AS entity, b AS neighbor, CASE WHEN outgoing THEN a ELSE b END || ' ' || verb || ' ' || CASE WHEN outgoing THEN b ELSE a END || '.' AS text,
  ids[1] AS cited, CAST(len(ids) AS INT) AS chunks, confidence, told.rel_type AS relationship_type FROM told JOIN verbs USING (rel_type)""",
}
