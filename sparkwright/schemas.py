"""Declared schemas of all tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
_IDS = T.ArrayType(_S)


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


SECTION = _struct(("section_path", _S, True), ("text", _S, True))
DOCUMENT = _struct(
    ("document_id", _S, False), ("source", _S, False), ("document_type", _S, False), ("title", _S, False), ("date", T.DateType(), False),
    ("metadata", T.MapType(_S, _S), True), ("sections", T.ArrayType(SECTION), False), ("text", _S, False), ("source_uri", _S, False), ("content_hash", _S, False),
)
CHUNK = _struct(("chunk_id", _S, False), ("document_id", _S, False), ("chunk_index", _I, False), ("section_path", _S, False), ("text", _S, False), ("metadata", T.MapType(_S, _S), True))
MENTION = _struct(("entity_type", _S, False), ("raw_name", _S, False), ("canonical_name", _S, True), ("source_chunk_id", _S, False), ("confidence", _D, False))
CLAIM = _struct(("relationship_type", _S, False), ("source_entity", _S, False), ("target_entity", _S, False), ("source_chunk_id", _S, False), ("confidence", _D, False))
NODE = _struct(("entity_type", _S, False), ("canonical_name", _S, False), ("aliases", _IDS, True))
EDGE = _struct(("src_type", _S, False), ("src", _S, False), ("rel_type", _S, False), ("dst_type", _S, False), ("dst", _S, False), ("source_chunk_ids", _IDS, False), ("confidence", _D, False))
VECTOR = _struct(
    ("chunk_id", _S, False), ("document_id", _S, False), ("section_path", _S, True), ("text", _S, True), ("company", _S, True), ("ticker", _S, True),
    ("document_type", _S, True), ("filing_date", T.DateType(), True), ("embedding", T.ArrayType(T.FloatType()), False), ("created_at", T.TimestampType(), True),
)
MANIFEST = _struct(
    ("company", _S, False), ("ticker", _S, False), ("cik", _S, False), ("accession_number", _S, False), ("filing_type", _S, False),
    ("filing_date", T.DateType(), False), ("local_path", _S, False), ("downloaded_at", _S, False), ("sha256", _S, False),
)
RAW = _struct(("name", _S, False), ("content", T.BinaryType(), False))
DECISION = _struct(("asked_at", T.TimestampType(), False), ("question", _S, False), ("route", _S, False), ("confidence", _D, True), ("overridden", _B, False), ("entity_names", _IDS, True), ("query_type", _S, True), ("relationship_type", _S, True), ("second_relationship_type", _S, True), ("max_hops", _I, True), ("latency_ms", _D, False))
EXTRACTION = _struct(("entities", T.ArrayType(_struct(("entity_type", _S, True), ("raw_name", _S, True), ("confidence", _D, True))), True), ("relationships", T.ArrayType(_struct(("relationship_type", _S, True), ("source_entity", _S, True), ("target_entity", _S, True), ("confidence", _D, True))), True))
CACHE = _struct(("cache_key", _S, False), ("result", EXTRACTION, True), ("input_tokens", _L, True), ("output_tokens", _L, True))
ROUTE = _struct(
    ("route", _S, False), ("confidence", _D, False), ("entity_names", _IDS, False), ("query_type", _S, True), ("relationship_type", _S, True),
    ("second_relationship_type", _S, True), ("max_hops", _I, True),
)
ANSWER = _struct(("claims", T.ArrayType(_struct(("text", _S, True), ("chunk_id", _S, True))), True), ("no_answer_reason", _S, True))
GOLDEN = _struct(
    ("id", _S, False), ("difficulty", _S, False), ("expected_route", _S, True), ("hop_count", _I, True), ("gold_entities", T.ArrayType(_IDS), True),
    ("gold_relationship_types", _IDS, True), ("gold_count", _I, True), ("source_document", _S, True), ("source_evidence", _S, True),
)
OUTCOME = _struct(("question_id", _S, False), ("correct", _B, False), ("route", _S, True), ("latency_ms", _D, False), ("answer_text", _S, True), ("graph_evidence_count", _I, True), ("vector_evidence_count", _I, True))
