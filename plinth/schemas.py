"""Row types of the data model and its fixed vocabularies."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType, TimestampType

_s, _i = StringType(), IntegerType()


def _row(**fields: tuple) -> StructType:
    return StructType([StructField(name, kind, null) for name, (kind, null) in fields.items()])


NODES = _row(id=(_s, False), full_name=(_s, False), name=(_s, False), kind=(_s, False), module=(_s, False), source_path=(_s, True), source_start_line=(_i, True), source_end_line=(_i, True), source_revision=(_s, False))
EDGES = _row(source_id=(_s, False), target_id=(_s, False), relation=(_s, False), evidence_grade=(_s, False), producer=(_s, False))
SOURCES = _row(id=(_s, False), source_revision=(_s, False), source_path=(_s, False), source_start_line=(_i, False), source_end_line=(_i, False), declaration_hint=(_s, True), text=(_s, False), content_sha256=(_s, False))
RAW_NODE = _row(name=(_s, True), module=(_s, True), kind=(_s, True), fullName=(_s, True))
RAW_EDGE = _row(source=(_s, True), target=(_s, True), kind=(_s, True))
RAW_GRAPH = StructType([StructField("nodes", ArrayType(RAW_NODE)), StructField("edges", ArrayType(RAW_EDGE))])
GENERATIONS = _row(generation_id=(_s, False), generation_content_sha256=(_s, False), catalog_sha256=(_s, False), projection_schema_version=(_s, False), state=(_s, False), ready_at=(TimestampType(), True))
CORPORA = _row(generation_id=(_s, False), source_id=(_s, False), release_tag=(_s, False), artifact_sha256=(_s, False), source_descriptor_sha256=(_s, False), availability=(_s, False), unavailable_reason=(_s, True))
SEARCH_DOCS = _row(generation_id=(_s, False), source_id=(_s, False), candidate_id=(_s, False), declaration_id=(_s, True), source_row_id=(_s, True), source_path=(_s, False), source_line=(_i, True), exact_identity=(_s, True), body_text=(_s, False))

#: Dependency kind to relation and evidence grade.
RELATIONS = {
    "type": ("type_dependency", "ELABORATED_TYPE_DEPENDENCY"),
    "value": ("value_dependency", "ELABORATED_VALUE_DEPENDENCY"),
}
LEXICAL_HIT = "LEXICAL_HIT"
ID_PREFIX = "lean:"
EDGE_KEY = ["source_id", "target_id", "relation", "producer"]
