"""Schemas and vocabularies of a property graph of code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


NODE_SCHEMA = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, signature string, docstring string, visibility string, is_abstract int, is_exported int, decorators string, framework string, properties string, body string, body_hash string, updated_at bigint"
EDGE_SCHEMA = "id bigint, source string, target string, target_text string, kind string, source_loc string, provenance string, properties string"
FILE_SCHEMA = "path string, content_hash string, language string, node_count int, indexed_at bigint, size bigint, modified_at bigint"

# Edge kinds of the vocabulary; loaders do not reject others.
EDGE_KINDS = tuple(
    "calls imports references extends implements contains data_flows reads writes throws env_accesses emits listens_on http_calls grpc_service grpc_client grpc_server similar_to test_edge config_link overrides instantiates decorates type_ref cross_ffi".split()
)
PROVENANCES = ("tree-sitter", "heuristic", "resolved", "unresolved", "ambiguous", "cycle_detected")
DIRECTIONS = ("in", "out", "both")
#: Kinds that calls, impact and paths follow unless told otherwise.
CALL_KINDS = ("calls", "references", "imports")


def node_id(file_path: Column, qualified_name: Column) -> Column:
    """First 32 hex digits of SHA-256 over ``file_path:qualified_name``."""
    return F.substring(F.sha2(F.concat_ws(":", file_path, qualified_name), 256), 1, 32)


def columns(ddl: str) -> dict[str, str]:
    """Column names and simple types of a schema string."""
    return {p.split()[0]: p.split()[1] for p in ddl.split(", ")}
