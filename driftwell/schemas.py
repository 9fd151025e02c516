"""Schemas of the corpus model."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    return T.StructType.fromDDL(spec)


NOTES = _struct("path string, title string, content string, created timestamp, modified timestamp, file_mtime double, is_virtual boolean, source_file string, entry_date date")
LINKS = _struct("source_path string, position int, target string, display_text string, is_embed boolean, block_ref string")
TAGS = _struct("note_path string, tag string")
SESSIONS = _struct("session_id bigint, date date, state_hash string, created_at timestamp")
VECTORS = _struct("path string, embedding array<double>")
SESSION_VECTORS = _struct("session_id bigint, date date, path string, embedding array<double>, cluster_label string")
HISTORY = _struct("session_date date, query_id string, text string, block_id string, created_at timestamp")
SUGGESTIONS = _struct("text string, notes array<string>, query_id string, title string")
METRICS = _struct("session_date date, intrinsic_dim double, vendi_score double, shannon_entropy double, silhouette_score double, n_clusters int, n_gaps int, cluster_labels map<int,string>, computed_at timestamp")
STATUS = _struct("query_id string, failure_count int, disabled boolean, last_error string, updated timestamp")
