"""Schemas of the tables that pass between operators."""

from __future__ import annotations

MANIFEST = (
    "name string, source_path string, content_type string, size bigint, last_modified timestamp, "
    "metadata map<string,string>"
)

CHUNK = (
    "id string, content string, source string, metadata map<string,string>, created_at timestamp, "
    "embedding array<float>, embedding_model string, vector_id string"
)

RESULT = (
    "job_id string, success boolean, n_embedded int, processing_time double, "
    "token_usage map<string,bigint>, error string"
)

TRANSITION = (
    "fingerprint string, seq bigint, ts timestamp, instance_id string, status string, error_message string"
)

LEDGER = (
    "fingerprint string, status string, instance_id string, started_at timestamp, "
    "completed_at timestamp, error_message string, retry_count int"
)

API_DOC = (
    "user_name string, api_name string, api_call string, api_version string, "
    "api_arguments string, functionality string"
)

# The domains of the string columns.
CHUNKING_STRATEGIES = ("semantic", "fixed", "sentence")
JOB_STATUSES = ("pending", "processing", "completed", "failed")
OUTPUT_FORMATS = ("jsonl", "parquet")
METRICS = ("cosine", "euclidean", "dot_product")


def require(value: str, allowed: tuple[str, ...], what: str) -> str:
    if value not in allowed:
        raise ValueError(f"unknown {what} {value!r}; expected one of {', '.join(allowed)}")
    return value
