"""Schemas of the pipeline's tables and of raw mail."""

from __future__ import annotations


def payload_schema(depth: int) -> str:
    parts = f"ARRAY<{payload_schema(depth - 1)}>" if depth else "VARIANT"
    return f"STRUCT<mimeType: STRING, headers: ARRAY<STRUCT<name: STRING, value: STRING>>, body: STRUCT<data: STRING>, parts: {parts}>"


def raw_schema(depth: int = 5) -> str:
    """A stored message. Structs cannot recurse: parts below ``depth`` stay one VARIANT, whatever their depth."""
    return f"user_id LONG, id STRING, threadId STRING, snippet STRING, internalDate STRING, labels ARRAY<STRING>, payload {payload_schema(depth)}"


FIXTURE = "id STRING, source STRING, split STRING, note STRING, email STRUCT<subject: STRING, fromName: STRING, fromEmail: STRING, body: STRING>, expect STRING"
VERDICTS = "ARRAY<STRUCT<index: INT, relevant: BOOLEAN, stage: STRING, company: STRING, role: STRING, req: STRING>>"
APPLICATIONS = "id STRING, user_id LONG, company STRING, company_key STRING, role STRING, role_key STRING, stage STRING, locked BOOLEAN, dedup_key STRING, first_email_at TIMESTAMP, last_email_at TIMESTAMP"
EVENTS = "user_id long, message_id string, application_id string, stage string, email_at timestamp, subject string, sender string, snippet string, body string"
SYNC_STATE = "user_id long, last_synced_at timestamp, status string"
