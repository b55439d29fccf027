"""Schemas of what passes between the stages."""

LOCATION = "struct<heading_path: array<string>, article_no: string, paragraph_seq: int, anchor_text: string, sheet_name: string, table_index: int, row_range: string, column_names: array<string>, column_names_confidence: string>"
ELEMENT = f"struct<kind: string, text: string, location: {LOCATION}>"
REGISTRY = "doc_id string, file_path string, format string, size long, mtime double, content_hash string, doc_version string, fingerprint string, doc_title string, title_source string, effective_date string, source_url string, issuing_org string, duplicate_of string, version_group string, is_latest int, status string, tenant_id string"
QUESTION = "qid string, format string, qtype string, question string, golden_answer string, expected_source struct<doc_title: string, file_path: string, locator: string>, notes string"
RECORD = "doc_id string, file_path string, format string, size long, mtime double, content_hash string, doc_version string, fingerprint string, doc_title string, title_source string, effective_date string, source_url string, issuing_org string, status string, line long"
DETAIL = "qid string, format string, qtype string, question string, golden_answer string, expected_source struct<doc_title: string, file_path: string, locator: string>, retrieved_files array<string>, answer_text string, citations array<string>, refused boolean, degraded boolean, cite_ok boolean, key_ok boolean, ok boolean, sec double"
