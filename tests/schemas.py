"""Columns of the test tables."""

CHUNKS = "chunk_id string, parent_id string, doc_id string, unit_type string, heading string, text string, seq int, ingested_at timestamp_ntz"
LINES = "line_id long, doc_id string, page int, line_no int, text string, kind string, char_start int, char_end int, head string, tail string, extracted_at timestamp_ntz"
UNITS = "unit_id string, doc string, unit_type string, added_at timestamp_ntz, deleted_at timestamp_ntz"
RELATIONS = (
    "relation_id long, unit_id string, structural_join array<struct<doc_id: string, unit_id: string, basis: string>>, prose_xrefs array<struct<surface: string, kind: string, classification: string, detail: string, sentence: string, target: string>>,"
    " prose_xrefs_dropped array<struct<surface: string, kind: string, classification: string, detail: string, sentence: string, reason: string>>, recorded_at timestamp_ntz"
)
FOUND = "reference_id long, source_id string, kind string, surface string, char_start int, char_end int, candidates array<string>, seen_at timestamp_ntz"
REQUESTS = "custom_id string, query_set string, condition string, query_id string, system_text string, user_text string, created_at timestamp_ntz"
ANSWERS = (
    "custom_id string, result_type string, response struct<type: string, message: struct<id: string, model: string, role: string, stop_reason: string, content: array<struct<type: string, text: string, citations: string>>,"
    " usage: struct<input_tokens: int, output_tokens: int, service_tier: string>>>, body_sha256 string, collected_at timestamp_ntz"
)
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, title string"
ITEMS = "item_id long, id string, type string, query string, passage string, expected_units array<string>"
WORDLIST = "word string, lang string, common boolean"
DECISIONS = "decision_id long, sentence string"
