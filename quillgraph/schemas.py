"""Table contracts. Times are epoch milliseconds; vectors are arrays; states are folded from events."""

from __future__ import annotations

RECORDS = "record_id string, virtual_record_id string, org_id string, record_name string, mime_type string, connector_id string, connector_name string, origin string, indexing_status string, owner_id string, created_at long, importance double, importance_base double, last_accessed_at long, access_count long"
CHUNKS = "point_id string, virtual_record_id string, org_id string, content string, embedding array<float>"
ENTITIES = "id string, label string, type string"
PRINCIPALS = "id string, coll string, user_id string, email string, role string, org_id string, file_key string"
EDGE_EVENTS = "seq long, ts long, op string, src string, dst string, label string, weight double, valid_at long, confidence double, record_id string"
EDGES = "src string, dst string, label string, weight double, created_at long, valid_at long, invalid_at long, expired_at long, provenance array<string>, confidence double"
FACTS = "seq long, ts long, subject string, predicate string, object string, confidence double, virtual_record_id string, record_id string, org_id string"
MEMORIES = "id string, org_id string, virtual_record_id string, subject_key string, memory string, is_static boolean, is_forgotten boolean, forget_after long, forget_reason string, version int, parent_id string, root_id string, is_latest boolean, relation string, source_record_id string, created_at long, updated_at long, use_count long, last_used_at long, kind string, occurred_at long, actor_ids array<string>, confidence double"
FORGOTTEN = "subject_key string, memory string, reason string"
EPISODES = MEMORIES
PROCEDURES = "seq long, ts long, org_id string, virtual_record_id string, record_id string, trigger string, action string"
WORKING = "session_id string, item_id string, content string, repeat_count int, ref_count int, important boolean, first_seen_at long, last_seen_at long"
AUDIT = "id long, ts long, actor string, action string, target string, prev_hash string, hash string"
QUERIES = "query_id string, user_id string, org_id string, query string"
CASES = "case_id string"
HISTORY = "case_id string, item_id string, text string, speaker string, timestamp string, pos int"
QUESTIONS = "case_id string, question_id string, question string, answer string, category string, evidence_ids array<string>, abstain boolean"

ALL = {k.lower(): v for k, v in globals().items() if k.isupper() and isinstance(v, str)}
