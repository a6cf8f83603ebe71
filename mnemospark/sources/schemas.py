"""Schemas of the engine's tables; nothing is inferred."""

MEMORY = (
    "id string, type string, text string, cwd string, importance double, status string, supersedes string, superseded_by string, canonical string, canonical_model string, canonical_at long, "
    "source struct<session_id:string,seq:long,quote:string,at:long>, created_at long, updated_at long, recalls long, last_recalled_at long, "
    "judge struct<kind:string,confidence:double,conflict:string,mode:string>"
)
ARCHIVE = "session_id string, seq long, role string, at long, cwd string, text string"
BLOCKS = "array<struct<type:string,text:string,is_error:boolean>>"
EVENT = f"session_id string, seq long, type string, source_kind string, call_id string, name string, blocks {BLOCKS}, error_code string, error_name string, time long"
#: The JSON document as it is on disk; its values may be of any kind, so numbers are read as text first.
RAW_MEMORY = (
    "id string, type string, text string, cwd string, importance string, status string, supersedes string, supersededBy string, canonical string, canonicalModel string, canonicalAt string, "
    "source struct<sessionId:string,seq:string,quote:string,at:string>, createdAt string, updatedAt string, recalls string, lastRecalledAt string, judge struct<kind:string,confidence:string,conflict:string,mode:string>"
)
