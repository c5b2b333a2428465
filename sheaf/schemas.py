"""Row shapes of the engine."""

from __future__ import annotations

FILES = "bundle_id string, path string, length bigint, content binary"

ENTRIES = (
    "bundle_id string, entry_idx bigint, path string, content string, encoding string, "
    "is_binary boolean, eol_style string, checksum string, file_size_bytes bigint, "
    "content_type string"
)

BUNDLES = "bundle_id string, profile string, part_no bigint, text string"

LOG = "sessionId string, timestamp timestamp, event string, details string"

_IMPORT = "struct<name:string,alias:string,line:int,scope:string>"
_CLASS = "struct<name:string,line:int,doc:string>"
_FUNCTION = (
    "struct<name:string,line:int,kind:string,scope:string,doc:string,"
    "complexity:int,statement_count:int>"
)
_VARIABLE = "struct<name:string,line:int,scope:string>"
_COMMAND = (
    "struct<scope:string,kind:string,text:string,line:int,col:int,file:string,"
    "comment:string,pos_index:int>"
)
CATALOG = (
    f"file string, language string, error string, imports array<{_IMPORT}>, "
    f"classes array<{_CLASS}>, functions array<{_FUNCTION}>, variables array<{_VARIABLE}>, "
    f"commands array<{_COMMAND}>, metrics struct<file:struct<statement_count:int,"
    "function_count:int,class_count:int>>"
)

CHANGE_COLUMNS = (
    "project", "pairing_mode", "file_old", "file_new", "scope", "change_type", "line_old",
    "pos_old", "line_new", "pos_new", "kind_old", "kind_new", "text_old", "text_new",
)
