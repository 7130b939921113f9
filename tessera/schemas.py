"""Schemas of the engine's tables (DDL); every reader and writer uses these."""

COMPLEXITY = "STRUCT<cyclomatic: INT, cognitive: INT, max_nesting: INT, param_count: INT, loc: INT>"
SYMBOLS = (
    "repo STRING, id STRING, file STRING, name STRING, qualified_name STRING, kind STRING, language STRING, signature STRING, docstring STRING, summary STRING, "
    "decorators ARRAY<STRING>, keywords ARRAY<STRING>, parent STRING, line INT, end_line INT, byte_offset BIGINT, byte_length BIGINT, content_hash STRING, "
    f"calls ARRAY<STRING>, imports ARRAY<STRING>, inherits_from ARRAY<STRING>, implements ARRAY<STRING>, complexity {COMPLEXITY}, ord BIGINT"
)
FILES = "repo STRING, file STRING, language STRING, sha256 STRING, n_bytes BIGINT, ord INT"
CONTENTS = "repo STRING, file STRING, content BINARY"
REPOS = "repo STRING, owner STRING, name STRING, indexed_at TIMESTAMP, index_version INT, git_head STRING, symbol_count BIGINT, file_count BIGINT, languages MAP<STRING, INT>"
EMBEDDINGS = "repo STRING, symbol_id STRING, model STRING, dim INT, vec ARRAY<FLOAT>"
USAGE = "tool_name STRING, ts TIMESTAMP, success BOOLEAN, error_message STRING, response_time_ms INT, argument_keys ARRAY<STRING>, session_id STRING"
EDGES = "repo STRING, rel STRING, src STRING, dst STRING, resolved BOOLEAN"
IMPORTS = "repo STRING, file STRING, module STRING"
DEPENDENCIES = "name STRING, version STRING, ecosystem STRING, purl STRING, source STRING"
LICENSES = "scope STRING, name STRING, version STRING, license STRING, classification STRING, source STRING"
TREE = "path STRING, type STRING, size BIGINT"

INDEX_VERSION = 2
EXECUTABLE = ("function", "method")
KINDS = ("function", "class", "method", "constant", "type")

#: Limits that results depend on.
MAX_FILES, MAX_FILE_BYTES, MAX_PATH, MAX_DEPTH = 5_000, 500_000, 512, 10
MAX_RESULTS, MAX_CONTEXT, MAX_BATCH, MAX_REPOS = 50, 100, 50, 5
MAX_LIST, MAX_LIST_ITEM = 500, 200
