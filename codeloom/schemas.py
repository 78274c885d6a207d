"""Record types of the engine as Spark schemas."""





TELEMETRY = "id STRING, timestamp BIGINT, client_id STRING, event_type STRING, file_path STRING, symbol_name STRING, raw_tokens BIGINT, sliced_tokens BIGINT, tokens_saved BIGINT, latency_us BIGINT, status STRING, synced INT, extra_json STRING"
FILE_CACHE = "file_path STRING, hash STRING, last_indexed_at BIGINT"
SYMBOLS = "id STRING, file_path STRING, symbol_name STRING, kind STRING, language STRING, start_line INT, end_line INT, docstring STRING, hash STRING"
SOURCE_FILES = "file_path STRING, language STRING, content STRING"
CACHED_AST = "content_hash STRING, file_path STRING, language STRING, symbols ARRAY<STRING>, contracts ARRAY<STRING>, token_count BIGINT, cached_at BIGINT"
RULES = "rule_ord INT, name STRING, from_glob STRING, forbid_ord INT, forbid STRING, message STRING"
NODES = "id STRING, name STRING, file STRING, language STRING, hash STRING"
EDGES = "source_id STRING, target_id STRING, edge_type STRING, weight FLOAT"
OUTBOX = "id STRING, organization_id STRING, repository_id STRING, event_type STRING, aggregate_id STRING, payload STRING, idempotency_key STRING, status STRING, retry_count INT, created_at TIMESTAMP, processed_at TIMESTAMP"
PUSH = "repository STRING, branch STRING, commit_sha STRING, author STRING, commit_message STRING, modified ARRAY<STRING>, added ARRAY<STRING>, removed ARRAY<STRING>"
SLICE = "target_symbol STRING, file_path STRING, language STRING, sparse_code_lines ARRAY<STRUCT<line_no: INT, line: STRING>>, type_contracts ARRAY<STRING>, estimated_tokens BIGINT, original_file_tokens BIGINT, compression_ratio FLOAT, syntax_degraded BOOLEAN"
