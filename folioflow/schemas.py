"""Explicit schemas (DDL) of the tables the operators exchange; nothing is inferred."""

FRAMES = "source_id STRING, frame_index INT, ts_sec DOUBLE, width INT, height INT, data BINARY"
ROIS = "source_id STRING, roi ARRAY<ARRAY<DOUBLE>>, layout_hint STRING"
PROFILE = "sheet_id STRING, y INT, density DOUBLE"
PAGES = "sheet_id STRING, page_index INT, y_start INT, y_end INT"
JOB_PATCHES = (
    "job_id STRING, ts TIMESTAMP, seq BIGINT, status STRING, progress DOUBLE, current_step STRING, "
    "message STRING, result STRING, error_code STRING"
)
JOB_LOG = "job_id STRING, seq BIGINT, ts TIMESTAMP, line STRING"
CAPTURES = "job_id STRING, idx INT, path STRING, role STRING"
ASSETS = "path STRING, modificationTime TIMESTAMP, length BIGINT"
ATTEMPTS = "request_id STRING, rank INT, ok BOOLEAN, width INT, height INT, error STRING"
JOB = (
    "id STRING, source_type STRING, file_path STRING, youtube_url STRING, options STRING, artifact_dir STRING, "
    "status STRING, progress STRING, current_step STRING, message STRING, result STRING, error_code STRING, "
    "log ARRAY<STRING>, created_at STRING, updated_at STRING"
)
JOB_STATUS = "queued", "running", "done", "error"
