"""Sources and sinks."""

from tablecare.sources.landing import broken_parquet, encodings, load_summary, manifest, read_csv_files, read_parquet_files
from tablecare.sources.readers import (
    SourceError, check_table, null_tokens, read_csv, read_json, read_json_columns, read_parquet,
)
from tablecare.sources.writers import write_csv, write_parquet

__all__ = [
    "SourceError", "broken_parquet", "check_table", "encodings", "load_summary", "manifest", "null_tokens", "read_csv",
    "read_csv_files", "read_json", "read_json_columns", "read_parquet",
    "read_parquet_files", "write_csv", "write_parquet",
]
