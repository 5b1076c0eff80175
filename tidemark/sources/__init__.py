"""Readers, table sinks and the shared scratch folder."""

from tidemark.sources.delimited import load_raw, read_delimited, stamp_ingest
from tidemark.sources.shared import materialise, shared_folder, table_folder
from tidemark.sources.tables import (
    append_batch,
    bronze,
    register_bronze,
    replace_table,
    stored,
    write_audit,
)

__all__ = [
    "append_batch",
    "bronze",
    "load_raw",
    "materialise",
    "read_delimited",
    "register_bronze",
    "replace_table",
    "shared_folder",
    "stamp_ingest",
    "stored",
    "table_folder",
    "write_audit",
]
