"""Readers and writers."""
from weftline.sources.arrow_ipc import read_arrow, write_arrow
from weftline.sources.database import (
    Connection, Slices, probe_schema, read_database, write_database,
)
from weftline.sources.files import (
    read_csv, read_json, read_parquet, write_csv, write_ndjson, write_parquet,
)
from weftline.sources.partitioned import read_partitioned, write_partitioned
from weftline.sources.policy import Checked, checked_text
from weftline.sources.text_table import (
    infer_text_types, repair_headers, text_literals, typed_text,
)

__all__ = [
    "Checked", "Connection", "Slices", "checked_text", "infer_text_types", "probe_schema", "read_arrow", "read_csv", "read_database",
    "read_json", "read_parquet", "read_partitioned", "repair_headers", "text_literals", "typed_text", "write_arrow",
    "write_csv", "write_database", "write_ndjson", "write_parquet", "write_partitioned",
]
