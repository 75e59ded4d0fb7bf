"""Sources and sinks of entity tables."""

from graphloom.sources.files import append, catalog_columns, changed_files, read_binary, read_csv, read_json_objects, read_table, register_tables, write_csv, write_json_lines
from graphloom.sources.lookups import by_key, ensure_row, exists, first_or_none, fetch, key_map, named_call, page, rows_as_dicts, run_sql, scalar, stream_rows
