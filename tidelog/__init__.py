"""Log search and log analytics on Spark DataFrames."""

from tidelog.operators.partials import PartialCounts, refresh_partials
from tidelog.plans.counted import search_counted
from tidelog.plans.observed import search_observed
from tidelog.plans.search import SearchResult, search, search_many
from tidelog.sources.composite import open_index, union_sources
from tidelog.sources.file_index import FileIndex, indexed_lines
from tidelog.sources.index import Field, LogIndex, log_index
from tidelog.sources.readers import (
    apply_schema,
    json_lines_index,
    parse_declared,
    read_jdbc,
    read_json_lines,
)
from tidelog.sources.writers import (
    document_table_index,
    pruned_scan,
    time_table_index,
    write_document_table,
    write_time_table,
)
from tidelog.streaming.ingest import ingest_new_files
from tidelog.streaming.matches import match_new_files, match_totals, read_matches

__all__ = [
    "Field",
    "FileIndex",
    "LogIndex",
    "PartialCounts",
    "SearchResult",
    "apply_schema",
    "document_table_index",
    "indexed_lines",
    "ingest_new_files",
    "json_lines_index",
    "log_index",
    "match_new_files",
    "match_totals",
    "open_index",
    "parse_declared",
    "pruned_scan",
    "read_jdbc",
    "read_json_lines",
    "read_matches",
    "refresh_partials",
    "search",
    "search_counted",
    "search_many",
    "search_observed",
    "time_table_index",
    "union_sources",
    "write_document_table",
    "write_time_table",
]
