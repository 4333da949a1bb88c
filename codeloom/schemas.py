"""Schemas of the tables this engine keeps."""

from __future__ import annotations

SCHEMA_VERSION = 1
LANGUAGES = ("python", "javascript", "typescript", "tsx", "go", "rust", "java", "c", "cpp", "swift", "ruby", "php", "kotlin", "csharp")
CHUNK_TYPES = ("function", "class", "method", "module", "import", "comment", "other")

FILES = "path string, language string, size_bytes bigint, last_modified timestamp, hash string, chunk_count int"
METADATA = "is_overview boolean, import_count int, line_count int, is_summary boolean, method_count int, parent_classes array<string>, parameter_types array<struct<name:string,type:string>>, parameter_defaults map<string,string>, return_type string, decorators array<string>, is_async boolean, raises array<string>"
CHUNKS = "id string, file_path string, language string, chunk_type string, name string, content string, start_line int, end_line int, docstring string, parent_name string"
IMPORTS = "file_path string, line int, module string"
CALLS = "file_path string, caller string, callee string, pos int"
COMMITS = "hash string, full_hash string, author string, ts timestamp_ntz, message string, files array<string>"
BLAME = "file_path string, line int, author string, email string, ts timestamp_ntz, commit string, summary string"


def checked(value: str | None, allowed: tuple[str, ...], what: str) -> str | None:
    """``value`` if it is one of those allowed or None; else an error (O-22, O-69)."""
    if value is not None and value not in allowed:
        raise ValueError(f"Invalid {what} filter: {value!r}")
    return value


def clamped(value: object, low: int, high: int, default: int) -> int:
    """An integer within bounds, the default for anything else (O-69)."""
    if isinstance(value, bool) or not isinstance(value, int):
        return default
    return max(low, min(high, value))
