"""Typed errors, each with one of the fixed codes, and the exit code of a command that ended with one."""

from __future__ import annotations

# Fixed values.
CODES = (
    "NOT_INITIALIZED",
    "INDEX_FAILED",
    "PARSE_FAILED",
    "CHUNK_FAILED",
    "EMBEDDER_FAILED",
    "SEARCH_FAILED",
    "CONFIG_INVALID",
    "DB_CORRUPTED",
    "DB_WRITE_FAILED",
    "WATCHER_FAILED",
    "LLM_FAILED",
)


class SeekError(Exception):
    """An error the engine foresees."""

    def __init__(self, message: str, code: str):
        if code not in CODES:
            raise ValueError(f"unknown error code {code}")
        super().__init__(message)
        self.code = code


class IndexingError(SeekError):
    """Discovery, parsing, chunking or embedding failed."""


class SearchError(SeekError):
    """A query cannot be run."""


class SettingsError(SeekError):
    """Settings are missing or not valid."""


class StoreError(SeekError):
    """The stored index cannot be read or written."""


def exit_code(error: BaseException) -> int:
    """1 for foreseen errors, 2 for all others."""
    return 1 if isinstance(error, SeekError) else 2
