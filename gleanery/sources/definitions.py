"""Definitions: one regular expression per ``.txt`` file of a directory.

Patterns become literals of the query plan, so they are read where the plan is
made, like the text of a query.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from gleanery.functions.regex import Definition, rejection
from gleanery.sources.files import list_files, resolve

SUFFIX = ".txt"
DEFINITION_SCHEMA = "definition string, pattern string, path string"
REJECTED_SCHEMA = "definition string, reason string, path string"


class Loaded(NamedTuple):
    """Valid definitions and rejected files, each with its path last."""

    valid: list[tuple[str, str, str]]
    rejected: list[tuple[str, str, str]]

    @property
    def definitions(self) -> list[Definition]:
        return [Definition(name, pattern) for name, pattern, _ in self.valid]

    def definitions_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.valid, DEFINITION_SCHEMA)

    def rejected_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rejected, REJECTED_SCHEMA)


def _read_pattern(path: str) -> str:
    filesystem, inner = resolve(path)
    with filesystem.open_input_stream(inner) as stream:
        text = stream.read().decode("utf-8")
    return text.replace("\r\n", "\n").replace("\r", "\n").strip()


def load_definitions(directory: str) -> Loaded:
    """Read, strip and check every definition; a bad one is set aside.

    A missing directory holds no definitions.
    """
    try:
        files = list_files(directory, SUFFIX)
    except FileNotFoundError:
        files = []
    valid, rejected = [], []
    for path, _ in files:
        name = path.rsplit("/", 1)[1][: -len(SUFFIX)]
        try:
            pattern = _read_pattern(path)
        except (OSError, UnicodeDecodeError) as e:
            rejected.append((name, f"unreadable: {e}", path))
            continue
        reason = rejection(pattern)
        if reason is None:
            valid.append((name, pattern, path))
        else:
            rejected.append((name, reason, path))
    return Loaded(valid, rejected)


def require_valid(loaded: Loaded) -> None:
    """Stop before any scan if there is nothing to search with."""
    if not loaded.valid:
        reasons = "; ".join(f"{name}: {reason}" for name, reason, _ in loaded.rejected)
        raise ValueError(f"no valid definitions ({reasons or 'no .txt files'})")
