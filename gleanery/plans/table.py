"""Search a table that has a name and a text (or payload) column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.chunks import CHUNK_MATCHES
from gleanery.operators import search


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def prepare_table(df: DataFrame, keys: list[str], name: Column | str, text: Column | str,
                  *, search_binary: bool = False, is_text: bool = True,
                  redistribute: int = 0) -> DataFrame:
    """Keys, name and searchable text of every row.

    ``is_text`` says that ``text`` is a string already; otherwise it is a
    binary payload, to be decoded.
    """
    if redistribute:
        df = df.select(*keys, _column(name).alias("name"), _column(text).alias("text")) \
            .repartition(redistribute)
        name, text = "name", "text"
    return search.prepare(df, keys, _column(name), _column(text),
                          search_binary=search_binary, is_text=is_text)


def search_table(df: DataFrame, keys: list[str], name: Column | str, text: Column | str,
                 definitions, *, search_binary: bool = False, is_text: bool = True,
                 dialect: str = "auto", redistribute: int = 0) -> DataFrame:
    """One row per (row of ``df``, definition) with a match in name or text:
    ``keys``, ``name``, ``definition``, ``name_matches``, ``content_matches``.

    ``redistribute`` spreads the rows over that many tasks first, for tables of
    fewer splits than there are cores; it shuffles the texts.
    """
    prepared = prepare_table(df, keys, name, text, search_binary=search_binary,
                             is_text=is_text, redistribute=redistribute)
    return search.search_pairs(prepared, keys, definitions, dialect)


def search_table_chunks(df: DataFrame, keys: list[str], name: Column | str, text: Column | str,
                        definitions, *, search_binary: bool = False, is_text: bool = True,
                        chunk_matches: int = CHUNK_MATCHES, window: int | None = None,
                        redistribute: int = 0) -> DataFrame:
    """``search_table`` for rows with any number of matches: one row per chunk of
    ``chunk_matches``, with ``chunk`` and ``whole`` (see ``functions.chunks``)."""
    prepared = prepare_table(df, keys, name, text, search_binary=search_binary,
                             is_text=is_text, redistribute=redistribute)
    return search.search_chunks(prepared, definitions, chunk_matches=chunk_matches, window=window)
