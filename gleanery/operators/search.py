"""Search every record with every definition in one pass over the records."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import regex, text
from gleanery.functions.chunks import CHUNK_MATCHES, CHUNK_SCHEMA, ChunkSearch

SCOPE_NAME = "file name"
SCOPE_CONTENTS = "file contents"

# More searches than this in one generated method exceed what the JVM compiles.
MAX_GENERATED = 32

# An Arrow batch of chunks is handed to Spark at this many rows or characters.
BATCH_ROWS, BATCH_CHARS = 10_000, 16 << 20

_SEARCH_ONLY = ("text", "folded_name", "folded")


def prepare(records: DataFrame, keys: list[str], name: Column, payload: Column,
            *, search_binary: bool = False, is_text: bool = False,
            carry: list[str] = ()) -> DataFrame:
    """``keys``, ``name`` and the searchable ``text``, decoded once per record.

    ``text`` is NULL where the payload is binary and ``search_binary`` is off;
    ``folded_name`` and ``folded`` are the forms for substring tests.
    """
    decoded = records.select(
        *keys, name.alias("name"),
        text.searchable_text(payload, search_binary, is_text).alias("text"),
        *carry)
    return decoded.withColumns({"folded_name": regex.fold(F.col("name")),
                                "folded": regex.fold(F.col("text"))})


def _hit(definition: regex.Definition) -> Column:
    return F.struct(
        F.lit(definition.definition).alias("definition"),
        regex.find_all(F.col("name"), definition.pattern, F.col("folded_name"))
        .alias("name_matches"),
        regex.find_all(F.col("text"), definition.pattern, F.col("folded"))
        .alias("content_matches"))


def _hits(definitions, dialect: str) -> Column:
    """Array with one struct per definition; from Python it holds hits only."""
    native, python = regex.split_by_engine(regex.as_definitions(definitions), dialect)
    if python:
        return regex.python_hits(F.col("name"), F.col("text"), python)
    return F.array(*[_hit(d) for d in native])


def _matched(name_matches, content_matches) -> Column:
    return (F.size(name_matches) > 0) | (F.size(content_matches) > 0)


def search_pairs(prepared: DataFrame, keys: list[str], definitions,
                 dialect: str = "auto") -> DataFrame:
    """One row per (record, definition) with a match in name or text.

    No join: the definitions are literals of the plan, so each record is read,
    decoded and searched once, in the stage of the scan and without a shuffle.
    The filter sits above the generator, so the searches are not repeated.
    """
    native, _ = regex.split_by_engine(regex.as_definitions(definitions), dialect)
    if len(native) > MAX_GENERATED:
        found = search_records(prepared, definitions, dialect)
        return found.select(*keys, "name", F.inline("hits"))
    pairs = prepared.select(*keys, "name", F.inline(_hits(definitions, dialect)))
    return pairs.where(_matched("name_matches", "content_matches"))


def search_records(prepared: DataFrame, definitions, dialect: str = "auto",
                   keep: Column | None = None) -> DataFrame:
    """One row per record with a match; all its hits in the array ``hits``.

    Used where a wide column (the payload) must be kept once per record and
    not once per pair.  Rows for which ``keep`` holds stay without a match,
    with NULL in ``hits`` and no payload to carry.
    """
    kept = [c for c in prepared.columns if c not in _SEARCH_ONLY]
    hits = F.filter(_hits(definitions, dialect),
                    lambda h: _matched(h["name_matches"], h["content_matches"]))
    # The one-element generator keeps the optimizer from moving the filter
    # below the projection, which would search every record twice.
    found = prepared.select(*kept, F.inline(F.array(F.struct(hits.alias("hits")))))
    found = found.withColumn("hits", F.when(F.size("hits") > 0, F.col("hits")))
    wanted = F.col("hits").isNotNull()
    return found.where(wanted if keep is None else wanted | keep)


def chunk_batch(chunks: list[tuple]) -> list[pa.Array]:
    """The columns of ``CHUNK_SCHEMA``."""
    strings = pa.list_(pa.string())
    kinds = (pa.string(), pa.int64(), pa.bool_(), strings, strings)
    columns = zip(*chunks) if chunks else ((),) * len(kinds)
    return [pa.array(column, kind) for column, kind in zip(columns, kinds)]


def _searched(definitions, chunk_matches: int, window: int | None, dropped: tuple[str, ...]):
    """Rows with ``name``, ``text`` and ``kept`` to their chunks."""
    searcher = ChunkSearch(definitions, chunk_matches)
    if window:
        searcher.window = window

    def chunks_of(name, value):
        if window and value is not None:
            pieces = (value[i:i + window] for i in range(0, len(value), window))
            return searcher.pieces(name, pieces)
        return searcher.whole(name, value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = [c for c in batch.schema.names if c not in dropped]
            names, texts, kept = (batch.column(c).to_pylist() for c in ("name", "text", "kept"))

            def handed(owners, chunks):
                at = pa.array(owners, pa.int64())
                return pa.RecordBatch.from_arrays(
                    [batch.column(c).take(at) for c in passed] + chunk_batch(chunks),
                    [*passed, *(field.split()[0] for field in CHUNK_SCHEMA.split(", "))])

            owners, chunks, size = [], [], 0
            for at, (name, value, keep) in enumerate(zip(names, texts, kept)):
                if keep:
                    owners.append(at)
                    chunks.append((None, None, None, None, None))
                for chunk in chunks_of(name, value):
                    owners.append(at)
                    chunks.append(chunk)
                    size += sum(map(len, chunk[3])) + sum(map(len, chunk[4]))
                    if len(chunks) >= BATCH_ROWS or size >= BATCH_CHARS:
                        yield handed(owners, chunks)
                        owners, chunks, size = [], [], 0
            yield handed(owners, chunks)

    return run


def search_chunks(prepared: DataFrame, definitions, *, chunk_matches: int = CHUNK_MATCHES,
                  window: int | None = None, keep: Column | None = None) -> DataFrame:
    """One row per chunk of the matches of a record and definition (see ``chunks``),
    with Python ``re``; so a row is bounded however many matches there are.

    All columns of ``prepared`` but the texts stay.  A record for which ``keep`` holds
    also has a row without a definition.  With ``window``, texts are searched in
    windows of that many characters, with the same result.
    """
    passed = [c for c in prepared.columns if c not in _SEARCH_ONLY]
    kept = F.lit(False) if keep is None else F.coalesce(keep, F.lit(False))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in prepared.select(*passed).schema]
    return prepared.select(*passed, "text", kept.alias("kept")).mapInArrow(
        _searched(regex.as_definitions(definitions), chunk_matches, window, ("text", "kept")),
        ", ".join([*fields, CHUNK_SCHEMA]))


def as_chunks(found: DataFrame, keep: Column) -> DataFrame:
    """Records with their ``hits`` (``search_records``) in the form of
    ``search_chunks``, each pair one chunk."""
    none = F.array().cast(f"array<{regex.HIT_TYPE}>")
    first = F.when(keep, F.array(F.lit(None).cast(regex.HIT_TYPE))).otherwise(none)
    hits = F.concat(first, F.coalesce("hits", none))
    kept = [c for c in found.columns if c != "hits"]
    rows = found.select(*kept, F.explode(hits).alias("hit"))
    single = F.col("hit").isNotNull()
    return rows.select(*kept, "hit.definition", F.when(single, 0).cast("bigint").alias("chunk"),
                       F.when(single, True).alias("whole"), "hit.name_matches",
                       "hit.content_matches")


def matching_definitions(prepared: DataFrame, keys: list[str], definitions,
                         dialect: str = "auto") -> DataFrame:
    """The pairs that match, without the matches themselves.

    Every definition is tested at most once per record and stops at its first
    match; only pairs that match become rows.
    """
    native, python = regex.split_by_engine(regex.as_definitions(definitions), dialect)
    if python:
        matching = regex.python_matching(F.col("name"), F.col("text"), python)
    else:
        matching = F.array_compact(F.array(*[
            F.when(regex.contains(F.col("name"), d.pattern, F.col("folded_name"))
                   | regex.contains(F.col("text"), d.pattern, F.col("folded")),
                   F.lit(d.definition))
            for d in native]))
    return prepared.select(*keys, F.explode(matching).alias("definition"))


def records_with_a_match(prepared: DataFrame, definitions, dialect: str = "auto") -> DataFrame:
    """The records on which at least one definition matches."""
    native, python = regex.split_by_engine(regex.as_definitions(definitions), dialect)
    if python:
        matching = regex.python_matching(F.col("name"), F.col("text"), python)
        return prepared.where(F.size(matching) > 0)
    tests = [regex.contains(F.col("name"), d.pattern, F.col("folded_name"))
             | regex.contains(F.col("text"), d.pattern, F.col("folded")) for d in native]
    return prepared.where(reduce(lambda a, b: a | b, tests))
