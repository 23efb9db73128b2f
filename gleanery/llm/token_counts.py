"""Tokens per field and section of a document, from one encoding of the whole.

A document is encoded once.  The bytes of its tokens, one after the other, are
its bytes, so running sums give the span of every token; spans are joined to the
sections (also spans) by binary search.  A token that reaches over a boundary
goes to the section that ``rule`` says:

    first   where the token begins
    most    which has most of its bytes; the earlier one if equal
"""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import PurePath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import bound_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# How byte-level BPE cuts a text before merging; the rule of the public vocabulary.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
RULES = ("first", "most")
# A document is these fields; those of the second list are cut into lines.
FIELDS, BY_LINE = ("source", "lang", "text"), ("text",)
SEPARATOR = " "
# Rows of an Arrow batch, about.
ROWS = 20_000


@lru_cache(maxsize=2)
def load_encoding(vocabulary: str):
    """The encoding of a file of ranks, and the bytes each of its ids stands for."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    encoding = tiktoken.Encoding(PurePath(vocabulary).stem, pat_str=SPLIT, mergeable_ranks=ranks,
                                 special_tokens={})
    return encoding, lengths


def line_starts(data: np.ndarray) -> np.ndarray:
    """Where the lines of a text begin, in bytes; a line has its line feed."""
    breaks = np.flatnonzero(data == 10) + 1
    return np.concatenate([[0], breaks[breaks < len(data)]])


def allocate(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, size: int,
             rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token and whether it reaches over a boundary.  Tokens and
    sections are spans of bytes; sections begin at ``sections``, end where the
    next begins, the last at ``size``."""
    own = np.searchsorted(sections, starts, "right") - 1
    last = np.searchsorted(sections, ends - 1, "right") - 1
    crossing = own != last
    if rule == "most":
        until = np.append(sections[1:], size)
        for t in np.flatnonzero(crossing):
            k = np.arange(own[t], last[t] + 1)
            share = np.minimum(until[k], ends[t]) - np.maximum(sections[k], starts[t])
            own[t] = k[np.argmax(share)]
    return own, crossing


def assemble(fields: list[str], by_line: list[bool]) -> tuple[str, list[int], list[int], np.ndarray]:
    """The document of field values: (text, field and number in the field of
    every section, where each section begins, in bytes).  A space follows every
    field but the last and belongs to it."""
    text = SEPARATOR.join(fields)
    starts, owner, number, at = [], [], [], 0
    for i, field in enumerate(fields):
        raw = (field + SEPARATOR * (i + 1 < len(fields))).encode()
        own = line_starts(np.frombuffer(raw, np.uint8)) if by_line[i] else np.zeros(1, np.int64)
        starts.append(own + at)
        owner += [i] * len(own)
        number += range(len(own))
        at += len(raw)
    return text, owner, number, np.concatenate(starts)


def section_tokens(documents: DataFrame, fields=FIELDS, by_line=BY_LINE,
                   vocabulary: str = VOCABULARY, rule: str = "most") -> DataFrame:
    """A row per section of every row of ``documents``: doc_id, field, section
    (from 0 in the field), start_char, end_char (in the whole document),
    n_tokens, n_crossing (of these, over a boundary), doc_tokens.

    A document is its ``fields``, one after the other; those in ``by_line`` are
    cut into lines, the others are one section.  Null fields are empty; a section
    without characters has no tokens.  The n_tokens of a document add up to its
    doc_tokens.  Repeated rows have their rows each.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    bound_batches(documents.sparkSession)
    cut = [f in by_line for f in fields]
    names = ["section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"]

    def of_document(values, encoding, lengths):
        text, owner, number, sections = assemble(values, cut)
        data = np.frombuffer(text.encode(), np.uint8)
        size = len(data)
        ids = np.array(encoding.encode_ordinary(text), np.int64)
        ends = np.cumsum(lengths[ids])
        starts = ends - lengths[ids]
        own, crossing = allocate(starts, ends, sections, size, rule)
        n = len(sections)
        # Places in characters: the bytes that begin one.
        edges = np.append(sections, size)
        if size and data.max() > 127:
            edges = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[edges]
        return owner, [np.array(number), edges[:-1], edges[1:], np.bincount(own, minlength=n),
                       np.bincount(own[crossing], minlength=n), np.full(n, len(ids))]

    def run(batches):
        encoding, lengths = load_encoding(vocabulary)
        for batch in batches:
            ids, rows, owner, kinds, filled = batch.column("id"), [], [], [], 0

            def flush():
                columns = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*rows)]
                taken = ids.take(pa.array(np.concatenate(owner), pa.int64()))
                return pa.RecordBatch.from_arrays(
                    [taken, pa.array([fields[k] for k in kinds], pa.string()), *columns],
                    ["doc_id", "field", *names])

            for i, values in enumerate(zip(*(batch.column(f"f{k}") for k in range(len(fields))))):
                kind, row = of_document([v.as_py() or "" for v in values], encoding, lengths)
                rows.append(row)
                kinds += kind
                owner.append(np.full(len(kind), i))
                filled += len(kind)
                if filled >= ROWS:
                    yield flush()
                    rows, owner, kinds, filled = [], [], [], 0
            if rows:
                yield flush()

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select(F.col("doc_id").alias("id"), *[
        F.col(f).cast("string").alias(f"f{k}") for k, f in enumerate(fields)]).mapInArrow(
        run, f"doc_id {kind}, field string, " + ", ".join(f"{name} bigint" for name in names))
