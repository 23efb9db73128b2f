"""Column functions over record names and payloads.

Everything here is a composition of built-in Spark functions, so it stays
inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The size of the prefix that decides whether a payload is
# binary, and the bytes that make it so (every byte outside
# 07-0A, 0C, 0D, 1B and 20-FF, plus 7F).
SNIFF_BYTES = 1024
BINARY_BYTES = r"[\x00-\x06\x0b\x0e-\x1a\x1c-\x1f\x7f]"

# The web prefixes removed from an entry name, in order, and the
# characters that may not occur in one.
WEB_PREFIXES = ("http://", "https://", "www.")
FORBIDDEN_IN_ENTRY_NAME = '\\/*?:"<>|'

REPORT_SUFFIX = "_results.txt"

_REPLACEMENT = "\ufffd"
_MARK = "\ufdd0"


def is_binary(payload: Column) -> Column:
    """True if the first 1024 bytes hold a byte that text does not use.

    An empty payload is text, and so is any byte from 0x80 up.
    """
    head = F.substring(payload.cast("binary"), 1, SNIFF_BYTES)
    return F.decode(head, "ISO-8859-1").rlike(BINARY_BYTES)


def decode_lenient(payload: Column) -> Column:
    """UTF-8 text of ``payload`` with invalid bytes dropped.

    ``make_valid_utf8`` turns invalid bytes into U+FFFD, which then has to be
    told apart from a U+FFFD that was really in the payload.  Genuine ones are
    therefore escaped first; the mark used for escaping is escaped as well, so
    the round trip is exact for every input.
    """
    raw = payload.cast("string")
    escaped = F.replace(raw, F.lit(_MARK), F.lit(_MARK + "1"))
    escaped = F.replace(escaped, F.lit(_REPLACEMENT), F.lit(_MARK + "0"))
    cleaned = F.replace(F.make_valid_utf8(escaped), F.lit(_REPLACEMENT), F.lit(""))
    restored = F.replace(cleaned, F.lit(_MARK + "0"), F.lit(_REPLACEMENT))
    restored = F.replace(restored, F.lit(_MARK + "1"), F.lit(_MARK))
    return F.when(F.is_valid_utf8(raw), raw).otherwise(restored)


def searchable_text(payload: Column, search_binary: bool, is_text: bool = False) -> Column:
    """Decoded payload, or NULL where the payload must not be searched."""
    text = payload if is_text else decode_lenient(payload)
    if search_binary:
        return text
    return F.when(~is_binary(payload), text)


def base_name(path: Column) -> Column:
    """Last component of ``path`` without its last extension."""
    last = F.regexp_extract(path, r"([^/]*)\z", 1)
    return F.regexp_replace(last, r"(?s)^(\.*[^.].*)\.[^.]*\z", "$1")


def report_name(definition: Column) -> Column:
    """Name of the report of a definition."""
    return F.concat(definition, F.lit(REPORT_SUFFIX))


def export_name(definition: Column) -> Column:
    """Name of the zip export of a definition."""
    return F.concat(base_name(report_name(definition)), F.lit(".zip"))


def entry_name(name: Column) -> Column:
    """Record name made fit for use as a file name."""
    for prefix in WEB_PREFIXES:
        name = F.replace(name, F.lit(prefix), F.lit(""))
    return F.translate(name, FORBIDDEN_IN_ENTRY_NAME, "")


def elapsed_text(seconds: Column) -> Column:
    """Elapsed time as ``M minutes and S seconds``."""
    minutes = F.floor(seconds / 60).cast("bigint")
    rest = F.round(seconds - minutes * 60, 2)
    return F.concat(minutes.cast("string"), F.lit(" minutes and "),
                    rest.cast("string"), F.lit(" seconds"))
