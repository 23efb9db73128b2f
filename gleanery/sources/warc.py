"""Spark data source ``warc``: the records of gzip web archives.

    spark.dataSource.register(WarcDataSource)
    spark.read.format("warc").load("/archives")

A record is known by its archive, the offset of the gzip member it begins in
(``record_offset``) and the place in the decompressed member
(``record_position``).  An ``error`` ends its archive; a ``note`` says what was
odd about a record.  A payload too large for a row is NULL in it, with its
``payload_size``; ``Payloads`` reads it by its place, piece by piece.

Small archives share a partition and large ones can be cut into byte ranges
(``split_bytes``), since web archives hold one gzip member per record and a
reader may start at any member.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from gleanery.sources.files import list_archives, resolve

RECORD_SCHEMA = ("archive string, record_offset bigint, record_position bigint, warc_type string,"
                 " name string, payload binary, payload_size bigint, note string, error string")
TRAILER_SCHEMA = ("split_start bigint, split_end bigint, first_start bigint,"
                  " next_start bigint, records_read bigint, stopped bigint")

# Splits are packed up to this size per partition, and not cut below the other
# unless asked for.
PACK_BYTES = 256 << 20
MIN_SPLIT_BYTES = 4 << 20
# An Arrow batch is handed to Spark at this many rows or payload bytes.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20
# A longer header line, which could not be a name in a row, ends its archive with an
# error.
MAX_LINE = 512 << 20
# An HTTP header block that goes on beyond so many bytes stays in the payload.
MAX_HEAD = 16 << 20
# Larger payloads stay out of the rows, which cannot exceed 2 GiB.
MAX_PAYLOAD = 512 << 20
# Payloads are read by place in pieces of this size at most.
PIECE_BYTES = 64 << 20
NO_HTTP_END = "HTTP header block without an end"
LONG_HTTP = "HTTP header block without an end in its first {} bytes"

_READ_AHEAD = 4 << 20
_CHUNK = 64 << 10
_MAGIC = b"\x1f\x8b\x08"
_RECORD = b"WARC/"
_HTTP = b"HTTP/"
_HTTP_END = re.compile(rb"\r?\n\r?\n")


class ArchiveError(Exception):
    """The archive cannot be read any further."""


class Split(NamedTuple):
    """Members of ``archive`` that start in [start, end).

    ``first`` is the exact offset of the first of them where it is known.
    """

    archive: str
    start: int
    end: int
    first: int | None


class _Ahead:
    """Reads a file on from an offset, in blocks that grow; the file stays the
    caller's, who may read elsewhere in between."""

    def __init__(self, file, offset: int):
        self._file, self._at, self._size = file, offset, _CHUNK
        self._block, self._cursor = b"", 0

    def read(self, n: int) -> bytes:
        if self._cursor == len(self._block):
            self._file.seek(self._at)
            self._block, self._cursor = self._file.read(self._size), 0
            self._at += len(self._block)
            self._size = min(2 * self._size, _READ_AHEAD)
        part = self._block[self._cursor:self._cursor + n]
        self._cursor += len(part)
        return part


class Members:
    """Decompressed bytes of consecutive gzip members, with their offsets."""

    def __init__(self, file, offset: int):
        self._source = _Ahead(file, offset)
        self._raw, self._raw_at = b"", offset
        self._inflater = None
        self._buffer, self._cursor = b"", 0
        self._total = 0
        self._starts = deque()

    def _read_raw(self) -> bool:
        self._raw = self._source.read(_CHUNK)
        return bool(self._raw)

    def _consume(self, rest: bytes) -> None:
        self._raw_at += len(self._raw) - len(rest)
        self._raw = rest

    def _open_member(self) -> bool:
        while True:
            self._consume(self._raw.lstrip(b"\0"))
            if self._raw or not self._read_raw():
                break
        if not self._raw:
            return False
        if len(self._raw) < len(_MAGIC):
            self._raw += self._source.read(_CHUNK)
        if not self._raw.startswith(_MAGIC):
            raise ArchiveError(f"no gzip member at byte {self._raw_at}")
        self._inflater = zlib.decompressobj(31)
        self._starts.append((self._total, self._raw_at))
        return True

    def _fill(self) -> bool:
        while True:
            if self._inflater is None and not self._open_member():
                return False
            if not self._raw and not self._read_raw():
                raise ArchiveError(f"gzip member at byte {self._starts[-1][1]} is cut off")
            out = self._inflater.decompress(self._raw, 4 * _CHUNK)
            if self._inflater.eof:
                self._consume(self._inflater.unused_data)
                self._inflater = None
            else:
                self._consume(self._inflater.unconsumed_tail)
            if out:
                self._buffer = self._buffer[self._cursor:] + out
                self._cursor = 0
                self._total += len(out)
                return True

    def peek(self, n: int) -> bytes:
        while len(self._buffer) - self._cursor < n and self._fill():
            pass
        return self._buffer[self._cursor:self._cursor + n]

    def locate(self) -> tuple[int, int] | None:
        """Offset of the member of the next byte, and the place of it in there."""
        if not self.peek(1):
            return None
        position = self._total - (len(self._buffer) - self._cursor)
        while len(self._starts) > 1 and self._starts[1][0] <= position:
            self._starts.popleft()
        begin, offset = self._starts[0]
        return offset, position - begin

    def consumed(self) -> int:
        """Decompressed bytes taken so far."""
        return self._total - (len(self._buffer) - self._cursor)

    def line(self) -> bytes:
        """The next line with its end, whole."""
        parts, size = [], 0
        while self._cursor < len(self._buffer) or self._fill():
            at = self._buffer.find(b"\n", self._cursor)
            end = at + 1 or len(self._buffer)
            parts.append(self._buffer[self._cursor:end])
            size += len(parts[-1])
            self._cursor = end
            if at >= 0:
                break
            if size > MAX_LINE:
                raise ArchiveError(f"header line of more than {MAX_LINE} bytes")
        return b"".join(parts)

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes, as they are decompressed."""
        while n:
            if self._cursor == len(self._buffer) and not self._fill():
                raise ArchiveError("last record is cut off")
            piece = self._buffer[self._cursor:self._cursor + n]
            self._cursor += len(piece)
            n -= len(piece)
            yield piece

    def skip(self, n: int) -> None:
        for _ in self.pieces(n):
            pass


def read_headers(members: Members) -> dict[str, str]:
    """The header block of one record; names in lower case, LF alone will do."""
    if members.peek(len(_RECORD)) != _RECORD:
        raise ArchiveError(f"no record header: {members.peek(40)!r}")
    members.line()
    headers, last = {}, None
    while True:
        line = members.line()
        if not line:
            raise ArchiveError("record header is cut off")
        text = line.decode("utf-8", "ignore").rstrip("\r\n")
        if not text:
            return headers
        if text[0] in " \t" and last:
            headers[last] += " " + text.strip()
        elif ":" in text:
            last, value = text.split(":", 1)
            last = last.strip().lower()
            headers[last] = value.strip()


def payload_length(headers: dict[str, str]) -> int:
    try:
        length = int(headers["content-length"])
    except (KeyError, ValueError):
        length = -1
    if length < 0:
        raise ArchiveError("record without a valid content length")
    return length


def open_payload(members: Members, headers: dict[str, str], http_headers: bool = False):
    """(size, note, pieces) of the payload that comes next, without its HTTP
    header block if it begins with one.  A block without an end stays."""
    length = payload_length(headers)
    kind = headers.get("content-type", "").lower()
    if http_headers or not kind.startswith("application/http"):
        return length, None, members.pieces(length)
    head = bytearray()
    while True:
        more = min(_CHUNK if head else len(_HTTP), length - len(head))
        searched = max(len(head) - 3, 0)
        head += b"".join(members.pieces(more))
        rest = members.pieces(length - len(head))
        if not head.startswith(_HTTP):
            return length, None, chain([bytes(head)], rest)
        if end := _HTTP_END.search(head, searched):
            return length - end.end(), None, chain([bytes(head[end.end():])], rest)
        if len(head) == length:
            return length, NO_HTTP_END, chain([bytes(head)], rest)
        if len(head) >= MAX_HEAD:
            return length, LONG_HTTP.format(len(head)), chain([bytes(head)], rest)


class Payloads:
    """Payloads by the place of their records.

    Places of one gzip member that are asked for in order are reached by one
    pass over the member.
    """

    def __init__(self):
        self._archive = self._offset = self._file = self._members = None

    def open(self, archive: str, offset: int, position: int) -> tuple[int, Iterator[bytes]]:
        """Size and pieces of the payload."""
        if archive != self._archive:
            self.close()
            filesystem, inner = resolve(archive)
            self._file, self._archive = filesystem.open_input_file(inner), archive
        if offset != self._offset or self._members.consumed() > position:
            self._members, self._offset = Members(self._file, offset), offset
        self._members.skip(position - self._members.consumed())
        size, _, pieces = open_payload(self._members, read_headers(self._members))
        return size, pieces

    def close(self) -> None:
        if self._file is not None:
            self._file.close()
        self._archive = self._offset = self._file = self._members = None


def read_payload(archive: str, offset: int, position: int) -> bytes:
    """The payload, without HTTP headers, of one record of known place."""
    payloads = Payloads()
    try:
        return b"".join(payloads.open(archive, offset, position)[1])
    finally:
        payloads.close()


def read_pieces(batches) -> Iterator[pa.RecordBatch]:
    """Rows with a record's place, with ``piece`` (from 0) and ``payload`` added:
    a row per piece of the payload, one for an empty one."""
    payloads = Payloads()
    for batch in batches:
        places = (batch.column(c).to_pylist()
                  for c in ("archive", "record_offset", "record_position"))
        for i, place in enumerate(zip(*places)):
            held, number = bytearray(), 0
            for piece in chain(payloads.open(*place)[1], [None]):
                if piece is None or len(held) + len(piece) > PIECE_BYTES:
                    if held or (piece is None and not number):
                        row = batch.slice(i, 1)
                        yield pa.RecordBatch.from_arrays(
                            [*row.columns, pa.array([number], pa.int32()),
                             pa.array([bytes(held)], pa.binary())],
                            [*row.schema.names, "piece", "payload"])
                        number += 1
                    held = bytearray()
                held += piece or b""
    payloads.close()


def find_member(file, start: int, end: int) -> int | None:
    """First offset in [start, end) at which a member with a record begins."""
    position = start
    while position < end:
        file.seek(position)
        window = file.read(min(1 << 20, end - position) + len(_MAGIC) - 1)
        at = window.find(_MAGIC)
        while at >= 0:
            file.seek(position + at)
            try:
                head = zlib.decompressobj(31).decompress(file.read(_CHUNK), len(_RECORD))
            except zlib.error:
                head = b""
            if head == _RECORD:
                return position + at
            at = window.find(_MAGIC, at + 1)
        position += 1 << 20
    return None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        def flag(name: str, default: str) -> bool:
            return options.get(name, default).lower() == "true"

        self.path = options.get("path")
        self.skip = set(json.loads(options.get("skip", "[]")))
        types = options.get("record_types", "response").lower()
        self.types = None if types == "all" else set(types.split(","))
        self.split_bytes = int(options.get("split_bytes", "0"))
        self.min_split_bytes = min(self.split_bytes, MIN_SPLIT_BYTES)
        self.parallelism = max(int(options.get("parallelism", "1")), 1)
        self.payload = flag("payload", "true")
        self.max_payload = int(options.get("max_payload_bytes", MAX_PAYLOAD))
        self.http_headers = flag("http_headers", "false")
        self.trailers = flag("trailers", "false")
        self.errors = True

    def _share(self, limit: int, total: int) -> int:
        """``limit``, or less if there would be fewer partitions than cores."""
        return max(min(limit, -(-total // self.parallelism)), 1)

    def _splits(self) -> list[Split]:
        archives = [(archive, size) for archive, size in list_archives(self.path)
                    if archive.rsplit("/", 1)[-1] not in self.skip]
        total = sum(size for _, size in archives)
        splits = []
        for archive, size in archives:
            size = max(size, 1)
            step = size
            if self.split_bytes:
                step = max(self._share(self.split_bytes, total), self.min_split_bytes)
            splits += [Split(archive, start, min(start + step, size), 0 if start == 0 else None)
                       for start in range(0, size, step)]
        return splits

    def partitions(self):
        splits = self._splits()
        limit = self._share(PACK_BYTES, sum(s.end - s.start for s in splits))
        packed, filled = [], limit
        for split in splits:
            length = split.end - split.start
            if filled + length > limit:
                packed.append([])
                filled = 0
            # Plain tuples: a partition is pickled on its own, and a large scan
            # has many.
            packed[-1].append(tuple(split))
            filled += length
        return [InputPartition(group) for group in packed or [[]]]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from self.read_splits(Split(*split) for split in partition.value)

    def read_ranges(self, batches) -> Iterator[pa.RecordBatch]:
        """The same from a table (archive, split_start, split_end, first)."""
        names = ("archive", "split_start", "split_end", "first")
        yield from self.read_splits(
            Split(*row) for batch in batches
            for row in zip(*(batch.column(c).to_pylist() for c in names)))

    def read_splits(self, splits: Iterator[Split]) -> Iterator[pa.RecordBatch]:
        batch, filled = [], 0
        for split in splits:
            for row in self._read_split(split):
                batch.append(row)
                filled += len(row[5] or b"")
                if len(batch) >= BATCH_ROWS or filled >= BATCH_BYTES:
                    yield self._to_arrow(batch)
                    batch, filled = [], 0
        if batch:
            yield self._to_arrow(batch)

    def _to_arrow(self, rows: list[tuple]) -> pa.RecordBatch:
        text, number = pa.string(), pa.int64()
        fields = [("archive", text), ("record_offset", number), ("record_position", number),
                  ("warc_type", text), ("name", text), ("payload", pa.binary()),
                  ("payload_size", number), ("note", text), ("error", text)]
        if self.trailers:
            fields += [(c.split()[0], number) for c in TRAILER_SCHEMA.split(", ")]
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, (_, kind) in zip(columns, fields)],
            schema=pa.schema(fields))

    def _read_split(self, split: Split) -> Iterator[tuple]:
        state = {"first": None, "next": None, "read": 0, "stopped": 0}
        here = (split.start, split.end, None, None, None, None) if self.trailers else ()
        at = None
        try:
            for at, row in self._records(split, state):
                yield (split.archive, *at, *row, *here)
        except (ArchiveError, zlib.error, OSError, ValueError) as e:
            state.update(next=None, stopped=1)
            if self.errors:
                offset = at[0] if at else split.start
                yield (split.archive, offset, None, None, None, None, None, None,
                       f"{type(e).__name__}: {e}", *here)
        if self.trailers:
            yield (split.archive, *[None] * 8, split.start, split.end,
                   state["first"], state["next"], state["read"], state["stopped"])

    def _records(self, split: Split, state: dict) -> Iterator[tuple]:
        filesystem, inner = resolve(split.archive)
        with filesystem.open_input_file(inner) as file:
            size = file.size()
            first = split.first
            if first is None:
                first = find_member(file, split.start, split.end)
            if first is None or first >= split.end or not size:
                return
            state["first"] = first
            members = Members(file, first)
            while True:
                place = members.locate()
                if place is None:
                    state["next"] = size
                    return
                offset, position = place
                head = members.peek(len(_RECORD))
                if position == 0 and offset >= split.end and head == _RECORD:
                    state["next"] = offset
                    return
                if head[:1] in b"\r\n":
                    members.line()
                    continue
                row = self._record(members)
                if row is not None:
                    state["read"] += 1
                    yield place, row

    def _record(self, members: Members) -> tuple | None:
        """(warc_type, name, payload, size, note, error) of the next record, if
        wanted."""
        headers = read_headers(members)
        kind = headers.get("warc-type", "").lower()
        name = headers.get("warc-target-uri")
        if self.types is not None and kind not in self.types or not self.payload:
            members.skip(payload_length(headers))
            wanted = self.types is None or kind in self.types
            return (kind, name, None, None, None, None) if wanted else None
        size, note, pieces = open_payload(members, headers, self.http_headers)
        if size > self.max_payload:
            for _ in pieces:
                pass
            return kind, name, None, size, note, None
        return kind, name, b"".join(pieces), size, note, None


class PushdownWarcReader(WarcReader):
    """Takes an equality on ``warc_type``, which error rows never satisfy."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("warc_type",):
                wanted = {f.value}
                self.types = wanted if self.types is None else self.types & wanted
                self.errors = False
            else:
                yield f


class WarcDataSource(DataSource):
    """Options, with their defaults:

    ``record_types`` (response): comma-separated types to keep, or ``all``;
    bodies of other records are skipped, not read.
    ``skip`` ([]): JSON list of the names of archives to pass over.
    ``split_bytes`` (0): cut archives into ranges of this size; 0 keeps each
    archive whole.  A range begins at the first member found in it, which is
    wrong only if an archive stores another one uncompressed; ``trailers``
    gives what is needed to notice, and ``read_records`` does.
    ``parallelism`` (1): the number of partitions to aim for if the archives
    are small.
    ``payload`` (true): false leaves the payload out if only names matter.
    ``max_payload_bytes`` (512 MiB): a larger payload is NULL in the row of its
    record, to be read by its place (``read_pieces``).
    ``http_headers`` (false): true keeps the HTTP header block in the payload.
    ``trailers`` (false): adds one row per range with the number of records
    read, the member offsets it began and ended at, and whether it broke off.
    ``filter_pushdown`` (false): true makes the reader apply filters on
    ``warc_type``; needs ``spark.sql.python.filterPushdown.enabled``.
    """

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        if self.options.get("trailers", "false").lower() == "true":
            return f"{RECORD_SCHEMA}, {TRAILER_SCHEMA}"
        return RECORD_SCHEMA

    def reader(self, schema):
        options = dict(self.options)
        pushdown = options.get("filter_pushdown", "false").lower() == "true"
        return (PushdownWarcReader if pushdown else WarcReader)(options)
