"""Spark data sink ``zip``: matched records as deflated zip files.

Takes rows (``file``, ``entry_name``, ``archive``, ``record_offset``,
``record_position``) in which the rows of a file are consecutive and its places
in order, as ``sortWithinPartitions`` leaves them.  Payloads are read from the
archives, by place and in pieces, and never become rows.
"""

from __future__ import annotations

import json
import uuid
import zipfile
from dataclasses import dataclass, field
from itertools import groupby

from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from gleanery.sources.files import resolve
from gleanery.sources.warc import Payloads

FAILURES = "_failures"
FAILURE_SCHEMA = "file string, entry_name string, error string"
COLUMNS = ("file", "entry_name", "archive", "record_offset", "record_position")


@dataclass
class ZipsWritten(WriterCommitMessage):
    """Files a task has written; ``failures`` names the list of entries that
    could not be, if there are any."""

    files: list[str] = field(default_factory=list)
    failures: str | None = None


class ZipWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> ZipsWritten:
        filesystem, root = resolve(self.path)
        rows = (row for batch in iterator
                for row in zip(*(batch.column(c).to_pylist() for c in COLUMNS)))
        written, failures, payloads = ZipsWritten(), [], Payloads()
        for file, entries in groupby(rows, key=lambda row: row[0]):
            path = f"{root}/{file}"
            filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
            self._write_zip(filesystem, path, entries, payloads, failures)
            written.files.append(file)
        payloads.close()
        if failures:
            filesystem.create_dir(f"{root}/{FAILURES}", recursive=True)
            written.failures = f"{FAILURES}/{uuid.uuid4().hex}.json"
            with filesystem.open_output_stream(f"{root}/{written.failures}") as stream:
                stream.write("".join(json.dumps(f) + "\n" for f in failures).encode())
        return written

    def _write_zip(self, filesystem, path: str, entries, payloads, failures: list) -> None:
        """Write under a name of this attempt, then move into place: content
        and final name are the same for every attempt of a task."""
        attempt = f"{path}.{uuid.uuid4().hex}"
        try:
            with filesystem.open_output_stream(attempt) as stream:
                with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as archive:
                    for file, name, *place in entries:
                        size, pieces = payloads.open(*place)
                        try:
                            entry = zipfile.ZipInfo(name)
                            entry.compress_type = zipfile.ZIP_DEFLATED
                            out = archive.open(entry, "w", force_zip64=size > 1 << 30)
                        except Exception as e:  # one bad name must not lose the others
                            failures.append({"file": file, "entry_name": name, "error": str(e)})
                            continue
                        with out:
                            for piece in pieces:
                                out.write(piece)
            filesystem.move(attempt, path)
        except BaseException:
            self._remove(filesystem, attempt)
            raise

    @staticmethod
    def _remove(filesystem, path: str) -> None:
        try:
            filesystem.delete_file(path)
        except OSError:
            pass

    def commit(self, messages) -> None:
        """Lists of failed attempts of tasks do not count."""
        filesystem, root = resolve(self.path)
        filesystem.create_dir(f"{root}/{FAILURES}", recursive=True)
        kept = {m.failures for m in messages if m}
        self._sweep(filesystem, root, lambda name: f"{FAILURES}/{name}" not in kept)

    def abort(self, messages) -> None:
        """Take back what the tasks that did end have written."""
        filesystem, root = resolve(self.path)
        for message in messages:
            for file in message.files if message else ():
                self._remove(filesystem, f"{root}/{file}")
        self._sweep(filesystem, root, lambda name: True)

    def _sweep(self, filesystem, root: str, unwanted) -> None:
        for info in filesystem.get_file_info(
                FileSelector(f"{root}/{FAILURES}", allow_not_found=True)):
            if unwanted(info.base_name):
                self._remove(filesystem, info.path)


class ZipDataSource(DataSource):
    @classmethod
    def name(cls):
        return "zip"

    def writer(self, schema, overwrite):
        return ZipWriter(self.options["path"])


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an export that could not be written: file, entry_name, error."""
    # The name begins with "_", which Spark's own sources pass over.
    filesystem, root = resolve(path)
    files = [f"{path}/{FAILURES}/{info.base_name}" for info in filesystem.get_file_info(
        FileSelector(f"{root}/{FAILURES}", allow_not_found=True))]
    if not files:
        return spark.createDataFrame([], FAILURE_SCHEMA)
    return spark.read.schema(FAILURE_SCHEMA).json(files)
