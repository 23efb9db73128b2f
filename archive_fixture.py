"""Writes a table of pages as gzip web archives, as input for tests and bench."""

from __future__ import annotations

import gzip
import sys
import tempfile
import uuid
import zipfile
from io import BytesIO

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession

from gleanery.sources.files import resolve, spark_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"


# An Arrow batch of entries is handed to Spark at this many of them or payload bytes.
UNZIP_ROWS, UNZIP_BYTES = 1000, 8 << 20


def make_dir(path: str) -> str:
    filesystem, inner = resolve(path)
    filesystem.create_dir(inner, recursive=True)
    return path


def work_dir(spark: SparkSession) -> str:
    """A new directory that all executors see, gone when the session ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors see")
        shared = tempfile.gettempdir()
    made = make_dir(f"{shared.rstrip('/')}/gleanery-{uuid.uuid4().hex}")
    path = spark._jvm.org.apache.hadoop.fs.Path(spark_path(made))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return made


def write_definitions(definitions: dict[str, str], directory: str) -> None:
    filesystem, inner = resolve(make_dir(directory))
    for name, pattern in definitions.items():
        with filesystem.open_output_stream(f"{inner}/{name}.txt") as out:
            out.write(pattern.encode())


def write_archives(pages: DataFrame, directory: str, cut: int | None = None,
                   prefix: str = "part") -> int:
    """One archive per partition of (name string, payload binary); returns the
    number of records written.

    A column ``kind`` gives the record type (response), a false one ``http``
    leaves the HTTP header block out.  With ``cut``, archives whose number leaves
    1 when divided by 3 break off within the last ``cut`` bytes.  Names of archives
    begin with ``prefix``.
    """
    make_dir(directory)
    names = pages.columns

    def member(row):
        block = (HTTP if row.get("http", True) else b"") + row["payload"]
        return gzip.compress((
            f"WARC/1.0\r\nWARC-Type: {row.get('kind', 'response')}\r\n"
            f"WARC-Target-URI: {row['name']}\r\n"
            "Content-Type: application/http; msgtype=response\r\n"
            f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n")

    def write(batches):
        filesystem, inner = resolve(directory)
        number = TaskContext.get().partitionId()
        path = f"{inner}/{prefix}-{number:05d}.warc.gz"
        attempt, count, held = f"{path}.{uuid.uuid4().hex}", 0, b""
        with filesystem.open_output_stream(attempt) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    out.write(held)
                    held = member(row)
                    count += 1
            out.write(held[:-cut] if cut and number % 3 == 1 else held)
        filesystem.move(attempt, path)
        yield pa.RecordBatch.from_pydict({"records": pa.array([count], pa.int64())})

    assert names[:2] == ["name", "payload"], names
    written = pages.mapInArrow(write, "records bigint")
    return written.agg({"records": "sum"}).first()[0]


def unzip(batches):
    """``path`` of zip exports to (definition, entry_name, payload).  A zip is read where
    it lies, entry by entry, and is never held whole."""
    def handed(definition, names, payloads):
        return pa.RecordBatch.from_arrays(
            [pa.array([definition] * len(names), pa.string()), pa.array(names, pa.string()),
             pa.array(payloads, pa.binary())], ["definition", "entry_name", "payload"])

    for batch in batches:
        for path in batch.column("path").to_pylist():
            definition = path.rsplit("/", 2)[1][len("export="):].split("_results")[0]
            filesystem, inner = resolve(path)
            # In a zip without entries zipfile looks in front of the file, where Arrow's
            # files raise another error than it expects.
            with filesystem.open_input_file(inner) as file, zipfile.ZipFile(
                    BytesIO(file.read()) if file.size() < 100 else file) as z:
                names, payloads, size = [], [], 0
                for name in z.namelist():
                    names.append(name)
                    payloads.append(z.read(name))
                    size += len(payloads[-1])
                    if len(names) >= UNZIP_ROWS or size >= UNZIP_BYTES:
                        yield handed(definition, names, payloads)
                        names, payloads, size = [], [], 0
                yield handed(definition, names, payloads)
