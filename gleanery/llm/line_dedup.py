"""Lines that many documents share, found by levelled sorted runs of line hashes.

The documents come in batches.  A run is a table of line hashes with the number
of documents that have the line, bucketed and sorted by hash.  A batch is counted,
merge-anti-joined with the runs, which know some lines for common already, and
what remains is its own run of the lowest level.  Two runs of a level are compacted
to one of the next.  Runs have the same buckets, so neither these joins nor
compaction shuffle or sort; only the batch itself is shuffled once.

When all batches are in, the runs are merged and every document is rewritten
without the common lines.  Lines meet their common ones by hash; the few that
make up a large part of all lines are broadcast, so no line is one large group.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import Scratch
from gleanery.llm.spread import join_by_weight

BATCHES = 8
# Lets a scan of one file a bucket tell that it is sorted.
SORTED_SCAN = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: bytes) -> bytes:
    """A line without white space at its ends, A-Z lower-cased."""
    return line.strip().lower()


def line_hash(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _texts(column: pa.Array) -> list[bytes]:
    return [text or b"" for text in column.cast(pa.large_binary()).to_pylist()]


def _hashes(least_chars: int):
    """A row per document and different line."""
    def long_enough(key: bytes) -> bool:
        return len(key) >= least_chars and (least_chars <= 1 or len(key.decode()) >= least_chars)

    def run(batches):
        for batch in batches:
            owner, found = [], []
            for at, text in enumerate(_texts(batch.column("text"))):
                keys = {key for key in set(map(line_key, text.split(b"\n")))
                        if key and long_enough(key)}
                owner += [at] * len(keys)
                found += map(line_hash, keys)
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("mark").take(at),
                 pa.array(found, pa.binary())], ["doc_id", "mark", "line"])

    return run


def _rewrite(batches):
    """Texts without the lines of their list ``gone``."""
    for batch in batches:
        kept, lines, dropped = [], [], []
        for text, gone in zip(_texts(batch.column("text")), batch.column("gone").to_pylist()):
            if not gone:
                lines.append(text.count(b"\n") + 1)
                dropped.append(0)
                kept.append(text)
                continue
            gone, all_lines = set(gone), text.split(b"\n")
            stay = [line for line in all_lines if line_hash(line_key(line)) not in gone]
            lines.append(len(all_lines))
            dropped.append(len(all_lines) - len(stay))
            kept.append(b"\n".join(stay))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()),
             pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
            ["doc_id", "text", "n_lines", "n_dropped"])


class LineRuns:
    """Counts of documents by line hash, in levelled sorted runs.

    A hash that a run has with ``least`` documents or more is common; the batches
    after it no longer store it.
    """

    def __init__(self, scratch: Scratch, least: int):
        self.scratch, self.least = scratch, least
        self.buckets = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
        # The run of each level, if it has one now.
        self.levels: list[str | None] = []
        self.written = 0

    @contextmanager
    def _sorted_scans(self):
        conf, before = self.scratch.spark.conf, self.scratch.spark.conf.get(SORTED_SCAN, None)
        conf.set(SORTED_SCAN, "true")
        try:
            yield
        finally:
            conf.unset(SORTED_SCAN) if before is None else conf.set(SORTED_SCAN, before)

    def _write(self, counts: DataFrame) -> str:
        name = f"run{self.written}"
        self.written += 1
        with self._sorted_scans():
            self.scratch.save_sorted(counts.select("line", "n"), name, ["line"], self.buckets)
        return name

    def _runs(self) -> list[str]:
        return [name for name in self.levels if name]

    def merged(self, one: str, other: str) -> DataFrame:
        """Two runs as one.  (A union with a sum would do in principle; but Spark 4.1
        may plan it without a shuffle and then read its scans without their buckets.)"""
        first = self.scratch.sorted_table(one)
        second = self.scratch.sorted_table(other).select("line", F.col("n").alias("m"))
        return first.join(second.hint("merge"), "line", "full_outer").select(
            "line", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

    def uncommon(self, counts: DataFrame) -> DataFrame:
        """``counts`` (line, n) without what some run has as common."""
        for name in self._runs():
            run = self.scratch.sorted_table(name).where(F.col("n") >= self.least)
            counts = counts.join(run.select("line").hint("merge"), "line", "left_anti")
        return counts

    def add(self, lines: DataFrame) -> None:
        """A batch: a row per document and different line."""
        run = self._write(self.uncommon(lines.groupBy("line").agg(
            F.count(F.lit(1)).alias("n"))))
        for level, other in enumerate(self.levels):
            if other is None:
                self.levels[level] = run
                return
            run = self._compacted(run, other)
            self.levels[level] = None
        self.levels.append(run)

    def _compacted(self, one: str, other: str) -> str:
        run = self._write(self.merged(one, other))
        self.scratch.drop(one, other)
        return run

    def common(self) -> DataFrame:
        """Rows (line, n) of all common lines; n counts the documents that were
        added until the line was known for common.  Leaves one run."""
        run, *others = self._runs()
        for other in others:
            run = self._compacted(run, other)
        self.levels = [run]
        return self.scratch.save(
            self.scratch.sorted_table(run).where(F.col("n") >= self.least), "common")

    def close(self) -> None:
        self.scratch.drop(*self._runs())
        self.levels = []


def without_common_lines(documents: DataFrame, least_documents: int = 10,
                         least_chars: int = 1, batches: int = BATCHES) -> DataFrame:
    """A row per row of ``documents``: doc_id, the text without common lines,
    n_lines (before), n_dropped.

    Texts are split at newlines, and a line is known by its key: without white space
    at both ends, A-Z lower-cased.  Lines whose key has ``least_chars`` code points
    (one at least) and is in ``least_documents`` rows go, wherever they are; the
    others stay as they were.  A row counts once for a line, however often it has it,
    and a repeated row counts anew.  A null or empty text has one empty line, which
    stays.  A batch is what some of the input's partitions hold.  Other columns are
    not read.
    """
    scratch = Scratch(documents.sparkSession, "lines")
    kind = documents.schema["doc_id"].dataType.simpleString()
    marked = documents.select(
        "doc_id", "text", F.unhex(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
        .alias("mark"))
    hashed = marked.mapInArrow(_hashes(least_chars), f"doc_id {kind}, mark binary, line binary")
    lines = scratch.save(hashed.withColumn("batch", F.spark_partition_id() % batches), "lines",
                         partition="batch")
    runs = LineRuns(scratch, least_documents)
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch))
    common = runs.common()
    runs.close()
    known = join_by_weight(lines.select("doc_id", "mark", "line"), common, ["line"], "n",
                           lines.count())
    gone = scratch.save(
        known.groupBy("doc_id", "mark").agg(F.collect_set("line").alias("gone")), "gone")
    scratch.drop("lines", "common")
    same = marked["doc_id"].eqNullSafe(gone["doc_id"]) & (marked["mark"] == gone["mark"])
    return marked.join(gone, same, "left").select(marked["doc_id"], "text", "gone").mapInArrow(
        _rewrite, f"doc_id {kind}, text string, n_lines bigint, n_dropped bigint")


def line_digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the lines that stay."""
    return without_common_lines(documents).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256)
        .alias("kept_sha256"))
