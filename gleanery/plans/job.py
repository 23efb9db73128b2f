"""The whole search over directories, as one call."""

from __future__ import annotations

import codecs
import json
import re
import time
import uuid
from datetime import datetime
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import regex, text
from gleanery.functions.chunks import CHUNK_MATCHES, CHUNK_SCHEMA, ChunkSearch
from gleanery.functions.windows import WINDOW
from gleanery.operators import export, search, summary
from gleanery.sinks import report, zip_export
from gleanery.sources.definitions import load_definitions, require_valid
from gleanery.sources.files import list_archives, read_lines, resolve, spark_path, states
from gleanery.sources.warc import (
    MAX_PAYLOAD, RECORD_SCHEMA, TRAILER_SCHEMA, Payloads, WarcDataSource, WarcReader, read_pieces)

RECORD_KEY = ["archive", "record_offset", "record_position"]
SPLIT = ["archive", "split_start"]
SPLIT_BYTES = 256 << 20
ZIP_BYTES = 256 << 20
PARTITION_BYTES = 128 << 20
# A row that names a split is about 100 bytes.
MAX_BROADCAST_SPLITS = 100_000
# Splits that one task reads again.
SPLITS_PER_TASK = 4

MATCH_SCHEMA = ("archive string, record_offset bigint, record_position bigint, name string,"
                f" payload_size bigint, {CHUNK_SCHEMA}, exportable boolean")
SUMMARY_SCHEMA = ("archives bigint, records_read bigint, errors bigint, warnings bigint,"
                  " elapsed_seconds double, elapsed string")

# Fixed value: the time stamp in the name of a run directory.
RUN_FORMAT = "%m-%d-%y_%H_%M_%S"


class SearchResult(NamedTuple):
    """``matches`` reads the table of matches in ``run_dir``."""

    run_dir: str
    matches: DataFrame
    summary: DataFrame


def register(spark: SparkSession) -> None:
    """Make the formats ``warc`` and ``zip`` known to the session."""
    spark.dataSource.register(WarcDataSource)
    spark.dataSource.register(zip_export.ZipDataSource)


def _scan(spark: SparkSession, archives: str, **options) -> DataFrame:
    register(spark)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("warc").option("filter_pushdown", pushdown) \
        .option("parallelism", spark.sparkContext.defaultParallelism) \
        .options(**options).load(archives)


def _reread(spark: SparkSession, splits: DataFrame, archives: str, **options) -> DataFrame:
    """The ranges of ``splits`` (archive, split_start, split_end, first), read
    where the rows are: their number is not the driver's business."""
    reader = WarcReader({"path": archives, **{k: str(v) for k, v in options.items()}})
    trailers = f", {TRAILER_SCHEMA}" if reader.trailers else ""
    n = max(spark.sparkContext.defaultParallelism, -(-splits.count() // SPLITS_PER_TASK))
    return splits.select("archive", "split_start", "split_end", "first").repartition(n) \
        .mapInArrow(reader.read_ranges, RECORD_SCHEMA + trailers)


def read_records(spark: SparkSession, archives: str, **options) -> DataFrame:
    """The response records of a directory of archives.  ``error`` is set on
    the rows that report an archive that could not be read further.

    With ``split_bytes``, ranges are first gone through without payloads, to
    find where each really begins, and then read; so the rows are those of
    whole archives.  Needs ``spark.checkpoint.dir`` for the table of ranges.
    """
    split_bytes = int(options.pop("split_bytes", 0))
    if not split_bytes:
        return _scan(spark, archives, **options)
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("split_bytes needs spark.checkpoint.dir, a folder all executors see")
    root = f"{shared.rstrip('/')}/_ranges_{uuid.uuid4().hex}"
    _delete_on_exit(spark, root)
    look = {"trailers": "true", "payload": "false"}

    def stage(rows, number):
        rows.where("records_read is not null").write.parquet(f"{root}/rows/pass={number}")
        return spark.read.parquet(f"{root}/rows")

    splits = _settle(spark, archives, root, stage, look,
                     _scan(spark, archives, split_bytes=split_bytes, **look))
    places = splits.where("after_stop = 0").withColumn(
        "first", F.coalesce("first_start", "split_end"))
    return _reread(spark, places, archives, **options)


def new_run_dir(out: str, now: datetime) -> str:
    """A fresh directory below ``out``, which must exist."""
    filesystem, inner = resolve(out)
    if filesystem.get_file_info(inner).type != fs.FileType.Directory:
        raise FileNotFoundError(f"output directory does not exist: {out}")
    name = f"results_{now.strftime(RUN_FORMAT)}"
    if filesystem.get_file_info(f"{inner}/{name}").type != fs.FileType.NotFound:
        raise FileExistsError(f"{out.rstrip('/')}/{name}")
    filesystem.create_dir(f"{inner}/{name}")
    return f"{out.rstrip('/')}/{name}"


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)


def require_shared(spark: SparkSession, path: str) -> None:
    """Refuse a folder that every executor would have for itself."""
    local = spark.sparkContext.master.split("[")[0] == "local"
    if not local and spark_path(path).startswith("file:"):
        raise ValueError(f"executors do not share the local folder {path}; if it is mounted on"
                         " all of them, say so by shared_files=True")


def _staging_dir(spark: SparkSession, run_dir: str) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{(shared or spark_path(run_dir)).rstrip('/')}/_staging_{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def _stage(records, definitions, path, *, dialect, search_binary, redistribute,
           max_payload_bytes, chunk_matches):
    """Decode and search records once; keep what later steps need.

    One row per matched record, definition and chunk, plus, without a definition, the
    error and trailer rows of the source, records with a note, and those whose payload
    is too large for a row.  Payloads are not kept.
    """
    trailer = [c.split()[0] for c in TRAILER_SCHEMA.split(", ")]
    if redistribute:
        records = records.repartition(redistribute)
    large = F.coalesce(F.col("payload").isNull() & (F.col("payload_size") > max_payload_bytes),
                       F.lit(False))
    records = records.withColumn("large", large)
    prepared = search.prepare(
        records, RECORD_KEY, F.when(~F.col("large"), F.col("name")), F.col("payload"),
        search_binary=search_binary,
        carry=["error", "note", *trailer, "payload_size", "large",
               F.col("name").alias("record_name")])
    keep = F.coalesce("error", "note").isNotNull() | F.col("records_read").isNotNull() \
        | F.col("large")
    if dialect == "native":
        found = search.as_chunks(search.search_records(prepared, definitions, dialect, keep), keep)
    else:
        found = search.search_chunks(prepared, definitions, chunk_matches=chunk_matches, keep=keep)
    found.write.parquet(path)


def _large_records(spark, staged, definitions, search_binary, chunk_matches, window) -> DataFrame:
    """Matches of the records whose payload is too large for a row.

    Each is read and searched where it lies, by its place in the archive, those
    of one gzip member in one pass; only chunks of matches become rows.  A text is
    held in windows, whole only for definitions that may look any far.
    """
    searcher = ChunkSearch(definitions, chunk_matches, window)
    binary = re.compile(text.BINARY_BYTES.encode("latin-1"))
    fields = [("archive", pa.string()), ("record_offset", pa.int64()),
              ("record_position", pa.int64()), ("name", pa.string()), ("payload_size", pa.int64())]

    def content(pieces):
        """The text, decoded as it is read; nothing if it is binary."""
        head, waiting = b"", []
        decoder = codecs.getincrementaldecoder("utf-8")("ignore")
        for piece in pieces:
            if len(head) < text.SNIFF_BYTES:
                head += piece[:text.SNIFF_BYTES - len(head)]
                if not search_binary and binary.search(head):
                    return
                waiting.append(piece)
                if len(head) < text.SNIFF_BYTES:
                    continue
                piece = b"".join(waiting)
                waiting.clear()
            yield decoder.decode(piece)
        yield decoder.decode(b"".join(waiting), final=True)

    def search_in_place(batches):
        payloads = Payloads()
        for batch in batches:
            for archive, offset, position, name in zip(*(c.to_pylist() for c in batch.columns)):
                size, pieces = payloads.open(archive, offset, position)
                record = (archive, offset, position, name, size)
                for chunk in searcher.pieces(name, content(pieces)):
                    columns = [pa.array([value], kind) for value, (_, kind) in zip(record, fields)]
                    yield pa.RecordBatch.from_arrays(
                        columns + search.chunk_batch([chunk]),
                        [*(field for field, _ in fields),
                         *(field.split()[0] for field in CHUNK_SCHEMA.split(", "))])
        payloads.close()

    member = ["archive", "record_offset"]
    places = staged.where("large and definition is null") \
        .select(*RECORD_KEY, F.col("record_name").alias("name")) \
        .repartition(spark.sparkContext.defaultParallelism, *member) \
        .sortWithinPartitions(*RECORD_KEY)
    return places.mapInArrow(search_in_place, (
        "archive string, record_offset bigint, record_position bigint, name string,"
        f" payload_size bigint, {CHUNK_SCHEMA}"))


def _splits(staged: DataFrame) -> DataFrame:
    """The latest reading of every split, with the place where it had to begin.

    A split of an archive is right if it began where those before it left off,
    which is the furthest place any of them read up to: a record that covers
    several splits leaves all of them empty.  By induction from the first
    split, which begins at byte 0, all are.
    The windows hold one short row per split of one archive: some 4,000 for an
    archive of 1 TB.
    """
    latest = Window.partitionBy(*SPLIT).orderBy(F.desc("pass"))
    before = Window.partitionBy("archive").orderBy("split_start") \
        .rowsBetween(Window.unboundedPreceding, -1)
    trailers = staged.where("records_read is not null").select(
        *SPLIT, "split_end", "first_start", "next_start", "stopped", "records_read", "pass")
    current = trailers.withColumn("newest", F.row_number().over(latest)).where("newest = 1")
    placed = current.select(
        *SPLIT, "split_end", "first_start", "records_read", "pass", "stopped",
        F.coalesce(F.max("next_start").over(before), F.lit(0)).alias("expected"))
    begins = F.when(F.col("expected") < F.col("split_end"), F.col("expected"))
    # A reading from a wrong place may well break off; the archive does not.
    judged = placed.withColumn("misled", (F.col("split_start") > 0)
                               & ~F.col("first_start").eqNullSafe(begins))
    stop = F.when(~F.col("misled"), F.col("stopped"))
    return judged.withColumn("after_stop", F.coalesce(F.max(stop).over(before), F.lit(0))) \
        .withColumn("wrong", F.col("misled") & (F.col("after_stop") == 0))


def _valid(staged: DataFrame, splits: DataFrame, repaired: bool) -> DataFrame:
    """The staged rows that count: latest reading, none after a break-off."""
    bad = splits.where("after_stop > 0").select(*SPLIT, "pass")
    if repaired:
        newest = splits.select(*SPLIT, "pass")
        readings = staged.where("records_read is not null").select(*SPLIT, "pass")
        bad = bad.unionByName(readings.join(newest, [*SPLIT, "pass"], "left_anti"))
    count = bad.count()
    if not count:
        return staged
    if count <= MAX_BROADCAST_SPLITS:
        bad = F.broadcast(bad)
    return staged.join(bad, [*SPLIT, "pass"], "left_anti")


def _settle(spark, archives, root, stage, options, records) -> DataFrame:
    """Stage ``records``, then again those splits that began in a wrong place
    (inside an archive stored within an archive) until none is left; the splits
    as they are then.  ``stage`` writes a pass and gives all rows so far."""
    passes = 0
    while True:
        staged = stage(records, passes)
        passes += 1
        # A small table, read several times below; the rows are many files.
        _splits(staged).write.parquet(f"{root}/splits{passes}")
        splits = spark.read.parquet(f"{root}/splits{passes}")
        wrong = splits.where("wrong").select(
            *SPLIT, "split_end", F.col("expected").alias("first"))
        if wrong.isEmpty():
            return splits.withColumn("passes", F.lit(passes))
        records = _reread(spark, wrong, archives, **options)


def _partitions(spark: SparkSession, size: int) -> int:
    """Partitions for ``size`` bytes, and no fewer than there are cores."""
    return max(-(-size // PARTITION_BYTES), spark.sparkContext.defaultParallelism)


def _text_bytes():
    """Bytes of the report blocks of matches, about, as an aggregate."""
    def length(column):
        return F.aggregate(column, F.lit(0).cast("bigint"), lambda a, m: a + F.octet_length(m) + 40)

    size = length("name_matches") + length("content_matches") + 200
    return F.coalesce(F.sum(size), F.lit(0))


def _place(sizes: list[tuple[str, int]], shard_bytes: int, cores: int):
    """``{definition: (shards, first partition)}`` and the number of partitions.

    Every shard of a large definition has a partition of its own; small
    definitions share partitions, but leave no core idle.
    """
    share = min(shard_bytes, -(-sum(size for _, size in sizes) // cores))
    places, n, room = {}, 0, 0
    for definition, size in sizes:
        shards = max(-(-size // shard_bytes), 1)
        if shards == 1 and size <= room:
            places[definition] = (1, n - 1)
            room -= size
        else:
            places[definition] = (shards, n)
            n += shards
            room = share - size if shards == 1 else 0
    return places, n


def _winners(spark, matches, path, shard_bytes, earlier=None) -> tuple[DataFrame, int]:
    """The records to export, and the number of partitions to write them from.

    One row per definition and entry name, with its ``shard`` out of ``shards``,
    as many per definition as its size calls for, and its ``partition``.  Keys
    and sizes only: a payload is read by its place where it is written.  The
    records of one gzip member are in one shard, so it is gone through once.
    Entries of the matches of ``earlier`` runs are exported already.
    """
    named = export.entries(matches.select(*RECORD_KEY, "name", "definition", "payload_size"))
    if earlier is not None:
        there = export.entries(earlier.select("name", "definition")).select(*export.ENTRY_KEY)
        named = named.join(there.distinct(), list(export.ENTRY_KEY), "left_anti")
    export.first_per_entry(named, [*RECORD_KEY, "payload_size"]).write.parquet(path)
    winners = spark.read.parquet(path)
    # One row per definition, as many as the plan has literals.
    sizes = winners.groupBy("definition").agg(F.sum("payload_size")).orderBy("definition")
    places, n = _place([tuple(row) for row in sizes.collect()], shard_bytes,
                       spark.sparkContext.defaultParallelism)
    if not places:
        places = {"": (1, 0)}
    place = F.create_map(*[c for d, (shards, first) in places.items() for c in (
        F.lit(d), F.struct(F.lit(shards).alias("shards"), F.lit(first).alias("first")))])
    placed = winners.withColumn("place", place[F.col("definition")])
    shard = F.pmod(F.xxhash64("archive", "record_offset"), F.col("place.shards")).cast("int")
    return placed.select(*winners.columns, shard.alias("shard"),
                         (F.col("place.first") + shard).alias("partition")), max(n, 1)


def _dealt(winners: DataFrame, n: int, *first: str) -> DataFrame:
    return winners.repartitionById(n, F.col("partition")).sortWithinPartitions(*first, *RECORD_KEY)


def _export_zip(spark, winners, n, path, run) -> None:
    """Write the zips of each definition into a directory of its own."""
    part = "part-%05d.zip" if run is None else f"run-{run}-part-%05d.zip"
    file = F.format_string(f"export=%s/{part}", text.export_name(F.col("definition")), "shard")
    _dealt(winners.withColumn("file", file), n, "file") \
        .select("file", "entry_name", *RECORD_KEY) \
        .write.format("zip").mode("append").save(path)


def _export_table(winners, n, path) -> None:
    """Write the exported records as a table partitioned by definition, a row
    for each piece of a payload."""
    rows = _dealt(winners, n).select("definition", "entry_name", *RECORD_KEY, "payload_size")
    rows.mapInArrow(read_pieces, (
        "definition string, entry_name string, archive string, record_offset bigint,"
        " record_position bigint, payload_size bigint, piece int, payload binary")) \
        .write.mode("append").partitionBy("definition").parquet(path)


class Earlier(NamedTuple):
    """What the runs before this one have in a run directory."""

    run_dir: str
    runs: int
    #: Size and time of change of each archive they have searched.
    archives: dict[str, tuple[int, int]]
    definitions: list


def _earlier(run_dir: str) -> Earlier:
    """The committed runs of a directory.  A run is committed by its part of the
    manifest, which is written last."""
    rows = [json.loads(line) for line in read_lines(f"{run_dir}/manifest")]
    if not rows:
        raise ValueError(f"no finished run in {run_dir}")
    return Earlier(
        run_dir.rstrip("/"), max(r["run"] for r in rows),
        {r["archive"]: (r["size"], r["modified"]) for r in rows if "archive" in r},
        next(r["definitions"] for r in rows if "definitions" in r))


def _sweep(spark, target: str, run: str) -> None:
    """Take away what an unfinished run of this number has left."""
    for found in (f"{target}/matches/run={run}", f"{target}/problems/run={run}",
                  f"{target}/summary/run={run}", f"{target}/reports/*/run={run}",
                  f"{target}/exports/*/run-{run}-*", f"{target}/exports/*/*/run={run}"):
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in files.globStatus(path) or ():
            files.delete(status.getPath(), True)


def _problems(spark, staged, matches, counts, loaded, extract, failures, refused,
              changed) -> DataFrame:
    """``refused`` says that records whose payload is no row were not searched;
    ``changed`` are archives that are not what an earlier run has searched."""
    other = spark.createDataFrame([(path,) for path in changed], "archive string")
    rows = staged.where("definition is null")
    errors = rows.where("error is not null").select("archive", "error")
    notes = rows.where("note is not null").select("archive", F.concat_ws(
        " ", "note", F.lit("at"), "record_offset").alias("message"))
    unsearched = rows.where("large" if refused else "false").select("archive", F.concat_ws(
        " ", F.lit("payload too large for a row, which the native dialect searches only: at"),
        "record_offset").alias("message"))
    seen = counts.where("records_read > 0").select("archive") \
        .unionByName(errors.select("archive"))
    unexported = matches.where("not exportable and chunk = 0" if extract else "false").select(
        "definition", F.concat_ws(" ", F.lit("no name to export under: archive"), "archive",
                                  F.lit("at"), "record_offset").alias("message"))
    return summary.problems(
        ("error", errors, "archive", "error"),
        ("error", unsearched, "archive", "message"),
        ("error", other, "archive", "'changed since it was searched'"),
        ("error", loaded.rejected_table(spark), "definition", "reason"),
        ("error", unexported, "definition", "message"),
        ("error", failures, "file", "concat_ws(': ', error, entry_name)"),
        ("warning", notes, "archive", "message"),
        ("warning", summary.archives_without_records(counts.select("archive"), seen),
         "archive", "'no records found'"))


def search_archives(spark: SparkSession, archives: str, definitions: str, out: str, *,
                    extract: bool = False, extract_format: str = "zip",
                    search_binary: bool = False, dialect: str = "auto",
                    split_bytes: int = SPLIT_BYTES, zip_bytes: int = ZIP_BYTES,
                    redistribute: int = 0, max_payload_bytes: int = MAX_PAYLOAD,
                    chunk_matches: int = CHUNK_MATCHES, window: int = WINDOW,
                    append_to: str | None = None, shared_files: bool = False) -> SearchResult:
    """Search all archives of a directory with all definitions of another.

    Writes below a fresh directory in ``out``: ``matches`` (table), ``reports``
    (text), ``exports`` (with ``extract``), ``problems`` and ``summary``.
    The archives are read once, and the records to export once more by their
    places.

    An archive that is one single gzip member can only be decompressed by one
    task; ``redistribute`` then spreads the search over that many tasks, at
    the price of a shuffle of the payloads.  Payloads above
    ``max_payload_bytes`` do not become rows: they are searched and exported
    where they lie, in windows of ``window`` characters, with the same result.

    ``matches`` has a row per record and definition; one with more than
    ``chunk_matches`` matches has several, numbered by ``chunk``, and ``whole`` is
    false in them.  ``dialect`` is ``python`` (``auto`` is the same here), or
    ``native`` for Java's regular expressions, which search rows only: records
    above ``max_payload_bytes`` are errors then.

    ``append_to`` names the run directory of an earlier search with the same
    definitions, for a directory of archives that has grown: archives that it has
    searched are passed over, and the others' matches, report blocks, exports, problems
    and totals are added to what is there (``out`` is not used).  An archive that has
    changed since is an error.  Without new ones nothing changes.

    Off local mode ``out`` and ``spark.checkpoint.dir`` must be folders that all
    executors see; ``shared_files`` says that a ``file:`` path is one.
    """
    if extract_format not in ("zip", "table"):
        raise ValueError("extract_format must be 'zip' or 'table'")
    if not shared_files:
        require_shared(spark, out)
    if dialect not in regex.DIALECTS:
        raise ValueError(f"dialect must be one of {regex.DIALECTS}, not {dialect!r}")
    started, now = time.time(), datetime.now()
    loaded = load_definitions(definitions)
    require_valid(loaded)
    listed = {path.rsplit("/", 1)[-1]: (path, size, modified) for path, size, modified in
              states([path for path, _ in list_archives(archives)])}
    earlier, run, changed = None, None, []
    patterns = sorted([d.definition, d.pattern] for d in loaded.definitions)
    if append_to is None:
        run_dir = new_run_dir(out, now)
    else:
        earlier = _earlier(append_to)
        if earlier.definitions != patterns:
            raise ValueError(f"the definitions are not those of {append_to}")
        run_dir, run = earlier.run_dir, f"{earlier.runs + 1:05d}"
        changed = [listed[name][0] for name, known in earlier.archives.items()
                   if name in listed and listed[name][1:] != known]
        listed = {name: one for name, one in listed.items() if name not in earlier.archives}
        _sweep(spark, spark_path(run_dir), run)
    skip = json.dumps(sorted(earlier.archives)) if earlier else "[]"
    staging, target = _staging_dir(spark, run_dir), spark_path(run_dir)

    def place(name):
        return f"{target}/{name}" + (f"/run={run}" if run else "")

    def written(name, columns):
        rows = spark.read.option("recursiveFileLookup", True).schema(columns)
        return getattr(rows, "parquet" if name == "matches" else "json")(f"{target}/{name}")

    if earlier and not listed and not changed:
        return _result(spark, run_dir, written)
    native = dialect == "native"
    how = dict(dialect=dialect, search_binary=search_binary, redistribute=redistribute,
               max_payload_bytes=max_payload_bytes, chunk_matches=chunk_matches)

    def stage(records, number):
        _stage(records, loaded.definitions, f"{staging}/rows/pass={number}", **how)
        return spark.read.parquet(f"{staging}/rows")

    try:
        options = {"trailers": "true", "max_payload_bytes": max_payload_bytes, "skip": skip}
        splits = _settle(spark, archives, staging, stage, options,
                         _scan(spark, archives, split_bytes=split_bytes, **options))
        repaired = splits.select(F.max("passes")).first()[0] or 1
        staged = _valid(spark.read.parquet(f"{staging}/rows"), splits, repaired=repaired > 1)
        chunk = [field.split()[0] for field in CHUNK_SCHEMA.split(", ")]
        found = staged.where("definition is not null").withColumn("name", F.col("record_name")) \
            .select(*RECORD_KEY, "name", "payload_size", *chunk)
        if not native:
            found = found.unionByName(_large_records(
                spark, staged, loaded.definitions, search_binary, chunk_matches, window))
        # How much text there is only sizes the partitions of the reports.
        seen = Observation()
        found.withColumn("exportable", F.col("name").isNotNull()) \
            .observe(seen, _text_bytes().alias("text_bytes")).write.parquet(place("matches"))
        matches = spark.read.schema(MATCH_SCHEMA).parquet(place("matches"))

        created = F.lit(now.strftime(report.CREATED_FORMAT))
        headed = loaded.definitions_table(spark)
        lines = report.report_lines(matches, headed.limit(0) if run else headed, RECORD_KEY,
                                    F.col("archive"), created,
                                    _partitions(spark, seen.get["text_bytes"]))
        report.write_reports(lines, f"{target}/reports", run)

        failures = spark.createDataFrame([], zip_export.FAILURE_SCHEMA)
        if extract:
            before = written("matches", MATCH_SCHEMA).join(
                matches.select(*RECORD_KEY).distinct(), RECORD_KEY, "left_anti") if run else None
            winners, n = _winners(spark, matches.where("exportable"), f"{staging}/winners",
                                  zip_bytes, before)
            if extract_format == "zip":
                _export_zip(spark, winners, n, f"{target}/exports", run)
                failures = zip_export.read_failures(spark, f"{target}/exports")
            else:
                _export_table(winners, n, f"{target}/exports")

        counts = splits.where("after_stop = 0").groupBy("archive") \
            .agg(F.sum("records_read").alias("records_read"))
        problems = _problems(spark, staged, matches, counts, loaded if not run else
                             loaded._replace(rejected=[]), extract, failures, native, changed)
        problems.write.json(place("problems"))
        seconds = F.lit(time.time() - started)
        totals = summary.run_totals(counts, spark.read.schema(problems.schema).json(
            place("problems"))).select(
            F.lit(len(listed)).cast("bigint").alias("archives"), "records_read", "errors",
            "warnings", seconds.alias("elapsed_seconds"),
            text.elapsed_text(seconds).alias("elapsed"))
        totals.write.json(place("summary"))
        _commit(spark, run_dir, earlier.runs + 1 if earlier else 1, listed,
                None if earlier else patterns)
    finally:
        _delete(spark, staging)

    return _result(spark, run_dir, written)


def _commit(spark, run_dir, run, listed, definitions) -> None:
    """Note the archives of a run, and the definitions of the first."""
    rows = [{"run": run, "archive": name, "size": size, "modified": modified}
            for name, (_, size, modified) in listed.items()]
    rows.append({"run": run} if definitions is None else {"run": run, "definitions": definitions})
    filesystem, inner = resolve(f"{run_dir}/manifest")
    filesystem.create_dir(inner, recursive=True)
    attempt, final = f"{inner}/_run-{run:05d}.json", f"{inner}/part-{run:05d}.json"
    with filesystem.open_output_stream(attempt) as stream:
        stream.write("".join(json.dumps(row) + "\n" for row in rows).encode())
    filesystem.move(attempt, final)


def _result(spark, run_dir, written) -> SearchResult:
    """All matches and the totals of all runs."""
    totals = written("summary", SUMMARY_SCHEMA).agg(
        *[F.sum(c).alias(c) for c in ("archives", "records_read", "errors", "warnings",
                                      "elapsed_seconds")])
    return SearchResult(run_dir, written("matches", MATCH_SCHEMA), totals.withColumn(
        "elapsed", text.elapsed_text(F.col("elapsed_seconds"))))
