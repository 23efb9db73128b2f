"""Records joined with a table of definitions, on the patterns matching.

A definition that is a row, not a literal of the plan, may be one of very many.  Each
is indexed by grams of its required literals: one gram of every literal of which a
match must contain one.  Records and definitions that share a gram are candidates, and
these alone are verified by the pattern.  Of the grams of a literal that one counts
that the fewest definitions have, so that a beginning they all share joins nothing.

Which grams there are is told to the scan by a bit map, so hardly any but grams of some
definition leave it, and a gram is an equi-join key.  Definitions without a
literal of ``SHORT`` bytes may match any record; they are apart, in chunks, and a
record meets each chunk by its number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.regex import (
    FOLDS_TO_ASCII, compiled, rejection, required_literals)

# Bytes of a gram: the longest of these that a literal has.  Short ones are shared by
# more definitions the more there are.
LONGEST, LONG, SHORT = 12, 6, 3
WIDTHS = (LONGEST, LONG, SHORT)
# The map of grams that every task has is of 2^24 bits, 2 MB, or of so many bits for a
# gram if that is more, up to 2^30 bits, 128 MB.
GRAM_BITS, LEAST_BITS, MOST_BITS = 128, 24, 30
# Definitions of a chunk, be they apart or candidates of one record.
CHUNK = 500
# Patterns that a task remembers.
REMEMBERED = 4096
# Broadcast grams up to so many rows, of less than 100 bytes each.
MAX_BROADCAST = 200_000


def _grams(data: np.ndarray, width: int) -> np.ndarray:
    """Every run of ``width`` bytes as a number that tells its width too; one of
    ``LONGEST`` is a hash."""
    n = len(data) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    if width == LONGEST:
        half = _grams(data, LONG).astype(np.uint64)
        mixed = half[:n] * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) + half[LONG:] * np.uint64(0xBF58476D1CE4E5B9)
        return ((mixed >> np.uint64(2)) | np.uint64(1 << 62)).astype(np.int64)
    total = np.full(n, width, np.int64)
    for i in range(width):
        total = (total << 8) | data[i:n + i]
    return total


def _places(grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits that each gram sets in a map of 2^``bits``."""
    mixed = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    other = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return tuple((m >> np.uint64(64 - bits)).astype(np.int64) for m in (mixed, other))


def _folded(value: str) -> str:
    """Lower case in which every character is ASCII that matches an ASCII one."""
    if not value.isascii():
        for odd, plain in zip(FOLDS_TO_ASCII, "iis"):
            value = value.replace(odd, plain)
    return value.lower()


def _indexed(batches):
    """A row per gram of each literal of a definition; without a gram if it has a
    literal too short for one, or none."""
    for batch in batches:
        rows = []
        for definition, pattern in zip(*(batch.column(c).to_pylist()
                                         for c in ("definition", "pattern"))):
            if pattern is None or rejection(pattern) is not None:
                continue
            literals = required_literals(pattern)
            if not literals or min(map(len, literals)) < SHORT:
                rows.append((definition, pattern, None, None))
                continue
            for number, literal in enumerate(literals):
                data = np.frombuffer(literal.encode(), np.uint8)
                width = next(w for w in WIDTHS if len(data) >= w)
                rows += [(definition, pattern, number, int(gram))
                         for gram in np.unique(_grams(data, width))]
        columns = list(zip(*rows)) if rows else [()] * 4
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            ["definition", "pattern", "literal", "gram"])


def _map(spark, grams: DataFrame, number: int):
    """The bit map of so many grams and its bits' logarithm, for the tasks."""
    bits = min(max((max(number, 1) * GRAM_BITS - 1).bit_length(), LEAST_BITS), MOST_BITS)

    def places(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(
                _places(batch.column("gram").to_numpy(), bits)))], ["bit"])

    # At most two rows for a gram, each 64 bits of the map.
    rows = grams.mapInArrow(places, "bit bigint").groupBy(F.shiftright("bit", 6).alias("word")) \
        .agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return spark.sparkContext.broadcast((words.view(np.uint8), bits))


def _found(shared):
    """The grams on the map that a record has in its name or text, each once."""
    def run(batches):
        bitmap, bits = shared.value

        def grams_of(value):
            if value is None:
                return
            data = np.frombuffer(_folded(value).encode("utf-8", "surrogatepass"), np.uint8)
            for width in WIDTHS:
                for low in range(0, len(data), 1 << 20):
                    grams = _grams(data[low:low + (1 << 20) + width - 1], width)
                    for which in (0, 1):
                        bit = _places(grams, bits)[which]
                        grams = grams[bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 > 0]
                    yield grams

        for batch in batches:
            owners, grams = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for at, values in enumerate(zip(*(batch.column(c).to_pylist()
                                              for c in ("name", "text")))):
                found = [g for value in values for g in grams_of(value) if len(g)]
                if found:
                    grams.append(np.unique(np.concatenate(found)))
                    owners.append(np.full(len(grams[-1]), at))
            yield pa.RecordBatch.from_arrays(
                [batch.column("mark").take(pa.array(np.concatenate(owners))),
                 pa.array(np.concatenate(grams))], ["mark", "gram"])

    return run


def _verified(batches):
    """The definitions of each row's list that match its name or text.  Lists change from
    row to row, so patterns are parsed once for many and compiled when they are tried."""
    literals, patterns = {}, {}

    def remembered(known, make, pattern):
        if pattern not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[pattern] = make(pattern)
        return known[pattern]

    def occurs(pattern, value, folded):
        needed = remembered(literals, required_literals, pattern)
        return (not needed or any(one in folded for one in needed)) \
            and remembered(patterns, compiled, pattern).search(value) is not None

    for batch in batches:
        marks, found = [], []
        for mark, name, text, some in zip(*(batch.column(c) for c in (
                "mark", "name", "text", "definitions"))):
            values = [(value, _folded(value)) for value in (name.as_py(), text.as_py())
                      if value is not None]
            names = [d["definition"] for d in some.as_py()
                     if any(occurs(d["pattern"], *value) for value in values)]
            marks += [mark.as_py()] * len(names)
            found += names
        yield pa.RecordBatch.from_arrays(
            [pa.array(marks, pa.binary()), pa.array(found, pa.string())], ["mark", "definition"])


def _kept(rows: DataFrame) -> DataFrame:
    """The rows, made once for all that is done with them."""
    if rows.sparkSession.sparkContext.getCheckpointDir():
        return rows.checkpoint()
    return rows.localCheckpoint()


def join_patterns(prepared: DataFrame, keys: list[str], definitions: DataFrame) -> DataFrame:
    """``keys`` and ``definition`` of every record and definition that match, like
    ``search.matching_definitions``; ``definitions`` is a table (definition, pattern).

    Patterns that are null or invalid match nothing.  Definitions of one name are one,
    and match where any of their patterns does.  Records that are equal in name and
    text are searched once.
    """
    spark = prepared.sparkSession
    # Patterns are parsed one by one; by their bytes they would go to a single task.
    indexed = definitions.select(F.col("definition").cast("string").alias("definition"),
                                 F.col("pattern").cast("string").alias("pattern")).distinct() \
        .repartition(spark.sparkContext.defaultParallelism, "definition", "pattern") \
        .mapInArrow(_indexed, "definition string, pattern string, literal int, gram bigint") \
        .persist()
    try:
        held = indexed.where("gram is not null").groupBy("gram") \
            .agg(F.count(F.lit(1)).alias("held"))
        chosen = _kept(
            indexed.where("gram is not null").join(held, "gram")
            .groupBy("definition", "pattern", "literal")
            .agg(F.min(F.struct("held", F.xxhash64("gram"), "gram")).alias("best"))
            .select("definition", "pattern", F.col("best.gram").alias("gram")))
        apart = _kept(indexed.where("gram is null").select("definition", "pattern").distinct())
    finally:
        indexed.unpersist()
    number = chosen.count()
    shared = _map(spark, chosen.select("gram"), number)
    few = chosen if number > MAX_BROADCAST else F.broadcast(chosen)
    chunks = -(-apart.count() // CHUNK)

    def part(value):
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value),
                          F.lit("-"))

    marked = prepared.select(*keys, "name", "text", F.unhex(F.md5(F.encode(
        F.concat(part("name"), part("text")), "UTF-8"))).alias("mark"))
    seen = marked.select("mark", "name", "text").mapInArrow(_found(shared), "mark binary, gram bigint") \
        .distinct()

    def listed(rows, *by):
        return rows.groupBy(*by).agg(F.collect_set(F.struct("definition", "pattern"))
                                     .alias("definitions"))

    # A record that has very many candidates is verified in parts.
    pairs = seen.join(few, "gram").select("mark", "definition", "pattern").distinct()
    parts = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("mark")) / CHUNK)
    piece = F.pmod(F.xxhash64("definition", "pattern"), parts)
    candidates = listed(pairs.withColumn("piece", piece), "mark", "piece").drop("piece")

    lists = candidates
    if chunks:
        # Marks with each chunk of the definitions apart, by its number.
        place = F.pmod(F.xxhash64("definition", "pattern"), F.lit(chunks))
        chunked = listed(apart.withColumn("chunk", place), "chunk")
        numbered = marked.select("mark").distinct().withColumn("chunk", F.explode(
            F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint"))))
        lists = lists.unionByName(numbered.join(chunked, "chunk").select("mark", "definitions"))
    texts = marked.groupBy("mark").agg(F.first("name").alias("name"), F.first("text").alias("text"))
    found = texts.join(lists, "mark").select("mark", "name", "text", "definitions") \
        .mapInArrow(_verified, "mark binary, definition string").distinct()
    return marked.select(*keys, "mark").join(found, "mark").select(*keys, "definition")
