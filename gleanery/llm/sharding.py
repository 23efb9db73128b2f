"""Uniform sharding by a hypergeometric communication matrix.

Rows lie in partitions.  How many rows each partition sends to each shard is
drawn exactly as a uniform shuffle would have it (hypergeometric, with the
shard sizes given), every partition deals out its rows in a random order of
its own, the rows are exchanged, and every shard orders what it received at
random.  The result is a uniform random permutation cut into shards whose
sizes differ by one at most.

DataFrame functions only.  Nothing but the matrix (partitions times shards)
and one offset per shard and slot range is ever joined back; both are bounded
by ``MAX_PARTS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import Scratch, let

SEED = 20240607
# Rows of a partition aimed at, and the least and greatest number of partitions.
PART_ROWS = 1_000_000
MIN_PARTS, MAX_PARTS = 64, 4096


def unit(*keys: Column) -> Column:
    """A number in [0, 1) that the keys decide."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def hypergeometric(u: Column, good: Column, bad: Column, draws: Column) -> Column:
    """How many of ``draws`` balls, taken from ``good`` and ``bad`` ones without
    putting back, are good: the inverse of the distribution at ``u``.

    Starts at the mode and walks up, then down; the weights of neighbours are
    fractions of each other, so nothing overflows.  Beyond 12 standard
    deviations all weights are below double precision.
    """
    number = "double"

    def walk(s, steps, up, found):
        def ratio(k):
            if up:
                return (s.good - k) * (s.draws - k) / ((k + 1) * (s.bad - s.draws + k + 1))
            return k * (s.bad - s.draws + k) / ((s.good - k + 1) * (s.draws - k + 1))

        step = F.lit(1.0 if up else -1.0)
        numbers = F.when(steps >= 1, F.sequence(F.lit(1), steps.cast("int"))) \
            .otherwise(F.array().cast("array<int>"))

        def move(acc, _):
            weight = acc.weight * ratio(acc.k)
            return F.struct(
                (acc.k + step).alias("k"), weight.alias("weight"),
                (acc.left - weight).alias("left"),
                F.when(acc.found.isNull() & (acc.left < weight), acc.k + step)
                .otherwise(acc.found).alias("found"))

        start = F.struct(s.mode.alias("k"), F.lit(1.0).alias("weight"), found.alias("left"),
                         F.lit(None).cast(number).alias("found"))
        return F.aggregate(numbers, start, move)

    total = good + bad
    low, high = F.greatest(F.lit(0.0), draws - bad), F.least(draws, good)
    spread = F.sqrt(draws * good / total * bad / total * (total - draws)
                    / F.greatest(total - 1, F.lit(1.0)))
    args = F.struct(
        u.alias("u"), good.alias("good"), bad.alias("bad"), draws.alias("draws"),
        low.alias("low"), high.alias("high"), (F.ceil(spread * 12) + 24).alias("reach"),
        F.greatest(low, F.least(high, F.floor((draws + 1) * (good + 1) / (total + 2))
                                .cast(number))).alias("mode"))

    def draw(s):
        ups, downs = F.least(s.high - s.mode, s.reach), F.least(s.mode - s.low, s.reach)
        # What the walks leave of 0 is minus the sum of their weights.
        sums = F.struct((-walk(s, ups, True, F.lit(0.0)).left).alias("up"),
                        (-walk(s, downs, False, F.lit(0.0)).left).alias("down"))

        def pick(t):
            goal = s.u * (1 + t.up + t.down) - 1
            above = F.coalesce(walk(s, ups, True, goal).found, s.mode + ups)
            below = F.coalesce(walk(s, downs, False, goal - t.up).found, s.mode - downs)
            return F.when(goal < 0, s.mode).when(goal < t.up, above).otherwise(below)

        return let(sums, pick)

    return F.when((draws <= 0) | (good <= 0), F.lit(0.0)).when(bad <= 0, draws) \
        .otherwise(let(args, draw))


def communication_matrix(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """``counts``: (part, n) for parts 0, 1, ...  Rows (part, until): how many of
    its rows the part sends to shard 0, to shards 0 and 1, and so on."""
    number = "double"
    sizes = counts.agg(
        F.sort_array(F.collect_list(F.struct("part", F.col("n").cast(number).alias("n"))))
        .alias("parts"), F.sum("n").alias("total"))

    def share(acc, part):
        """What one part sends to each shard; ``acc.room`` is left in the shards."""
        def deal(inner, j):
            room = F.element_at(acc.room, j + 1)
            n = hypergeometric(unit(F.lit(seed), part.part, j), room, inner.others - room,
                               inner.draws)
            return let(n, lambda x: F.struct(
                (inner.draws - x).alias("draws"), (inner.others - room).alias("others"),
                F.concat(inner.sent, F.array(x)).alias("sent")))

        start = F.struct(part.n.alias("draws"), acc.others.alias("others"),
                         F.array().cast("array<double>").alias("sent"))
        dealt = F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), start, deal)
        return let(dealt.sent, lambda sent: F.struct(
            F.zip_with(acc.room, sent, lambda r, x: r - x).alias("room"),
            (acc.others - part.n).alias("others"),
            F.concat(acc.rows, F.array(F.struct(part.part.alias("part"), sent.alias("sent"))))
            .alias("rows")))

    room = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: (
        F.floor(F.col("total") / shards) + F.when(j < F.col("total") % shards, 1).otherwise(0))
        .cast(number))
    start = F.struct(room.alias("room"), F.col("total").cast(number).alias("others"),
                     F.array().cast("array<struct<part:int,sent:array<double>>>").alias("rows"))
    drawn = sizes.where("total > 0").select(
        F.inline(F.aggregate("parts", start, share).rows))
    until = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda j: F.aggregate(
        F.slice("sent", 1, j), F.lit(0.0), lambda a, x: a + x).cast("bigint"))
    return drawn.select("part", until.alias("until"))


def shard_rows(frame: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """``frame`` with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... in each
    shard): a uniform random deal with shard sizes at most one apart.

    Columns of these names are replaced.  Nulls, repeated rows and empty texts
    are rows like any other; an empty table gives an empty one.  The deal
    follows from the seed and the place of a row in the table first written,
    so equal rows are dealt apart, and a row that a third of the table repeats
    is no key of any shuffle.
    """
    spark = frame.sparkSession
    scratch = Scratch(spark, "sharding")
    carried = [c for c in frame.columns if c not in ("shard", "slot")]
    inner = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)]
    rows = scratch.save(frame.select(
        *inner, F.monotonically_increasing_id().alias("place")), "rows")
    parts, total = MIN_PARTS, rows.count()
    while parts < MAX_PARTS and parts * PART_ROWS < total:
        parts *= 2
    # Rows are dealt to equal partitions by their place.
    placed = rows.withColumn(
        "part", F.pmod(F.xxhash64(F.lit(seed), "place"), F.lit(parts)).cast("int"))
    counts = spark.range(parts).select(F.col("id").cast("int").alias("part")).join(
        placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "part", "left") \
        .select("part", F.coalesce("n", F.lit(0)).alias("n"))
    matrix = scratch.save(communication_matrix(counts, shards, seed), "matrix")

    # Permute within the partition: the first rows of its order go to shard 0, ...
    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed + 1), "place"), "place")
    dealt = placed.withColumn("turn", F.row_number().over(local) - 1) \
        .join(F.broadcast(matrix), "part") \
        .withColumn("shard", F.size(F.filter("until", lambda c: c <= F.col("turn"))))
    # Exchange, and permute within the shard, in ranges of the random order.
    order = F.xxhash64(F.lit(seed + 2), "place")
    ranged = dealt.withColumn("order", order).withColumn(
        "range", F.shiftrightunsigned("order", 64 - (parts.bit_length() - 1)).cast("int")) \
        .select(*[f"c{i}" for i in range(len(carried))], "place", "shard", "order", "range")
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    offsets = scratch.save(offsets, "offsets")
    within = Window.partitionBy("shard", "range").orderBy(
        F.shiftrightunsigned("order", 1), "order", "place")
    return ranged.withColumn("turn", F.row_number().over(within) - 1) \
        .join(F.broadcast(offsets), ["shard", "range"]) \
        .select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)],
                F.col("shard").cast("int").alias("shard"),
                (F.col("offset") + F.col("turn")).cast("bigint").alias("slot"))


def shard_documents(documents: DataFrame, shards: int = 8, seed: int = SEED) -> DataFrame:
    """Manifest of ``documents`` dealt out under the law ``rows``: doc_id, size,
    text_crc32, law, shard, slot, grown_shard (null: another number of shards
    is another deal).  A null text has no bytes, so size 1 and checksum 0.
    Texts stay where they are; ids and digests are what moves.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    narrow = documents.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
                              F.crc32(text).alias("text_crc32"))
    return shard_rows(narrow, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
