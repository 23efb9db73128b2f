"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source is a stream of documents in seeded order, dealt out over shards
and cut into blocks of equally many words.  Blocks are handed to the sources one by
one, always to the highest quotient target / (2 * blocks + 1), and those of a source
to its shards in the same way, so that quotas are whole blocks and a source as a whole
is within one of its target.  In a shard a source then gives the first blocks of its
stream, and goes round a second time if its quota asks for more than there is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import WORD, Scratch

SEED = 20240606
# Weights of the sources in code point order, over and over.
WEIGHTS = (5, 2, 1)
SHARE, LIMIT = 1.5, 2
BLOCK_WORDS = 32
# Words of a shard aimed at, and the least and greatest number of shards.
SHARD_WORDS = 200_000_000
MIN_SHARDS, MAX_SHARDS = 64, 65536
# Words of a source for each of its shards, at least: many blocks.
CELL_WORDS = 1 << 16
MAX_BROADCAST = 200_000


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE,
            limit: float = LIMIT) -> DataFrame:
    """``totals``: (source, source_size).  Adds ``target``: ``share`` of all
    sizes divided by weight, none above ``limit`` times its source.

    With level x, a source takes min(weight * x, limit * size).  The level that
    meets the goal is the highest of those that the sources capped first leave
    for the others.  One row per source, no documents.
    """
    everything = Window.partitionBy()
    named = totals.withColumn("weight", F.element_at(
        F.array(*map(F.lit, weights)),
        ((F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
         % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(limit))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    rest = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    goal = F.sum("source_size").over(everything) * share
    levels = named.withColumn("level", (goal - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                              / F.sum("weight").over(rest))
    level = F.max("level").over(everything)
    return levels.select("source", "source_size", F.greatest(F.lit(0.0), F.least(
        "cap", F.col("weight") * level)).alias("target"))


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients votes / (2 * seats + 1); equal quotients go to
    the earlier row.  A divisor that gives away no more than ``seats`` is found
    by halving, the few seats left go one by one."""
    votes = np.asarray(votes, float)
    got = np.zeros(len(votes), np.int64)
    if seats <= 0 or not (votes > 0).any():
        return got
    low, high = 0.0, 2 * votes.max() + 1
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if np.floor(votes / middle + 0.5).sum() > seats:
            low = middle
        else:
            high = middle
    got = np.floor(votes / high + 0.5).astype(np.int64)
    while got.sum() < seats:
        got[np.argmax(votes / (2 * got + 1))] += 1
    return got


def _seats(block: int):
    """Blocks for the sources: a row per source, no documents."""
    def deal(totals: pd.DataFrame) -> pd.DataFrame:
        totals = totals.sort_values("place", ignore_index=True)
        blocks = sainte_lague(totals["target"], round(totals["target"].sum() / block))
        return totals.assign(blocks=blocks)[["source", "source_size", "target", "shards", "blocks"]]

    return deal


def _quotas(block: int, limit: float):
    """Words for the shards of one source: a row per shard, no documents.  A source
    that gives all it may gives it everywhere."""
    def deal(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("shard", ignore_index=True)
        most = np.floor(limit * cells["cell_size"]).astype(np.int64)
        seats = sainte_lague(cells["cell_size"], int(cells["blocks"].iloc[0]))
        full = cells["target"].iloc[0] >= limit * cells["source_size"].iloc[0]
        return cells.assign(quota=most if full else np.minimum(seats * block, most))[
            ["source", "shard", "source_size", "target", "cell_size", "quota"]]

    return deal


def _overlap(low: Column, length: Column, until: Column) -> Column:
    return F.greatest(F.lit(0), F.least(length, until - low))


def mix_sizes(sized: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = SHARE,
              limit: float = LIMIT, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """``sized``: (doc_id, size, source, mark, ...).  Adds source_size, target
    and taken.  ``mark`` sets apart rows of one id in the seeded order; rows
    equal in both are interchangeable, so reruns agree."""
    totals = targets(sized.groupBy("source").agg(
        F.sum("size").alias("source_size")), weights, share, limit)
    kind = totals.schema["source"].dataType.simpleString()
    totals = scratch.save(totals, "targets")
    words = totals.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    shards = min(max(MIN_SHARDS, -(-words // SHARD_WORDS)), MAX_SHARDS)
    # A small source is in fewer shards, since each rounds to blocks.
    own_shards = F.least(F.lit(shards), F.greatest(
        F.lit(1), F.floor(F.col("source_size") / CELL_WORDS))).cast("int")
    totals = scratch.save(totals.select(
        "*", own_shards.alias("shards"),
        F.coalesce(F.xxhash64(F.lit(seed), "source"), F.lit(0)).alias("place"))
        .groupBy().applyInPandas(_seats(block), (
            f"source {kind}, source_size bigint, target double, shards int, blocks bigint")), "seats")
    few = totals.select(F.col("source").alias("of"), "shards")
    if totals.count() <= MAX_BROADCAST:
        few = F.broadcast(few)
    key = F.xxhash64(F.lit(seed), "doc_id", "mark")
    dealt = sized.withColumn("key", key).join(few, F.col("source").eqNullSafe(F.col("of"))) \
        .withColumn("shard", F.pmod("key", "shards").cast("int")).withColumn(
        "order", F.xxhash64(F.lit(seed + 1), "key")).drop("of", "shards")
    cells = dealt.groupBy("source", "shard").agg(F.sum("size").alias("cell_size"))
    votes = cells.join(totals.withColumnRenamed("source", "of"),
                       F.col("source").eqNullSafe(F.col("of"))).drop("of")
    quotas = votes.groupBy("source").applyInPandas(_quotas(block, limit), (
        f"source {kind}, shard int, source_size bigint, target double, cell_size bigint,"
        " quota bigint"))
    stream = Window.partitionBy("source", "shard").orderBy("order", "key", "doc_id", "size") \
        .rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("low", F.coalesce(F.sum("size").over(stream), F.lit(0)))
    quotas = quotas.select(F.col("source").alias("of"), F.col("shard").alias("at"),
                           "source_size", "target", "cell_size", "quota")
    joined = placed.join(quotas, F.col("source").eqNullSafe(F.col("of"))
                         & (F.col("shard") == F.col("at")))
    low, size, quota = F.col("low"), F.col("size"), F.col("quota")
    taken = _overlap(low, size, quota) + _overlap(low, size, quota - F.col("cell_size"))
    return joined.select(*sized.columns, "source_size", "target",
                         taken.cast("bigint").alias("taken"))


def _marks(documents: DataFrame) -> list[Column]:
    """Two hashes of all columns."""
    columns = [F.col(f"`{c}`") for c in documents.columns]
    return [F.xxhash64(F.lit(1), *columns).alias("mark"),
            F.xxhash64(F.lit(2), *columns).alias("check")]


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def mix_documents(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``documents``.

    Size is the number of words; a null or empty text has size 0, of which
    nothing is taken.  Null sources are one source, the last.  An empty table
    gives an empty one.
    """
    scratch = Scratch(documents.sparkSession, "mixing")
    sized = scratch.save(documents.select(
        "doc_id", word_count("text").alias("size"), "source", _marks(documents)[0]), "sizes")
    return mix_sizes(sized, scratch).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(documents: DataFrame) -> DataFrame:
    """``documents`` as the mix has them: each row as often as it is taken.

    Documents stay whole here: one of which the mix takes half or more of a
    copy beyond the last is copied once more, which touches at most one or two
    documents of a source in each shard.  Texts move once, to meet the number
    of their copies; rows are known by two hashes of all their columns.  Rows
    alike in every column are one row taken more often.
    """
    scratch = Scratch(documents.sparkSession, "mixing")
    columns = [F.col(f"`{c}`") for c in documents.columns]
    sized = scratch.save(documents.select(
        "doc_id", word_count("text").alias("size"), "source", *_marks(documents)), "sizes")
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    taken = mix_sizes(sized, scratch).where("size > 0").groupBy("mark", "check") \
        .agg(F.sum(copies).cast("int").alias("copies")).where("copies > 0")
    first = Window.partitionBy("mark", "check").orderBy("copies")
    return documents.select(*_marks(documents), F.struct(*columns).alias("row")) \
        .join(taken, ["mark", "check"]) \
        .withColumn("nth", F.row_number().over(first)).where("nth = 1") \
        .select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
