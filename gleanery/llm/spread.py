"""Joins, ranks and running sums that no single key can make uneven."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import Scratch

# A key is heavy if it has more than this part of all rows, so there are no more
# heavy keys than this.
HEAVY = 10_000
# Bits of a row's number that count within its partition, as Spark has them.
WITHIN = 33


def join_by_weight(rows: DataFrame, keyed: DataFrame, keys: list[str], weight: str,
                   total: int) -> DataFrame:
    """``rows`` inner-joined with ``keyed``, whose ``keys`` are unique and whose
    ``weight`` says how many of the ``total`` rows have them.

    Heavy keys, which are few whatever the tables hold, are broadcast; among the
    others none has a large part of the rows.
    """
    heavy = keyed.where(F.col(weight) * F.lit(HEAVY) > F.lit(total))
    light = keyed.where(F.col(weight) * F.lit(HEAVY) <= F.lit(total))
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(heavy), keys).unionByName(rest.join(light, keys))


def running(rows: DataFrame, key: str, order: str, band: str, columns: list[str],
            total: Callable[[str], Column], start: int) -> DataFrame:
    """``rows`` with, for each of ``columns``, ``<column>_before``: its ``total`` (sum
    or bit_xor) over the rows of the same ``key`` that come before in ``order``.

    ``band`` numbers bounded runs of a key's rows in that order.  Rows are totalled
    within their band, and only the totals of bands in a window over the key.
    """
    def combined(first: str, second: str) -> Column:
        one, two = F.coalesce(first, F.lit(start)), F.coalesce(second, F.lit(start))
        return one.bitwiseXOR(two) if total is F.bit_xor else one + two

    before = (Window.unboundedPreceding, -1)
    own = Window.partitionBy(key, band).orderBy(order).rowsBetween(*before)
    across = Window.partitionBy(key).orderBy(band).rowsBetween(*before)
    bands = rows.groupBy(key, band).agg(*[total(c).alias(f"{c}_band") for c in columns])
    bands = bands.select(key, band, *[total(f"{c}_band").over(across).alias(f"{c}_above")
                                      for c in columns])
    placed = rows.select("*", *[total(c).over(own).alias(f"{c}_own") for c in columns])
    kept = [F.col(c) for c in rows.columns]
    return placed.join(bands, [key, band]).select(*kept, *[
        combined(f"{c}_own", f"{c}_above").cast("bigint").alias(f"{c}_before") for c in columns])


def ranked(rows: DataFrame, order: list, scratch: Scratch, name: str) -> DataFrame:
    """``rows``, written in ``order``, with their rank ``at`` (bigint, from 0).

    Rows are dealt by range; a rank is the rank within the partition and what the
    partitions before it hold, a table with a row per partition.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = scratch.save(dealt.withColumn("_seq", F.monotonically_increasing_id()), name)
    part = F.shiftright("_seq", WITHIN)
    starts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.col("_seq").bitwiseAND((1 << WITHIN) - 1)
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part") \
        .withColumn("at", within + F.col("_before")).drop("_part", "_seq", "_before")


def groups_of(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.RecordBatch]:
    """The runs of rows with equal integer ``keys``, each as one batch; for groups
    of bounded size in sorted partitions."""
    kept = []
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        if len(kept) > 1:
            batch = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
        changed = np.zeros(batch.num_rows - 1, bool)
        for key in keys:
            values = batch.column(key).to_numpy(zero_copy_only=False)
            changed |= values[1:] != values[:-1]
        low = 0
        for high in np.flatnonzero(changed) + 1:
            yield batch.slice(low, high - low)
            low = high
        kept = [batch.slice(low)]
    yield from kept
