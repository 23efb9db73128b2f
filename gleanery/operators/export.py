"""Which matched records are exported, and under which entry name."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text

ENTRY_KEY = ("definition", "entry_name")


def entries(pairs: DataFrame) -> DataFrame:
    """Pairs with the entry name of their record; nameless records have none."""
    return pairs.withColumn("entry_name", text.entry_name(F.col("name"))) \
        .where(F.col("entry_name").isNotNull())


def first_per_entry(rows: DataFrame, order: Sequence[str],
                    key: Sequence[str] = ENTRY_KEY) -> DataFrame:
    """``key`` and ``order`` of the first row of every entry.

    A minimum, not a window: it is combined before the shuffle, so an entry
    that a third of all records share costs one row per task.  Only keys take
    part; join wide columns back with ``order``, which must identify a row.
    """
    first = rows.groupBy(*key).agg(F.min(F.struct(*order)).alias("first"))
    return first.select(*key, "first.*")


def merge_exports(parts: Sequence[DataFrame], order: Sequence[str] = ()) -> DataFrame:
    """Union of exports, one row per entry; the earliest part that has an entry
    supplies it.

    ``order`` decides within a part that holds an entry more than once (nulls
    first), then a hash of the row.  Each part is read once and each row moves
    once, after those of its task have been compared.  No parts: an empty table
    of the key columns.
    """
    if not parts:
        spark = SparkSession.active()
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in ENTRY_KEY))
    numbered = [part.withColumn("part", F.lit(i)) for i, part in enumerate(parts)]
    union = reduce(DataFrame.unionByName, numbered)
    columns = [c for c in union.columns if c not in (*ENTRY_KEY, "part")]
    row = F.struct(*columns) if columns else F.struct(F.lit(0).alias("none"))
    position = F.struct("part", *order, F.xxhash64(*ENTRY_KEY, *columns).alias("hash"))
    first = union.groupBy(*ENTRY_KEY).agg(F.min_by(row, position).alias("first"))
    return first.select(*ENTRY_KEY, *[F.col(f"first.`{c}`").alias(c) for c in columns])
