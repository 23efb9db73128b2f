"""Counts, distinct matches and numbering over the pairs of a search.

``match_counts`` and ``match_items`` work on the match arrays of one row, so they
shuffle nothing.  ``chunk_totals`` and ``chunk_items`` do the same for matches in
chunks (``search_chunks``): pairs of one chunk as above, and those of several by
distributed steps none of which gathers a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.search import SCOPE_CONTENTS, SCOPE_NAME


def by_scope(pairs: DataFrame) -> DataFrame:
    """One row per pair and scope that has a match, with its ``matches``."""
    kept = [c for c in pairs.columns if c not in ("name_matches", "content_matches")]
    scopes = F.inline(F.array(
        F.struct(F.lit(SCOPE_NAME).alias("scope"), F.col("name_matches").alias("matches")),
        F.struct(F.lit(SCOPE_CONTENTS).alias("scope"),
                 F.col("content_matches").alias("matches"))))
    return pairs.select(*kept, scopes).where(F.size("matches") > 0)


def total(matches: Column) -> Column:
    return F.size(matches)


def unique(matches: Column) -> Column:
    """Distinct texts in order of first occurrence; case counts."""
    return F.array_distinct(matches)


def duplicates(matches: Column) -> Column:
    return F.size(matches) - F.size(F.array_distinct(matches))


def match_counts(pairs: DataFrame) -> DataFrame:
    """Totals, distinct texts and omitted duplicates per pair and scope."""
    scoped = by_scope(pairs)
    m = F.col("matches")
    kept = [c for c in scoped.columns if c != "matches"]
    return scoped.select(*kept, total(m).alias("total"), unique(m).alias("unique"),
                         duplicates(m).alias("duplicates"))


def match_items(pairs: DataFrame) -> DataFrame:
    """The distinct matches of every pair and scope, numbered from 1."""
    scoped = by_scope(pairs)
    kept = [c for c in scoped.columns if c != "matches"]
    return scoped.select(*kept, F.posexplode(unique(F.col("matches"))).alias("pos", "match")) \
        .select(*kept, (F.col("pos") + 1).alias("item"), "match")


_CHUNK = ("chunk", "whole", "name_matches", "content_matches")


def _pair_columns(chunks: DataFrame) -> list[str]:
    return [*[c for c in chunks.columns if c not in _CHUNK], "scope"]


def _first_spots(parts: DataFrame, pair: list[str]) -> DataFrame:
    """The distinct matches of pairs in several chunks, each with the chunk and the
    place in it at which it comes first.  Minima, combined before the shuffle."""
    spots = by_scope(parts).select(*pair, "chunk", F.posexplode("matches").alias("pos", "match"))
    return spots.groupBy(*pair, "match").agg(F.min(F.struct("chunk", "pos")).alias("spot")) \
        .select(*pair, "match", "spot.chunk", "spot.pos")


def _numbered(firsts: DataFrame, pair: list[str]) -> DataFrame:
    """First spots with their number ``item`` in the pair: the number within their
    chunk, which is bounded, and what the chunks before it hold, a short row each."""
    same = [F.col(f"placed.{c}").eqNullSafe(F.col(f"counted.{c}")) for c in (*pair, "chunk")]
    counts = firsts.groupBy(*pair, "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*pair).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*pair, "chunk", F.coalesce(F.sum("n").over(before), F.lit(0))
                           .alias("before"))
    within = Window.partitionBy(*pair, "chunk").orderBy("pos")
    placed = firsts.withColumn("within", F.row_number().over(within)).alias("placed")
    return placed.join(counts.alias("counted"), same).select(
        *[F.col(f"placed.{c}") for c in pair],
        (F.col("before") + F.col("within")).alias("item"), "match")


def chunk_items(chunks: DataFrame) -> DataFrame:
    """The distinct matches of every pair and scope, numbered from 1 in order of
    their first place in all chunks."""
    pair = _pair_columns(chunks)
    single = match_items(chunks.where("whole").drop("chunk", "whole"))
    firsts = _first_spots(chunks.where("not whole"), pair)
    return single.select(*pair, F.col("item").cast("bigint").alias("item"), "match") \
        .unionByName(_numbered(firsts, pair))


def chunk_totals(chunks: DataFrame) -> DataFrame:
    """Totals, numbers of distinct texts and omitted duplicates per pair and scope."""
    pair = _pair_columns(chunks)
    single = match_counts(chunks.where("whole").drop("chunk", "whole")).select(
        *pair, F.col("total").cast("bigint").alias("total"),
        F.size("unique").cast("bigint").alias("uniques"))
    parts = chunks.where("not whole")
    none = F.lit(0).cast("bigint")
    totals = by_scope(parts).select(*pair, F.size("matches").cast("bigint").alias("total"),
                                    none.alias("uniques"))
    distinct = _first_spots(parts, pair).select(*pair, none.alias("total"),
                                                F.lit(1).cast("bigint").alias("uniques"))
    summed = totals.unionByName(distinct).groupBy(*pair).agg(
        F.sum("total").alias("total"), F.sum("uniques").alias("uniques"))
    return single.unionByName(summed).withColumn(
        "duplicates", F.col("total") - F.col("uniques"))
