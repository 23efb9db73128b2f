"""Text reports: one per definition, a header and one block per record.

The texts below are fixed values of the report format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text
from gleanery.operators import matches as match_tables
from gleanery.operators.search import SCOPE_CONTENTS, SCOPE_NAME

RULE = "_" * 67
HEADER = "[{report}]\n[Created: {created}]\n\n[Regex used]\n{pattern}\n\n" + RULE + "\n\n"
RECORD = "[Archive: {archive}]\n[File: {name}]\n\n"
COUNT = "[Matches found in {scope}: {total} ({duplicates} duplicates omitted)]\n"
MATCH = '[Match #{item} in {scope}]\n\n"{match}"\n\n'
CREATED_FORMAT = "%Y.%m.%d %H:%M:%S"


def fill(template: str, **values: Column) -> Column:
    """``template`` with its ``{fields}`` replaced by columns."""
    parts, rest = [], template
    while rest:
        literal, _, rest = rest.partition("{")
        if literal:
            parts.append(F.lit(literal))
        if rest:
            field, _, rest = rest.partition("}")
            parts.append(F.coalesce(values[field].cast("string"), F.lit("")))
    return F.concat(*parts)


def scope_section(matches: Column, scope: str) -> Column:
    """Count line and numbered distinct matches; empty if there is no match."""
    unique = F.array_distinct(matches)
    items = F.transform(unique, lambda match, i: fill(
        MATCH, item=i + 1, scope=F.lit(scope), match=match))
    count = fill(COUNT, scope=F.lit(scope), total=F.size(matches),
                 duplicates=F.size(matches) - F.size(unique))
    return F.when(F.size(matches) > 0, F.concat(count, F.array_join(items, ""))) \
        .otherwise(F.lit(""))


def record_block(archive: Column, name: Column, name_matches: Column,
                 content_matches: Column) -> Column:
    """The report text of one record and definition."""
    return F.concat(fill(RECORD, archive=archive, name=name),
                    scope_section(name_matches, SCOPE_NAME),
                    scope_section(content_matches, SCOPE_CONTENTS),
                    F.lit(RULE + "\n\n"))


def report_header(definition: Column, pattern: Column, created: Column) -> Column:
    return fill(HEADER, report=text.report_name(definition), created=created, pattern=pattern)


def _chunked_lines(chunks: DataFrame, order: list[str], archive: Column) -> DataFrame:
    """The blocks of pairs in several chunks, a row for each piece: heading, the
    count and the items of each scope, rule.  ``section`` and ``item`` order them."""
    pairs = chunks.where("chunk = 0").select("definition", *order, archive.alias("in_archive"),
                                             "name")
    kept = chunks.select("definition", *order, archive.alias("in_archive"), "name", "chunk",
                         "whole", "name_matches", "content_matches")
    place = ["definition", *order]

    def piece(section: Column, item: Column, value: Column) -> list[Column]:
        return [*place, section.cast("int").alias("section"), item.cast("bigint").alias("item"),
                value.alias("piece")]

    scope = F.when(F.col("scope") == SCOPE_NAME, 1).otherwise(2)
    zero = F.lit(0)
    heading = pairs.select(*piece(zero, zero, fill(
        RECORD, archive=F.col("in_archive"), name=F.col("name"))))
    counts = match_tables.chunk_totals(kept).select(*piece(scope, zero, fill(
        COUNT, scope=F.col("scope"), total=F.col("total"), duplicates=F.col("duplicates"))))
    items = match_tables.chunk_items(kept).select(*piece(scope, F.col("item"), fill(
        MATCH, item=F.col("item"), scope=F.col("scope"), match=F.col("match"))))
    rule = pairs.select(*piece(F.lit(3), zero, F.lit(RULE + "\n\n")))
    return heading.unionByName(counts).unionByName(items).unionByName(rule)


def report_lines(pairs: DataFrame, definitions: DataFrame, order: list[str], archive: Column,
                 created: Column, partitions: int | None = None) -> DataFrame:
    """All reports as (``report``, ``value``), range-partitioned in report order.

    Ranges and not a hash of the definition, so that the report of a definition
    that matches a third of all records is spread over many tasks.  The text is
    put together after the shuffle, which moves the matches only.  Pairs may be
    chunks; those of several are put out piece by piece.

    ``pairs`` should be a stored table: finding the ranges samples it, which
    would otherwise run the search once more.
    """
    report = F.coalesce(text.report_name(F.col("definition")), F.lit(""))
    single = pairs
    chunked = "whole" in pairs.columns and not pairs.where("not whole").isEmpty()
    if chunked:
        single = pairs.where("whole")
    body = single.select(report.alias("report"), *order, archive.alias("in_archive"), "name",
                         "name_matches", "content_matches",
                         F.lit(None).cast("string").alias("header"))
    header = definitions.select(report.alias("report"), report_header(
        F.col("definition"), F.col("pattern"), created).alias("header"))
    rows = body.unionByName(header, allowMissingColumns=True)
    position = ["report", *[F.col(c).asc_nulls_first() for c in order]]
    if chunked:
        pieces = _chunked_lines(pairs.where("not whole"), order, archive).select(
            report.alias("report"), *order, "section", "item", F.col("piece").alias("header"))
        rows = rows.unionByName(pieces, allowMissingColumns=True)
        position += ["section", "item"]
    by = position if partitions is None else [partitions, *position]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*position)
    block = F.coalesce("header", record_block(
        F.col("in_archive"), F.col("name"), F.col("name_matches"), F.col("content_matches")))
    # The text sink ends every value with a line feed of its own.
    return ordered.select("report", F.regexp_replace(block, r"\n\z", "").alias("value"))


def write_reports(lines: DataFrame, path: str, run: str | None = None) -> None:
    """One directory ``report=<name>`` per report; its parts, in name order, are the
    report.  What a later ``run`` appends is in a directory of its own, that comes
    behind the parts there are."""
    if run is not None:
        lines = lines.withColumn("run", F.lit(run))
    by = ["report"] if run is None else ["report", "run"]
    lines.write.mode("append").partitionBy(*by).text(path)
