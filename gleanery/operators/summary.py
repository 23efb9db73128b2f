"""Counts over a run: records read, archives without any, errors, warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def record_counts(records: DataFrame, archive: str = "archive") -> DataFrame:
    """Number of records read per archive."""
    return records.groupBy(archive).agg(F.count(F.lit(1)).alias("records_read"))


def archives_without_records(archives: DataFrame, records: DataFrame,
                             archive: str = "archive") -> DataFrame:
    """Archives of which no record was read."""
    return archives.join(records.select(archive).distinct(), archive, "left_anti")


def problems(*parts: tuple[str, DataFrame, str, str]) -> DataFrame:
    """One table of all problems from (severity, rows, subject, message) parts."""
    tables = [rows.select(F.lit(severity).alias("severity"),
                          F.expr(subject).cast("string").alias("subject"),
                          F.expr(message).cast("string").alias("message"))
              for severity, rows, subject, message in parts]
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table)
    return result


def run_totals(counts: DataFrame, found: DataFrame) -> DataFrame:
    """Records read, errors and warnings of a run, always one row."""
    rows = counts.select(F.lit("read").alias("kind"), F.col("records_read").alias("n")) \
        .unionByName(found.select(F.col("severity").alias("kind"), F.lit(1).alias("n")))

    def of(kind):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))

    return rows.agg(of("read").alias("records_read"), of("error").alias("errors"),
                    of("warning").alias("warnings"))
